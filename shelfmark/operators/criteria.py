"""Criteria search: a mapping of field path to wanted value, compiled to one predicate.

The shape of the value chooses the clause, in this order: null (value missing),
a string with ``*`` (wildcard), an object with ``range``, a list (any of), and
everything else (equality). All clauses must hold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.schema import (
    BOOLEAN,
    DATE,
    INTEGER,
    KEYWORD,
    LONG,
    NUMERIC,
    TEXT,
    TEXT_KEYWORD,
    CatalogSchema,
    Path,
)

# The parameters of the ranking formula.
K1, B = 1.2, 0.75

Predicate = Callable[[DataFrame], Column]


def nothing() -> Column:
    return F.lit(False)


def everything() -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Clause:
    """One compiled criterion: its predicate and whether it adds to the score."""

    field: str
    predicate: Column
    scoring: bool
    idf: bool = False
    #: Tokens of a text field and the one asked for: its frequency and the length count too.
    tokens: Column | None = None
    asked: Any = None


def validate_criteria(criteria: Mapping[str, Any]) -> None:
    if not isinstance(criteria, Mapping) or not criteria:
        raise ValueError("Criteria parameter is required and must be a non-empty object")


def clauses(
    criteria: Mapping[str, Any], schema: CatalogSchema, honor_field_kinds: bool = True
) -> list[Clause]:
    validate_criteria(criteria)
    return [_clause(name, value, schema, honor_field_kinds) for name, value in criteria.items()]


def predicate(
    criteria: Mapping[str, Any], schema: CatalogSchema, honor_field_kinds: bool = True
) -> Column:
    return reduce(and_, [c.predicate for c in clauses(criteria, schema, honor_field_kinds)])


def criteria_filter(
    df: DataFrame,
    criteria: Mapping[str, Any],
    schema: CatalogSchema | None = None,
    honor_field_kinds: bool = True,
) -> DataFrame:
    """Rows that satisfy every criterion."""
    return df.filter(predicate(criteria, schema or CatalogSchema.of(df), honor_field_kinds))


def with_score(
    df: DataFrame,
    criteria: Mapping[str, Any],
    schema: CatalogSchema | None = None,
    honor_field_kinds: bool = True,
    idf: bool = False,
) -> DataFrame:
    """Matching rows with ``_score``: one point per scoring clause; a score of 0 is null.

    With ``idf`` an equality on a keyword field weighs by the rarity of its value
    instead, and one on a text field also by the frequency of the token and the length
    of the text. All counts are one row from one pass, a scalar subquery that is run once.
    """
    schema = schema or CatalogSchema.of(df)
    compiled = clauses(criteria, schema, honor_field_kinds)
    keep = reduce(and_, [c.predicate for c in compiled])
    constant = sum(1 for c in compiled if c.scoring and not (idf and c.idf))
    score = F.lit(float(constant))
    rare = [c for c in compiled if idf and c.idf]
    if rare:
        counts = []
        for i, c in enumerate(rare):
            there = _exists(schema.resolve(c.field))
            counts += [F.count_if(c.predicate).alias(f"df{i}"), F.count_if(there).alias(f"n{i}")]
            if c.tokens is not None:
                counts.append(F.avg(F.when(there, F.size(c.tokens))).alias(f"mean{i}"))
        stats = df.agg(*counts)
        row = stats.select(F.struct(*stats.columns)).scalar()
        for i, c in enumerate(rare):
            n, d = row[f"n{i}"], row[f"df{i}"]
            weight = F.log(1 + (n - d + 0.5) / (d + 0.5))
            if c.tokens is not None:
                tf = F.size(F.array_compact(F.transform(c.tokens, _is(c.asked))))
                length = F.size(c.tokens) / row[f"mean{i}"]
                weight = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
            score = score + weight
    return df.filter(keep).withColumn("_score", F.nullif(score, F.lit(0.0)))


def _is(asked: Any) -> Callable[[Column], Column]:
    return lambda t: F.when(t == F.lit(asked), t)


def caller_filter(df: DataFrame, keep: Predicate) -> DataFrame:
    """Filter by a caller's function from the frame to a boolean column."""
    if keep is None:
        raise ValueError("Filter predicate is required")
    return df.filter(keep(df))


def _clause(name: str, value: Any, schema: CatalogSchema, honor: bool) -> Clause:
    path = schema.resolve(name, honor, like=value)
    if value is None:
        return Clause(name, missing(path, honor), scoring=False)
    if isinstance(value, str) and "*" in value:
        return Clause(name, wildcard(path, value, honor), scoring=True)
    if isinstance(value, Mapping) and "range" in value:
        return Clause(name, in_range(path, value["range"], honor), scoring=True)
    if isinstance(value, (list, tuple, set)):
        return Clause(name, any_of(path, list(value), honor), scoring=True)
    if isinstance(value, Mapping):
        return Clause(name, term_object(path, value, honor), scoring=True)
    return Clause(
        name,
        term(path, value, honor),
        scoring=True,
        idf=path.kind in (KEYWORD, TEXT, TEXT_KEYWORD),
        tokens=_tokens(path) if _tokenised(path, honor) else None,
        asked=value,
    )


def _exists(path: Path) -> Column:
    return ~missing(path, True)


def _tokenised(path: Path, honor: bool) -> bool:
    return honor and path.kind in (TEXT, TEXT_KEYWORD)


def _tokens(path: Path) -> Column:
    if path.many:
        return tx.tokens_of_all(path.column)
    return tx.tokens(path.column)


def _as_text(path: Path) -> tuple[Column, bool]:
    """A keyword path as string or array of strings, values too long to search left out."""
    fits = lambda c: F.when(F.length(c) <= path.ignore_above, c)
    if path.many:
        return F.transform(path.column, lambda x: fits(x.cast("string"))), True
    return fits(path.column.cast("string")), False


def _number(path: Path, value: Any) -> int | float:
    if isinstance(value, bool):
        raise ValueError(f"Field [{path.name}] of kind {path.kind} cannot be compared with {value!r}")
    if isinstance(value, (int, float)):
        return value
    try:
        f = float(value)
    except (TypeError, ValueError):
        raise ValueError(
            f"Field [{path.name}] of kind {path.kind} cannot be compared with {value!r}"
        ) from None
    return int(f) if f.is_integer() and path.kind in (INTEGER, LONG) else f


def _literal(path: Path, value: Any) -> Column:
    if path.kind in NUMERIC:
        return F.lit(_number(path, value))
    if path.kind == BOOLEAN:
        if value in (True, "true"):
            return F.lit(True)
        if value in (False, "false", ""):
            return F.lit(False)
        raise ValueError(f"Field [{path.name}] is boolean and cannot be compared with {value!r}")
    if path.kind == DATE:
        return F.lit(value).cast("timestamp")
    return F.lit(_text(value))


def _text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def _usable(path: Path, honor: bool) -> bool:
    return path.column is not None and (path.searchable or not honor)


def _any(path: Path, test: Callable[[Column], Column]) -> Column:
    hit = F.exists(path.column, test) if path.many else test(path.column)
    return F.coalesce(hit, nothing()) if path.many else hit


def term(path: Path, value: Any, honor: bool = True) -> Column:
    """Equality; an array matches when one element does, a text when one token does."""
    if not _usable(path, honor):
        return nothing()
    if _tokenised(path, honor):
        return F.array_contains(_tokens(path), _text(value))
    if path.kind == KEYWORD:
        return any_of(path, [value], honor)
    if isinstance(value, float) and path.kind in (INTEGER, LONG) and not value.is_integer():
        return nothing()
    want = _literal(path, value)
    return F.array_contains(path.column, want) if path.many else path.column == want


def any_of(path: Path, values: list[Any], honor: bool = True) -> Column:
    """Membership; an empty list matches nothing."""
    values = [v for v in values if v is not None]
    if not values or not _usable(path, honor):
        return nothing()
    if _tokenised(path, honor):
        return F.arrays_overlap(_tokens(path), F.array(*[F.lit(_text(v)) for v in values]))
    if path.kind == KEYWORD:
        wanted = [_text(v) for v in values]
        if honor:
            wanted = [w for w in wanted if len(w) <= path.ignore_above]
        kind = path.dtype.typeName() if path.dtype is not None else "string"
        if kind in ("long", "integer"):
            # only the canonical spelling of a number equals its text form
            wanted = [int(w) for w in wanted if w.lstrip("-").isdigit() and str(int(w)) == w]
        if not wanted:
            return nothing()
    else:
        wanted = [v for v in values if path.kind not in NUMERIC or _number(path, v) is not None]
    if path.many:
        if path.kind == KEYWORD:
            options = F.array(*[F.lit(w).cast(path.dtype) for w in wanted])
        else:
            options = F.array(*[_literal(path, w) for w in wanted])
        return F.coalesce(F.arrays_overlap(path.column, options), nothing())
    if len(wanted) == 1:
        return path.column == (F.lit(wanted[0]) if path.kind == KEYWORD else _literal(path, wanted[0]))
    if path.kind == KEYWORD:
        return path.column.isin(wanted)
    return path.column.isin(*[_literal(path, w) for w in wanted])


_BOUNDS: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def in_range(path: Path, bounds: Mapping[str, Any], honor: bool = True) -> Column:
    """Range; on an array one and the same element has to lie within all bounds.

    A keyword compares as text, whatever it holds, so "10" sorts before "9".
    """
    unknown = set(bounds) - set(_BOUNDS)
    if unknown:
        raise ValueError(f"Unknown range bounds: {sorted(unknown)}")
    if not _usable(path, honor):
        return nothing()
    given = {k: v for k, v in bounds.items() if v is not None}
    if _tokenised(path, honor):
        return F.exists(
            _tokens(path),
            lambda x: reduce(and_, [_BOUNDS[k](x, F.lit(_text(v))) for k, v in given.items()], everything()),
        )
    if path.kind == KEYWORD and honor:
        c, many = _as_text(path)
        test = lambda x: reduce(
            and_, [_BOUNDS[k](x, F.lit(_text(v))) for k, v in given.items()], x.isNotNull()
        )
        if many:
            return F.coalesce(F.exists(c, test), nothing())
        plain = path.column.cast("string") if path.dtype.typeName() != "string" else path.column
        return test(plain) & (F.length(plain) <= path.ignore_above)
    test = lambda x: reduce(
        and_, [_BOUNDS[k](x, _literal(path, v)) for k, v in given.items()], x.isNotNull()
    )
    return _any(path, test)


def wildcard(path: Path, pattern: str, honor: bool = True) -> Column:
    """``*`` is any run of characters and ``?`` one character; case matters."""
    if not _usable(path, honor):
        return nothing()
    if _tokenised(path, honor):
        return F.exists(_tokens(path), lambda x: tx.wildcard_match(x, pattern))
    if path.kind in NUMERIC and honor:
        raise ValueError(f"Field [{path.name}] of kind {path.kind} does not take wildcards")
    if path.many:
        c, _ = _as_text(path)
        return F.coalesce(F.exists(c, lambda x: tx.wildcard_match(x, pattern)), nothing())
    c = path.column if path.dtype.typeName() == "string" else path.column.cast("string")
    hit = tx.wildcard_match(c, pattern)
    return hit & (F.length(c) <= path.ignore_above) if honor else hit


def missing(path: Path, honor: bool = True) -> Column:
    """No value: null, an empty array, only nulls, or nothing that was ever searchable."""
    if not _usable(path, honor):
        return everything()
    if _tokenised(path, honor):
        return F.coalesce(F.size(_tokens(path)), F.lit(0)) <= 0
    if path.kind == KEYWORD and honor:
        c, many = _as_text(path)
        if many:
            return ~F.coalesce(F.exists(c, lambda x: x.isNotNull()), nothing())
        return path.column.isNull() | (F.length(path.column.cast("string")) > path.ignore_above)
    if path.many:
        return ~F.coalesce(F.exists(path.column, lambda x: x.isNotNull()), nothing())
    return path.column.isNull()


def term_object(path: Path, body: Mapping[str, Any], honor: bool = True) -> Column:
    """Equality written as ``{value, case_insensitive}``; any other object is an error."""
    if "value" not in body or set(body) - {"value", "case_insensitive"}:
        raise ValueError(f"Unsupported criterion for field [{path.name}]: {dict(body)!r}")
    if not body.get("case_insensitive"):
        return term(path, body["value"], honor)
    if not _usable(path, honor):
        return nothing()
    want = _text(body["value"]).lower()
    if _tokenised(path, honor):
        return F.array_contains(_tokens(path), want)
    if path.kind not in (KEYWORD, TEXT, TEXT_KEYWORD):
        raise ValueError(f"Field [{path.name}] of kind {path.kind} does not compare without case")
    if path.many:
        return F.coalesce(F.exists(path.column, lambda x: F.lower(x.cast("string")) == want), nothing())
    return F.lower(path.column) == want
