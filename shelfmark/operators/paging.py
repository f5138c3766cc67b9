"""Sorting, paging and totals."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import TEXT, TEXT_KEYWORD, CatalogSchema

# Page size, largest page, and the count above which a total is not tracked.
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
TRACKED_TOTAL = 10_000
#: Rows that a task may have to hold for one page.
MAX_WINDOW = 10_000


def validate_limit(limit: int) -> None:
    if limit > MAX_LIMIT:
        raise ValueError(f"Limit cannot exceed {MAX_LIMIT}")


def sort_columns(sort: Sequence[Any], schema: CatalogSchema) -> list[Column]:
    """Sort keys; missing values come last in both directions.

    An array sorts by its smallest element when ascending, by its largest when descending.
    """
    return [c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in sort_keys(sort, schema)]


def sort_keys(sort: Sequence[Any], schema: CatalogSchema) -> list[tuple[Column, bool]]:
    """The value of each sort key, and whether it ascends."""
    keys = []
    for item in sort:
        name, order = (item["field"], item["order"]) if isinstance(item, dict) else item
        if order not in ("asc", "desc"):
            raise ValueError(f"Sort order must be asc or desc, not {order!r}")
        path = schema.resolve(name)
        if not path.searchable:
            raise ValueError(f"No mapping found for [{name}] in order to sort on")
        if path.kind in (TEXT, TEXT_KEYWORD):
            raise ValueError(f"Text field [{name}] cannot be sorted on; use [{name}.keyword]")
        c = path.column
        if path.many:
            c = F.array_min(c) if order == "asc" else F.array_max(c)
        keys.append((c, order == "asc"))
    return keys


def page(
    df: DataFrame,
    sort: Sequence[Any] | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    schema: CatalogSchema | None = None,
    id_col: str = "id",
) -> DataFrame:
    """One page, by the given keys or else by ``_score``; the id breaks ties.

    Offset and limit together end at ``MAX_WINDOW``; ``page_after`` goes further.
    """
    validate_limit(limit)
    if offset + limit > MAX_WINDOW:
        raise ValueError(f"Offset and limit cannot exceed {MAX_WINDOW} together; use page_after")
    if sort:
        keys = sort_columns(sort, schema or CatalogSchema.of(df))
        df = df.withColumn("_score", F.lit(None).cast("double")) if "_score" in df.columns else df
    else:
        keys = [F.col("_score").desc_nulls_last()] if "_score" in df.columns else []
    ordered = df.orderBy(*keys, F.col(id_col).asc())
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_after(
    df: DataFrame,
    after: Sequence[Any],
    sort: Sequence[Any] = (),
    limit: int = DEFAULT_LIMIT,
    schema: CatalogSchema | None = None,
    id_col: str = "id",
) -> DataFrame:
    """The page behind a row, given by its sort values and its id: as cheap at any depth as the first.

    The row's place is a filter, so no task keeps the rows before it.
    """
    validate_limit(limit)
    schema = schema or CatalogSchema.of(df)
    keys = [*sort_keys(sort, schema), (F.col(id_col), True)]
    if len(after) != len(keys):
        raise ValueError("Give one value for each sort key, and the id")
    behind, equal = F.lit(False), F.lit(True)
    for (key, up), value in zip(keys, after):
        if value is None:  # missing values are last: nothing of this key lies behind
            beyond = F.lit(False)
        else:
            beyond = ((key > F.lit(value)) if up else (key < F.lit(value))) | key.isNull()
        behind = behind | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & key.eqNullSafe(F.lit(value))
    return df.filter(behind).orderBy(*sort_columns(sort, schema), F.col(id_col).asc()).limit(limit)


def hit_projection(df: DataFrame, fields: Sequence[str] | None = None, id_col: str = "id") -> DataFrame:
    """Rows as hits: the source or the listed fields of it, then ``_id`` and what the search added."""
    added = [c for c in ("_score", "_highlight") if c in df.columns]
    source = list(fields) if fields else [c for c in df.columns if c not in added]
    return df.select(*source, F.col(id_col).alias("_id"), *added)


def first_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in an order."""
    return df.orderBy(*order).limit(n)


def totals(df: DataFrame, score: str = "_score") -> DataFrame:
    """Total hits, the total as a capped tracker reports it, and the best score: one row."""
    best = F.max(score) if score in df.columns else F.lit(None).cast("double")
    return df.agg(F.count(F.lit(1)).alias("total"), best.alias("max_score")).select(
        "total", F.least("total", F.lit(TRACKED_TOTAL)).alias("total_capped"), "max_score"
    )
