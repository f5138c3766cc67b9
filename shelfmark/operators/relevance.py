"""Ranked text search: BM25 per field, best field per document, fuzzy terms, highlighting.

Text fields are split into tokens; a keyword field is one token, its whole value,
compared with the whole query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.runtime import cut_lineage
from shelfmark.schema import KEYWORD, TEXT, TEXT_KEYWORD, CatalogSchema, Path

# BM25 saturation and length weight.
K1 = 1.2
B = 0.75

# Highlight tags.
OPEN_TAG, CLOSE_TAG = "<em>", "</em>"

# Most terms of an expansion that are sent to every task; beyond, both sides are shuffled.
BROADCAST_TERMS = 100_000

# Scores are rounded so that rank does not depend on the order of a sum.
SCORE_DIGITS = 9

WORDS, WHOLE = "words", "whole"


@dataclass(frozen=True)
class TextIndex:
    """Occurrences and length statistics of a set of fields.

    ``occurrences``: id, field, analysis, term, tf, length. From a catalog it is a
    projection with one row per token; read from the side table it is already
    counted and sorted by term. ``stats``: field, docs, mean_length, total (of lengths).
    ``variants``: the stored terms by what is left of their halves without a character
    (variant, analysis, term); with it, ``fresh`` has the occurrences that are not in it.
    """

    occurrences: DataFrame
    stats: DataFrame
    fields: tuple[tuple[str, str], ...]
    variants: DataFrame | None = None
    fresh: DataFrame | None = None

    @classmethod
    def of(
        cls,
        df: DataFrame,
        fields: Sequence[str] | None = None,
        schema: CatalogSchema | None = None,
        id_col: str = "id",
    ) -> "TextIndex":
        paths = search_fields(schema or CatalogSchema.of(df), fields)
        per_field = terms_of(df, paths, id_col).select("id", *named_field(paths), "terms", "length")
        occurrences = per_field.select(
            "id",
            "field",
            "analysis",
            F.explode("terms").alias("term"),
            F.lit(1).cast("bigint").alias("tf"),
            "length",
        )
        stats = per_field.groupBy("field").agg(
            F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length"), F.sum("length").alias("total")
        )
        return cls(occurrences, stats, tuple((p.name, _analysis(p)) for p in paths))


def terms_of(df: DataFrame, paths: Sequence[Path], id_col: str = "id") -> DataFrame:
    """``id, no, terms, length`` of each field that holds terms; ``no`` is the place of the field among ``paths``."""
    split = df.select(F.col(id_col).alias("id"), *[_terms(p).alias(f"_t{i}") for i, p in enumerate(paths)])
    lists = F.array(
        *[
            F.struct(F.lit(i).alias("no"), F.col(f"_t{i}").alias("terms"), F.size(f"_t{i}").cast("bigint").alias("length"))
            for i in range(len(paths))
        ]
    )
    return split.select("id", F.explode(lists).alias("f")).select("id", "f.*").filter("length > 0")


def named_field(paths: Sequence[Path]) -> list[Column]:
    """``field, analysis`` of the field number ``no``."""
    names, kinds = ([F.lit(x) for x in some] for some in ([p.name for p in paths], [_analysis(p) for p in paths]))
    return [F.get(F.array(*names), F.col("no")).alias("field"), F.get(F.array(*kinds), F.col("no")).alias("analysis")]


def search_fields(schema: CatalogSchema, fields: Sequence[str] | None) -> list[Path]:
    """The fields a search covers: those listed, or every text and keyword field.

    A listed field that cannot be searched is passed over, as it matches nothing.
    """
    paths = [schema.resolve(name) for name in (fields or schema.text_fields())]
    return [p for p in paths if p.kind in (TEXT, KEYWORD, TEXT_KEYWORD)]


def _analysis(path: Path) -> str:
    return WHOLE if path.kind == KEYWORD else WORDS


def _terms(path: Path) -> Column:
    c = path.column
    if path.kind == KEYWORD:
        values = F.transform(c, lambda x: x.cast("string")) if path.many else F.array(c.cast("string"))
        terms = F.filter(values, lambda x: x.isNotNull() & (F.length(x) <= path.ignore_above))
    else:
        terms = tx.tokens_of_all(c) if path.many else tx.tokens(c)
    return F.coalesce(terms, F.array().cast("array<string>"))


def vocabulary(index: TextIndex) -> DataFrame:
    """Terms with the number of documents and of occurrences."""
    per_doc = index.occurrences.groupBy("id", "field", "term").agg(F.sum("tf").alias("tf"))
    return per_doc.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences")
    )


def query_table(query: str) -> list[tuple[str, str, int]]:
    """(analysis, term, weight) rows of a query."""
    words = [(WORDS, t, n) for t, n in tx.query_terms(query).items()]
    return words + [(WHOLE, tx.normalise_query(query), 1)]


@dataclass(frozen=True)
class Expansion:
    """Terms to look for: analysis, asked, term, weight, edits, boost.

    ``exact`` lists them where they are the query's own words. ``small`` says that
    their number was counted and is within ``BROADCAST_TERMS``.
    """

    rows: DataFrame
    small: bool
    exact: tuple[tuple[str, str], ...] = ()

    def side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def expand(index: TextIndex, query: str, fuzziness: str | int = "AUTO") -> Expansion:
    """Terms of the vocabulary close enough to a query term, with weight and edits.

    Edit distances are taken once per distinct term, not per occurrence; only terms
    of a possible length get that far. The result is written down and counted, as
    its size decides how it is joined.
    """
    rows = cut_lineage(near_terms(index, query, fuzziness))
    return Expansion(rows, rows.count() <= BROADCAST_TERMS)


def near_terms(index: TextIndex, query: str, fuzziness: str | int = "AUTO") -> DataFrame:
    kinds = {a for _, a in index.fields}
    asked = [(a, t, n, tx.allowed_edits(t, fuzziness)) for a, t, n in query_table(query) if a in kinds]
    length = F.length("term")
    near = reduce(
        lambda x, y: x | y,
        [
            (F.col("analysis") == a)
            & ((F.col("term") == t) if k == 0 else length.between(len(t) - k, len(t) + k))
            for a, t, _, k in asked
        ],
    )
    if index.variants is None or max(k for *_, k in asked) > tx.HALVED_EDITS:
        distinct = index.occurrences.select("analysis", "term").filter(near).distinct()
    else:
        # an equality on stored rests in place of a scan of all occurrences
        rests = sorted({v for _, t, _, k in asked for v in tx.half_rests_of(t, k)})
        distinct = index.variants.filter(F.col("variant").isin(rests)).select("analysis", "term")
        if index.fresh is not None:
            distinct = distinct.unionByName(index.fresh.select("analysis", "term"))
        distinct = distinct.filter(near).distinct()
    hits = F.array(
        *[
            F.when(
                F.col("analysis") == a,
                F.struct(
                    F.lit(t).alias("asked"),
                    F.lit(n).alias("weight"),
                    tx.edit_distance(F.col("term"), t, k).alias("edits"),
                ),
            )
            for a, t, n, k in asked
        ]
    )
    boost = 1.0 - F.col("edits") / F.least(F.length("asked"), F.length("term"))
    return (
        distinct.select("analysis", "term", F.explode(hits).alias("h"))
        .filter(F.col("h.edits").isNotNull())
        .select("analysis", "h.asked", "term", "h.weight", "h.edits")
        .withColumn("boost", boost)
        .filter(F.col("boost") > 0)
    )


def exact_terms(spark: SparkSession, index: TextIndex, query: str) -> Expansion:
    """The expansion without fuzziness: the query's own terms."""
    kinds = {a for _, a in index.fields}
    rows = [(a, t, t, n, 0, 1.0) for a, t, n in query_table(query) if a in kinds]
    df = spark.createDataFrame(
        rows, "analysis string, asked string, term string, weight int, edits int, boost double"
    )
    return Expansion(df, True, tuple((a, t) for a, t, *_ in rows))


def matched_terms(index: TextIndex, expansion: Expansion) -> DataFrame:
    """Occurrences of the wanted terms, counted per document and field.

    The words of the query become a plain filter, which reaches a stored index as
    a pushed filter. Fuzzy terms join, without moving the occurrences while the
    terms are few enough to send to every task.
    """
    occurrences = index.occurrences
    if expansion.exact:
        wanted = [
            (F.col("analysis") == a) & F.col("term").isin([t for b, t in expansion.exact if b == a])
            for a in sorted({a for a, _ in expansion.exact})
        ]
        found = occurrences.filter(F.col("term").isin([t for _, t in expansion.exact])).filter(
            reduce(lambda x, y: x | y, wanted)
        )
    else:
        terms = expansion.rows.select("analysis", "term").distinct()
        found = occurrences.join(expansion.side(terms), ["analysis", "term"], "left_semi")
    return found.groupBy("id", "field", "analysis", "length", "term").agg(F.sum("tf").alias("tf"))


def bm25(matched: DataFrame, expansion: Expansion, stats: DataFrame) -> DataFrame:
    """Score per document and field; the terms of the query add up.

    Document frequencies come from an aggregation joined back, not from a window,
    so a term that most documents hold is never gathered in one task. They have a
    row per field and term found, so they are as few as the expansion.
    """
    df = matched.groupBy("field", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    # one row per searched field
    facts = F.broadcast(stats)
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # a keyword has no length to weigh
    relative = F.when(F.col("analysis") == WHOLE, F.lit(1.0)).otherwise(
        F.col("length") / F.col("mean_length")
    )
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * relative))
    return (
        matched.join(expansion.side(df), ["field", "term"])
        .join(expansion.side(expansion.rows), ["analysis", "term"])
        .join(facts, "field")
        .groupBy("id", "field")
        .agg(F.sum(F.col("weight") * F.col("boost") * idf * saturation).alias("score"))
    )


def best_fields(scores: DataFrame) -> DataFrame:
    """A document scores as its best field."""
    return scores.groupBy("id").agg(F.round(F.max("score"), SCORE_DIGITS).alias("_score"))


def mark(c: Column, terms: Column) -> Column:
    """``c`` with every whole word out of ``terms`` (joined by ``|``) between tags."""
    pattern = F.concat(
        F.lit(r"(?iu)(?<![\p{L}\p{N}])("), terms, F.lit(r")(?![\p{L}\p{N}])")
    )
    return F.regexp_replace(c, pattern, F.lit(f"{OPEN_TAG}$1{CLOSE_TAG}"))


def _mark_whole(terms: Column) -> Callable[[Column], Column]:
    def mark_one(value: Column) -> Column:
        text = value.cast("string")
        tagged = F.concat(F.lit(OPEN_TAG), text, F.lit(CLOSE_TAG))
        return F.when(F.array_contains(terms, text), tagged).otherwise(text)

    return mark_one


def highlight(
    page: DataFrame, matched: DataFrame, schema: CatalogSchema, fields: Sequence[str], id_col: str = "id"
) -> DataFrame:
    """Add ``_highlight``, field -> marked text, for the fields that matched.

    ``page`` is one page of hits. Only terms found on that page are gathered.
    """
    ids = page.select(F.col(id_col).alias("id"))
    found = (
        matched.join(F.broadcast(ids), "id", "left_semi")
        .groupBy("id", "field")
        .agg(F.array_sort(F.collect_set("term")).alias("terms"))
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "terms"))).alias("_terms"))
        .withColumnRenamed("id", "_hit")
    )
    entries = []
    for name in fields:
        path = schema.resolve(name)
        terms = F.element_at("_terms", F.lit(name))
        if path.kind == KEYWORD:
            values = path.column if path.many else F.array(path.column)
            marked = F.array_join(F.transform(values, _mark_whole(terms)), ",")
        else:
            text = F.concat_ws("\n", path.column) if path.many else path.column
            marked = mark(text, F.array_join(terms, "|"))
        entries.append(F.when(terms.isNotNull(), F.struct(F.lit(name).alias("k"), marked.alias("v"))))
    shown = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    return (
        page.join(found, page[id_col] == found["_hit"], "left")
        .withColumn("_highlight", F.when(F.col("_terms").isNotNull(), shown))
        .drop("_terms", "_hit")
    )
