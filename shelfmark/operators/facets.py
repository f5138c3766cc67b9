"""Facet counts over the property map, with one representative hit per bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Buckets per facet and the leaves shown for the representative hit.
BUCKETS = 50
SHOWN = ["Translation", "KeyName", "FriendlyName"]

PROPERTIES = "DefaultProductProperties"


def facet_rows(df: DataFrame, names: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Long form of the property map: one row per product and facet.

    With ``names`` only those entries are looked up; without, the whole map is
    opened, which is what the published side table stores.
    """
    base = [F.col("id"), *[F.col(k) for k in keep]]
    if names:
        entries = F.array(
            *[
                F.struct(F.lit(n).alias("facet"), *_leaves(F.element_at(PROPERTIES, F.lit(n))))
                for n in names
            ]
        )
        rows = df.select(*base, F.explode(entries).alias("e")).select(
            *[c for c in ("id", *keep)], "e.facet", *[f"e.{leaf}" for leaf in SHOWN]
        )
    else:
        rows = df.select(*base, F.explode(PROPERTIES).alias("facet", "p")).select(
            *[c for c in ("id", *keep)], "facet", *_leaves(F.col("p"))
        )
    return rows


def _leaves(entry: Column) -> list[Column]:
    return [entry[leaf].alias(leaf) for leaf in SHOWN]


def count_facets(
    rows: DataFrame, by: str = "KeyName", size: int = BUCKETS, score: str | None = None
) -> DataFrame:
    """Top buckets per facet from long rows, largest first, key breaking ties.

    The representative hit is the best-scoring product, the smallest id among
    equals. Counting combines on the map side; the rank keeps ``size`` rows per
    facet in every task before the shuffle, so a hot facet stays small.
    """
    rank_by = F.struct(-F.coalesce(F.col(score), F.lit(0.0)), F.col("id")) if score else F.col("id")
    buckets = (
        rows.filter(F.col(by).isNotNull())
        .groupBy("facet", F.col(by).alias("key"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min_by(F.struct("id", *SHOWN), rank_by).alias("top"),
        )
    )
    w = W.partitionBy("facet").orderBy(F.col("count").desc(), F.col("key"))
    return (
        buckets.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= size)
        .select("facet", "rank", "key", "count", "top")
    )


def facets(
    df: DataFrame,
    names: Sequence[str],
    by: str = "KeyName",
    size: int = BUCKETS,
    score: str | None = None,
) -> DataFrame:
    """Facets of all rows of ``df``; give it the matches, not a page of them."""
    keep = [score] if score else []
    return count_facets(facet_rows(df, names, keep), by, size, score)


def category_counts(df: DataFrame) -> DataFrame:
    """Products per category."""
    return (
        df.select(F.explode("CategoryIds").alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("products"))
    )
