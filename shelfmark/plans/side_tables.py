"""Side tables written when a version is published, so that searches read little.

Map keys defeat column pruning and free text has to be tokenised; both are done
once per version here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import facets as fc
from shelfmark.operators import relevance as rv
from shelfmark.runtime import cut_lineage
from shelfmark.schema import CatalogSchema


def write_facets(df: DataFrame, path: str) -> None:
    """Long facet rows sorted by (facet, id): a search skips the files and row groups of other facets.

    Facet names are an open set, so they are a column and no folders.
    """
    rows = fc.facet_rows(df).repartitionByRange("facet", "id").sortWithinPartitions("facet", "id")
    rows.write.mode("overwrite").parquet(path)


def read_facets(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("facet").isin(list(names)))


def facets_of(
    matches: DataFrame, stored: DataFrame, by: str = "KeyName", size: int = fc.BUCKETS, score: str | None = None
) -> DataFrame:
    """Facets of matching ids from the stored rows."""
    keep = ["id", score] if score else ["id"]
    return fc.count_facets(stored.join(matches.select(*keep), "id"), by, size, score)


def write_text_index(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """Counted occurrences, sorted by term so that pages of other terms are skipped, and the vocabulary.

    A term of the vocabulary is stored under what deleting one character leaves of its
    halves, so that fuzzy terms are found by equality.

    Occurrences are dealt out by (term, id), once for counting and for the files: a term that
    most documents hold spreads over all files, and no ranges have to be found first.

    The documents are split into words once: an occurrence says in ``heads`` how often it was
    the first of its field, so that the files also give the statistics of the fields.
    """
    paths = rv.search_fields(CatalogSchema.of(df), fields)
    words = rv.terms_of(df, paths).select("id", "no", "length", F.posexplode("terms").alias("place", "term"))
    # fields go by their number through the shuffle and the sort
    counted = words.repartition("term", "id").groupBy("id", "no", "length", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.count_if(F.col("place") == 0).alias("heads")
    )
    counted = counted.sortWithinPartitions("term", "id").select("id", *rv.named_field(paths), "length", "term", "tf", "heads")
    counted.write.mode("overwrite").parquet(f"{path}/occurrences")
    stored = df.sparkSession.read.parquet(f"{path}/occurrences")
    sums = stored.groupBy("field").agg(F.sum("heads").alias("docs"), F.sum("tf").alias("total"))
    sums.select("field", "docs", (F.col("total") / F.col("docs")).alias("mean_length"), "total").write.mode("overwrite").parquet(f"{path}/stats")
    terms = stored.groupBy("analysis", "term").agg(F.count("*").alias("documents"))
    # few bytes, but much work on each term: dealt out to all cores
    terms = terms.repartition(df.sparkSession.sparkContext.defaultParallelism, "term")
    variants = terms.select(F.explode(tx.half_rests(F.col("term"))).alias("variant"), "analysis", "term", "documents")
    # common rests spread over files, as common terms do
    variants = variants.repartition("variant", "term").sortWithinPartitions("variant", "term")
    variants.write.mode("overwrite").parquet(f"{path}/variants")


def read_text_index(
    spark: SparkSession, path: str, schema: CatalogSchema, fields: Sequence[str] | None = None
) -> rv.TextIndex:
    paths = rv.search_fields(schema, fields)
    names = [p.name for p in paths]
    return rv.TextIndex(
        spark.read.parquet(f"{path}/occurrences").drop("heads").filter(F.col("field").isin(names)),
        spark.read.parquet(f"{path}/stats").filter(F.col("field").isin(names)),
        tuple((p.name, rv._analysis(p)) for p in paths),
        spark.read.parquet(f"{path}/variants"),
    )


def extended(
    index: rv.TextIndex, ids: DataFrame, old: DataFrame, new: DataFrame, schema: CatalogSchema, fields: Sequence[str] | None = None
) -> rv.TextIndex:
    """A stored index as changes leave it: ``old`` and ``new`` are the rows of the changed ``ids`` before and after.

    What the changed documents held is left out by id, what they hold now is a segment of
    its own, and the statistics of a field are moved by the difference.
    """
    before, after = rv.TextIndex.of(old, fields, schema), rv.TextIndex.of(new, fields, schema)
    kept = index.occurrences.join(ids.select("id").distinct(), "id", "left_anti")
    columns = ["id", "field", "analysis", "length", "term", "tf"]
    occurrences = kept.select(*columns).unionByName(after.occurrences.select(*columns))
    moved = [
        stats.select("field", (F.col("docs") * sign).alias("docs"), (F.col("total") * sign).alias("total"))
        for stats, sign in ((index.stats, 1), (before.stats, -1), (after.stats, 1))
    ]
    summed = moved[0].unionByName(moved[1]).unionByName(moved[2]).groupBy("field")
    stats = summed.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).filter("docs > 0")
    # one row per field, which every use would make anew from all merged rows
    stats = cut_lineage(stats.withColumn("mean_length", F.col("total") / F.col("docs")))
    return rv.TextIndex(occurrences, stats, index.fields, index.variants, after.occurrences)
