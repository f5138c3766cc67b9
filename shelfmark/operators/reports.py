"""Statistics of stored versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import scalar as sc


def document_count(version: DataFrame) -> DataFrame:
    return version.agg(F.count(F.lit(1)).alias("documents"))


def version_stats(version: DataFrame, health: str = "green") -> DataFrame:
    """Documents, files, bytes and readable size of a table read from files.

    Rows are counted per file first, so a file's size is taken once. ``health`` comes
    from the audit (``registry.health``); rates of a running server have no counterpart here.
    """
    per_file = version.groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    ).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return per_file.agg(
        F.coalesce(F.sum("n"), zero).alias("documents"),
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), zero).alias("bytes"),
    ).select(
        "documents",
        "files",
        "bytes",
        sc.human_bytes(F.col("bytes")).alias("store_size"),
        F.lit(health).alias("health"),
    )
