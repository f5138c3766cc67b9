"""Ids, batches, duplicate tests and row outcomes of a load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.numbering import number_rows, running_totals
from shelfmark.runtime import cut_lineage

# Batch sizes (library, deployment, loader), the largest batch, the first new record id.
LIBRARY_BATCH = 1000
DEPLOY_BATCH = 100
LOADER_BATCH = 500
MAX_BATCH = 1000
FIRST_RECORD_ID = 68_719_500_000

# Statuses of an accepted row.
ACCEPTED = (200, 201)


def derive_id(id_col: Column, record_id: Column, *place: Column | str) -> Column:
    """The given id unless blank, else the record number, else one made from the row's place.

    The made-up form holds no clock, so a retried batch gives the same ids.
    """
    options = [F.nullif(id_col, F.lit("")), record_id.cast("string")]
    if place:
        options.append(F.concat_ws("_", F.lit("doc"), *[F.col(p) if isinstance(p, str) else p for p in place]))
    return F.coalesce(*options)


def require_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Fail the job when a row has no id."""
    checked = F.when(
        F.col(id_col).isNull(), F.raise_error(F.lit("document without id or RecordId"))
    ).otherwise(F.col(id_col))
    return df.withColumn(id_col, checked)


def loader_batch_size(requested: int | None = None) -> int:
    """The loader's batch size: 500 unless asked, never above 1000."""
    size = LOADER_BATCH if requested is None else int(requested)
    if size <= 0:
        raise ValueError("Batch size must be greater than 0")
    return min(size, MAX_BATCH)


def slice_batches(
    df: DataFrame, size: int, order_by: Sequence[str | Column] = (), name: str = "batch"
) -> DataFrame:
    """Cut rows into batches of ``size``; the last one may be shorter."""
    numbered = number_rows(df, order_by, "_n")
    return numbered.withColumn(name, F.floor((F.col("_n") - 1) / size) + 1).drop("_n")


def batch_limits(df: DataFrame, by: Sequence[str], limit: int = MAX_BATCH) -> DataFrame:
    """Rows per batch and whether the batch is within the limit."""
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("within_limit", F.col("rows") <= limit)
    )


def duplicate_ids(df: DataFrame, by: Sequence[str], id_col: str = "id") -> DataFrame:
    """Ids that occur more than once in a batch, with the number of surplus copies."""
    return (
        df.groupBy(*by, id_col)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(*by, id_col, (F.col("n") - 1).alias("copies"))
    )


def without_duplicate_batches(df: DataFrame, by: Sequence[str], id_col: str = "id") -> DataFrame:
    """Rows of the batches in which every id occurs once."""
    return df.join(duplicate_ids(df, by, id_col).select(*by).distinct(), list(by), "left_anti")


def cross_batch_counts(df: DataFrame, by: Sequence[str], id_col: str = "id") -> DataFrame:
    """Rows processed beside documents stored: a repeated id counts in both batches, stores once."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"), F.count_distinct(F.col(id_col)).alias("stored")
    )


def outcome(error: Column, status: Column) -> Column:
    """A row's error: its own, or ``unexpected_status``; null when it was stored."""
    odd = F.struct(
        F.lit("unexpected_status").alias("type"),
        F.concat(F.lit("Unexpected status code: "), F.coalesce(status.cast("string"), F.lit("unknown"))).alias(
            "reason"
        ),
        status.cast("int").alias("status"),
    )
    known = F.struct(
        F.coalesce(error["type"], F.lit("unknown")).alias("type"),
        F.coalesce(error["reason"], F.lit("unknown error")).alias("reason"),
        F.coalesce(error["status"], status).cast("int").alias("status"),
    )
    return F.when(error.isNotNull(), known).when(~F.coalesce(status.isin(*ACCEPTED), F.lit(False)), odd)


def split_outcomes(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined rows."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def failed_rows(df: DataFrame, error: str = "error") -> DataFrame:
    """Quarantine: the document, its place and what was wrong with it."""
    return df.filter(F.col(error).isNotNull())


def reconcile(df: DataFrame, by: Sequence[str], error: str = "error") -> DataFrame:
    """Per batch: input, successful, failed, and whether the two add up."""
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("input"),
            F.count_if(F.col(error).isNull()).alias("successful"),
            F.count_if(F.col(error).isNotNull()).alias("failed"),
        )
        .withColumn("balanced", F.col("successful") + F.col("failed") == F.col("input"))
    )


def allocate_ids(
    rows: DataFrame, index: str, existing: DataFrame, existing_id: str, start: int = FIRST_RECORD_ID
) -> DataFrame:
    """Give row ``index`` (0, 1, ...) the next free number from ``start`` on.

    The i-th free number is ``start + i`` plus the taken numbers below it. A taken
    number of rank j stands in the way of every index from ``number - start - j``
    on, so a running count of those thresholds is the shift.
    """
    taken = existing.select(F.col(existing_id).alias("_id")).filter(F.col("_id") >= start).distinct()
    taken = taken.select((F.col("_id") - start).alias("_off"))
    ranked = running_totals(taken, [], "_off", {"_rank": F.lit(1)}, span_bits=60)
    thresholds = (
        ranked.select((F.col("_off") - F.col("_rank") + 1).alias("_at"))
        .groupBy("_at")
        .agg(F.count(F.lit(1)).alias("_step"))
    )
    # even places hold thresholds, odd places the rows they shift
    marks = thresholds.select((F.col("_at") * 2).alias("_place"), "_step")
    asked = rows.select("*", (F.col(index) * 2 + 1).alias("_place"), F.lit(0).cast("bigint").alias("_step"))
    walked = running_totals(
        asked.unionByName(marks, allowMissingColumns=True), [], "_place", {"_shift": "_step"}
    )
    return (
        walked.filter(F.col("_place") % 2 == 1)
        .withColumn("RecordId", F.lit(start) + F.col(index) + F.col("_shift"))
        .drop("_place", "_step", "_shift")
    )


def uniqueness_report(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """Distinct ids, with the ``n`` smallest and the ``n`` largest. The distinct ids are written down once."""
    ids = cut_lineage(df.select(F.col(id_col).alias("id")).distinct())
    ends = None
    for edge, order in (("smallest", F.col("id").asc()), ("largest", F.col("id").desc())):
        part = ids.orderBy(order).limit(n).select(F.lit(edge).alias("edge"), "id")
        ends = part if ends is None else ends.unionByName(part)
    return ends.withColumn("distinct_ids", ids.agg(F.count(F.lit(1))).scalar())
