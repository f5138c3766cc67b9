"""Load sessions: a ledger of batches, running totals, idle expiry and late batches.

The ledger is append-only; a session's state is an aggregate of its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import scalar as sc
from shelfmark.plans.numbering import running_totals
from shelfmark.runtime import cut_lineage

# Fixed value: idle time that ends a session.
IDLE_SECONDS = 3600

ACTIVE, COMPLETED, FAILED, EXPIRED = "active", "completed", "failed", "expired"

LEDGER = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("event", T.StringType()),  # start, batch, error, complete, fail, cancel
        T.StructField("batch", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("input", T.LongType()),
        T.StructField("successful", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("estimated_total", T.LongType()),
        T.StructField("alias", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


def replay_once(ledger: DataFrame) -> DataFrame:
    """Batch rows, one per (session, batch): the last attempt, with the number of attempts.

    A batch sent again replaces its earlier row, so counters do not count it twice.
    """
    row = F.struct("attempt", "at", "input", "successful", "failed")
    return (
        ledger.filter("event = 'batch'")
        .groupBy("session", "batch")
        .agg(F.max(row).alias("_last"), F.count(F.lit(1)).alias("attempts"))
        .select("session", "batch", "attempts", "_last.at", "_last.input", "_last.successful", "_last.failed")
    )


def session_starts(ledger: DataFrame) -> DataFrame:
    return ledger.filter("event = 'start'").select(
        "session", F.col("at").alias("created_at"), "estimated_total", "alias", "version", "color", "strategy"
    )


def progress(ledger: DataFrame) -> DataFrame:
    """Totals of each session after each batch, with progress where an estimate was given."""
    once = replay_once(ledger)
    run = running_totals(
        once,
        ["session"],
        "batch",
        {"batch_number": F.lit(1), "total_processed": F.col("successful"), "total_failed": F.col("failed")},
    )
    estimate = session_starts(ledger).select("session", "estimated_total")
    share = F.when(F.col("estimated_total") > 0, F.col("total_processed") / F.col("estimated_total") * 100)
    return run.join(estimate, "session", "left").select(
        "session",
        "batch",
        "batch_number",
        "successful",
        "failed",
        "total_processed",
        "total_failed",
        share.alias("progress"),
    )


def session_status(ledger: DataFrame, now: Column | None = None) -> DataFrame:
    """State of every session; with ``now`` an idle session counts as expired."""
    counted = (
        replay_once(ledger)
        .groupBy("session")
        .agg(
            F.count(F.lit(1)).alias("processed_batches"),
            F.sum("input").alias("total_documents"),
            F.sum("successful").alias("processed_documents"),
            F.sum("failed").alias("failed_documents"),
            F.max("at").alias("last_batch_at"),
        )
    )
    ends = (
        ledger.filter(F.col("event").isin("complete", "fail", "cancel"))
        .groupBy("session")
        .agg(F.min_by("event", "at").alias("_end"))
    )
    joined = session_starts(ledger).join(counted, "session", "left").join(ends, "session", "left")
    last = F.coalesce("last_batch_at", "created_at")
    status = F.when(F.col("_end") == "complete", COMPLETED).when(F.col("_end").isNotNull(), FAILED)
    if now is not None:
        status = F.when(now > last + F.expr(f"INTERVAL {IDLE_SECONDS} SECONDS"), EXPIRED).otherwise(status)
    zero = {
        c: F.coalesce(c, F.lit(0).cast("bigint"))
        for c in ("processed_batches", "total_documents", "processed_documents", "failed_documents")
    }
    return (
        joined.withColumns(zero)
        .withColumn("last_batch_at", last)
        .withColumn("status", F.coalesce(status, F.lit(ACTIVE)))
        .drop("_end")
    )


def active_sessions(ledger: DataFrame, now: Column | None = None) -> DataFrame:
    return session_status(ledger, now).filter(F.col("status") == ACTIVE)


def idle_sessions(
    rows: DataFrame,
    key: str,
    ts: str,
    sums: Mapping[str, Column] | None = None,
    gap_seconds: int = IDLE_SECONDS,
) -> DataFrame:
    """Sessions of a key: rows no more than the gap apart belong together.

    Two rows in one slot as long as the gap always share a session. So rows are
    first summed per slot, on the map side, and only slots are put in order: a key
    with a third of all rows is no longer than a key with one row per slot.
    """
    sums = dict(sums or {})
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    slots = (
        rows.withColumn("_slot", F.floor(micros / gap))
        .groupBy(key, "_slot")
        .agg(
            F.min(ts).alias("_from"),
            F.max(ts).alias("_to"),
            F.min(micros).alias("_from_us"),
            F.max(micros).alias("_to_us"),
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()],
        )
    )
    w = W.partitionBy(key).orderBy("_slot")
    breaks = (F.col("_from_us") - F.lag("_to_us").over(w) > gap).cast("int")
    marked = slots.withColumn("_new", F.coalesce(breaks, F.lit(1)))
    numbered = marked.withColumn(
        "session_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    return numbered.groupBy(key, "session_no").agg(
        F.min("_from").alias("opened"),
        F.max("_to").alias("last_batch_at"),
        F.sum("_rows").alias("batches"),
        *[F.sum(f"_sum_{n}").alias(n) for n in sums],
    )


def late_batches(
    batches: DataFrame, completions: DataFrame, key: str, ts: str, gap_seconds: int = IDLE_SECONDS
) -> DataFrame:
    """Batches that come after their session ended, with the reason.

    A session opens with the first batch of its key. It is gone once it was idle
    for more than the gap; before that, a completed session still answers, but
    takes no more batches. Spans of keys, one row each, are written down once, so the
    batches are read once for them and twice to place them.
    """
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    first = idle_sessions(batches, key, ts, gap_seconds=gap_seconds).filter("session_no = 1")
    first = cut_lineage(first.select(F.col(key).alias("_key"), "opened", F.col("last_batch_at").alias("_end")))
    done = completions.select(F.col(key).alias("_done_key"), F.col(ts).alias("_at"))
    ended = (
        done.join(first, F.col("_done_key") == F.col("_key"))
        .filter((F.col("_at") >= F.col("opened")) & (F.col("_at") <= F.col("_end") + gap))
        .groupBy("_key")
        .agg(F.min("_at").alias("_completed"))
        .withColumnRenamed("_key", "_ended_key")
    )
    spans = cut_lineage(
        first.join(ended, F.col("_key") == F.col("_ended_key"), "left").select(
            "_key", F.least("_end", "_completed").alias("_until"), "_completed"
        )
    )
    placed = batches.join(spans, batches[key] == F.col("_key"))
    accepted = (
        placed.filter(F.col(ts) <= F.col("_until"))
        .groupBy("_key")
        .agg(F.max(ts).alias("_last"))
        .withColumnRenamed("_key", "_last_key")
    )
    reason = F.when(
        F.col("_completed").isNotNull() & (F.col(ts) <= F.col("_last") + gap), F.lit("not active")
    ).otherwise(F.lit("not found or expired"))
    return (
        placed.filter(F.col(ts) > F.col("_until"))
        .join(accepted, F.col("_key") == F.col("_last_key"), "left")
        .select(*batches.columns, reason.alias("reason"))
    )


def error_summary(errors: DataFrame, kind: str) -> DataFrame:
    """Errors by type."""
    return errors.groupBy(kind).agg(F.count(F.lit(1)).alias("errors"))


def first_errors(errors: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first errors, each beside the number of those not shown."""
    more = F.greatest(errors.agg(F.count(F.lit(1))).scalar() - n, F.lit(0).cast("bigint"))
    return errors.orderBy(*order_by).limit(n).withColumn("more", more)


def load_summary(ledger: DataFrame) -> DataFrame:
    """One row: batches, documents, duration in seconds, rate and success share."""
    totals = replay_once(ledger).agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.coalesce(F.sum("successful"), F.lit(0)).alias("total_processed"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("total_failed"),
        ((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1e6).alias("seconds"),
    )
    rate = F.when(
        (F.col("total_processed") > 0) & (F.col("seconds") > 0),
        sc.round_half_up(F.col("total_processed") / F.col("seconds"), 1),
    ).otherwise(F.lit(0.0))
    share = sc.percent(F.col("total_processed"), F.col("total_processed") + F.col("total_failed"))
    return totals.withColumns({"per_second": rate, "success_percent": share})


def completion(ledger: DataFrame, stored: DataFrame, accepted: DataFrame) -> DataFrame:
    """What completing each session finds: documents expected, stored, and whether that holds.

    ``accepted`` has (session, id) of every accepted row; the expectation is its
    distinct ids, so a repeated id is not missed twice. ``stored`` has (session, id).
    """
    expected = accepted.groupBy("session").agg(F.count_distinct("id").alias("expected"))
    actual = stored.groupBy("session").agg(F.count(F.lit(1)).alias("actual"))
    zero = F.lit(0).cast("bigint")
    return (
        session_status(ledger)
        .select("session", "strategy", "status", "processed_documents")
        .join(expected, "session", "left")
        .join(actual, "session", "left")
        .withColumns({"expected": F.coalesce("expected", zero), "actual": F.coalesce("actual", zero)})
        .withColumn("healthy", F.col("actual") >= F.col("expected"))
        .withColumn("count_differs", F.col("actual") != F.col("processed_documents"))
        .withColumn(
            "deployment_status",
            F.when(~F.col("healthy"), F.lit("failed"))
            .when(F.col("strategy") == "auto-swap", F.lit("completed"))
            .otherwise(F.lit("ready-for-swap")),
        )
    )
