"""Versions, colours and the published pointer, as queries over an append-only registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import scalar as sc

SAFE, AUTO_SWAP, BLUE_ONLY, GREEN_ONLY = "safe", "auto-swap", "blue-only", "green-only"
STRATEGIES = (SAFE, AUTO_SWAP, BLUE_ONLY, GREEN_ONLY)

IDLE, READY, DONE = "IDLE", "READY_FOR_SWAP", "COMPLETED"

STAGE, PUBLISH, ROLLBACK, DROP = "stage", "publish", "rollback", "drop"

REGISTRY = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("alias", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


def versions(registry: DataFrame) -> DataFrame:
    """One row per version: when it was staged, last pointed at and dropped."""
    pointed = F.col("action").isin(PUBLISH, ROLLBACK)
    return registry.groupBy("alias", "version").agg(
        F.max("color").alias("color"),
        F.max(F.when(F.col("action") == STAGE, F.col("seq"))).alias("staged_seq"),
        F.max(F.when(pointed, F.col("seq"))).alias("published_seq"),
        F.max(F.when(pointed, F.struct("seq", "at"))).alias("_published"),
        F.max(F.when(F.col("action") == DROP, F.col("seq"))).alias("dropped_seq"),
    ).select(
        "alias",
        "version",
        "color",
        "staged_seq",
        "published_seq",
        F.col("_published.at").alias("published_at"),
        F.col("dropped_seq").isNotNull().alias("dropped"),
    )


def deployment_status(registry: DataFrame) -> DataFrame:
    """Per alias: the active version, the version awaiting promotion, and the status.

    A version awaits promotion when it was staged after the active one, was never
    published, and is not dropped; the newest such version counts.
    """
    live = versions(registry).filter(~F.col("dropped"))
    row = F.struct("version", "color", "published_at", "staged_seq")
    waiting = F.when(F.col("published_seq").isNull(), F.col("staged_seq"))
    state = live.groupBy("alias").agg(
        F.max_by(row, F.col("published_seq")).alias("_active"),
        F.max_by(row, waiting).alias("_staging"),
    )
    ahead = F.col("_staging.staged_seq") > F.coalesce(F.col("_active.staged_seq"), F.lit(-1))
    staging = F.when(ahead, F.col("_staging"))
    return state.withColumn("_staging", staging).select(
        "alias",
        F.col("_active.version").alias("active_version"),
        F.col("_active.color").alias("active_color"),
        F.col("_staging.version").alias("staging_version"),
        F.col("_staging.color").alias("staging_color"),
        F.when(F.col("_staging").isNotNull(), READY).otherwise(IDLE).alias("status"),
        F.col("_active.published_at").alias("last_deployment"),
        F.when(F.col("_staging").isNotNull(), F.col("_staging.color"))
        .otherwise(sc.opposite_color(F.col("_active.color")))
        .alias("next_color"),
    )


def published_history(registry: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` published versions of each alias that still exist; rank 1 is active.

    The rank is cut to ``n`` rows per alias in every task before the shuffle.
    """
    live = versions(registry).filter("published_seq is not null and not dropped")
    w = W.partitionBy("alias").orderBy(F.col("published_seq").desc())
    return (
        live.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select("alias", "rank", "version", "color", "published_at")
    )


def rollback_target(registry: DataFrame) -> DataFrame:
    """The version that was published before the active one."""
    return published_history(registry, 2).filter("rank = 2").drop("rank")


def cleanup_candidates(registry: DataFrame, keep_last: int = 1) -> DataFrame:
    """Versions that may be deleted.

    Kept are the active version, the ``keep_last`` published ones before it (the
    first of which is the rollback target) and the version awaiting promotion.
    Versions staged and never promoted, abandoned sessions included, are candidates.
    """
    live = versions(registry).filter(~F.col("dropped")).select("alias", "version", "color")
    kept = published_history(registry, max(keep_last, 1) + 1).select("alias", "version")
    staging = deployment_status(registry).select("alias", F.col("staging_version").alias("version"))
    return live.join(kept.unionByName(staging), ["alias", "version"], "left_anti")


def audit(
    version: DataFrame,
    expected: int | None = None,
    minimum: int | None = None,
    columns: list[str] | None = None,
    key: str = "id",
    types: T.StructType | None = None,
    written: int | None = None,
) -> DataFrame:
    """One row per check of a staged version: check, severity, passed, observed, wanted.

    ``columns`` have to be there; fields that ``types`` declares have to be of its
    types, at every depth; ``written`` is the exact number of rows. More documents than
    expected pass. Everything but the schema comes from one aggregation.
    """
    seen = version.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(key).isNull()).alias("without_id"),
        F.count_distinct(F.col(key)).alias("ids"),
    )
    n, spare = F.col("n"), F.col("n") - F.col("without_id") - F.col("ids")
    missing = sorted(set(columns or []) - set(version.columns))
    wrong = mistyped(version.schema, types) if types is not None else []

    def check(name: str, severity: str, passed: Column, observed: Column, wanted: int | None) -> Column:
        return F.struct(
            F.lit(name).alias("check"),
            F.lit(severity).alias("severity"),
            passed.alias("passed"),
            observed.cast("bigint").alias("observed"),
            F.lit(wanted).cast("bigint").alias("wanted"),
        )

    checks = [
        check("exists", "fail", F.lit(True), n, None),
        check("null_id", "fail", F.col("without_id") == 0, F.col("without_id"), 0),
        check("duplicate_id", "fail", spare == 0, spare, 0),
        check("schema", "fail", F.lit(not missing), F.lit(len(missing)), 0),
        check("types", "fail", F.lit(not wrong), F.lit(len(wrong)), 0),
    ]
    if written is not None:
        checks.append(check("written", "fail", n == written, n, written))
    if expected is not None:
        checks.append(check("expected_count", "fail", n >= expected, n, expected))
        checks.append(check("surplus", "warn", n <= expected, n, expected))
    if minimum is not None:
        checks.append(check("minimum_count", "fail", n >= minimum, n, minimum))
    return seen.select(F.inline(F.array(*checks)))


def mistyped(actual: T.DataType, declared: T.DataType, path: str = "") -> list[str]:
    """Paths that both have and whose types differ; fields only one side has do not count."""
    if isinstance(actual, T.StructType) and isinstance(declared, T.StructType):
        known = {f.name: f.dataType for f in declared.fields}
        return [
            p for f in actual.fields if f.name in known for p in mistyped(f.dataType, known[f.name], f"{path}.{f.name}".lstrip("."))
        ]
    if isinstance(actual, T.ArrayType) and isinstance(declared, T.ArrayType):
        return mistyped(actual.elementType, declared.elementType, f"{path}[]")
    if isinstance(actual, T.MapType) and isinstance(declared, T.MapType):
        return mistyped(actual.keyType, declared.keyType, path) + mistyped(actual.valueType, declared.valueType, f"{path}.*")
    return [] if actual == declared else [path]


def passed(report: DataFrame) -> bool:
    """Whether no failing check is left in an audit of a few rows."""
    return report.filter("severity = 'fail' and not passed").isEmpty()


def health(report: DataFrame) -> str:
    """``red`` where a check failed that a version must pass, ``yellow`` where another did, else ``green``."""
    failed = {r["severity"] for r in report.filter("not passed").select("severity").collect()}
    return "red" if "fail" in failed else "yellow" if failed else "green"
