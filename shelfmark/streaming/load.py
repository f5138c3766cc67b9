"""Load sessions on Structured Streaming: micro-batches in, an audited version out.

Files of a session live beside the catalog:

    {root}/{alias}/sessions/{session}/accepted/epoch={e}     rows to store
    {root}/{alias}/sessions/{session}/rejected/epoch={e}     rows set aside
    {root}/{alias}/sessions/{session}/ledger/epoch={e}       one row per batch

Every epoch overwrites its own folders, so an epoch that runs again after a
failure leaves the same files and is counted once.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators import ingest as ing
from shelfmark.operators import registry as rg
from shelfmark.operators import sessions as ss
from shelfmark.operators import writes as wr
from shelfmark.plans.numbering import number_rows
from shelfmark.plans.publish import AuditFailed, BlueGreenCatalog, DeploymentState
from shelfmark.schema import EXTRA, PRODUCT
from shelfmark.sources import products as src


class LoadSession:
    """One load into a new version of an alias."""

    def __init__(
        self,
        catalog: BlueGreenCatalog,
        alias: str,
        strategy: str = rg.SAFE,
        estimated_total: int | None = None,
        batch_size: int | None = None,
        schema: T.StructType = PRODUCT,
        session: str | None = None,
    ):
        if strategy not in rg.STRATEGIES:
            raise ValueError(f"Unknown strategy {strategy!r}; use one of {', '.join(rg.STRATEGIES)}")
        self.catalog, self.alias, self.strategy = catalog, alias, strategy
        self.schema = schema
        self.batch_size = ing.loader_batch_size(batch_size)
        self.session = session or f"product_batch_{uuid.uuid4().hex}"
        self.path = f"{catalog.files.root}/{alias}/sessions/{self.session}"
        if not catalog.files.exists(f"{self.path}/ledger"):
            self._note("start", estimated_total=estimated_total)

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark

    # --- ledger ------------------------------------------------------------------------------

    def _note(self, event: str, **values: object) -> None:
        row = {f.name: None for f in ss.LEDGER.fields}
        row.update(
            session=self.session,
            event=event,
            at=dt.datetime.now(dt.timezone.utc),
            alias=self.alias,
            strategy=self.strategy,
            **values,
        )
        one = self.spark.createDataFrame([tuple(row.values())], ss.LEDGER)
        one.coalesce(1).write.mode("overwrite").json(f"{self.path}/ledger/epoch={event}")

    def ledger(self) -> DataFrame:
        rows = self.spark.read.schema(ss.LEDGER).option("recursiveFileLookup", True)
        return rows.json(f"{self.path}/ledger")

    def status(self, idle_check: bool = True) -> DataFrame:
        return ss.session_status(self.ledger(), F.current_timestamp() if idle_check else None)

    def _recent(self, epoch: int) -> DataFrame:
        """Of the ledger what decides whether the session is open: its ends and the epoch before."""
        names = [e for e in ("start", "complete", "fail", "cancel", str(epoch - 1)) if self.catalog.files.exists(f"{self.path}/ledger/epoch={e}")]
        return self.spark.read.schema(ss.LEDGER).json([f"{self.path}/ledger/epoch={e}" for e in names])

    def _require_active(self, epoch: int | None = None) -> None:
        ledger = self.ledger() if epoch is None else self._recent(epoch)
        row = ss.session_status(ledger, F.current_timestamp()).select("status").first()
        if row is None or row["status"] == ss.EXPIRED:
            raise LookupError(f"Session {self.session} not found or expired")
        if row["status"] != ss.ACTIVE:
            raise ValueError(f"Session {self.session} is not active (status: {row['status']})")

    # --- loading -----------------------------------------------------------------------------

    def process(self, lines: DataFrame, epoch: int = 0) -> None:
        """Store one micro-batch of JSON lines.

        Rows are numbered and cut into batches. A batch in which an id occurs twice
        is refused as a whole; a row that cannot be parsed is set aside alone.
        """
        self._require_active(epoch)
        # files count in the order of their time and name, whatever their size
        order = src.PLACE if src.SOURCE in lines.columns else ()
        placed = src.placed(lines) if order else lines
        numbered = number_rows(placed.select("value", *order), order, name="_n").drop(*order).withColumn(
            "batch", F.floor((F.col("_n") - 1) / self.batch_size) + 1
        )
        parsed = src.parse_lines(numbered, self.schema)
        # only a row that is set aside keeps its text
        parsed = parsed.withColumn("document", F.when(F.col("error").isNotNull(), F.col("document")))
        keyed = parsed.withColumn(
            "id",
            ing.derive_id(F.col("id"), F.col("RecordId"), F.lit(self.session), F.lit(epoch), "batch", "_n"),
        ).persist()
        try:
            # every id counts, also that of a row with an error in another field
            twice = ing.duplicate_ids(keyed, ["batch"])
            twice.write.mode("overwrite").parquet(f"{self.path}/duplicates/epoch={epoch}")
            repeated = twice.groupBy("batch").agg(F.sum("copies").alias("copies"))
            fine = keyed.join(repeated, "batch", "left_anti")
            good, bad = ing.split_outcomes(fine)
            stored = [f.name for f in self.schema.fields] + [EXTRA]
            good.select(*stored, "batch", F.col("_n").alias("pos")).write.mode("overwrite").parquet(
                f"{self.path}/accepted/epoch={epoch}"
            )
            bad.select("batch", F.col("_n").alias("pos"), "document", "error.*").write.mode(
                "overwrite"
            ).parquet(f"{self.path}/rejected/epoch={epoch}")
            counts = ing.reconcile(keyed, ["batch"]).join(repeated, "batch", "left")
            refused = F.col("copies").isNotNull()
            zero = F.lit(0).cast("bigint")
            rows = counts.select(
                F.lit(self.session).alias("session"),
                F.when(refused, "error").otherwise("batch").alias("event"),
                (F.lit(epoch).cast("bigint") * 1_000_000_000 + F.col("batch")).alias("batch"),
                F.lit(1).alias("attempt"),
                F.current_timestamp().alias("at"),
                "input",
                F.when(refused, zero).otherwise(F.col("successful")).alias("successful"),
                F.when(refused, zero).otherwise(F.col("failed")).alias("failed"),
                F.when(
                    refused,
                    F.concat(
                        F.lit("Duplicate document IDs detected in batch: "), F.col("copies").cast("string")
                    ),
                ).alias("message"),
            )
            rows.write.mode("overwrite").json(f"{self.path}/ledger/epoch={epoch}")
        finally:
            keyed.unpersist()

    def run(self, lines: DataFrame, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
        """Drive ``process`` from a stream of lines; the checkpoint lets it resume."""
        writer = lines.writeStream.foreachBatch(lambda df, epoch: self.process(df, epoch)).option(
            "checkpointLocation", checkpoint or f"{self.path}/checkpoint"
        )
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def accepted(self) -> DataFrame:
        if not self.catalog.files.exists(f"{self.path}/accepted"):
            places = [T.StructField(n, T.LongType()) for n in ("batch", "pos", "epoch")]
            extra = [T.StructField(EXTRA, T.VariantType())]
            return self.spark.createDataFrame([], T.StructType(self.schema.fields + extra + places))
        return self.spark.read.parquet(f"{self.path}/accepted")

    def duplicates(self) -> DataFrame:
        """The repeated ids of refused batches: ``batch, id, copies, epoch``."""
        return self.spark.read.schema("batch long, id string, copies long, epoch long").parquet(f"{self.path}/duplicates")

    def rejected(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rejected")

    # --- ending ------------------------------------------------------------------------------

    def complete(self) -> DeploymentState:
        """Merge the accepted rows by id, audit against their distinct ids, stage or publish."""
        self._require_active()
        rows = self.accepted()
        expected = rows.agg(F.count_distinct("id")).first()[0]
        kept = [c for c in rows.columns if c not in ("epoch", "batch", "pos")]
        last = wr.latest(rows, ["epoch", "pos"], columns=kept)
        try:
            state = self.catalog.deploy(
                self.alias, last, self.strategy, expected=expected, unique=True, schema=self.schema
            )
        except AuditFailed as e:
            self._note("fail", message=str(e))
            raise
        self._note("complete", version=state.staging_version or state.active_version)
        return state

    def cancel(self) -> None:
        """Give an active load up: its accepted rows are deleted, its ledger and rejects stay."""
        self._require_active()
        self._note("cancel")
        self.catalog.files.delete(f"{self.path}/accepted")


def load_and_publish(
    catalog: BlueGreenCatalog,
    alias: str,
    folder: str,
    strategy: str = rg.SAFE,
    files_per_batch: int = 100,
    batch_size: int | None = None,
    estimated_total: int | None = None,
    schema: T.StructType = PRODUCT,
) -> tuple[LoadSession, DeploymentState]:
    """Start, load all files of a folder, complete, and promote.

    A failure before completion cancels the session; one after it leaves the staged version.
    """
    session = LoadSession(catalog, alias, strategy, estimated_total, batch_size, schema)
    try:
        lines = src.stream_lines(catalog.spark, folder, files_per_batch)
        session.run(lines).awaitTermination()
        state = session.complete()
    except Exception:
        # a load that failed its audit is closed already; what it stored is evidence
        if session.status().select("status").first()["status"] == ss.ACTIVE:
            session.cancel()
        raise
    if strategy != rg.AUTO_SWAP and state.staging_color:
        state = catalog.swap(alias, state.staging_color)
    return session, state


def all_sessions(catalog: BlueGreenCatalog, alias: str) -> DataFrame:
    """The ledgers of all load sessions of an alias, for ``session_status`` and ``active_sessions``."""
    if not catalog.files.exists(f"{catalog.files.root}/{alias}/sessions"):
        return catalog.spark.createDataFrame([], ss.LEDGER)
    rows = catalog.spark.read.schema(ss.LEDGER).option("recursiveFileLookup", True)
    return rows.json(f"{catalog.files.root}/{alias}/sessions/*/ledger")


def purge_expired(catalog: BlueGreenCatalog, alias: str, now: Column | None = None) -> list[str]:
    """Delete the rows of sessions that went idle and were never completed; ledgers stay."""
    moment = F.current_timestamp() if now is None else now
    ledger = all_sessions(catalog, alias)
    open_ones = ss.active_sessions(ledger).select("session")
    idle = ss.session_status(ledger, moment).filter(F.col("status") == ss.EXPIRED)
    gone = [r["session"] for r in idle.join(open_ones, "session", "left_semi").select("session").collect()]
    for session in gone:
        catalog.files.delete(f"{catalog.files.root}/{alias}/sessions/{session}/accepted")
    return gone


def closed_sessions(batches: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of batches, given out once idle time and watermark have passed.

    Sessions are merged in each task before the shuffle, so a key with very many
    batches sends a few rows.
    """
    batches.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        batches.withWatermark(ts, late)
        .groupBy(F.session_window(ts, f"{ss.IDLE_SECONDS} seconds"), F.col(key))
        .agg(F.count(F.lit(1)).alias("batches"), F.min(ts).alias("opened"), F.max(ts).alias("last_batch_at"))
        .select(key, "opened", "last_batch_at", "batches", F.lit(ss.EXPIRED).alias("status"))
    )
