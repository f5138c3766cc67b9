"""Blue/green publishing: write a version, audit it, point the alias at it, go back, clean up."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import scalar as sc
from shelfmark.functions.scalar import BLUE, GREEN
from shelfmark.operators import changes as ch
from shelfmark.operators import ingest as ing
from shelfmark.operators import registry as rg
from shelfmark.operators import reports as rp
from shelfmark.operators import writes as wr
from shelfmark.operators.relevance import search_fields
from shelfmark.plans import side_tables as st
from shelfmark.plans.changes import OPEN, SEAL, ChangeLog, Sealed
from shelfmark.plans.search import SearchResult, criteria_search, text_search
from shelfmark.plans.store import CatalogFiles, ConcurrentPublish
from shelfmark.schema import PRODUCT, CatalogSchema, describe
from shelfmark.sources import products as src

WARMING = "warming"
STAGE_ATTEMPTS = 5
CHANGE_ATTEMPTS = 5
#: Batches of changes beside a version, after which a further one merges them into a new version.
COMPACT_AFTER = 100
#: Ids that may stand in a filter as literals.
FEW_IDS = 1000
#: Asks for a text index of every field that a search without a field list covers.
ALL_FIELDS = "*"


class AuditFailed(RuntimeError):
    """A staged version did not pass its checks."""


@dataclass(frozen=True)
class DeploymentState:
    alias: str
    active_color: str | None = None
    active_version: str | None = None
    staging_color: str | None = None
    staging_version: str | None = None
    status: str = rg.IDLE
    last_deployment: dt.datetime | None = None
    strategy: str = rg.SAFE


def _named(alias: str, what: str = "Alias name") -> str:
    if not isinstance(alias, str) or not alias.strip():
        raise ValueError(f"{what} must be specified")
    return alias.strip()


class BlueGreenCatalog:
    """Versions of product tables under one folder, and the pointers readers follow."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id", compact_after: int = COMPACT_AFTER):
        self.spark = spark
        self.files = CatalogFiles(spark, root)
        self.key = key
        self.compact_after = compact_after

    # --- pointers and versions ---------------------------------------------------------------

    def status(self, alias: str) -> DeploymentState:
        """The state of an alias; one that is not known is idle."""
        row = rg.deployment_status(self.files.registry(_named(alias))).first()
        if row is None:
            return DeploymentState(alias)
        return DeploymentState(
            alias,
            row["active_color"],
            row["active_version"],
            row["staging_color"],
            row["staging_version"],
            row["status"],
            row["last_deployment"],
        )

    def alias_exists(self, alias: str) -> bool:
        return self.status(alias).active_version is not None

    def versions(self, alias: str) -> DataFrame:
        """Versions of an alias that were not dropped."""
        return rg.versions(self.files.registry(_named(alias))).filter("not dropped")

    def version_exists(self, alias: str, version: str) -> bool:
        return not self.versions(alias).filter(F.col("version") == version).isEmpty()

    def resolve(self, alias: str, version: str | None = None) -> str:
        """An explicit version, else the active one."""
        if version and version.strip():
            return version
        active = self.status(alias).active_version
        if active is None:
            raise LookupError(f"Alias '{alias}' does not exist")
        return active

    def table(self, alias: str, version: str | None = None) -> DataFrame:
        """The rows of a version as the changes made since leave them."""
        found = self.resolve(alias, version)
        return self.changes(alias, found).merged(self._stored(alias, found))

    def changes(self, alias: str, version: str) -> ChangeLog:
        return ChangeLog(self.spark, self.files, self.files.version_path(alias, version), self.key)

    def _stored(self, alias: str, version: str) -> DataFrame:
        return self.spark.read.parquet(self.files.data_path(alias, version))

    def view(self, alias: str) -> str:
        """A temporary view of the active version for SQL in this session."""
        name = alias.replace("-", "_").replace(".", "_")
        self.table(alias).createOrReplaceTempView(name)
        return name

    # --- searches of the active version ------------------------------------------------------

    def search_criteria(
        self, alias: str, criteria: Mapping[str, Any], aggs: Sequence[str] | None = None, **options: Any
    ) -> SearchResult:
        """Structured search; facets read the stored long form."""
        active = self.resolve(alias)
        path = f"{self.files.version_path(alias, active)}/facets"
        pending = self.changes(alias, active).entries()
        stored = st.read_facets(self.spark, path, aggs) if aggs and not pending and self.files.exists(path) else None
        return criteria_search(
            self.table(alias, active), criteria, aggs=aggs, facet_table=stored, **options
        )

    def search_text(
        self,
        alias: str,
        query: str,
        fields: Sequence[str] | None = None,
        highlight: bool = True,
        **options: Any,
    ) -> SearchResult:
        """Ranked search; uses the stored text index when it covers the fields."""
        active = self.resolve(alias)
        log = self.changes(alias, active)
        entries, base = log.entries(), self._stored(alias, active)
        rows = log.merged(base, entries)
        path = f"{self.files.version_path(alias, active)}/text"
        index = None
        if self.files.exists(path):
            schema = CatalogSchema.of(rows)
            stored = {r["field"] for r in self.spark.read.parquet(f"{path}/stats").collect()}
            if stored >= {p.name for p in search_fields(schema, fields)}:
                index = st.read_text_index(self.spark, path, schema, fields)
                changes = log.rows(base, entries)
                if changes is not None:
                    ids = changes.select(F.col(self.key).alias("id")).distinct()
                    old, new = (self._only(df, ids) for df in (base, rows))
                    index = st.extended(index, ids, old, new, schema, fields)
        return text_search(rows, query, fields, highlight=highlight, index=index, **options)

    def _only(self, rows: DataFrame, ids: DataFrame) -> DataFrame:
        """The rows of those ids; few ids are literals, which skip files of others."""
        few = ids.limit(FEW_IDS + 1).collect()
        if len(few) <= FEW_IDS:
            return rows.filter(F.col(self.key).isin([r["id"] for r in few]))
        return rows.join(ids, rows[self.key] == ids["id"], "left_semi")

    def get(self, alias: str, product_id: str | int) -> Row | None:
        """One product by id, else by record number, else nothing.

        The id is a literal in the filter, so files and row groups of other ids are skipped.
        """
        rows, asked = self.table(alias), str(product_id)
        found = rows.filter(F.col(self.key) == asked).first()
        number = sc.numeric_key(F.lit(asked))
        if found is None and "RecordId" in rows.columns:
            value = self.spark.range(1).select(number.alias("n")).first()["n"]
            found = None if value is None else rows.filter(F.col("RecordId") == value).sort(self.key).first()
        return found

    def schema_of(self, alias: str) -> DataFrame:
        """Path, type and kind of every field of the active version."""
        return describe(self.spark, CatalogSchema.of(self.table(alias)))

    def count(self, alias: str, version: str | None = None) -> int:
        return self.table(alias, version).count()

    def stats(self, alias: str, version: str | None = None) -> DataFrame:
        """Documents as readers see them, files, bytes, and the health that the audit finds."""
        found = self.resolve(alias, version)
        stored = self._stored(alias, found)
        out = rp.version_stats(stored, rg.health(rg.audit(stored, key=self.key)))
        if self.changes(alias, found).entries():
            out = out.withColumn("documents", F.lit(self.count(alias, found)).cast("bigint"))
        return out

    # --- staging -----------------------------------------------------------------------------

    def create_version(self, alias: str, version: str, color: str, label: str | None = None) -> str:
        """An empty version with the product schema; one that exists is refused."""
        if self.files.exists(self.files.version_path(_named(alias), version)):
            raise ValueError(f"Index '{version}' already exists")
        empty = self.spark.createDataFrame([], PRODUCT)
        empty.write.mode("errorifexists").parquet(self.files.data_path(alias, version))
        self.files.record(alias, rg.STAGE, version, color, label=label)
        return version

    def create_warming_version(self, alias: str) -> str:
        """An empty version of the next colour, labelled as warming."""
        return self.create_version(
            alias, self.files.new_version(), self._next_color(self.status(alias)), WARMING
        )

    @staticmethod
    def _next_color(state: DeploymentState, strategy: str = rg.SAFE) -> str:
        if strategy == rg.BLUE_ONLY:
            return BLUE
        if strategy == rg.GREEN_ONLY:
            return GREEN
        return GREEN if state.active_color == BLUE else BLUE

    def keyed(
        self, products: DataFrame, order_by: Sequence[str] = (), unique: bool = False
    ) -> DataFrame:
        """Products with their id, the last of each id kept.

        Rows read from files count in the order of their place there. A frame without
        such a place has no last row: name ``order_by``, or its ids must not repeat.
        ``unique`` says that no id repeats. The audit checks both.
        """
        products = src.without_errors(products)
        given = F.col(self.key) if self.key in products.columns else F.lit(None).cast("string")
        number = F.col("RecordId") if "RecordId" in products.columns else F.lit(None).cast("bigint")
        df = products.withColumn(self.key, ing.derive_id(given, number))
        df = ing.require_id(df, self.key)
        if unique:
            return df
        if order_by:
            return wr.latest(df, order_by, self.key)
        if src.SOURCE in df.columns:
            kept = [c for c in df.columns if c != src.SOURCE]
            return wr.latest(src.placed(df), src.PLACE, self.key, kept)
        return df

    def _write(self, alias: str, rows: DataFrame) -> tuple[str, int]:
        """Write a version in the order of its key, and count what was written.

        Files that hold a range of keys each let a read of one key skip all others.
        """
        version, seen = self.files.new_version(), Observation()
        # counted behind the sort: finding the ranges reads the rows once more
        ordered = rows.repartitionByRange(self.key).sortWithinPartitions(self.key)
        ordered.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(
            self.files.data_path(alias, version)
        )
        return version, seen.get["n"]

    def _audit(
        self, alias: str, version: str, written: int, expected: int | None, minimum: int | None, schema: T.StructType | None
    ) -> DataFrame:
        """What is stored has to be what was written, of the declared types, and enough of it."""
        stored = self.spark.read.parquet(self.files.data_path(alias, version))
        report = rg.audit(
            stored, expected, minimum, [f.name for f in schema.fields] if schema else None, self.key, schema or PRODUCT, written
        )
        if not rg.passed(report):
            failed = [r["check"] for r in report.filter("severity = 'fail' and not passed").collect()]
            raise AuditFailed(f"Version {version} of '{alias}' failed validation: {', '.join(failed)}")
        return report

    def deploy(
        self,
        alias: str,
        products: DataFrame,
        strategy: str = rg.SAFE,
        enrich: wr.Enrich | None = None,
        keep: Callable[[DataFrame], Column] | None = None,
        order_by: Sequence[str] = (),
        expected: int | None = None,
        minimum: int | None = None,
        color: str | None = None,
        unique: bool = False,
        text_fields: Sequence[str] | str | None = ALL_FIELDS,
        schema: T.StructType | None = None,
        base: str | None = None,
        take_over: Callable[[str], None] | None = None,
    ) -> DeploymentState:
        """Stage a new version; with ``auto-swap`` also publish it.

        The audit runs on the written files before anything points at them: declared
        fields must have their declared types, and with ``schema`` all its fields must
        be there. The property map is also stored in long form, and a text index of
        ``text_fields``: all that a search covers, those listed, or with None no index. ``base`` is the version the rows were made
        from; if another one is active by then, ``ConcurrentPublish`` is raised.
        ``take_over`` is called with the new version just before it is published.
        """
        _named(alias)
        if products is None:
            raise ValueError("Products array is required")
        if strategy not in rg.STRATEGIES:
            raise ValueError(f"Unknown strategy {strategy!r}; use one of {', '.join(rg.STRATEGIES)}")
        rows = products.filter(keep(products)) if keep else products
        rows = wr.load_enriched(rows, enrich)
        version, written = self._write(alias, self.keyed(rows, order_by, unique))
        try:
            self._audit(alias, version, written, expected, minimum, schema)
        except AuditFailed:
            self.files.delete(self.files.version_path(alias, version))
            raise
        if "DefaultProductProperties" in rows.columns:
            stored = self.spark.read.parquet(self.files.data_path(alias, version))
            st.write_facets(stored, f"{self.files.version_path(alias, version)}/facets")
        stored = self._stored(alias, version)
        if text_fields == ALL_FIELDS:
            text_fields = [p.name for p in search_fields(CatalogSchema.of(stored), None)]
        if text_fields:
            st.write_text_index(stored, f"{self.files.version_path(alias, version)}/text", text_fields)
        try:
            before, target, seq = self._stage(alias, version, color, strategy, base)
        except ConcurrentPublish:
            self.files.delete(self.files.version_path(alias, version))
            raise
        if strategy == rg.AUTO_SWAP:
            try:
                if take_over:
                    take_over(version)
                self.files.record(alias, rg.PUBLISH, version, target, strategy, seen=seq)
            except ConcurrentPublish:
                # another writer came between: the version was never published, take it back
                self.files.record(alias, rg.DROP, version, target)
                self.files.delete(self.files.version_path(alias, version))
                raise
            return DeploymentState(
                alias, target, version, None, None, rg.DONE, dt.datetime.now(dt.timezone.utc), strategy
            )
        return replace(
            before,
            staging_color=target,
            staging_version=version,
            status=rg.READY,
            strategy=strategy,
        )

    def _stage(
        self, alias: str, version: str, color: str | None, strategy: str, base: str | None = None
    ) -> tuple[DeploymentState, str, int]:
        """Enter a written version; a writer that came between is looked at, then it is tried again.

        With a ``base`` the version is entered only while that one is active.
        """
        for attempt in range(STAGE_ATTEMPTS):
            seen = self.files.last_seq(alias)
            before = self.status(alias)
            if base is not None and before.active_version != base:
                raise ConcurrentPublish(f"'{alias}' no longer points at {base}")
            target = color or self._next_color(before, strategy)
            try:
                seq = self.files.record(alias, rg.STAGE, version, target, strategy, seen=seen)
                return before, target, seq
            except ConcurrentPublish:
                if attempt == STAGE_ATTEMPTS - 1:
                    raise
        raise AssertionError

    def deploy_filtered(
        self,
        alias: str,
        products: DataFrame,
        keep: Callable[[DataFrame], Column],
        strategy: str = rg.SAFE,
        **options: Any,
    ) -> DeploymentState:
        if keep is None:
            raise ValueError("Filter predicate is required")
        return self.deploy(alias, products, strategy, keep=keep, **options)

    def initialise(
        self, alias: str, products: DataFrame, color: str = BLUE, **options: Any
    ) -> DeploymentState:
        """First version of a new alias: staged, audited, then published."""
        if self.alias_exists(alias):
            raise ValueError(
                f"Alias '{alias}' already exists; deploy adds a version to it"
            )
        staged = self.deploy(alias, products, color=color, **options)
        self.swap(alias, color)
        return replace(
            staged,
            active_color=color,
            active_version=staged.staging_version,
            staging_color=None,
            staging_version=None,
            status=rg.DONE,
        )

    def workflow(
        self,
        alias: str,
        products: DataFrame,
        auto_promote: bool = False,
        enrich: wr.Enrich | None = None,
        keep: Callable[[DataFrame], Column] | None = None,
        **options: Any,
    ) -> DeploymentState:
        """Filter, then initialise a new alias or deploy to an existing one."""
        if not self.alias_exists(_named(alias)):
            color = GREEN if auto_promote else BLUE
            return self.initialise(alias, products, color, enrich=enrich, keep=keep, **options)
        strategy = rg.AUTO_SWAP if auto_promote else rg.SAFE
        return self.deploy(alias, products, strategy, enrich, keep, **options)

    # --- publishing --------------------------------------------------------------------------

    def swap(self, alias: str, color: str) -> DeploymentState:
        """Publish the staged version; the colour has to be the staged one."""
        seen = self.files.last_seq(_named(alias))
        state = self.status(alias)
        if state.staging_version is None:
            raise ValueError(f"No staging index available for alias {alias}")
        if state.staging_color != color:
            raise ValueError(
                f"Target color {color} does not match staging color {state.staging_color}"
            )
        self.files.record(alias, rg.PUBLISH, state.staging_version, color, seen=seen)
        return self.status(alias)

    def publish_version(self, alias: str, version: str, delete_old: bool = False) -> DeploymentState:
        """Publish by name; the version has to exist. Old versions go after the pointer moved."""
        _named(version, "New index name")
        seen = self.files.last_seq(_named(alias))
        known = self.versions(alias).filter(F.col("version") == version).first()
        if known is None:
            raise LookupError(f"Index '{version}' does not exist")
        self.files.record(alias, rg.PUBLISH, version, known["color"], seen=seen)
        self.reopen(alias)
        if delete_old:
            waiting = self.status(alias).staging_version
            for row in self.versions(alias).filter(F.col("version") != version).collect():
                if row["version"] != waiting:
                    self.drop_version(alias, row["version"])
        return self.status(alias)

    create_alias = publish_version

    def rollback(self, alias: str) -> DeploymentState:
        """Point back at the version that was published before."""
        seen = self.files.last_seq(_named(alias))
        if self.status(alias).active_version is None:
            raise ValueError(f"No active index to rollback to for alias {alias}")
        target = rg.rollback_target(self.files.registry(alias)).first()
        if target is None:
            raise ValueError(f"No previous index found for rollback of alias {alias}")
        self.files.record(alias, rg.ROLLBACK, target["version"], target["color"], seen=seen)
        self.reopen(alias)
        return self.status(alias)

    def cleanup(self, alias: str, keep_last: int = 1) -> list[str]:
        """Delete versions nothing needs any more; returns their names."""
        gone = [
            r["version"]
            for r in rg.cleanup_candidates(self.files.registry(_named(alias)), keep_last).collect()
        ]
        for version in gone:
            self.drop_version(alias, version)
        return gone

    def drop_version(self, alias: str, version: str) -> None:
        """Take a version out of the registry, then delete its files.

        The entry is only made if nobody published since the version was found idle.
        """
        seen = self.files.last_seq(alias)
        if self.status(alias).active_version == version:
            raise ValueError(f"Version {version} is active and cannot be dropped")
        known = self.versions(alias).filter(F.col("version") == version).first()
        if known is None:
            raise LookupError(f"Index '{version}' does not exist")
        self.files.record(alias, rg.DROP, version, known["color"], seen=seen)
        self.files.delete(self.files.version_path(alias, version))

    # --- health ------------------------------------------------------------------------------

    def healthy(self, alias: str, version: str | None = None) -> bool:
        """Whether a version exists and its audit passes."""
        try:
            found = self.resolve(alias, version)
        except LookupError:
            return False
        if not self.files.exists(self.files.data_path(alias, found)):
            return False
        stored = self.spark.read.parquet(self.files.data_path(alias, found))
        return rg.passed(rg.audit(stored, key=self.key))

    # --- keyed changes to a published table --------------------------------------------------

    def change(
        self, alias: str, how: Callable[[DataFrame], DataFrame], strategy: str = rg.AUTO_SWAP
    ) -> DeploymentState:
        """A new version from the active one: ``how`` is an upsert, a patch or a delete of many rows.

        If another writer publishes meanwhile, ``how`` is applied to its version
        instead, so no change is lost; changes entered beside the old version while the
        new one was written are carried over. The text index keeps its fields.
        """
        for attempt in range(CHANGE_ATTEMPTS):
            base = self.resolve(alias)
            log = self.changes(alias, base)
            entries = log.entries()
            seen = entries[-1].seq if entries else 0
            sealed = False

            def take_over(version: str) -> None:
                nonlocal sealed
                log.mark(SEAL)
                sealed = True
                log.copy_to(self.changes(alias, version), self._stored(alias, base), seen)

            try:
                return self.deploy(
                    alias,
                    how(log.merged(self._stored(alias, base), entries)),
                    strategy,
                    unique=True,
                    base=base,
                    text_fields=self._indexed_fields(alias, base),
                    take_over=take_over,
                )
            except Exception as failed:
                if sealed:
                    log.mark(OPEN)
                if not isinstance(failed, ConcurrentPublish) or attempt == CHANGE_ATTEMPTS - 1:
                    raise
        raise AssertionError

    def compact(self, alias: str) -> DeploymentState:
        """Merge the changes beside the active version into a new one, and publish that."""
        return self.change(alias, lambda rows: rows)

    def reopen(self, alias: str) -> None:
        """Let the active version take changes again, after a writer died while it was replacing it."""
        self.changes(alias, self.resolve(alias)).mark(OPEN)

    def write_changes(
        self,
        alias: str,
        upserts: DataFrame | None = None,
        patches: DataFrame | None = None,
        deletes: DataFrame | None = None,
        order: str | None = None,
    ) -> int:
        """Enter a batch of changes beside the active version; writes nothing but their rows.

        Whole documents have to have ids that do not repeat, or a place in their files;
        ``patches`` have the id and a variant ``patch``, and ``order`` names a whole-number
        column that orders those of one id. Readers merge the batch from then on. Returns
        its number.
        """
        keyed = None if upserts is None else self.keyed(upserts)
        given = {ch.UPSERT: keyed, ch.PATCH: patches, ch.DELETE: deletes}
        ops = tuple(op for op, rows in given.items() if rows is not None)
        if not ops:
            raise ValueError("Changes are required")
        for attempt in range(CHANGE_ATTEMPTS):
            active = self.resolve(alias)
            stored = self._stored(alias, active)
            try:
                seq = self.changes(alias, active).append(
                    lambda n: ch.change_rows(stored, n, keyed, patches, deletes, self.key, order=order), ops
                )
                break
            except Sealed:
                # another version is taking over, or has just done so
                if attempt == CHANGE_ATTEMPTS - 1 or self.resolve(alias) == active:
                    raise
        if seq >= self.compact_after:
            self.compact(alias)
        return seq

    def _indexed_fields(self, alias: str, version: str) -> list[str] | None:
        path = f"{self.files.version_path(alias, version)}/text/stats"
        if not self.files.exists(path):
            return None
        return sorted(r["field"] for r in self.spark.read.parquet(path).select("field").distinct().collect())

    def _result(self, alias: str, document_id: str) -> str:
        """What a write of one id does; the id is a literal, so files of other ids are skipped."""
        return "created" if self.table(alias).filter(F.col(self.key) == document_id).isEmpty() else "updated"

    def index_one(self, alias: str, document: DataFrame) -> str:
        """Store one document under its id; says whether it was created or updated."""
        if document is None:
            raise ValueError("Document is required")
        keyed = self.keyed(document)
        found = keyed.select(self.key).first()
        if found is None:
            raise ValueError("Document is required")
        result = self._result(alias, found[0])
        self.write_changes(alias, upserts=keyed)
        return result

    def update(self, alias: str, document_id: str | int, patch_json: str) -> str:
        """Apply a partial document, inserting it when the id is new."""
        found = _named(str(document_id), "Document ID")
        if not patch_json:
            raise ValueError("Document is required")
        one = self.spark.createDataFrame([(found, patch_json)], "_k string, _t string")
        patches = one.select(F.col("_k").alias(self.key), F.parse_json("_t").alias("patch"))
        fault = wr.patch_errors(patches, self._stored(alias, self.resolve(alias)).schema, self.key).first()
        if fault is not None:
            raise ValueError(fault["reason"])
        result = self._result(alias, found)
        self.write_changes(alias, patches=patches)
        return result

    def delete(self, alias: str, document_id: str | int) -> None:
        """Remove one document; an unknown id is an error."""
        found = _named(str(document_id), "Document ID")
        if self._result(alias, found) == "created":
            raise LookupError(f"Error deleting document {found} from '{alias}': not found")
        self.write_changes(alias, deletes=self.spark.createDataFrame([(found,)], f"{self.key} string"))
