"""Files of a catalog: version folders and the registry log.

    {root}/{alias}/version={v}/data        rows of one version (Parquet), in ranges of ids
    {root}/{alias}/version={v}/facets      long facet rows, sorted by facet
    {root}/{alias}/version={v}/changes     changes made since, merged when the version is read
    {root}/{alias}/registry/{seq}.json     one publish event per file
    {root}/{alias}/registry/checkpoint-{seq}.json    the events up to that one

The log is the truth. Each entry takes the next number with an exclusive create,
so of two writers that saw the same state one fails.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.registry import REGISTRY


#: Events after which all so far are put in one file.
CHECKPOINT_EVERY = 100
CHECKPOINT = "checkpoint-"


class ConcurrentPublish(RuntimeError):
    """Another writer took the same place in the registry."""


class CatalogFiles:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._jvm = spark._jvm

    def version_path(self, alias: str, version: str) -> str:
        return f"{self.root}/{alias}/version={version}"

    def data_path(self, alias: str, version: str) -> str:
        return f"{self.version_path(alias, version)}/data"

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.delete(p, True)

    def new_version(self) -> str:
        """A name no other version has: 17 digits of time, then a random part."""
        now = dt.datetime.now(dt.timezone.utc)
        return f"{now:%Y%m%d%H%M%S}{now.microsecond // 1000:03d}-{uuid.uuid4().hex[:8]}"

    def _log(self, alias: str) -> str:
        return f"{self.root}/{alias}/registry"

    def last_seq(self, alias: str) -> int:
        fs, p = self._fs(self._log(alias))
        if not fs.exists(p):
            return 0
        return max((int(n[:-5]) for n in self._names(p, fs) if n[0].isdigit()), default=0)

    @staticmethod
    def _names(p, fs) -> list[str]:
        return [n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(".json")]

    def registry(self, alias: str) -> DataFrame:
        """All events of an alias; an entry that was cut off while being written raises when read.

        The latest checkpoint and the entries after it, so that the number of files stays
        small. One row per publish action of one alias: a single partition saves the shuffles.
        """
        log = self._log(alias)
        if not self.exists(log):
            return self.spark.createDataFrame([], REGISTRY)
        fs, p = self._fs(log)
        names = sorted(self._names(p, fs))
        marks = [n for n in names if n.startswith(CHECKPOINT)]
        done = int(marks[-1][len(CHECKPOINT) : -5]) if marks else 0
        paths = [f"{log}/{n}" for n in [*marks[-1:], *(n for n in names if n[0].isdigit() and int(n[:-5]) > done)]]
        rows = self.spark.read.schema(REGISTRY).option("mode", "FAILFAST").json(paths).coalesce(1)
        return rows.withColumn(
            "seq", F.coalesce("seq", F.raise_error(F.lit(f"Registry of '{alias}' holds a broken entry")).cast("bigint"))
        )

    def record(
        self,
        alias: str,
        action: str,
        version: str,
        color: str | None,
        strategy: str | None = None,
        label: str | None = None,
        seen: int | None = None,
    ) -> int:
        """Add an event after the last one the caller has ``seen``."""
        seq = (self.last_seq(alias) if seen is None else seen) + 1
        entry = {
            "seq": seq,
            "alias": alias,
            "action": action,
            "version": version,
            "color": color,
            "at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="milliseconds"),
            "strategy": strategy,
            "label": label,
        }
        self.write_once(f"{self._log(alias)}/{seq:020d}.json", json.dumps(entry))
        if seq % CHECKPOINT_EVERY == 0:
            self._checkpoint(alias, seq)
        return seq

    def _checkpoint(self, alias: str, seq: int) -> None:
        """All events up to ``seq`` in one file, which appears whole; readers take it and what came later."""
        lines = self.registry(alias).filter(F.col("seq") <= seq).orderBy("seq").toJSON().collect()
        path = f"{self._log(alias)}/{CHECKPOINT}{seq:020d}.json"
        draft = f"{path}.{uuid.uuid4().hex}"
        self.write_once(draft, "\n".join(lines))
        fs, p = self._fs(draft)
        if not fs.rename(p, self._fs(path)[1]):  # another writer has made it
            fs.delete(p, False)

    def write_once(self, path: str, line: str) -> None:
        """A new file with one line; if it exists, another writer was first."""
        fs, p = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise ConcurrentPublish(f"Another writer made {path}") from e
        try:
            out.write(bytearray((line + "\n").encode()))
        finally:
            out.close()

    def read_all(self, folder: str) -> list[str]:
        """The texts of the JSON entries of a folder, which is kept small."""
        fs, p = self._fs(folder)
        if not fs.exists(p):
            return []
        paths = [str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")]
        return [r[0] for r in self.spark.read.text(paths, wholetext=True).collect()] if paths else []
