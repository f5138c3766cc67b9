"""Change files of a version, and the log that says which of them count, in which order.

    {version}/changes/log/{seq}.json     one entry per batch of changes, made with an exclusive create
    {version}/changes/rows/{name}        the rows of a batch (Parquet)

Rows are written first and count once their entry is there, so a writer that fails leaves
nothing behind that is read. An entry ``seal`` closes the log while another version takes
over; a later ``open`` opens it again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators import changes as ch
from shelfmark.plans.store import CatalogFiles, ConcurrentPublish

SEAL, OPEN = "seal", "open"


class Sealed(ConcurrentPublish):
    """The version is being replaced and takes no more changes."""


@dataclass(frozen=True)
class Entry:
    seq: int
    ops: tuple[str, ...]
    name: str | None = None


class ChangeLog:
    def __init__(self, spark: SparkSession, files: CatalogFiles, version_path: str, key: str = "id"):
        self.spark, self.files, self.key = spark, files, key
        self.path = f"{version_path}/changes"

    def entries(self) -> list[Entry]:
        """All entries in order. Their number is bounded by compaction."""
        rows = [json.loads(text) for text in self.files.read_all(f"{self.path}/log")]
        return sorted((Entry(r["seq"], tuple(r["ops"]), r.get("name")) for r in rows), key=lambda e: e.seq)

    @staticmethod
    def sealed(entries: list[Entry]) -> bool:
        marks = [e.ops[0] for e in entries if e.name is None]
        return bool(marks) and marks[-1] == SEAL

    def _enter(self, seq: int, ops: tuple[str, ...], name: str | None) -> None:
        entry = json.dumps({"seq": seq, "ops": list(ops), "name": name})
        self.files.write_once(f"{self.path}/log/{seq:020d}.json", entry)

    def append(self, make: Callable[[int], DataFrame], ops: tuple[str, ...], attempts: int = 5) -> int:
        """Write the rows that ``make`` gives for a number, and enter them; made anew if another writer took it."""
        for attempt in range(attempts):
            entries = self.entries()
            if self.sealed(entries):
                raise Sealed(f"{self.path} is sealed")
            seq = (entries[-1].seq if entries else 0) + 1
            name = f"{seq:020d}-{uuid.uuid4().hex[:8]}"
            make(seq).write.parquet(f"{self.path}/rows/{name}")
            try:
                self._enter(seq, ops, name)
                return seq
            except ConcurrentPublish:
                self.files.delete(f"{self.path}/rows/{name}")
                if attempt == attempts - 1:
                    raise
        raise AssertionError

    def mark(self, what: str, attempts: int = 5) -> int:
        """Seal the log or open it again."""
        for attempt in range(attempts):
            entries = self.entries()
            if self.sealed(entries) == (what == SEAL):
                if what == OPEN:
                    return entries[-1].seq if entries else 0
                raise Sealed(f"{self.path} is sealed already")
            seq = (entries[-1].seq if entries else 0) + 1
            try:
                self._enter(seq, (what,), None)
                return seq
            except ConcurrentPublish:
                if attempt == attempts - 1:
                    raise
        raise AssertionError

    def rows(self, base: DataFrame, entries: list[Entry]) -> DataFrame | None:
        """The changes of those entries, or nothing where there are none."""
        paths = [f"{self.path}/rows/{e.name}" for e in entries if e.name]
        if not paths:
            return None
        return self.spark.read.schema(ch.change_schema(base.schema, self.key)).parquet(*paths)

    def merged(self, base: DataFrame, entries: list[Entry] | None = None) -> DataFrame:
        """``base`` as the changes leave it; without changes it is returned as it is."""
        entries = self.entries() if entries is None else entries
        changes = self.rows(base, entries)
        if changes is None:
            return base
        return ch.merge_changes(base, changes, self.key, {op for e in entries if e.name for op in e.ops})

    def copy_to(self, other: "ChangeLog", base: DataFrame, after: int) -> None:
        """Carry the changes entered after ``after`` over to another version's log."""
        for e in self.entries():
            if e.name and e.seq > after:
                rows = self.rows(base, [e])
                other.append(lambda seq, rows=rows: rows.withColumn("_seq", rows["_seq"] * 0 + seq), e.ops)
