"""Exchange of packed arrays: one shuffle row carries the keys of a whole group of documents.

A group's keys are dealt to buckets by their hash, one row of bytes for each
(group, bucket); a bucket sees every occurrence of its keys, answers each row
with a code per key, and the answers return to their groups. A group sends a
key once however often it holds it, so a hot key costs one entry per group.
All steps are stages of one lazy plan: a lost executor repeats its tasks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PACK = "bucket long, grp long, tag int, body binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("tag", pa.int32()), ("body", pa.binary())])

Row = tuple[int, int, int, bytes]


def pack_table(rows: list[Row]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def pack_rows(tab: pa.Table) -> list[Row]:
    """Rows in a fixed order, so that answers and repeated tasks agree."""
    rows = list(zip(*(tab.column(n).to_pylist() for n in ("bucket", "grp", "tag", "body"))))
    return sorted(rows, key=lambda r: r[:3])


def own(grp: int, tag: int, body: bytes) -> Row:
    """A note of a group to itself; buckets hand it on."""
    return -1 - grp, grp, tag, body


def send(docs: DataFrame, fn: Callable[[pa.Table, list[Row]], Iterator[Row]], answers: DataFrame | None = None) -> DataFrame:
    """Visit every group of documents with the answers it got so far; returns packs for buckets."""

    def first(tab: pa.Table) -> pa.Table:
        return pack_table(list(fn(tab, []))) if len(tab) else pack_table([])

    def later(tab: pa.Table, got: pa.Table) -> pa.Table:
        return pack_table(list(fn(tab, pack_rows(got)))) if len(tab) else pack_table([])

    if answers is None:
        return docs.groupBy("grp").applyInArrow(first, PACK)
    return docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(later, PACK)


def meet(packs: DataFrame, fn: Callable[[list[Row]], Iterator[Row]]) -> DataFrame:
    """Each bucket sees all its packs at once and answers them; a group's notes to itself pass."""

    def reduce(tab: pa.Table) -> pa.Table:
        rows = pack_rows(tab)
        if rows and rows[0][0] < 0:
            return pack_table(rows)
        return pack_table(list(fn(rows)))

    return packs.groupBy("bucket").applyInArrow(reduce, PACK)


def finish(docs: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, list[Row]], pa.Table], schema: StructType) -> DataFrame:
    """The last visit: each group's documents beside its answers give the result rows."""

    def last(tab: pa.Table, got: pa.Table) -> pa.Table:
        return fn(tab, pack_rows(got))

    return docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(last, schema)


def bucketed(keys: np.ndarray, buckets: int, *others: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Slices of parallel arrays by bucket, in a stable order."""
    if not len(keys):
        return
    where = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where = where[order]
    arrays = [a[order] for a in (keys, *others)]
    edges = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)]))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(where[a]), [x[a:b] for x in arrays]
