"""Removal of repeated word windows over a whole corpus by level-wise doubling.

A word goes if a window of ``window`` words covers it whose words also start in a
document with a smaller id. Windows are judged on the input.

A window can only repeat if every shorter window inside it repeats. So the levels are
lengths that double up to ``window`` (for 13: 7, 13; for 50: 7, 13, 25, 50). On each
level but the last every window still alive names one run of that length inside it,
the least-hashed one; equal windows name equal runs. Only windows whose run occurs in
two documents are extended to twice the length, until none survives or the full
length is reached. There the least document id of each window decides.

Groups of documents and buckets of hashes exchange packed arrays (``packs``), one
entry per group and distinct run, so a phrase in every document costs one entry per
group. Full-length windows are compared by 96-bit hashes.

Defined results: null text has no words; documents shorter than the window stay
(their words joined by one space); rows that repeat an id do not count as smaller
than each other; a null id counts as the largest. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from shelfmark.llm import hashing as H
from shelfmark.llm.frames import grouped, sorted_group, texts, total_bytes
from shelfmark.llm.packs import Row, bucketed, finish, meet, own, send

#: Text whose hashes one bucket sees, about.
BUCKET_BYTES = 8 << 20
#: Length of the first level at most.
FIRST = 8
ALIVE = 9


def levels(window: int, first: int = FIRST) -> list[int]:
    """Lengths that at most double from one to the next and end at ``window``."""
    out = [window]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    if len(out) == 1 and window > 1:
        out.insert(0, -(-window // 2))
    return out


class _Words:
    """A group's words and those windows that may still repeat."""

    def __init__(self, tab: pa.Table, window: int):
        self.window = window
        self.docs, self.offsets, self.data, self.rows = sorted_group(tab)
        self.start, self.end, self.doc = H.words(self.data, self.offsets)
        self.hash = H.word_hashes(self.data, self.start, self.end)
        count = max(0, len(self.start) - window + 1)
        self.alive = np.flatnonzero(self.doc[:count] == self.doc[window - 1 : window - 1 + count])

    def bits(self) -> bytes:
        alive = np.zeros(len(self.start) + 1, bool)
        alive[self.alive] = True
        return np.packbits(alive).tobytes()

    def revive(self, body: bytes) -> None:
        self.alive = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8)))

    def runs(self, length: int) -> tuple[np.ndarray, ...]:
        """The run each living window names, as an index into the distinct runs; their hashes; whether in two documents here."""
        h = H.mix(H.windows(self.hash, length))
        place = H.sliding_argmin(h, self.window - length + 1)[self.alive]
        key, which = np.unique(H.mix(h[place] + np.uint64(1)), return_inverse=True)
        doc = self.docs[self.doc[self.alive]]
        least, most = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), np.iinfo(np.int64).min)
        np.minimum.at(least, which, doc)
        np.maximum.at(most, which, doc)
        return which, key, least < most

    def full(self) -> tuple[np.ndarray, ...]:
        """Distinct living windows: index of each living one, two hashes and the least document."""
        if not len(self.alive):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        one = H.mix(H.windows(self.hash, self.window))[self.alive]
        two = H.mix(H.windows(self.hash ^ np.uint64(0x5851F42D4C957F2D), self.window, H.BASE[1]))[self.alive] >> np.uint64(32)
        order = np.lexsort((two, one))  # stable: documents stay in order
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        return which, one[first], two[first], self.docs[self.doc[self.alive[first]]]


def _codes(got: list[Row]) -> dict[int, np.ndarray]:
    return {r[0]: np.frombuffer(r[3], np.uint8) for r in got if r[2] != ALIVE}


def _ask(words: _Words, grp: int, length: int, buckets: int) -> Iterator[Row]:
    if length < words.window:
        _, key, _ = words.runs(length)
        for bucket, (k,) in bucketed(key, buckets):
            yield bucket, grp, 0, k.tobytes()
    else:
        _, one, two, least = words.full()
        for bucket, (a, b, d) in bucketed(one, buckets, two, least):
            yield bucket, grp, 1, a.tobytes() + d.tobytes() + b.astype(np.uint32).tobytes()


def _survive(words: _Words, got: list[Row], length: int, buckets: int) -> None:
    """Drop the windows whose run of ``length`` words is found in one document only."""
    which, key, repeated = words.runs(length)
    codes = _codes(got)
    for bucket, (_, at) in bucketed(key, buckets, np.arange(len(key))):
        if bucket in codes:
            repeated[at] |= codes[bucket] > 0
    words.alive = words.alive[repeated[which]]


def _revived(tab: pa.Table, got: list[Row], window: int) -> _Words:
    words = _Words(tab, window)
    for row in got:
        if row[2] == ALIVE:
            words.revive(row[3])
    return words


def _visit(window: int, lengths: list[int], level: int, buckets: int):
    def fn(tab: pa.Table, got: list[Row]) -> Iterator[Row]:
        grp = tab.column("grp")[0].as_py()
        words = _revived(tab, got, window)
        if level:
            _survive(words, got, lengths[level - 1], buckets)
            yield own(grp, ALIVE, words.bits())
        yield from _ask(words, grp, lengths[level], buckets)

    return fn


def _answer(rows: list[Row]) -> Iterator[Row]:
    if rows[0][2] == 0:
        parts = [np.frombuffer(r[3], np.uint64) for r in rows]
        order = np.argsort(key := np.concatenate(parts))
        key = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        code = np.empty(len(key), np.uint8)
        code[order] = same[1:] | same[:-1]
    else:
        sizes = [len(r[3]) // 20 for r in rows]
        one = np.concatenate([np.frombuffer(r[3], np.uint64, n) for r, n in zip(rows, sizes)])
        doc = np.concatenate([np.frombuffer(r[3], np.int64, n, 8 * n) for r, n in zip(rows, sizes)])
        two = np.concatenate([np.frombuffer(r[3], np.uint32, n, 16 * n) for r, n in zip(rows, sizes)])
        parts = [one[:n] for n in sizes]
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        code = np.empty(len(one), np.uint8)
        code[order] = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    for row, part in zip(rows, np.split(code, np.cumsum([len(p) for p in parts])[:-1])):
        if part.any():
            yield row[0], row[1], 0, part.tobytes()


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(window: int, buckets: int):
    def fn(tab: pa.Table, got: list[Row]) -> pa.Table:
        words = _revived(tab, got, window)
        which, one, _, least = words.full()
        later = words.docs[words.doc[words.alive]] > least[which] if len(which) else np.zeros(0, bool)
        codes = _codes(got)
        for bucket, (_, at) in bucketed(one, buckets, np.arange(len(one))):
            if bucket in codes:
                hit = np.zeros(len(one), bool)
                hit[at[codes[bucket] > 0]] = True
                later |= hit[which]
        n, docs = len(words.start), len(words.docs)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, words.alive[later], 1)
        np.add.at(edge, words.alive[later] + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        keep = np.flatnonzero(~gone)
        # kept words with one space behind each; the last of a document has none
        length = words.end[keep] - words.start[keep]
        owner = words.doc[keep]
        space = np.ones(len(keep), np.int64)
        space[:-1] = owner[1:] == owner[:-1]
        space[-1:] = 0
        total = length + space
        ends = np.cumsum(total)
        at = np.repeat(words.start[keep] - (ends - total), total) + np.arange(ends[-1] if len(ends) else 0)
        body = words.data[np.minimum(at, max(0, len(words.data) - 1))].copy()
        body[ends[space > 0] - 1] = 32
        size = np.bincount(owner, total, minlength=docs).astype(np.int64)
        edges = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        kept = pa.Array.from_buffers(pa.string(), docs, [None, pa.py_buffer(edges), pa.py_buffer(body)])
        first = gone & np.concatenate(([True], ~gone[:-1] | (words.doc[1:] != words.doc[:-1])))[: len(gone)]
        last = gone & np.concatenate((~gone[1:] | (words.doc[1:] != words.doc[:-1]), [True]))[: len(gone)]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        base = np.searchsorted(words.doc, np.arange(docs))
        spans = np.bincount(words.doc[begin], minlength=docs)
        pairs = pa.StructArray.from_arrays(
            [pa.array(begin - base[words.doc[begin]], pa.int64()), pa.array(end - base[words.doc[begin]], pa.int64())], ["start", "end"]
        )
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(spans))), pa.int32()), pairs)
        return pa.table(
            {
                "doc_id": words.rows.column("doc"),
                "n_words": pa.array(np.bincount(words.doc, minlength=docs), pa.int64()),
                "n_removed": pa.array(np.bincount(words.doc[gone], minlength=docs), pa.int64()),
                "spans": lists.cast(_SPAN),
                "kept": kept,
            }
        )

    return fn


def remove_phrases(
    docs: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    first: int = FIRST,
    group_bytes: int | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans`` (of words) and ``kept``."""
    if window < 2:
        raise ValueError("a window holds two words at least")
    rows = texts(docs, id_col, text_col)
    size = total_bytes(rows)
    rows, _ = grouped(rows, size, **({"group_bytes": group_bytes} if group_bytes else {}))
    buckets = max(1, -(-size // BUCKET_BYTES))
    lengths = levels(window, first)
    answers = None
    for level in range(len(lengths)):
        answers = meet(send(rows, _visit(window, lengths, level, buckets), answers), _answer)
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
    return finish(rows, answers, _remove(window, buckets), schema)
