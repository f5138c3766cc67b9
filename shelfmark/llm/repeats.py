"""Removal of repeated byte strings over a whole corpus by suffix arrays.

A byte goes if it lies in a string of ``window`` bytes that also starts earlier: in a
document with a smaller id, or in the same document further left. Strings are judged
on the input.

Sorting all suffixes of a corpus in one place does not scale, so suffixes are first
brought together by contents. Each window of ``window`` bytes names as its anchor the
place of its least-hashed 32-byte string. Equal windows name equal anchors at equal
offsets, so only windows of equal anchors have to be compared.

1. Every group of documents sends its anchors (a hash, a hash of the stretch of text
   whose windows name it, the document). Equal stretches are merged: all but the
   first occurrence are repeats. The rest of an anchor that occurs with different
   stretches goes on.
2. Those stretches meet by anchor. A two-stage suffix sort and the common prefixes of
   adjacent suffixes show which windows they share. An anchor with more different
   stretches than one task should sort sends 128-bit hashes of its windows instead,
   which spread over all buckets.
3. Each group removes what it was told.

The three steps are stages of one plan that shuffles the documents once.

Defined results: null text is empty; texts shorter than the window stay; rows that
repeat an id are documents of their own, the first in text order (or group) counting
as the earlier; a null id counts as the largest. Other columns
come along as ``rest`` if ``carry``, else they are not read.
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
from shelfmark.llm.suffixes import adjacent_prefixes, eight_bytes, suffix_array

GRAM = 32
#: Text whose anchors one bucket sees, about.
BUCKET_BYTES = 8 << 20
#: Different stretches of one anchor that one task sorts; beyond it windows are hashed.
MOST_STRETCHES = 50_000
STRETCH, WINDOW, GONE = 0, 1, 2


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window of each stretch, its anchor's hash and the stretch's hash."""
    power, back = H.powers(H.SLAB + window + 1, H.BASE[0]), H.powers(H.SLAB + window + 1, H.inverse(H.BASE[0]))
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(data) - window + 1, H.SLAB):
        part = data[at : at + H.SLAB + window - 1]
        count = len(part) - window + 1
        first = np.searchsorted(offsets, at, "right") - 1
        last = np.searchsorted(offsets, at + count - 1, "right")
        begin = np.maximum(offsets[first:last], at) - at
        end = np.minimum(offsets[first + 1 : last + 1] - window + 1, at + count) - at
        ok = end > begin
        edge = np.zeros(count + 1, np.int32)
        np.add.at(edge, begin[ok], 1)
        np.add.at(edge, end[ok], -1)
        valid = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(valid):
            continue
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(H.BYTE[0][part] * power[: len(part)], out=total[1:])
        h = H.mix((total[gram:] - total[:-gram]) * back[: len(part) - gram + 1])
        place = H.sliding_argmin(h, window - gram + 1)[valid]
        cut = np.flatnonzero((place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1
        lo = valid[np.concatenate(([0], cut))]
        hi = valid[np.concatenate((cut - 1, [len(valid) - 1]))]
        p = place[np.concatenate(([0], cut))]
        stretch = (total[hi + window] - total[lo]) * back[lo]
        stretch += (p - lo).astype(np.uint64) * H.BASE[1] + (hi - lo).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        parts.append((lo + at, hi + at, H.mix(h[p] + np.uint64(1)), H.mix(stretch)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def joined(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, in order."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return begin[np.concatenate(([0], new))], end[np.concatenate((new - 1, [len(end) - 1]))]


def intervals(begin: np.ndarray, end: np.ndarray) -> bytes:
    begin, end = joined(begin.astype(np.int64), end.astype(np.int64))
    return np.concatenate((begin, end)).tobytes()


def slices(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many slices, one behind the other."""
    ends = np.cumsum(length)
    return data[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class _Group:
    """A group's stretches: one of each kind stands for all of them here."""

    def __init__(self, tab: pa.Table, window: int, gram: int):
        self.grp = tab.column("grp")[0].as_py()
        self.docs, self.offsets, self.data, _ = sorted_group(tab)
        self.lo, self.hi, self.key, self.stretch = anchors(self.data, self.offsets, window, gram)
        order = np.lexsort((self.stretch, self.key))  # stable: the earliest of equals comes first
        key, stretch = self.key[order], self.stretch[order]
        first = np.ones(len(order), bool)
        first[1:] = (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])
        self.some, self.copies = order[first], order[~first]
        self.owner = np.searchsorted(self.offsets, self.lo[self.some], "right") - 1

    def entries(self, buckets: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        some = self.some
        yield from bucketed(self.key[some], buckets, self.stretch[some], self.docs[self.owner], some)


def _announce(window: int, gram: int, buckets: int):
    def fn(tab: pa.Table, _: list[Row]) -> Iterator[Row]:
        group = _Group(tab, window, gram)
        for bucket, (key, stretch, doc, _some) in group.entries(buckets):
            yield bucket, group.grp, 0, np.concatenate((key, stretch, doc.view(np.uint64))).tobytes()

    return fn


def _decide(most: int):
    """0: nothing to do; 1: a repeat as a whole; 2: compare stretches; 3: compare windows."""

    def fn(rows: list[Row]) -> Iterator[Row]:
        parts = [np.frombuffer(r[3], np.uint64).reshape(3, -1) for r in rows]
        key, stretch, doc = np.concatenate(parts, axis=1)
        sizes = [p.shape[1] for p in parts]
        grp = np.repeat([r[1] for r in rows], sizes)
        order = np.lexsort((grp, doc.view(np.int64), stretch, key))
        k, s = key[order], stretch[order]
        new_key = np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        new = new_key.copy()
        new[1:] |= s[1:] != s[:-1]
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
        code = np.where(new, np.where(kinds > most, 3, np.where(kinds > 1, 2, 0)), 1).astype(np.uint8)
        back = np.empty_like(code)
        back[order] = code
        for row, part in zip(rows, np.split(back, np.cumsum(sizes)[:-1])):
            if part.any():
                yield row[0], row[1], row[0], part.tobytes()

    return fn


def _submit(window: int, gram: int, buckets: int):
    def fn(tab: pa.Table, got: list[Row]) -> Iterator[Row]:
        group = _Group(tab, window, gram)
        codes = {r[2]: np.frombuffer(r[3], np.uint8) for r in got}
        gone, windows = [group.copies], []
        for bucket, (key, _stretch, doc, some) in group.entries(buckets):
            code = codes.get(bucket)
            if code is None:
                continue
            gone.append(some[code == 1])
            windows.append(some[code == 3])
            at = code == 2
            if at.any():
                lo, length = group.lo[some[at]], group.hi[some[at]] - group.lo[some[at]] + window
                head = np.concatenate(([len(lo)], doc[at], lo, length)).astype(np.int64)
                yield bucket, group.grp, STRETCH, head.tobytes() + slices(group.data, lo, length).tobytes()
        gone = np.concatenate(gone)
        begin, end = [group.lo[gone]], [group.hi[gone] + window]
        hot = np.sort(np.concatenate(windows)) if windows else np.zeros(0, np.int64)
        if len(hot):
            count = group.hi[hot] - group.lo[hot] + 1
            place = np.repeat(group.lo[hot] - np.cumsum(count) + count, count) + np.arange(count.sum())
            one, two = (_hash_at(group.data, place, window, which) for which in (0, 1))
            order = np.lexsort((two, one))
            same = np.zeros(len(order), bool)
            same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            begin.append(place[order[same]])
            end.append(place[order[same]] + window)
            some = order[~same]
            doc = group.docs[np.searchsorted(group.offsets, place[some], "right") - 1]
            for bucket, (a, b, d, p) in bucketed(one[some], buckets, two[some], doc, place[some]):
                body = np.concatenate((a, b, d.view(np.uint64), p.astype(np.int64).view(np.uint64)))
                yield buckets + bucket, group.grp, WINDOW, body.tobytes()
        yield own(group.grp, GONE, intervals(np.concatenate(begin), np.concatenate(end)))

    return fn


def _hash_at(data: np.ndarray, place: np.ndarray, window: int, which: int) -> np.ndarray:
    out = np.empty(len(place), np.uint64)
    step = H.SLAB
    for at in range(0, len(data), step):
        a, b = np.searchsorted(place, [at, at + step])
        if a < b:
            h = H.windows(H.BYTE[which][data[at : at + step + window - 1]], window, H.BASE[which])
            out[a:b] = h[place[a:b] - at]
    return H.mix(out)


def _compare(window: int):
    """Windows that are not the earliest of their kind, by a suffix array of all stretches here."""

    def stretches(rows: list[Row]) -> tuple[np.ndarray, ...]:
        doc, lo, length, grp, body = [], [], [], [], []
        for _, g, _, blob in rows:
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            head = np.frombuffer(blob, np.int64, 3 * n, 8)
            doc.append(head[:n])
            lo.append(head[n : 2 * n])
            length.append(head[2 * n :])
            grp.append(np.full(n, g))
            body.append(np.frombuffer(blob, np.uint8, offset=8 + 24 * n))
        doc, lo, length, grp = (np.concatenate(x) for x in (doc, lo, length, grp))
        body = np.concatenate(body)
        # text of UTF-8 bytes never holds 255, so a byte moves up by one and 0 separates
        start = np.cumsum(length + 1) - length - 1
        text = np.zeros(int((length + 1).sum()), np.uint8)
        text[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(len(body))] = body + 1
        words = eight_bytes(text, window + 8)
        order = suffix_array(text, window, words)
        shared = adjacent_prefixes(order, words, window) >= window
        which = np.searchsorted(start, order, "right") - 1
        inside = order - start[which]
        fits = inside + window <= length[which]
        # runs of adjacent suffixes that share a whole window
        pair = np.zeros(len(order) + 1, bool)
        pair[1:-1] = shared & fits[1:] & fits[:-1]
        member = np.flatnonzero(pair[:-1] | pair[1:])
        label = np.cumsum(~pair[:-1])[member]
        which, place = which[member], lo[which[member]] + inside[member]
        return label, doc[which], grp[which], place

    def fn(rows: list[Row]) -> Iterator[Row]:
        if rows[0][2] == STRETCH:
            label, doc, grp, place = stretches(rows)
            order = np.lexsort((place, grp, doc, label))
            new = np.ones(len(order), bool)
            new[1:] = label[order][1:] != label[order][:-1]
        else:
            parts = [np.frombuffer(r[3], np.uint64).reshape(4, -1) for r in rows]
            one, two, doc, place = np.concatenate(parts, axis=1)
            doc, place = doc.view(np.int64), place.view(np.int64)
            grp = np.repeat([r[1] for r in rows], [p.shape[1] for p in parts])
            order = np.lexsort((place, grp, doc, two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        later = order[~new]
        later = later[np.argsort(grp[later], kind="stable")]
        for a, b in zip(*H.runs(grp[later])):
            at = place[later[a:b]]
            yield rows[0][0], int(grp[later[a]]), GONE, intervals(at, at + window)

    return fn


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(tab: pa.Table, got: list[Row]) -> pa.Table:
    docs, offsets, data, rows = sorted_group(tab)
    edge = np.zeros(len(data) + 1, np.int32)
    for row in got:
        begin, end = np.frombuffer(row[3], np.int64).reshape(2, -1)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
    kept = np.concatenate(([0], np.cumsum(~gone)))
    size = np.diff(offsets)
    removed = size - np.diff(kept[offsets])
    first, last = gone.copy(), gone.copy()
    first[1:] &= ~gone[:-1]
    last[:-1] &= ~gone[1:]
    heads = offsets[:-1][size > 0]
    first[heads] = gone[heads]
    last[heads[1:] - 1] = gone[heads[1:] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, begin, "right") - 1
    spans = np.bincount(owner, minlength=len(docs)).astype(np.int64)
    pairs = pa.StructArray.from_arrays(
        [pa.array(begin - offsets[owner], pa.int64()), pa.array(end - offsets[owner], pa.int64())], ["start", "end"]
    )
    edges = np.concatenate(([0], np.cumsum(spans))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pairs)
    body = pa.Array.from_buffers(
        pa.binary(), len(docs), [None, pa.py_buffer(kept[offsets].astype(np.int32)), pa.py_buffer(data[~gone])]
    )
    columns = {
        "doc_id": rows.column("doc"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(spans, pa.int64()), "spans": lists.cast(_SPAN), "kept": body,
    }
    if "rest" in rows.column_names:
        columns["rest"] = rows.column("rest")
    return pa.table(columns)


def remove_repeats(
    docs: DataFrame,
    window: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = GRAM,
    most: int = MOST_STRETCHES,
    group_bytes: int | None = None,
    carry: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, spans, kept`` (bytes), and ``rest`` if asked."""
    if window < gram:
        raise ValueError("the window must hold the anchor's string")
    rows = texts(docs, id_col, text_col, carry)
    size = total_bytes(rows)
    rows, _ = grouped(rows, size, **({"group_bytes": group_bytes} if group_bytes else {}))
    buckets = max(1, -(-size // BUCKET_BYTES))
    codes = meet(send(rows, _announce(window, gram, buckets)), _decide(most))
    gone = meet(send(rows, _submit(window, gram, buckets), codes), _compare(window))
    schema = StructType.fromDDL(
        "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    )
    if carry:
        schema.add(rows.schema["rest"])
    return finish(rows, gone, _remove, schema)
