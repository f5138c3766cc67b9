"""Packing of tokenised documents into as few sequences as possible, by a configuration program.

A configuration is a multiset of lengths that fit in one sequence. Which configurations to
use, and how often, is a linear program with one covering row for each length of the
histogram; it is solved approximately, and the packing follows the solution.

1. Pieces: one pass encodes the texts. A document of more than ``room`` tokens is cut into
   pieces of ``room``, its first piece taking what is over; others stay whole. Every task
   numbers its pieces of each length.
2. Program, on the histogram of at most ``room`` rows: lengths have prices. In each round a
   knapsack dynamic program finds, for every length, the most valuable configuration that
   holds it; those near the best are used, and the prices of the lengths they cover fall by
   a power of the covering (multiplicative weights). The prices of any round also bound the
   number of sequences from below. The solution is scaled to cover no length twice, rounded
   down, and the program is solved again for the rest while that places much.
3. What rounding leaves, a share of one sequence for each configuration, goes by best fit,
   longest first, over groups of equal sequences.
4. Places: the n-th piece of a length belongs to a sequence and an offset that follow from
   n. The pieces of a task start where those of the tasks before it end: one joined row for
   each task and length. Adaptive execution broadcasts those rows while they are few.

The driver sees the histogram alone, and its work depends on ``room`` only. Pieces move at
most once.

Defined results: a null or empty text is the single end token; repeated rows are packed each
for itself; a null id stays null; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.frames import row_slabs, stored, texts
from shelfmark.llm.packing import WordTokenizer

_PIECES = "part long, place long, doc long, piece int, start long, length long, ids binary"
_ARROW = pa.schema(
    [("part", pa.int64()), ("place", pa.int64()), ("doc", pa.int64()), ("piece", pa.int32()),
     ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)
#: Bits for the number of a piece among those of its length.
_BITS = 44

FEW = 4
Configuration = tuple[tuple[int, int], ...]


def cut(tokens: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of the pieces of documents of so many tokens."""
    count = -(-tokens // room)
    row = np.repeat(np.arange(len(tokens)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    over = (tokens - (count - 1) * room)[row]
    start = np.where(piece == 0, 0, over + (piece - 1) * room)
    return row, piece, start, np.where(piece == 0, over, room)


def pieces_of(rows: DataFrame, tokenizer: str, room: int, end_id: int) -> DataFrame:
    """All pieces with their ids; ``place`` counts the task's pieces of one length."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), WordTokenizer(tokenizer)
        seen = np.zeros(room + 1, np.int64)
        for batch in batches:
            for a, b in row_slabs(batch.column(1), 4 << 20):
                offsets, flat = encode(batch.column(1).slice(a, b - a))
                n = b - a
                body = np.insert(flat.astype("<u4"), offsets[1:], end_id)
                begin = offsets + np.arange(n + 1)
                row, piece, start, length = cut(np.diff(begin), room)
                order = np.argsort(length, kind="stable")
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.searchsorted(length[order], length[order])
                place += seen[length]
                seen += np.bincount(length, minlength=room + 1)
                edges = 4 * np.append(begin[row] + start, begin[-1])
                ids = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(body.tobytes())]
                )
                doc = batch.column(0).slice(a, n).take(pa.array(row))
                columns = [np.full(len(row), part), place, doc, piece, start, length, ids.cast(pa.binary())]
                yield pa.record_batch(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
                )

    return rows.mapInArrow(fn, _PIECES)


def knapsack(lengths: np.ndarray, prices: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of every capacity, and the length that the fill of exactly so much ends with (-1: not full)."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fit = np.searchsorted(lengths, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if fit[c]:
            value = best[c - lengths[: fit[c]]] + prices[: fit[c]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], choice[c] = value[k], k
    return best, choice


def fills(lengths: np.ndarray, choice: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every length's best configuration the (configuration, length) entries, repeats included."""
    full = np.maximum.accumulate(np.where(choice >= 0, np.arange(room + 1), 0))
    who = np.arange(len(lengths))
    rows, picks, left = [who], [who], full[room - lengths]
    while True:
        who = who[left > 0]
        left = left[left > 0]
        if not len(who):
            return np.concatenate(rows), np.concatenate(picks)
        pick = choice[left]
        rows.append(who)
        picks.append(pick)
        left = full[left - lengths[pick]]


@dataclass
class Solution:
    plan: list[tuple[Configuration, int]]  # configuration and number of its sequences
    bound: float  # no packing has fewer sequences
    rounded: int  # so many entries of the plan come from the program, the others from best fit

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.plan)


def fractional(lengths: np.ndarray, count: np.ndarray, room: int, rounds: int, rate: float, near: float) -> tuple[dict[Configuration, float], float]:
    """Configurations with their amounts, covering no length more than it is there; and the best lower bound met."""
    count = count.astype(float)
    prices, covered, bound = lengths / room, np.zeros(len(lengths)), 0.0
    amounts: Counter = Counter()
    for _ in range(rounds):
        # a trace of the length itself: room that no price pays for is filled too
        worth = prices / prices.max() + 1e-6 * lengths / room
        best, choice = knapsack(lengths, worth, room)
        bound = max(bound, float((count * worth).sum() / best[room]))
        rows, picks = fills(lengths, choice, room)
        key, times = np.unique(rows * len(lengths) + picks, return_counts=True)
        rows, picks = key // len(lengths), key % len(lengths)
        value = np.bincount(rows, worth[picks] * times, len(lengths))
        good = value[rows] >= (1 - near) * value.max()
        rows, picks, times = rows[good], picks[good], times[good]
        alone = np.full(len(lengths), np.inf)
        np.minimum.at(alone, rows, count[picks] / times)
        # no length is used more often than it is there, however many configurations hold it
        wanted = np.bincount(picks, alone[rows] * times, len(lengths)) / count
        most = np.ones(len(lengths))
        np.maximum.at(most, rows, wanted[picks])
        step = alone / most
        used = np.bincount(picks, step[rows] * times, len(lengths)) / count
        covered += used
        prices = prices * np.exp(-rate * used / used.max())
        heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        for a, b in zip(heads, [*heads[1:], len(rows)]):
            own = tuple(zip(lengths[picks[a:b]].tolist(), times[a:b].tolist()))
            amounts[own] += float(step[rows[a]])
    scale = covered.max()
    return {c: x / scale for c, x in amounts.items()}, bound


def best_fit(lengths: np.ndarray, count: np.ndarray, room: int) -> list[tuple[Configuration, int]]:
    """Best fit, longest first, of whole groups: equal sequences with equal contents are one entry."""
    done: list[tuple[Configuration, int]] = []
    groups: dict[int, list[tuple[Configuration, int]]] = {}  # by the room that is left

    def put(contents: Configuration, number: int, left: int) -> None:
        if number:
            (groups.setdefault(left, []) if left else done).append((contents, number))

    for length, n in sorted(zip(lengths.tolist(), count.tolist()), reverse=True):
        while n:
            left = min((f for f in groups if f >= length), default=None)
            if left is None:
                contents, left = (), room
                many = -(-n // (room // length))
            else:
                contents, many = groups[left].pop()
                if not groups[left]:
                    del groups[left]
            most = left // length
            whole = min(many, n // most)  # so many sequences take all that fits
            put((*contents, (length, most)), whole, left - most * length)
            n, many = n - whole * most, many - whole
            if n and many:
                put((*contents, (length, n)), 1, left - n * length)
                n, many = 0, many - 1
            put(contents, many, left)
    return done + [g for some in groups.values() for g in some]


def solve(
    lengths: np.ndarray, count: np.ndarray, room: int, rounds: int = 20, rate: float = 0.5, near: float = 0.2, phases: int = 6
) -> Solution:
    """Sequences for ``count`` pieces of each length; lengths ascend."""
    rest, plan, bound = count.copy(), Counter(), 0.0
    for phase in range(phases):
        some = np.flatnonzero(rest)
        if not len(some):
            break
        amounts, least = fractional(lengths[some], rest[some], room, rounds, rate, near)
        bound = bound if phase else max(least, float((lengths * count).sum() / room))
        before = int(rest.sum())
        parts = []
        for own, amount in amounts.items():
            at, times = np.searchsorted(lengths, [x for x, _ in own]), np.array([n for _, n in own])
            if n := int(amount + 1e-9):
                plan[own] += n
                rest[at] -= n * times
            parts.append((amount - n, own, at, times))
        # parts of a sequence become whole ones where their pieces are still there: halves
        # and more, and at last, when that places little, all
        last = before - int(rest.sum()) < before / FEW
        for part, own, at, times in sorted(parts, key=lambda x: (-x[0], x[1])):
            if (last or part >= 0.5) and (rest[at] >= times).all():
                plan[own] += 1
                rest[at] -= times
        if before - int(rest.sum()) < before / 20:
            break
    some = np.flatnonzero(rest)
    return Solution([*plan.items(), *best_fit(lengths[some], rest[some], room)], bound, len(plan))


class Places:
    """Sequence and offset of the n-th piece of a length, under a plan.

    The sequences of one entry of the plan take a stretch of the pieces of each of its
    lengths; stretches are laid side by side in the order of the plan.
    """

    def __init__(self, plan: list[tuple[Configuration, int]]):
        entries = [(length, times, number) for own, number in plan for length, times in own]
        length, times, number = np.array(entries, np.int64).reshape(-1, 3).T
        size = np.array([len(own) for own, _ in plan], np.int64)
        heads = np.cumsum(size) - size
        used = length * times
        offset = np.cumsum(used) - used
        offset -= np.repeat(offset[heads] if len(heads) else offset, size)
        first = np.cumsum([n for _, n in plan]) - [n for _, n in plan] if plan else np.zeros(0, np.int64)
        order = np.argsort(length, kind="stable")
        taken = (times * number)[order]
        start = np.cumsum(taken) - taken
        edges = np.searchsorted(length[order], length[order])
        self.key = (length[order] << _BITS) + start - start[edges]
        self.times, self.offset = times[order], offset[order]
        self.sequence = np.repeat(np.asarray(first, np.int64), size)[order]

    def __call__(self, length: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << _BITS) + n
        at = np.searchsorted(self.key, key, "right") - 1
        n = key - self.key[at]
        return self.sequence[at] + n // self.times[at], self.offset[at] + n % self.times[at] * length


def pack_best_fit(
    docs: DataFrame,
    tokenizer: str,
    room: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: one row per piece, its ids as little-endian unsigned 32-bit integers."""
    pieces = stored(pieces_of(texts(docs, id_col, text_col), tokenizer, room, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = stored(counts, "lengths")
    # one row a length
    rows = sorted((r.length, r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())
    lengths, count = np.array(rows, np.int64).reshape(-1, 2).T
    places = Places(solve(lengths, count, room).plan)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, n: pa.Array) -> pa.Array:
        where = places(length.to_numpy(), n.to_numpy())
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in where], ["sequence_id", "offset"])

    placed = pieces.join(starts, ["part", "length"]).withColumn("to", place("length", F.col("before") + F.col("place")))
    return placed.select(F.col("doc").alias("doc_id"), "piece", "start", "length", "ids", "to.sequence_id", "to.offset")
