"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs ``n + n * n / quadratic_at``: a linear part and a
quadratic part for attention. The documents of a block are taken by descending cost; each goes
to the sequence of least cost among all that have room for it. Of a document as long as a
sequence or longer, whole sequences are cut off first and its rest is balanced. Where no
sequence has room, a document is cut to fill the least costly ones, so only the last sequence of a partition is padded;
that last one is broken into power-of-two lengths, which need no padding.

Each partition packs its own documents block by block, in one pass and without a
shuffle; memory holds one block. Sequence ids are ``partition * 2**40 + n``. A
task that runs again reads the same rows in the same order and numbers alike.

Defined results: a null or empty text is the single end token; repeated rows are
packed each for itself; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.frames import row_slabs, text_bytes, texts
from shelfmark.llm.hashing import word_hashes

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
#: Words that a task's tokenizer remembers at most.
REMEMBERED = 1_500_000
#: The pattern by which byte-level BPE of this kind cuts texts.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that may follow a space where a text is cut: the space before a non-space always begins a
#: token. White space, and characters that begin like wide white space, are never cut off.
_AFTER_SPACE = np.ones(256, bool)
_AFTER_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def word_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of short texts by the tokenizer file.

    Where the file's merges are in the order of their ids, the same byte-pair merging is
    done by rank, which is several times faster; texts with a special token, and files
    of another kind, go to the file's own tokenizer.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = Tokenizer.from_file(path)
    by_file = lambda words: [x.ids for x in own.encode_batch_fast(words, add_special_tokens=False)]
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    special = [t["content"] for t in spec.get("added_tokens", [])]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    ranks = [vocab.get(a + b, -1) for a, b in merges]
    alike = (
        model.get("type") == "BPE"
        and before.get("type") == "ByteLevel"
        and before.get("use_regex") is True
        and before.get("add_prefix_space") is False
        and spec.get("normalizer") is None
        and not model.get("ignore_merges")
        and all(a < b for a, b in zip(ranks, ranks[1:]))
    )
    if not alike:
        return by_file
    letters = _byte_alphabet()
    known = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=known, special_tokens={})
    odd = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(words: list[str]) -> list[list[int]]:
        return [
            by_file([w])[0] if odd is not None and odd.search(w) else fast.encode_ordinary(w) for w in words
        ]

    return encode


class WordTokenizer:
    """Ids of whole texts by a byte-level BPE file.

    Byte-level BPE never joins tokens over a space before a non-space, so a text is the
    concatenation of its space-led words. Words repeat: a slab of texts is cut and
    hashed at once, and only words whose 64-bit hash was not met before are encoded.
    """

    def __init__(self, path: str):
        self.encoder = word_encoder(path)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = self.encoder(words)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))))
        hashes, begin, count = (np.concatenate(x) for x in ((self.hashes, hashes), (self.begin, begin), (self.count, count)))
        order = np.argsort(hashes)
        self.hashes, self.begin, self.count = hashes[order], begin[order], count[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by text and the ids of all texts, one behind the other."""
        offsets, data = text_bytes(texts)
        if not len(data):
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 32) & _AFTER_SPACE[data[1:]]
        cut[offsets[1:][offsets[1:] > 0] - 1] = False  # the next byte is another text's
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        word, first, which = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        _, met = self.find(word)
        body = data.tobytes()
        fresh = [body[a:b].decode("utf-8", "replace") for a, b in zip(start[first[~met]].tolist(), end[first[~met]].tolist())]
        self.learn(word[~met], fresh)
        at, _ = self.find(word)
        at = at[which]
        count = self.count[at]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[at] - (ends - count), count) + np.arange(ends[-1])]
        before = np.concatenate(([0], ends))
        return before[np.searchsorted(start, offsets)], ids


def piece_cost(n: int, quadratic_at: int) -> float:
    return n + n * n / quadratic_at


class OpenSequences:
    """Open sequences by room and cost: a tree over the rooms, each with a heap of its sequences."""

    def __init__(self, room: int, number: int):
        self.size = 1 << room.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.least = [_NONE] * (2 * self.size)
        self.heaps[room] = [(0.0, b) for b in range(number)]
        self._renew(room)

    def _renew(self, room: int) -> None:
        at = self.size + room
        self.least[at] = (*self.heaps[room][0], room) if self.heaps[room] else _NONE
        while at := at >> 1:
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def put(self, cost: float, sequence: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, sequence))
            self._renew(room)

    def take(self, n: int) -> tuple[float, int, int] | None:
        """The least costly sequence with room for ``n``, of all that have it."""
        low, high, found = self.size + n, 2 * self.size, _NONE
        while low < high:
            if low & 1:
                found = min(found, self.least[low])
                low += 1
            low, high = low >> 1, high >> 1
        if found is _NONE:
            return None
        heapq.heappop(self.heaps[found[2]])
        self._renew(found[2])
        return found

    def rest(self) -> list[tuple[float, int]]:
        return sorted(x for heap in self.heaps for x in heap)


_NONE = (float("inf"), -1, -1)


class Packer:
    """Places pieces into open sequences of ``room`` tokens."""

    def __init__(self, room: int, quadratic_at: int, first_id: int):
        self.room, self.at, self.next_id = room, quadratic_at, first_id
        self.carry: list[tuple] = []

    def open(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def full(self, doc, ids: bytes, start: int, total: int) -> tuple:
        """A piece that fills a sequence of its own."""
        return doc, start, self.room, ids, total, self.open(), 0

    def pack(self, rest: list[tuple], last: bool) -> Iterator[tuple]:
        """``rest``: (doc, ids, start, total), each shorter than a sequence.

        Yields the pieces of full sequences; what fills less than one waits for the
        next block, or at the end goes to power-of-two sequences.
        """
        items = self.carry + rest
        self.carry = []
        items.sort(key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0, x[2], x[1]))
        total = sum(len(x[1]) for x in items) // 4
        bins = total // self.room
        held: list[list[tuple]] = [[] for _ in range(bins)]
        left = [self.room] * bins
        queue = OpenSequences(self.room, bins)
        over = []
        for item in items:
            n = len(item[1]) // 4
            found = queue.take(n)
            if found is None:
                over.append(item)
                continue
            cost, b, _ = found
            held[b].append(item)
            left[b] -= n
            queue.put(cost + piece_cost(n, self.at), b, left[b])
        # what found no room is cut to fill what is left, the least costly sequence first
        queue = queue.rest()
        at = 0
        for doc, ids, start, whole in over:
            while ids and at < len(queue):
                b = queue[at][1]
                n = min(left[b], len(ids) // 4)
                held[b].append((doc, ids[: 4 * n], start, whole))
                left[b] -= n
                ids, start = ids[4 * n :], start + n
                if not left[b]:
                    at += 1
            if ids:
                self.carry.append((doc, ids, start, whole))
        for b in range(bins):
            yield from self.placed(held[b])
        if last:
            yield from self.powers()

    def placed(self, items: list[tuple]) -> Iterator[tuple]:
        sequence, offset = self.open(), 0
        for doc, ids, start, whole in items:
            yield doc, start, len(ids) // 4, ids, whole, sequence, offset
            offset += len(ids) // 4

    def powers(self) -> Iterator[tuple]:
        """Less than one sequence of tokens, in sequences whose lengths are powers of two."""
        items, self.carry = self.carry, []
        total = sum(len(x[1]) for x in items) // 4
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            now = []
            while size:
                doc, ids, start, whole = items[0]
                n = min(size, len(ids) // 4)
                now.append((doc, ids[: 4 * n], start, whole))
                size -= n
                items[0] = (doc, ids[4 * n :], start + n, whole)
                if not items[0][1]:
                    items.pop(0)
            yield from self.placed(now)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    room: int = 1024,
    end_id: int = 0,
    quadratic_at: int = 1024,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = WordTokenizer(tokenizer)
        packer = Packer(room, quadratic_at, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * room

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for batch in batches:
            for a, b in row_slabs(batch.column(1), block_bytes):
                rows, rest = [], []
                offsets, flat = encode(batch.column(1).slice(a, b - a))
                for k, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    ids = flat[offsets[k] : offsets[k + 1]].astype("<u4").tobytes() + end
                    whole = len(ids) // 4
                    for at in range(0, len(ids) - step + 1, step):
                        rows.append(packer.full(doc, ids[at : at + step], at // 4, whole))
                    at = len(ids) // step * step
                    if at < len(ids):
                        rest.append((doc, ids[at:], at // 4, whole))
                rows += packer.pack(rest, last=False)
                if rows:
                    yield out(rows)
        if rows := list(packer.pack([], last=True)):
            yield out(rows)

    return texts(docs, id_col, text_col).mapInArrow(pack, PIECES)

