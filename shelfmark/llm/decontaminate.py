"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. Every run of ``seed`` words of a
test item is a possible seed; one pass over the corpus counts in how many documents
each occurs. An item keeps as seeds those that are rare in the corpus, and in any case
its rarest half, so an item that was copied very often keeps seeds too. A second pass
finds seeds in documents. Where ``hits`` different seeds of an item lie close to one
diagonal (the same shift between document and item), the passage around them is aligned
with the item word by word: a match scores 2, a mismatch or a gap -1. The score over its
possible maximum tells exact (1.0), edited and paraphrased copies from chance. Items of up
to 12 words need fewer seeds, one up to 8 words; items of 5 to 8 words have to be there but
for one edit; an excerpt that scores as 16 equal words counts however long its item is.

Items are the small side and are sent to the tasks in blocks of bounded size; each
block is one pass over the documents. Documents stay where they are: no shuffle but
of the seed counts.

Defined results: null and empty texts match nothing; an item with fewer words than a
seed is one seed as a whole; a null item id is reported as such; rows that repeat an id
are judged each for itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import hashing as H
from shelfmark.llm.frames import row_slabs, text_bytes, texts

#: Bytes of item text sent to the tasks at once.
BLOCK_BYTES = 4 << 20
_SIEVE = 1 << 22
#: Documents that may hold a seed in any case.
RARE = 16
#: Words of an item up to which all but one edit has to be there.
SHORT = 8
#: Words of an excerpt that count whatever the length of its item.
EXCERPT = 16


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column and the row of each."""
    offsets, data = text_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    start, end, doc = H.words(data, offsets, H.MARKS)
    return H.word_hashes(data, start, end), doc


@dataclass
class Items:
    """Test items with their seeds, as sorted arrays."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray  # distinct seed hashes, sorted
    post_start: np.ndarray
    post_item: np.ndarray
    post_place: np.ndarray
    sizes: list[int]

    @classmethod
    def of(cls, ids: list, texts_: list, seed: int) -> "Items":
        h, owner = word_hashes(pa.array(texts_, pa.string()))
        words = [h[owner == i] for i in range(len(ids))]
        grams, item, place = [], [], []
        for i, w in enumerate(words):
            n = min(seed, len(w))
            if n:
                g = _grams(w, n)
                grams.append(g)
                item.append(np.full(len(g), i))
                place.append(np.arange(len(g)))
        if not grams:
            empty = np.zeros(0, np.int64)
            return cls(ids, words, np.zeros(0, np.uint64), np.zeros(1, np.int64), empty, empty, [])
        g, item, place = (np.concatenate(x) for x in (grams, item, place))
        order = np.argsort(g, kind="stable")
        distinct, first = np.unique(g[order], return_index=True)
        sizes = sorted({min(seed, len(w)) for w in words if len(w)})
        return cls(ids, words, distinct, np.append(first, len(g)), item[order], place[order], sizes)

    def rare(self, found: np.ndarray, documents: int, share: float) -> "Items":
        """Only the seeds rare in the corpus, and the rarest half of each item."""
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.post_start))
        count = found[gram]
        order = np.lexsort((self.post_place, count, self.post_item))
        item = self.post_item[order]
        begin, end = H.runs(item)
        rank = np.arange(len(order)) - np.repeat(begin, end - begin)
        size = np.repeat(end - begin, end - begin)
        kept = np.zeros(len(order), bool)
        kept[order] = (count[order] <= max(RARE, share * documents)) | (rank < np.maximum(8, (size + 1) // 2))
        left = np.flatnonzero(kept)
        distinct, first = np.unique(gram[left], return_index=True)
        return Items(
            self.ids, self.words, self.grams[distinct], np.append(first, len(left)), self.post_item[left], self.post_place[left], self.sizes
        )

    def sieve(self) -> np.ndarray:
        out = np.zeros(_SIEVE, bool)
        out[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        return out


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    return H.mix(H.windows(words, n) + np.uint64(n))


def seed_hits(words: np.ndarray, doc: np.ndarray, items: Items, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a seed begins, and which seed."""
    places, seeds = [], []
    for n in items.sizes:
        g = _grams(words, n)
        at = np.flatnonzero(sieve[(g >> np.uint64(42)).astype(np.int64)])
        at = at[doc[at] == doc[at + n - 1]]
        found = np.minimum(np.searchsorted(items.grams, g[at]), len(items.grams) - 1)
        hit = items.grams[found] == g[at]
        places.append(at[hit])
        seeds.append(found[hit])
    return np.concatenate(places), np.concatenate(seeds)


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first word and end in the passage.

    A cell holds its score in the upper half and the start of its alignment in the
    lower half; gaps along a row are one running maximum.
    """
    m = len(passage)
    here = np.arange(m + 1, dtype=np.int64)
    one = np.int64(1) << 32
    slope = here * one
    row, best, span = here.copy(), 0, (0, 0)
    for word in item:
        new = here.copy()
        step = np.where(passage == word, 2 * one, -one)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        np.maximum(new, row - one, out=new)
        new = np.maximum.accumulate(new + slope) - slope
        row = np.where(new < one, here, new)
        top = int(np.argmax(row))
        if row[top] >> 32 > best:
            best, span = int(row[top] >> 32), (int(row[top] & 0xFFFFFFFF), top)
    return best, *span


def contaminated(words: np.ndarray, doc: np.ndarray, items: Items, sieve: np.ndarray, hits: int, score: float) -> list[tuple]:
    """(row, item, score, first word, end word) of every passage that aligns well, the best of each row and item."""
    if not len(words) or not len(items.grams):
        return []
    place, seed = seed_hits(words, doc, items, sieve)
    count = items.post_start[seed + 1] - items.post_start[seed]
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return []
    post = np.repeat(items.post_start[seed] - (ends - count), count) + np.arange(ends[-1])
    item, inside = items.post_item[post], items.post_place[post]
    shift = np.repeat(place, count) - inside
    row = doc[np.repeat(place, count)]
    size = np.array([len(w) for w in items.words])
    order = np.lexsort((inside, shift, item, row))
    row, item, shift, inside = row[order], item[order], shift[order], inside[order]
    slack = size[item] // 4 + 4
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > slack[1:])
    cluster = np.cumsum(new) - 1
    # different seeds of the item in each cluster
    both = np.unique(cluster * (int(size.max()) + 1) + inside) // (int(size.max()) + 1)
    different = np.bincount(both, minlength=cluster[-1] + 1)
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(row)) - 1
    # a short item with one word edited keeps few seeds, perhaps one
    long = size[item[first]]
    wanted = np.minimum(hits, np.where(long <= SHORT, np.where(long <= 4, np.maximum(1, long - items.sizes[-1] + 1), 1), np.maximum(1, (long - 4) // 3)))
    base = np.searchsorted(doc, np.arange(doc[-1] + 2))
    best: dict[tuple[int, int], tuple] = {}
    for c in np.flatnonzero(different >= wanted):
        i, r = int(item[first[c]]), int(row[first[c]])
        pad = int(slack[first[c]])
        lo = max(int(base[r]), int(shift[first[c]]) - pad)
        hi = min(int(base[r + 1]), int(shift[last[c]]) + int(size[i]) + pad)
        top, begin, end = align(words[lo:hi], items.words[i])
        part = top / (2 * int(size[i]))
        if _counts(top, int(size[i]), score) and part > best.get((r, i), (0, 0, 0.0))[2]:
            best[r, i] = (r, i, part, lo + begin - int(base[r]), lo + end - int(base[r]))
    return list(best.values())


def _counts(top: int, size: int, score: float) -> bool:
    """Whether an alignment is a leak: a share of the item, or an excerpt of so many words at the full score.

    A short item has to be there but for one edit; by its share alone, a few common words would do.
    """
    least = 2 * size * score
    if 4 < size <= SHORT:
        least = max(least, 2 * (size - 1) - 1)
    return top >= min(least, 2 * EXCERPT)


def _item_blocks(items: DataFrame, id_col: str, text_col: str, seed: int) -> Iterator[Items]:
    rows = items.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.filter("text is not null")
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        some = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).sort("id", "text").toArrow()
        yield Items.of(some.column("id").to_pylist(), some.column("text").to_pylist(), seed)


def _with_rare_seeds(docs: DataFrame, items: Items, share: float) -> Items:
    """Count the documents of every seed and keep the rare ones. ``docs`` has ``doc`` and ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sieve, documents = np.zeros(len(items.grams) + 1, np.int64), items.sieve(), 0
        for batch in batches:
            for a, b in row_slabs(batch.column(1)):
                words, doc = word_hashes(batch.column(1).slice(a, b - a))
                total[-1] += b - a
                if len(words) and len(items.grams):
                    place, seed = seed_hits(words, doc, items, sieve)
                    pair = np.unique(seed * (b - a) + doc[place])
                    total[:-1] += np.bincount(pair // (b - a), minlength=len(items.grams))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["seed", "n"])

    # as many rows as the block has seeds, which its bytes bound
    got = docs.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(len(items.grams) + 1, np.int64)
    found[got.column("seed").to_numpy()] = got.column("n").to_numpy()
    return items.rare(found[:-1], int(found[-1]), share) if len(items.grams) else items


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    seed: int = 3,
    hits: int = 3,
    score: float = 0.5,
    share: float = 0.001,
) -> DataFrame:
    """One row per document and test item it holds: ``doc_id, item_id, score, first_word, end_word``."""
    rows = texts(docs, id_col, text_col)
    out = None
    for block in _item_blocks(items, item_col, item_text, seed):
        found = rows.mapInArrow(
            _leaks(_with_rare_seeds(rows, block, share), hits, score),
            "doc_id long, item_id long, score double, first_word long, end_word long",
        )
        out = found if out is None else out.unionByName(found)
    return out


def _leaks(items: Items, hits: int, score: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = items.sieve()
        for batch in batches:
            for a, b in row_slabs(batch.column(1)):
                words, doc = word_hashes(batch.column(1).slice(a, b - a))
                rows = contaminated(words, doc, items, sieve, hits, score)
                ids = batch.column(0).slice(a, b - a).to_pylist() if rows else []
                yield pa.record_batch(
                    [
                        pa.array([ids[r[0]] for r in rows], pa.int64()),
                        pa.array([items.ids[r[1]] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                        pa.array([r[4] for r in rows], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "score", "first_word", "end_word"],
                )

    return fn


def without_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    seed: int = 3, hits: int = 3, score: float = 0.5, share: float = 0.001,
) -> DataFrame:
    """``docs`` with all its columns, less the documents that hold a test item."""

    def drop(block: Items, at: int):
        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sieve = block.sieve()
            for batch in batches:
                keep = np.ones(len(batch), bool)
                column = batch.column(at).cast(pa.string())
                for a, b in row_slabs(column):
                    words, doc = word_hashes(column.slice(a, b - a))
                    keep[[a + r[0] for r in contaminated(words, doc, block, sieve, hits, score)]] = False
                yield batch.filter(pa.array(keep))

        return fn

    rows = docs.select(F.lit(None).cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for block in _item_blocks(items, item_col, item_text, seed):
        block = _with_rare_seeds(rows, block, share)
        docs = docs.mapInArrow(drop(block, docs.columns.index(text_col)), docs.schema)
    return docs
