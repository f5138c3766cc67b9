"""Ranked lexical search of whole texts by branch-and-bound over document FP-trees.

1. Vectors: one pass over the documents counts all terms of each and keeps how often it
   holds the terms of the items. Only these restricted vectors are written.
2. Statistics: documents, their terms, and the documents that hold a term, over all vectors.
3. Trees: a task takes its documents block by block. Their terms are put in the order of
   document frequency, rarest and so heaviest first, and documents that begin with the same
   terms share that path of a trie. Every node knows, over the documents below it, the
   highest count of each term and the least length norm ``m``; with them the formula gives a
   score that no document below exceeds.
4. Search: for each item the trie is walked depth-first, best bound first. A subtree that
   cannot beat the item's tenth document so far is left out; a small one is scored document
   by document, exactly. The best of one block are the bar for the next, and a task emits at
   most ``top`` documents an item, of which the best of all tasks are ranked.

The items come in blocks of about ``block_bytes`` of text; documents are read once for each
block. No pair of item and document is a row.

Defined results: null, empty and termless texts have no term, are never found, and do not
count; an item without terms has no result; rows that repeat an item and its text are one
item, and rows that repeat its id with another text have ranks of their own; repeated
documents are found each for itself; null ids of documents come last among equal scores.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.frames import row_slabs, stored, text_bytes, texts, total_bytes
from shelfmark.llm.hashing import LOWER, MARKS, word_hashes, words

#: Fixed value: what a term is; only A-Z are lower-cased.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of one tree, and those that a leaf of it holds at least, about.
TREE, LEAF = 16_384, 48
#: Terms of the documents of one tree, about.
ENTRIES = 2 << 20
#: Columns of the table of highest counts; beyond them terms share a column.
COLUMNS = 4096
#: Text of the items that are searched in one pass.
BLOCK_BYTES = 2 << 20
_LAST = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, and two hashes, of every term."""
    offsets, data = text_bytes(column)
    data = LOWER[data]
    start, end, row = words(data, offsets, MARKS)
    return row, word_hashes(data, start, end), word_hashes(data, start, end, 1)


class Vocabulary:
    """The terms of a block of items, found by two 64-bit hashes."""

    def __init__(self, names: list[str]):
        _, one, two = text_terms(pa.array(names, pa.string()))
        order = np.argsort(one)
        self.one, self.two = one[order], two[order]
        self.names = [names[i] for i in order]

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Number of each term, or -1."""
        if not len(self.one):
            return np.full(len(one), -1)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), at, -1)


_VECTOR = "doc long, n long, terms array<int>, counts array<int>"


def restricted_vectors(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc, n, terms, counts``: all terms of a document counted, those of the vocabulary by number."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary.one))
        for batch in batches:
            for a, b in row_slabs(batch.column(1)):
                row, one, two = text_terms(batch.column(1).slice(a, b - a))
                number = vocabulary.find(one, two)
                key, count = np.unique(row[number >= 0] * size + number[number >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(b - a + 1) * size), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % size, count))
                n = pa.array(np.bincount(row, minlength=b - a), pa.int64())
                yield pa.record_batch([batch.column(0).slice(a, b - a), n, *lists], names=["doc", "n", "terms", "counts"])

    return rows.mapInArrow(fn, _VECTOR)


def share(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight ``w`` adds to a score; grows with ``tf`` and falls with ``m``."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """``10 + (90 * n * docs) div total``, without overflow."""
    whole, part = divmod(90 * docs, max(1, total))
    if part and int(n.max(initial=0)) > (1 << 62) // part:
        return np.array([10 + (90 * int(x) * docs) // total for x in n], np.int64)
    return 10 + n * whole + n * part // max(1, total)


class Tree:
    """A trie over the term vectors of one block of documents.

    Documents are sorted by their vectors, so that a subtree is a range of them. Children
    of few documents share one leaf with their neighbours.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, begin: np.ndarray, terms: np.ndarray, counts: np.ndarray, columns: int):
        # terms of a document by rank, documents by their terms
        size = np.diff(begin)
        owner = np.repeat(np.arange(len(ids)), size)
        order = np.lexsort((terms, owner))
        terms, counts = terms[order], counts[order]
        body = terms.astype(">u4").tobytes()
        paths = [body[4 * a : 4 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        docs = np.array(sorted(range(len(ids)), key=lambda i: (paths[i], ids[i])), np.int64)
        self.ids, self.m, size = ids[docs], m[docs], size[docs]
        self.begin = np.concatenate(([0], np.cumsum(size)))
        pick = np.repeat(begin[docs] - self.begin[:-1], size) + np.arange(self.begin[-1])
        self.terms, self.counts = terms[pick], counts[pick].astype(np.int64)
        self.columns = columns
        self._grow(size)
        self._bound(size)

    def _grow(self, size: np.ndarray) -> None:
        self.first, self.last, self.kids = [0], [len(self.ids)], [None]
        open_nodes = [(0, 0)]
        while open_nodes:
            node, depth = open_nodes.pop()
            a, b = self.first[node], self.last[node]
            if b - a <= LEAF:
                continue
            while True:
                ended = int(np.searchsorted(size[a:b] > depth, True)) if size[a] <= depth else 0
                cut = self.terms[self.begin[a + ended : b] + depth]
                edges = np.flatnonzero(cut[1:] != cut[:-1]) + 1
                if ended or len(edges) or not len(cut):
                    break
                depth += 1  # a path without a fork
            if not len(cut):
                continue  # all end here: equal vectors, which differ by length and id only
            edges = [a, *([a + ended] if ended else []), *(a + ended + edges).tolist(), b]
            kids, low = [], a
            for i in range(1, len(edges)):
                # small neighbours are one leaf; a large child is a node of its own
                large = edges[i] - edges[i - 1] > LEAF
                if large and low < edges[i - 1]:
                    kids.append((low, edges[i - 1], False))
                    low = edges[i - 1]
                if large or edges[i] - low > LEAF or i == len(edges) - 1:
                    kids.append((low, edges[i], large and edges[i - 1] >= a + ended))
                    low = edges[i]
            numbers = []
            for x, y, deeper in kids:
                numbers.append(len(self.first))
                self.first.append(x)
                self.last.append(y)
                self.kids.append(None)
                if deeper:
                    open_nodes.append((numbers[-1], depth + 1))
            self.kids[node] = np.array(numbers)

    def _bound(self, size: np.ndarray) -> None:
        """Highest counts, least norms and least ids of every subtree, from the leaves up."""
        nodes = len(self.first)
        self.most = np.zeros((nodes, self.columns), np.int64)
        leaf_of = np.zeros(len(self.ids), np.int64)
        for node in range(nodes):
            if self.kids[node] is None:
                leaf_of[self.first[node] : self.last[node]] = node
        np.maximum.at(self.most, (np.repeat(leaf_of, size), self.terms % self.columns), self.counts)
        self.least = np.array([self.m[a:b].min() for a, b in zip(self.first, self.last)])
        self.least_id = np.array([self.ids[a:b].min() for a, b in zip(self.first, self.last)])
        for node in range(nodes - 1, -1, -1):  # a node comes before its children
            if self.kids[node] is not None:
                self.most[node] = self.most[self.kids[node]].max(axis=0)

    def search(self, terms: np.ndarray, weights: np.ndarray, all_weights: np.ndarray, best: "Best") -> None:
        """Offer to ``best`` every document that can be among them. ``all_weights`` has the item's weights by rank."""
        column = terms % self.columns
        stack = [(_LAST, 0, 0)]
        while stack:
            bound, first_id, node = stack.pop()
            if not best.may_enter(bound, first_id):
                continue
            kids = self.kids[node]
            if kids is None:
                a, b = self.first[node], self.last[node]
                x, y = self.begin[a], self.begin[b]
                m = np.repeat(self.m[a:b], np.diff(self.begin[a : b + 1]))
                score = np.add.reduceat(share(all_weights[self.terms[x:y]], self.counts[x:y], m), self.begin[a:b] - x)
                best.offer(score, self.ids[a:b])
                continue
            bounds = share(weights, self.most[np.ix_(kids, column)], self.least[kids][:, None]).sum(axis=1)
            for i in np.lexsort((-self.least_id[kids], bounds)).tolist():
                if bounds[i] >= best.bar:
                    stack.append((int(bounds[i]), int(self.least_id[kids[i]]), int(kids[i])))


class Best:
    """The ``top`` highest-scoring documents so far, equal scores by id."""

    def __init__(self, top: int):
        self.top, self.bar, self.bar_id = top, 1, _LAST
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may_enter(self, score: int, doc: int) -> bool:
        return score > self.bar or (score == self.bar and doc <= self.bar_id)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        fit = (score > self.bar) | ((score == self.bar) & (ids <= self.bar_id))
        if not fit.any():
            return
        score, ids = np.concatenate((self.score, score[fit])), np.concatenate((self.ids, ids[fit]))
        order = np.lexsort((ids, -score))[: self.top]
        self.score, self.ids = score[order], ids[order]
        if len(order) == self.top:
            self.bar, self.bar_id = int(self.score[-1]), int(self.ids[-1])


def slices(lists: pa.ListArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` rows and about ``ENTRIES`` list entries."""
    ends = np.cumsum(lists.value_lengths().to_numpy())
    a, done = 0, 0
    while a < len(ends):
        b = min(a + most, max(a + 1, int(np.searchsorted(ends, done + ENTRIES, "right"))))
        yield a, b
        a, done = b, int(ends[b - 1])


def best_in_tasks(
    vectors: DataFrame, rank: np.ndarray, weight: np.ndarray, items: list[np.ndarray], docs: int, total: int, top: int, tree: int
) -> DataFrame:
    """``item, doc, score``: each task's best documents for each item.

    ``rank`` is a term's place in the order of the trie, ``weight`` has the weights by rank,
    ``items`` the ranks of each item's terms.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        all_weights = np.zeros(len(weight), np.int64)
        for batch in batches:
            for at, stop in slices(batch.column(2), tree):
                part = batch.slice(at, stop - at)
                begin = np.concatenate(([0], np.cumsum(part.column(2).value_lengths().to_numpy()))).astype(np.int64)
                terms = rank[part.column(2).flatten().to_numpy()]
                counts = part.column(3).flatten().to_numpy()
                some = np.flatnonzero(np.diff(begin))
                if not len(some):
                    continue
                ids = part.column(0).fill_null(_LAST).to_numpy()[some]
                m = norms(part.column(1).to_numpy()[some], docs, total)
                begin = np.append(begin[:-1][some], begin[-1])
                grown = Tree(ids, m, begin, terms, counts, min(COLUMNS, len(weight)))
                for own, found in zip(items, best):
                    all_weights[own] = weight[own]
                    grown.search(own, weight[own], all_weights, found)
                    all_weights[own] = 0
        count = [len(b.ids) for b in best]
        if sum(count):
            ids = np.concatenate([b.ids for b in best])
            yield pa.record_batch(
                [
                    pa.array(np.repeat(np.arange(len(items)), count), pa.int64()),
                    pa.array(ids, pa.int64(), mask=ids == _LAST),
                    pa.array(np.concatenate([b.score for b in best]), pa.int64()),
                ],
                names=["item", "doc", "score"],
            )

    return vectors.mapInArrow(fn, "item long, doc long, score long")


def _search_block(rows: DataFrame, items: list[tuple[int | None, str]], top: int, tree: int) -> DataFrame:
    spark = rows.sparkSession
    own = [sorted(set(terms_of(text))) for _, text in items]
    vocabulary = Vocabulary(sorted({t for terms in own for t in terms}))
    vectors = stored(restricted_vectors(rows, vocabulary), "vectors")
    sums = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = np.zeros(len(vocabulary.names), np.int64)
    for r in held.collect():  # one row a term of the block
        df[r.term] = r.df
    order = np.lexsort((np.arange(len(df)), df))
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * int(x) + 1))) for x in df[order]], np.int64)
    number = {name: rank[i] for i, name in enumerate(vocabulary.names)}
    ranks = [np.sort(np.array([number[t] for t in terms], np.int64)) for terms in own]
    found = best_in_tasks(vectors.filter("size(terms) > 0"), rank, weight, ranks, sums.docs, sums.total, top, tree)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item long, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    tree: int = TREE,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a score above 0."""
    rows = texts(docs, id_col, text_col)
    wanted = stored(texts(items, item_col, item_text_col).filter("text is not null").distinct(), "items")
    blocks = max(1, -(-total_bytes(wanted) // block_bytes))
    found = None
    for k in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("doc", "text"), F.lit(blocks)) == k) if blocks > 1 else wanted
        mine = sorted(((r.doc, r.text) for r in block.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        part = _search_block(rows, mine, top, tree)
        found = part if found is None else found.unionByName(part)
    return found
