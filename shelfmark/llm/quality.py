"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, word pairs and
character n-grams (3 and 4 bytes); a softmax layer over the mean gives the class.
Vectors and layer are trained together by numpy stochastic gradient descent.

Training uses a bounded sample of labelled rows (``sample``, a documented parameter),
spread over all of them by a hash of the id, and runs in one executor task. Scoring
covers every whole text: because the layer is linear in the mean, each n-gram's
vector is multiplied by it once beforehand, and a document's score is the mean of
its n-grams' rows. No shuffle is needed to score.

Defined results: a null or empty text has no n-grams and gets the prior of class 1;
without labels the score is 0.5. Null labels are not learned from. Repeated rows are
scored each for itself; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import hashing as H
from shelfmark.llm.frames import row_slabs, text_bytes

#: Rows of the vector table: words and n-grams share it.
BUCKETS = 1 << 17
SIZES = (3, 4)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) pairs of every word and n-gram, a slab of bytes at a time."""
    if not len(data):
        return
    start, end, doc = H.words(data, offsets)
    bits = np.uint64(64 - (BUCKETS.bit_length() - 1))
    word = H.word_hashes(data, start, end)
    yield doc, (word >> bits).astype(np.int64)
    # a pair of words is hashed by their difference: every doubled word is the same feature
    same = doc[1:] == doc[:-1]
    yield doc[1:][same], (H.mix((word[1:] - word[:-1])[same] + np.uint64(2)) >> bits).astype(np.int64)
    step = 4 * H.SLAB
    widest = max(SIZES)
    for lo in range(0, len(data), step):
        part = data[lo : lo + step + widest - 1]
        place = np.arange(lo, min(len(data), lo + step))
        owner = np.searchsorted(offsets, place, "right") - 1
        left = offsets[owner + 1] - place
        value = H.BYTE[0][part]
        for n in SIZES:
            h = H.windows(value, n)
            m = min(len(h), len(place))
            ok = left[:m] >= n
            yield owner[:m][ok], (H.mix(h[:m][ok] + np.uint64(n)) >> bits).astype(np.int64)


def train(texts: pa.Array, labels: np.ndarray, dim: int = 8, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Log odds that each bucket's vector adds for class 1, and the intercept."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    n = len(labels)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(n):
        offsets, data = text_bytes(texts.slice(k, 1))
        parts = [bucket for _, bucket in features(data, offsets)]
        ids, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0))
        bags.append((ids, (count / max(1, count.sum())).astype(np.float32)))
    share = np.bincount(labels, minlength=2) / max(1, n)
    for epoch in range(epochs):
        for step, k in enumerate(rng.permutation(n)):
            speed = np.float32(rate * (1 - (epoch * n + step) / (epochs * n)))
            ids, weight = bags[k]
            mean = weight @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = layer @ p
            layer -= speed * np.outer(mean, p)
            bias -= speed * 0.05 * p
            # the mean spreads a step over all n-grams; scale it back so that rare ones move
            vectors[ids] -= (speed * 40) * np.outer(weight, back)
    if not n or share.min() == 0:
        prior = (np.bincount(labels, minlength=2) + 1) / (n + 2)
        return np.zeros(BUCKETS, np.float32), float(np.log(prior[1] / prior[0]))
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 4000
) -> tuple[np.ndarray, float]:
    """Train on at most about ``sample`` labelled documents; the model has ``BUCKETS`` numbers."""
    marked = labels.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("label")
    ).filter("doc is not null and label in (0, 1)")
    # one label a document: its own vote counts, ties to 1
    marked = marked.groupBy("doc").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    n = marked.count()
    kept = int((1 << 30) * min(1.0, sample / max(1, n)))
    marked = marked.filter(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < kept)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # about `sample` ids of eight bytes: bounded, so they go to every task
    chosen = rows.join(F.broadcast(marked), "doc").groupBy("doc", "label").agg(F.max("text").alias("text"))

    def learn(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks().sort_by([("doc", "ascending")])
        text = tab.column("text").combine_chunks()
        odds, bias = train(text, tab.column("label").to_numpy().astype(np.int64))
        return pa.table({"odds": pa.array([odds.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    got = chosen.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "odds binary, bias double").first()
    if got is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(got[0], np.float32), got[1]


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, score``: the probability of class 1."""
    odds, bias = model
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = np.zeros(len(batch)), np.zeros(len(batch))
            for a, b in row_slabs(batch.column(1)):
                offsets, data = text_bytes(batch.column(1).slice(a, b - a))
                for doc, bucket in features(data, offsets):
                    total[a:b] += np.bincount(doc, odds[bucket], minlength=b - a)
                    count[a:b] += np.bincount(doc, minlength=b - a)
            z = total / np.maximum(count, 1) + bias
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(judge, "doc_id long, score double")
