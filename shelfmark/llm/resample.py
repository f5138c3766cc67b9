"""Importance resampling of documents towards a target corpus, on hashed word features.

A text is lower-cased in ASCII and cut by an untrained regex ``Split`` of the
``tokenizers`` library, which returns its words with their places. Features are all runs
of 1 to ``longest`` words, joined by one space: a run is a pair of places, and its CRC-32
grows from that of the run one word shorter. The bucket of a feature is its CRC modulo
``buckets``.

1. Features: one pass over the texts writes the buckets of each document, two bytes a
   feature, so that texts are cut once.
2. Histograms: every task counts the buckets of its documents and emits one row per bucket;
   their sums over all documents and over all target texts give each bucket's gain, the
   logarithm of how much more often the target holds it.
3. Weights: the gains of each document's features are added up. The score is the
   mean gain plus Gumbel noise drawn from a hash of the id, so that the highest scores are
   a sample without replacement.
4. Draw: scores are whole numbers in a narrow range, so their counts tell the score at
   which the draw ends; only documents at or above it are numbered, in ranges of the order.

Words never move: only histograms and rows of five numbers a drawn document are shuffled,
and every task gets the ``buckets`` gains.

Defined results: null, empty and wordless texts have no feature and weight 0; a null id
draws its noise from the empty id and comes last among equals; repeated rows count, score
and rank each for itself; empty tables give empty histograms and no draw. Other columns are
not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.frames import row_slabs, stored, text_bytes, texts
from shelfmark.llm.hashing import LOWER, MARKS, mix
from shelfmark.plans.numbering import number_rows

#: Fixed value: what a word is, in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that the splitter gets at once; it is cut between words only.
CHUNK = 1 << 19
#: Words beyond this length are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    """Remainders of single bytes under the reflected CRC-32 polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def crc_extend(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each value's bytes followed by ``data[start:end]``, byte by byte over all values at once."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    state = ~crc[order]
    long = int(np.searchsorted(-size, -LONG, "left"))
    for i in range(long):
        state[i] = ~np.uint32(zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(~state[i])))
    live = np.searchsorted(-size, -np.arange(LONG), "left")
    for k in range(LONG):
        if live[k] <= long:
            break
        part = state[long : live[k]]
        state[long : live[k]] = _CRC[(part ^ data[at[long : live[k]] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


class WordSplitter:
    """Words of many texts by a regex ``Split`` of the tokenizers library."""

    def __init__(self) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes of all texts, start and end of each word in them, and its text."""
        from tokenizers import PreTokenizedString

        offsets, raw = text_bytes(column)
        rows = len(offsets) - 1
        # a line end behind every text keeps words apart
        data = np.full(len(raw) + rows, 10, np.uint8)
        body = np.ones(len(data), bool)
        body[offsets[1:] + np.arange(rows)] = False
        data[body] = LOWER[raw]
        cuts = np.flatnonzero(MARKS[data]) + 1
        places, a = [], 0
        while a < len(data):
            k = int(np.searchsorted(cuts, a + CHUNK, "right")) - 1
            b = int(cuts[k]) if k >= 0 and cuts[k] > a else int(cuts[k + 1])
            piece = PreTokenizedString(data[a:b].tobytes().decode("utf-8"))
            self.split.pre_tokenize(piece)
            found = piece.get_splits("original", "byte")
            places.append(np.fromiter(chain.from_iterable(map(itemgetter(1), found)), np.int64, 2 * len(found)) + a)
            a = b
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        start, end = place[0::2], place[1::2]
        ends = offsets[1:] + np.arange(1, rows + 1)
        return data, start, end, np.searchsorted(ends, start, "right")


def feature_buckets(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, longest: int, buckets: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length the text and the bucket of every run of that many words."""
    crc, last = np.zeros(len(start), np.uint32), np.arange(len(start))
    space = np.array([32], np.uint8)
    for k in range(1, longest + 1):
        if k > 1:
            # a window moves on by the word behind it, if that is of the same text
            more = np.flatnonzero(last + 1 < len(start))
            more = more[text[last[more]] == text[last[more] + 1]]
            crc, last = crc[more], last[more] + 1
            crc = crc_extend(crc, space, np.zeros(len(crc), np.int64), np.ones(len(crc), np.int64))
        crc = crc_extend(crc, data, start[last], end[last])
        yield text[last], (crc % np.uint32(buckets)).astype(np.int64)


def features(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``doc, n_words, features, tie``: the buckets of each text's features, as small whole numbers.

    ``tie`` differs from row to row, so that even equal rows can be sorted apart.
    """
    small = _number(buckets)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, seen = WordSplitter(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in row_slabs(batch.column(1)):
                n = b - a
                words = split(batch.column(1).slice(a, n))
                found = list(feature_buckets(*words, longest, buckets))
                text, bucket = (np.concatenate(x) for x in zip(*found))
                if longest > 1:
                    order = np.argsort(text, kind="stable")
                    text, bucket = text[order], bucket[order]
                ends = np.searchsorted(text, np.arange(n + 1)) * small.itemsize
                body = pa.py_buffer(bucket.astype(small).tobytes())
                tie = mix(np.arange(seen, seen + n, dtype=np.uint64)).view(np.int64)
                seen += n
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, n),
                        pa.array(np.bincount(words[3], minlength=n), pa.int64()),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), body]).cast(pa.binary()),
                        pa.array(tie, pa.int64()),
                    ],
                    names=["doc", "n_words", "features", "tie"],
                )

    return rows.mapInArrow(fn, "doc long, n_words long, features binary, tie long")


def _number(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _lists(column: pa.Array, small: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every entry of a column of packed numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // small.itemsize
    body = column.buffers()[2]
    flat = np.frombuffer(body, small, int(offsets[-1])) if body is not None else np.zeros(0, small)
    return np.repeat(np.arange(len(column)), np.diff(offsets)), flat[offsets[0] :].astype(np.int64)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    small = _number(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_lists(batch.column(0), small)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    counted = found.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    size = len(source)
    s_all, t_all = float(source.sum() + size), float(target.sum() + size)
    ratio = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc, n_words, n_features, weight, tie``: the mean gain of each text's features."""
    small = _number(len(gains))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            text, bucket = _lists(batch.column(2), small)
            count = np.bincount(text, minlength=n)
            # sums of whole numbers below 2**53
            total = np.bincount(text, gains[bucket], n).astype(np.int64)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(count, pa.int64()),
                    pa.array(total // np.maximum(count, 1), pa.int64()),
                    batch.column(3),
                ],
                names=["doc", "n_words", "n_features", "weight", "tie"],
            )

    return found.mapInArrow(fn, "doc long, n_words long, n_features long, weight long, tie long")


def gumbel(id_col: str, seed: int) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of SHA-256 of ``seed:id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def last_score(scored: DataFrame, draw: int) -> int | None:
    """The score of the last document drawn, from the counts of all scores.

    Scores are thousandths of logarithms of 64-bit counts and of 32-bit noise: there are
    some 200,000 of them at most, however many documents.
    """
    counts = sorted(((r.score, r.n) for r in scored.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    for score, n in counts:
        draw -= n
        if draw <= 0:
            return score
    return None


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null where it is not drawn.

    ``percent`` of the documents with at least ``min_words`` words are drawn, those of the
    highest scores, ties to the smaller id.
    """
    valid = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    rows = texts(docs, id_col, text_col).withColumn("text", valid("text"))
    wanted = target.select(valid(f"`{target_col}`").alias("text"))
    found = stored(features(rows, longest, buckets), "features")
    target_found = features(wanted.select(F.lit(0).cast("bigint").alias("doc"), "text"), longest, buckets)
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(target_found, buckets))
    scored = stored(weigh(found, gains).withColumn("score", F.col("weight") + gumbel("doc", seed)), "scored")
    fit = F.col("n_words") >= min_words
    draw = percent * scored.filter(fit).count() // 100
    end = last_score(scored.filter(fit), draw) if draw else None
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("tie")]
    if end is None:
        out = scored.withColumn("rank", F.lit(None).cast("bigint"))
    else:
        near = fit & (F.col("score") >= end)
        drawn = number_rows(scored.filter(near), order, "rank")
        drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("bigint"))
        out = drawn.unionByName(scored.filter(~near).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")
