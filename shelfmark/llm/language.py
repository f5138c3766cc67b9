"""Language identification as inference of a multilingual mixture.

Each language is a distribution over hashed character n-grams (UTF-8 bytes of the
lower-cased text, everything that is no letter being one space). A document is a
mixture: expectation-maximisation estimates its language shares, and the set of
languages is the one with the best penalised likelihood,
``log likelihood / order - penalty * languages * log(n-grams) / 2``; the likelihood
is divided by the n-gram order because overlapping n-grams are not independent.

Fitting counts n-grams over all labelled documents in Spark; the model has one row
per language and ``buckets`` columns, so what reaches the driver does not grow with
the documents. Scoring needs no shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
every document if nothing was labelled. Null labels are not learned from. Repeated
rows are judged each for itself; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.frames import row_slabs, text_bytes

ORDER = 3
#: Languages a model may have; more means that the label column is something else.
MAX_LANGUAGES = 1000
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
#: Bytes counted at once.
_SLAB = 1 << 20


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # languages x buckets


def _grams(batch_texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of documents in bytes and the bucket of the n-gram that begins at each byte."""
    import pyarrow.compute as pc

    offsets, data = text_bytes(pc.utf8_lower(pc.fill_null(batch_texts.cast(pa.large_string()), "")))
    b = _PLAIN[data].astype(np.uint32)
    if len(b) < ORDER:
        return offsets, np.zeros(0, np.int32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    blank = code == np.uint32(0x202020)
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - (buckets.bit_length() - 1))
    out = code.astype(np.int32)
    out[blank] = -1  # only spaces say nothing
    return offsets, out


def _counts(offsets: np.ndarray, grams: np.ndarray, a: int, b: int, buckets: int) -> np.ndarray:
    """Dense counts of documents a to b; n-grams that cross documents are left out."""
    out = np.zeros((b - a, buckets), np.float32)
    lo, hi = int(offsets[a]), int(offsets[b])
    for at in range(lo, hi, _SLAB):
        stop = min(hi, at + _SLAB, len(grams))
        if stop <= at:
            break
        place = np.arange(at, stop)
        doc = np.searchsorted(offsets[a : b + 1], place, "right") - 1
        g = grams[at:stop]
        ok = (g >= 0) & (place + ORDER <= offsets[a + 1 : b + 1][doc])
        out += np.bincount(doc[ok] * buckets + g[ok], minlength=(b - a) * buckets).reshape(b - a, buckets)
    return out


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 4096) -> LanguageModel:
    """Learn from every document with a text and a label."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object).astype(str)
            for a, b in row_slabs(batch.column(0)):
                offsets, grams = _grams(batch.column(0).slice(a, b - a), buckets)
                place = np.flatnonzero(grams >= 0)
                doc = np.searchsorted(offsets, place, "right") - 1
                ok = place + ORDER <= offsets[doc + 1]
                place, doc = place[ok], doc[ok]
                names, which = np.unique(lang[a:b], return_inverse=True)
                both = np.bincount(which[doc] * buckets + grams[place], minlength=len(names) * buckets)
                for name, c in zip(names, both.reshape(len(names), buckets)):
                    total[str(name)] = total.get(str(name), 0) + c
        for name, c in total.items():
            seen = np.flatnonzero(c)
            yield pa.record_batch(
                [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(c[seen], pa.int64())],
                names=["lang", "gram", "n"],
            )

    summed = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = summed.limit(MAX_LANGUAGES * buckets + 1).toPandas()
    names = sorted(found["lang"].unique())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    counts = np.full((len(names), buckets), 0.5)
    place = {n: k for k, n in enumerate(names)}
    if len(found):
        np.add.at(counts, (found["lang"].map(place).to_numpy(), found["gram"].to_numpy()), found["n"].to_numpy())
        counts /= counts.sum(axis=1, keepdims=True)
    return LanguageModel(names, np.log(counts))


def mixture(counts: np.ndarray, p: np.ndarray, start: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each row's languages and the log likelihood, by expectation-maximisation.

    Languages that start at 0 stay out.
    """
    share, total = start, np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        seen = np.maximum(share @ p, 1e-30)
        new = share * ((counts / seen) @ p.T) / total
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-30)
        done = np.abs(new - share).max(initial=0) < 1e-4
        share = new
        if done:
            break
    return share, (counts * np.log(np.maximum(share @ p, 1e-30))).sum(axis=1)


def _ceiling(counts: np.ndarray, p: np.ndarray, share: np.ndarray, likelihood: np.ndarray) -> np.ndarray:
    """What no mixture's log likelihood exceeds: it is concave, so its slopes at ``share`` bound it."""
    slopes = (counts / np.maximum(share @ p, 1e-30)) @ p.T
    return likelihood + np.maximum(slopes.max(axis=1) - counts.sum(axis=1), 0)


def infer(counts: np.ndarray, model: LanguageModel, penalty: float, most: int | None = None) -> np.ndarray:
    """Shares over the language set of best penalised likelihood.

    Sets grow by the next language until no larger one can pay its penalty; ``most``
    ends them earlier.
    """
    p = np.exp(model.log_p).astype(np.float32)
    k = len(model.languages)
    n = counts.sum(axis=1)
    price = penalty * np.log(np.maximum(n, 2)) / 2
    alone = counts @ model.log_p.astype(np.float32).T
    best = np.argmax(alone, axis=1)
    rows = np.arange(len(counts))
    share = np.zeros((len(counts), k), np.float32)
    share[rows, best] = 1
    value = alone[rows, best] / ORDER - price
    if k > 1:
        full, likelihood = mixture(counts, p, np.full((len(counts), k), 1 / k, np.float32))
        ceiling = _ceiling(counts, p, full, likelihood) / ORDER
        order = np.argsort(-full, axis=1, kind="stable")
        open_rows = rows
        for m in range(2, min(k, most or k) + 1):
            # a set of m is worth a try where the best of all mixtures could pay for m languages
            open_rows = open_rows[ceiling[open_rows] - m * price[open_rows] > value[open_rows]]
            if not len(open_rows):
                break
            start = np.zeros((len(open_rows), k), np.float32)
            np.put_along_axis(start, order[open_rows, :m], 1 / m, axis=1)
            got, likelihood = mixture(counts[open_rows], p, start)
            new = likelihood / ORDER - m * price[open_rows]
            better = new > value[open_rows]
            share[open_rows[better]] = got[better]
            value[open_rows[better]] = new[better]
    return share


def judged(
    texts: pa.Array, letters: list[bool], model: LanguageModel, penalty: float, most: int | None
) -> tuple[list, list, list, list]:
    """Main language, score, shares and number of n-grams of each text; ``und`` where there is no letter."""
    k, names, buckets = len(model.languages), model.languages, model.log_p.shape[1]
    lang, score, shares = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in range(len(texts))]
    found = [0] * len(texts)
    if not k:
        return lang, score, shares, found
    for a, b in row_slabs(texts, most=128):
        offsets, grams = _grams(texts.slice(a, b - a), buckets)
        counts = _counts(offsets, grams, 0, b - a, buckets)
        share = infer(counts, model, penalty, most)
        size = counts.sum(axis=1) / ORDER
        for i in range(b - a):
            if letters[a + i]:
                top = int(np.argmax(share[i]))
                lang[a + i] = names[top]
                found[a + i] = int(counts[i].sum())
                score[a + i] = float((size[i] * share[i, top] + 1 / k) / (size[i] + 1))
                shares[a + i] = [{"lang": names[j], "share": float(share[i, j])} for j in np.flatnonzero(share[i] > 0.005)]
    return lang, score, shares, found


def identify(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    penalty: float = 2.0,
    max_languages: int | None = None,
) -> DataFrame:
    """Rows ``doc_id, lang_pred, score, shares``: the main language, how sure it is, and the mixture.

    ``score`` is the main language's share, drawn to 1 / languages for short texts.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, shares, _ = judged(batch.column(1), batch.column(2).to_pylist(), model, penalty, max_languages)
            yield pa.record_batch(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, kind)],
                names=["doc_id", "lang_pred", "score", "shares"],
            )

    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double, shares array<struct<lang:string,share:double>>")


def with_known_language(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", least: int = 1, penalty: float = 2.0, max_languages: int | None = None
) -> DataFrame:
    """``docs`` with all its columns, less those without a language or with fewer than ``least`` n-grams.

    How the text is shared out among languages does not matter: an even mixture stays.
    """
    letters = F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    own = docs.filter(letters)
    at = own.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, _, found = judged(batch.column(at).cast(pa.string()), [True] * len(batch), model, penalty, max_languages)
            known = (np.array(lang, object) != "und") & (np.array(found) >= least)
            yield batch.filter(pa.array(known.astype(bool), pa.bool_()))

    return own.mapInArrow(keep, own.schema)
