"""Near-duplicate vectors by randomised-rotation binary codes.

A vector's code is the signs of its coordinates after random rotations. With the code
goes one number, ``fix = <x, sign(x)> / sqrt(bits)``: ``<sign(x), rotated y> /
(sqrt(bits) * fix)`` estimates the inner product of two unit vectors without bias. The
other side is its rotated coordinates in eight bits each, rounded up or down by a fixed
random threshold, which adds no bias either. The spread of the estimate is at most
``sqrt((1 - fix^2) / fix^2 / (bits - 1))``, so ``estimate + confidence * spread`` is an
upper bound; only pairs whose bound reaches the threshold are computed exactly, in
double precision.

Pairs are looked up by bands of the same code: vectors of one label meet if they agree
on all bits of a band. Two vectors at the threshold differ in each bit with probability
``acos(threshold) / pi``; the number of bands follows from that and from the allowed
miss, and the width of a band grows with the logarithm of the largest label, so buckets
stay small. A pair counts in the first band where it meets.

Equal vectors of a label are merged first and counted by their number. Codes are written
once; only the places in the bands are grouped, and codes and vectors join the places that
somebody shares. A bucket with many vectors is cut into blocks that meet in pairs, so no
task holds more than two; small buckets share tasks of about ``TASK_ROWS`` rows, whatever
the size of the table. A task computes its pairs exactly and gives back one row a vector:
how many it links with there, and the least vector that its links lead to. So a dense
cluster costs comparisons, but no rows of pairs.

Defined results: a null label or vector, a zero vector, one with a null or non-finite
component, or vectors of different length link with nothing; a null id links with nothing.
Rows that repeat an id are vectors of their own, but lead on to each other: the id has one
component, and of its vectors' numbers of links the largest. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.frames import stored

#: Vectors that one block of a bucket holds.
BLOCK = 2000
#: Vectors of small buckets that share a task, about.
TASK_ROWS = 20_000
#: Pairs whose exact products are computed together.
EXACT_ROWS = 65_536
#: Spreads that the bound lies above the estimate.
CONFIDENCE = 6.0
#: What single precision may take from a bound.
ROUNDING = 1e-5
#: Chance to miss a pair that is just similar enough.
MISS = 1e-6


def bands_for(most: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band and number of bands for a label of ``most`` vectors."""
    width = int(min(24, max(6, math.log2(max(2, most)) - 4)))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** width
    return width, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


@lru_cache(maxsize=4)
def rotations(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal matrices side by side: ``dim`` rows, at least ``bits`` columns."""
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        parts.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.concatenate(parts, axis=1) if parts else np.zeros((dim, 0))


def encode(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors after rotation, the signs of that, and the correction of each."""
    rotated = x @ rotations(x.shape[1], bits)
    # several rotations side by side keep lengths only after this
    rotated *= math.sqrt(x.shape[1] / rotated.shape[1])
    return rotated, rotated > 0, np.abs(rotated).sum(axis=1) / math.sqrt(rotated.shape[1])


def upper_bounds(signs: np.ndarray, fix: np.ndarray, rotated: np.ndarray, confidence: float) -> np.ndarray:
    """Upper confidence bound of the inner products of all coded vectors with all rotated ones."""
    bits = signs.shape[1]
    estimate = (np.where(signs, 1.0, -1.0).astype(np.float32) @ rotated.T) / (math.sqrt(bits) * fix)[:, None]
    spread = np.sqrt((1 - np.minimum(fix, 1) ** 2) / fix**2 / max(1, bits - 1))
    return estimate + confidence * spread[:, None]


_CODED = "node long, own long, label string, v array<double>, copies long, dim int, at array<long>, code binary, fix double"
_MET = "node long, own long, links long, least long"


def _encode(width: int, bands: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            dims = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                _, code, fix = encode(_units(_matrix(rows.column(3))), width * bands)
                weight = 1 << np.arange(width, dtype=np.int64)
                value = code[:, : width * bands].reshape(len(rows), bands, width) @ weight
                packed = np.packbits(code, axis=1)
                edges = pa.array(np.arange(len(rows) + 1) * bands, pa.int32())
                more = [
                    pa.array(np.full(len(rows), dim), pa.int32()),
                    pa.ListArray.from_arrays(edges, pa.array(value.ravel(), pa.int64())),
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                    pa.array(fix, pa.float64()),
                ]
                yield pa.record_batch(rows.columns + more, names=[*rows.schema.names, "dim", "at", "code", "fix"])

    return fn


def linked(code: np.ndarray, fix: np.ndarray, x: np.ndarray, rotated: np.ndarray, y: np.ndarray, threshold: float, confidence: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of x, row of y) whose cosine reaches the threshold: by bounds first, then exactly."""
    for at in range(0, len(x), 512):
        some = slice(at, at + 512)
        a, b = np.nonzero(upper_bounds(code[some], fix[some], rotated, confidence) >= threshold - ROUNDING)
        for k in range(0, len(a), EXACT_ROWS):
            i, j = a[k : k + EXACT_ROWS] + at, b[k : k + EXACT_ROWS]
            p, q = x[i], y[j]
            near = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1)) >= threshold
            yield i[near], j[near]


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` points the least one that pairs lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(width: int, bands: int, threshold: float, confidence: float):
    """The links within a task: of small buckets, of one block or between two."""
    schema = pa.schema([("node", pa.int64()), ("own", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def fn(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks()
        tab = tab.take(pc.sort_indices(tab, sort_keys=[(k, "ascending") for k in ("label", "dim", "band", "value", "node", "own")]))
        node, own, copies, block, band, dim, value, fix = (
            tab.column(k).to_numpy() for k in ("node", "own", "copies", "block", "band", "dim", "value", "fix")
        )
        low, high = (int(tab.column(k)[0].as_py()) for k in ("low", "high"))
        same, label = low == high, tab.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        new = np.ones(len(tab), bool)
        new[1:] = np.any([key[1:] != key[:-1] for key in (label, dim, band, value)], axis=0)
        edges = np.append(np.flatnonzero(new), len(tab))
        out: list[tuple[np.ndarray, ...]] = []
        for begin, end in zip(edges[:-1], edges[1:]):
            at = np.arange(begin, end)
            left = at[block[at] == low]
            right = left if same else at[block[at] != low]
            if not len(left) or not len(right) or (same and len(left) < 2):
                continue
            # every row once; rows of both sides are numbered from begin
            rows = tab.slice(begin, end - begin)
            x = _matrix(rows.column("v").combine_chunks())
            code = np.unpackbits(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(at), -1), axis=1).astype(bool)
            rotated, _, _ = encode(_units(x), width * bands)
            code, rotated = code[:, : rotated.shape[1]], rotated.astype(np.float32)
            left, right, here = left - begin, right - begin, int(band[begin])
            links, first, second = np.zeros(len(at), np.int64), [], []
            for i, j in linked(code[left], fix[begin + left], x[left], rotated[right], x[right], threshold, confidence):
                i, j = left[i], right[j]
                keep = node[begin + i] != node[begin + j]
                keep &= (i < j) | (not same)
                i, j = i[keep], j[keep]
                # only where no earlier band has met
                cut = code[i, : here * width] == code[j, : here * width]
                fresh = ~cut.reshape(len(i), here, width).all(axis=2).any(axis=1) if here else np.ones(len(i), bool)
                i, j = i[fresh].astype(np.int32), j[fresh].astype(np.int32)
                np.add.at(links, i, copies[begin + j])
                np.add.at(links, j, copies[begin + i])
                first.append(i)
                second.append(j)
            i, j = (np.concatenate(c) if c else np.zeros(0, np.int32) for c in (first, second))
            # rows lie in the order of their nodes, so the least row has the least node
            least, some = least_reached(len(at), i, j), np.flatnonzero(links)
            out.append((node[begin + some], own[begin + some], links[some], node[begin + least[some]]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return fn


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    confidence: float = CONFIDENCE,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    )
    sound = (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    usable = rows.filter("id is not null and label is not null and v is not null").filter(sound)
    # -0.0 and 0.0 are one value
    usable = usable.withColumn("v", F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    # two hashes stand for the vector, so that it is shuffled once
    hashes = F.xxhash64("label", "v").alias("one"), F.xxhash64(F.lit(1), "v", "label").alias("own")
    classes = usable.groupBy("label", "v").agg(F.min("id").alias("node"), F.count_distinct("id").alias("copies"))
    classes = stored(classes.select("*", *hashes), "vectors")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    width, bands = bands_for(int(most), threshold)
    coded = stored(classes.select("node", "own", "label", "v", "copies").mapInArrow(_encode(width, bands), _CODED), "codes")
    key = ["label", "dim", "band", "value"]
    places = coded.select("node", "own", "label", "dim", F.posexplode("at").alias("band", "value"))
    crowd = stored(places.groupBy(*key).agg(F.count("*").alias("members")).filter("members > 1"), "crowd")
    small = crowd.filter(F.col("members") <= block).agg(F.sum("members")).first()[0] or 0
    tasks = max(1, -(-int(small) // TASK_ROWS))
    met = places.join(crowd, key).withColumn("blocks", F.ceil(F.col("members") / block))
    met = met.withColumn("block", F.pmod(F.xxhash64("node", "own"), F.col("blocks")))
    met = met.join(coded.select("node", "own", "v", "copies", "code", "fix"), ["node", "own"])
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.select(
        "node", "own", *key, "v", "copies", "code", "fix", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        # small buckets share tasks
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(*key), F.lit(tasks))).otherwise(tasks + F.abs(F.xxhash64(*key) % (1 << 40))).alias("task"),
    )
    found = met.groupBy("task", "low", "high").applyInArrow(_meet(width, bands, threshold, confidence), _MET)
    found = stored(found, "links")
    others = found.groupBy("node", "own").agg(F.sum("links").alias("others"))
    owners = stored(usable.select("id", *hashes).distinct().join(classes.select("one", "own", "node", "copies"), ["one", "own"]), "owners")
    repeated = owners.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("a")).filter("a <> b").select("id")
    same_id = owners.join(repeated, "id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    leads = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(same_id))
    summed = classes.select("node", "own", "copies").join(others, ["node", "own"], "left").join(
        leads.withColumnRenamed("component", "least"), "node", "left"
    )
    summed = summed.select(
        "node",
        "own",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.coalesce("least", "node").alias("component_id"),
    )
    found = owners.select("id", "node", "own").join(summed, ["node", "own"])
    found = found.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(found, "id", "left")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
