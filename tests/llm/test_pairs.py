"""Near-duplicates, components, vectors, leaks and the pipeline against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, near_dups, vectors
from shelfmark.llm.components import components


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_copies(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(900, 990)] + [(5, 5), (None, 7), (2000, 2001), (2001, 2000)]
    pairs += [(rng.randint(3000, 3100), rng.randint(3000, 3100)) for _ in range(70)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == union(real, {n for p in real for n in p})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 250))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    for k in range(1, 9):
        rows += [(n, " ".join(f"s{i}" for i in range(k))), (n + 1, " ".join(f"S{i}" for i in range(k)))]
        n += 2
    rows += [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "a b c d e f g"), (n + 4, "a b c d e f g a b c d e f g a b c d e f g")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,block", [(85, 1500), (80, 5)])
def test_classes_equal_brute_force(spark, percent, block):
    rows = near_corpus(percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("family", F.lit(1))
    got = near_dups.near_duplicates(df, percent=percent, block=block).collect()
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = union(links, ids)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])
    assert len(links) > 50


def test_near_duplicates_of_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.near_duplicates(empty).collect() == []
    rows = [(4, "one two three four five six"), (4, "one two three four five six"), (None, "one two three four five six"), (9, "one two three four five six"), (1, None)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_copies_of_one_text_are_cut_into_blocks(spark):
    # the deeper values of the path are the same in all of them
    regions = spark.range(6000).select(F.col("id").alias("node"), F.lit(7).alias("region"), F.lit(b"\x01" * 16).alias("path"), F.lit(6000).alias("members"))
    placed = near_dups.placed_in_blocks(regions, 500, 3).groupBy("place.block").count().collect()
    assert len(placed) == 12 and max(r["count"] for r in placed) < 750


@pytest.mark.parametrize("split", [1500, 3000])
def test_memory_of_alike_sets_does_not_grow_with_the_square(split):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(100, 95, replace=False)).astype(np.uint64) for _ in range(3000)]
    tracemalloc.start()
    links = near_dups.spanning_links(sets, split, 90, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 << 20
    member = np.zeros((3000, 100), np.int64)
    for i, s in enumerate(sets):
        member[i, s.astype(np.int64)] = 1
    both = member @ member.T
    near = np.argwhere(100 * both >= 90 * (190 - both))
    near = near[(near[:, 0] < split) & (near[:, 1] >= split)] if split < 3000 else near[near[:, 0] < near[:, 1]]
    assert union(links, range(3000)) == union(near.tolist(), range(3000)) and 0 < len(links) < 3000


def test_depth_follows_the_similarity():
    assert near_dups.depth_for(85) == 4 and near_dups.depth_for(80) == 3


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    words = [f"w{rng.random()}" for _ in range(900)]
    texts = pa.array([" ".join(words[:600]), " ".join(words[100:700])])
    offsets, h = near_dups.shingle_sets(texts, 1)
    mark = near_dups.signatures(offsets, h)
    assert abs(np.mean(mark[0] == mark[1]) - 500 / 700) < 0.13


def brute_vectors(rows, threshold):
    good = {}
    for vec, v, label in rows:
        if vec is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[vec] = (label, np.array(v, np.float64))
    links = []
    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("block", [2000, 7])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows, n = [], 0
    for label in (1, 2, 3):
        for _ in range(12):
            base = rng.standard_normal(32)
            for _ in range(int(rng.integers(1, 12))):
                v = base * rng.uniform(0.5, 2) + rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.1, 0.15])
                rows.append((n, [float(np.float32(x)) for x in v], label))
                n += 1
    same = rows[0][1]
    rows += [(n + k, same, 1) for k in range(20)]
    n += 20
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0]]
    rows += [(n + k, v, 1) for k, v in enumerate(bad)] + [(n + 20, same, None), (n + 21, [-0.0] + same[1:], 1), (n + 22, [0.0] + same[1:], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x")).withColumn("v", F.lit(0))
    links = brute_vectors(rows, 0.98)
    want = union(links, [r[0] for r in rows])
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = vectors.near_vectors(df, threshold=0.98, block=block).collect()
    assert len(got) == len(rows) and len(links) > 200
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], want[r.vec_id], r.vec_id == want[r.vec_id])


def test_vectors_of_empty_tables_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)]
    got = sorted((r.vec_id or 0, r.n_links) for r in vectors.near_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_an_id_with_two_vectors_joins_what_both_link_to(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (3, [1.0, 0.01], 1), (4, [0.01, 1.0], 1), (7, [0.0, 1.0], 1), (9, [1.0, 0.0], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [(3, 1, 3), (4, 2, 3), (5, 2, 3), (5, 2, 3), (7, 2, 3), (9, 0, 9)]


def test_dense_cluster_gives_a_row_a_vector_and_no_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(16) + rng.standard_normal((300, 16)) * 0.02
    table = pa.table(
        {"node": range(300), "own": range(300), "label": ["a"] * 300, "dim": [16] * 300, "band": [0] * 300, "value": [0] * 300,
         "v": x.tolist(), "copies": [1] * 300, "block": [0] * 300, "low": [0] * 300, "high": [0] * 300}
    )
    _, code, fix = vectors.encode(x / np.linalg.norm(x, axis=1, keepdims=True), 64)
    table = table.append_column("code", pa.array([np.packbits(c).tobytes() for c in code], pa.binary())).append_column("fix", pa.array(fix))
    got = vectors._meet(8, 8, 0.98, 6.0)(table)
    assert got.num_rows == 300
    assert set(got.column("links").to_pylist()) == {299} and set(got.column("least").to_pylist()) == {0}


def test_rows_reached_by_pairs():
    assert vectors.least_reached(7, np.array([1, 3, 5]), np.array([2, 2, 6])).tolist() == [0, 1, 1, 1, 4, 5, 5]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    y = 0.9 * x + 0.3 * rng.standard_normal((400, 64))
    x, y = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, y))
    _, code, fix = vectors.encode(x, 256)
    rotated = vectors.encode(y, 256)[0]
    true = (x * y).sum(axis=1)
    estimate = np.diag(vectors.upper_bounds(code, fix, rotated, 0.0))
    assert abs((estimate - true).mean()) < 0.01
    assert (np.diag(vectors.upper_bounds(code, fix, rotated, 6.0)) >= true).all()


def local_alignment(passage, item):
    """Smith-Waterman by the book."""
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(8)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 40)), rng.integers(0, 4, rng.integers(1, 20))
        score, begin, end = decontaminate.align(a, b)
        assert score == local_alignment(a, b)
        if score:
            assert local_alignment(a[begin:end], b) == score


def leak_corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 5))) for _ in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(25, 60)))) for k in range(15)]
    items += [(50, None), (51, ""), (52, "zq zr"), (None, "one item without an identity of its own but with many words")]
    docs, planted = [], set()
    for d in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 300))
        kind = rng.random()
        if kind < 0.3:
            k, text = items[rng.randrange(15)]
            part = text.split()
            for _ in range(int(len(part) * rng.choice([0, 0.05, 0.12]))):
                at = rng.randrange(len(part))
                change = rng.random()
                if change < 0.6:
                    part[at] = "edited"
                elif change < 0.8:
                    part.insert(at, "more")
                else:
                    del part[at]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.1 else w for w in part]
            planted.add((d, k))
        docs.append((d, rng.choice([" ", "\n", ", "]).join(words)))
    docs += [(200, None), (201, ""), (202, "begin zq zr end"), (203, items[0][1] * 1), (203, items[0][1])]
    planted |= {(202, 52), (203, 0)}
    return docs, items, planted


@pytest.mark.parametrize("block", [4 << 20, 700])
def test_planted_leaks_are_found_and_no_others(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items, planted = leak_corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == planted
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns
    bad = {d for d, _ in planted}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text of a document")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "text of a document")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.find_leaks(docs.limit(0), items).collect() == []
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == 1
    assert [r.item_id for r in decontaminate.find_leaks(docs, items).collect()] == [1]
