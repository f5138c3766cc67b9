"""Cases that earlier rounds lost: ids with several texts, short and partial test items, room in dear sequences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from shelfmark.llm import decontaminate, near_dups, packing


def words(n, tag):
    return [f"{tag}{i}" for i in range(n)]


def test_every_text_of_an_id_has_its_links(spark):
    a, b = words(120, "a"), words(120, "b")
    near_a, near_b = [*a[:-1], "other"], [*b[:-1], "other"]
    rows = [(1, a), (1, b), (2, near_a), (3, near_b), (4, words(50, "c")), (1, a), (7, near_b), (8, words(50, "c"))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = near_dups.near_duplicates(df.repartition(3), percent=85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (7, 1, False), (8, 4, False)
    ]
    # classes that only meet in an id with three texts
    three = [(5, words(30, "x")), (5, words(30, "y")), (5, words(30, "z")), (9, words(30, "z")), (6, words(30, "y"))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in three], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dups.near_duplicates(df).collect()} == {(5, 5), (6, 5), (9, 5)}


def test_neighbours_of_sorted_paths_are_all_pairs_of_a_prefix(spark):
    rng = np.random.default_rng(2)
    marks = rng.integers(0, 3, (400, near_dups.TREES * near_dups.DEPTH)).astype(np.uint32)
    marks[:30] = marks[0]  # a dense region
    marks[:30, -1] = np.arange(30)
    nodes = spark.createDataFrame([(i, bytearray(m.tobytes())) for i, m in enumerate(marks)], "node long, signature binary")
    got = near_dups.forest_regions(nodes.repartition(5), 4).collect()
    regions = {}
    for r in got:
        regions.setdefault((r.region, r.members), []).append(r)
    found = set()
    for (_, members), own in regions.items():
        ids = [r.node for r in own]
        assert len(ids) == members == len(set(ids))
        found |= {(x, y) for x in ids for y in ids if x < y}
    paths = marks.reshape(400, near_dups.TREES, near_dups.DEPTH)
    equal = (paths[:, None, :, :4] == paths[None, :, :, :4]).all(axis=3).any(axis=2)
    assert found == {(x, y) for x, y in np.argwhere(equal).tolist() if x < y}
    depths = {r.depth for r in got}
    assert min(depths) == 4 and max(depths) > 4


def test_short_edited_items_and_excerpts_are_leaks(spark):
    short, long = "which river crosses the oldest city", words(40, "q")
    items = [(1, short), (2, " ".join(long)), (3, "what is it then"), (4, " ".join(words(12, "m")))]
    edited_12 = words(12, "m")
    edited_12[5] = "edited"
    docs = [
        (1, "so which river passes the oldest city is it"), (2, "x " + " ".join(long[11:29]) + " y"), (3, "well what is it then eh"),
        (4, "my " + " ".join(edited_12) + " end"),
        (11, "which river crosses my street"), (12, " ".join(long[3:14])), (13, "what is it now"), (14, " ".join(words(5, "m"))),
        (15, "the oldest city of all and the oldest city"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4)}


@pytest.mark.parametrize("seed", [1, 2])
def test_no_document_is_cut_while_a_sequence_has_room(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(5, 1, 1500).astype(int), 1, 1023)
    rest = [(i, np.full(n, i, "<u4").tobytes(), 0, int(n)) for i, n in enumerate(sizes)]
    packer = packing.Packer(1024, 1024, 0)
    rows = list(packer.pack(rest, last=True))
    # a plain search over all sequences makes the same choice
    bins = int(sizes.sum()) // 1024
    left, cost, whole = [1024] * bins, [0.0] * bins, {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [b for b in range(bins) if left[b] >= sizes[i]]
        if fit:
            b = min(fit, key=lambda b: (cost[b], b))
            left[b] -= sizes[i]
            cost[b] += packing.piece_cost(int(sizes[i]), 1024)
            whole[i] = b
    got = {r[0]: r[5] for r in rows if r[2] == r[4] and r[0] in whole}
    assert got == whole
    assert sum(r[2] for r in rows) == sizes.sum()


def test_replacement_characters_of_a_text_stay(spark):
    shared = "".join(f"é{i}" for i in range(60))
    texts = [shared + "end", "a�b﷐c﷐a﷐b " + shared + " �", "no repeat �"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r for r in cp.suffix_dedup(spark, docs, "").collect()}
    assert kept[1].text == "a�b﷐c﷐a﷐b  �" and kept[1].n_chars == len(kept[1].text)
    assert kept[2].text == texts[2] and kept[0].text == texts[0]
    # a string may begin or end inside a character
    cut = spark.createDataFrame([(bytearray("xé�y".encode()[2:-2]),)], "t binary").select(F.col("t").cast("string").alias("t"))
    assert cut.select(cp._without_broken_characters(F.col("t"))).first()[0] == ""
