"""The pipeline's stages against plain re-tellings, on the smallest table with odd rows added."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_pairs import shingles, union
from tests.llm.test_repeats import brute_bytes
from tests.llm.test_rows import check_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    long = rows.orderBy(F.length("text").desc()).first()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [
        (9001, None, None, None, None),
        (9002, "", "en", "x", 0),
        (9003, "12 34 !!", "en", "x", 8),
        (9004, long.text, long.lang, "copy", long.n_chars),
        (9005, "Wer das liest, der " + item + " und so fort", "de", "leak", 1),
        (9006, long.text[:2000] + " and then quite another end of it all", long.lang, "half", 1),
    ]
    return rows.unionByName(spark.createDataFrame(odd, rows.schema))


def staged(spark, docs, upto):
    for _, stage in cp.STAGES[:upto]:
        rows = stage(spark, docs, SF)
        docs = spark.createDataFrame(rows.collect(), rows.schema)
    return docs


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in cp.STAGES] == ["language", "near_dups", "suffix_dedup", "decontamination", "packing"]


def test_language_keeps_what_has_letters(spark, docs):
    kept = cp.language(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.collect()}
    assert {9001, 9002, 9003} <= gone
    short = {r.doc_id for r in docs.collect() if len(re.findall(r"[^\W\d_]", r.text or "")) < 3}
    assert gone <= short


def test_one_document_of_each_class_stays(spark, docs):
    before = docs.filter("text is not null and text <> ''")
    kept = cp.near_dups(spark, before, SF)
    assert kept.columns == docs.columns
    sets = {r.doc_id: shingles(r.text) for r in before.collect()}
    ids = sorted(sets)
    inverted: dict = {}
    for d in ids:
        for s in sets[d]:
            inverted.setdefault(s, []).append(d)
    pairs = {(a, b) for group in inverted.values() for a in group for b in group if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    classes = union(links, ids)
    assert {r.doc_id for r in kept.collect()} == {d for d in ids if classes[d] == d}
    assert 9004 not in {r.doc_id for r in kept.collect()}


def test_repeated_strings_are_cut_out_of_the_texts(spark, docs):
    before = docs.filter("doc_id % 3 = 0 or doc_id > 9000")
    rows = before.collect()
    want = brute_bytes([(r.doc_id, r.text) for r in rows], 100)
    kept = {r.doc_id: r for r in cp.suffix_dedup(spark, before, SF).collect()}
    for r in rows:
        size, removed, _, body = want[r.doc_id]
        if removed == size and size:
            assert r.doc_id not in kept
            continue
        now = kept[r.doc_id]
        assert (now.lang, now.source) == (r.lang, r.source)
        text = body.decode("utf-8", "replace").replace("�", "") if removed else r.text or ""
        assert now.text == text and (now.n_chars == len(text) if removed else now.n_chars == r.n_chars)


def test_documents_with_test_items_go(spark, docs):
    kept = {r.doc_id for r in cp.decontamination(spark, docs, SF).collect()}
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in docs.collect() if any(i in plain(r.text) for i in items)}
    assert 9005 in holds and not holds & kept
    assert {r.doc_id for r in docs.collect()} - holds == kept


def test_the_whole_run(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    last = staged(spark, spark.read.parquet(f"{SF}/documents.parquet"), 4)
    pieces = cp.run(spark, SF).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in last.collect()], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert len(np.unique([p.doc_id for p in pieces])) == last.count()


def test_empty_tables_pass_through(spark, docs):
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_rows_that_repeat_are_kept_or_dropped_alike(spark, docs):
    some = docs.limit(20)
    both = some.unionByName(some)
    assert cp.language(spark, both, SF).count() % 2 == 0
    assert cp.near_dups(spark, both, SF).count() % 2 == 0
    assert cp.decontamination(spark, both, SF).count() % 2 == 0
    # of two equal rows the second repeats the first
    assert cp.suffix_dedup(spark, both, SF).count() <= both.count()
