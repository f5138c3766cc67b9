"""Operators that judge each row where it lies: URLs, archive, packing, language, quality."""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import language, packing, quality, url_filter, warc

SF = "/root/testdata/sf0.001"


def url_by_hand(url):
    """Host and path by plain string work."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def hits_by_hand(url):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    found = lambda t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)
    return sum(bool(found(t)) for t in url_filter.STRICT), sum(w for t, w in url_filter.SOFT.items() if found(t))


URLS = [
    "https://Example.ORG/es/1", "http://a.example.org/en/12?x#y", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/a",
    "http://notexample.org/es/", "http://com/fr/x", "http://x.com", "http://x.net/porn/", "http://x.net/pornography",
    "http://x.net/casino-poker", "http://x.net/casino?casino=casino", "http://sex.net/dating/bonus", "no scheme/porn", "", None,
    "://", "ftp://É.org/é#:", "http://a.org?x=/es/", "http://u:p@h.org:80/a b\nc", "a://b://c/d", "http://x.net/xxx2", "http://xxx",
]


def test_urls_equal_a_plain_reading(spark):
    rows = [(i, u, "shadow") for i, u in enumerate(URLS)] + [(0, URLS[0], "shadow")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path) == url_by_hand(r.url)
        assert (r.strict_hits, r.soft_weight) == hits_by_hand(r.url)
        fits = [x for x in url_filter.RULES if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.name), default=None)
        assert r.rule == (rule.name if rule else None)
        method = "block" if r.strict_hits or r.soft_weight >= 2 else "allow"
        assert r.verdict == (rule.verdict if rule else method)
    assert {r.url: r.verdict for r in got}["http://x.net/casino-poker"] == "block"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_archive_round_trip(spark, tmp_path):
    page = "<p>é</p>\r\n\r\n" * 3
    rows = [(5, "http://a", page), (2, "http://b\r\nX: y", page), (9, None, None), (7, "u", ""), (None, "n", "only"), (3, "c", "x" * 300_000), (5, "http://a", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("length", F.lit("clash"))
    path = f"file://{tmp_path}/archive"
    warc.write_archive(df, path)
    records = warc.read_archive(spark, path)
    got = warc.parse_records(records).collect()
    assert len(got) == len(rows)
    first = {"": 7, page: 2, "only": None, "x" * 300_000: 3}
    body = {r[0]: (r[2] or "") for r in rows}
    for r in got:
        text = body[r.page_id]
        assert r.payload_bytes == len(text.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert (r.record_type == "response") == (r.page_id == first[text])
        assert r.refers_to == (None if r.page_id == first[text] else first[text])
    whole = [bytes(r.record) for r in warc.record_bytes(records).collect()]
    assert all(w.startswith(b"WARC/1.1\r\n") and w.endswith(b"\r\n\r\n") for w in whole)
    # each payload is stored once
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    warc.write_archive(df.limit(0), path + "-empty")
    assert warc.parse_records(warc.read_archive(spark, path + "-empty")).count() == 0


def test_a_changed_payload_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), path)
    stored = spark.read.parquet(f"{path}/payloads").withColumn("packed", F.unhex(F.lit("28b52ffd2004210000626f6479")))
    stored.write.parquet(f"{path}/other")
    other = spark.read.parquet(f"{path}/other").withColumn("address", F.unhex(F.lit("00" * 32)))
    broken = spark.createDataFrame([(b"h",)], "header binary").crossJoin(other).select("header", "address", "packed")
    with pytest.raises(Exception, match="does not match its address"):
        broken.mapInArrow(warc._open, "header binary, payload binary").collect()


TEXTS = [
    "The quick  brown fox", " lead", "trail ", "a \n b\n\n c", "tab\tx \t y", "", None, "n\u00a0b \u00a0sp", "<|endoftext|> x<|endoftext|>y", "don't we'll 'tis",
    "漢字 かな 😀 é", "x" * 5000, "word " * 3000, "\x1c \x1c a", "nul\x00 byte \x00", "\u2003wide \u2003 space", "123 456,789 !!??",
]


def check_pieces(rows, texts, tokenizer):
    ids = {}
    for doc, text in texts:
        ids[doc] = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == ids[doc], doc
        assert all(r.doc_tokens == len(ids[doc]) for r in pieces)
    waste = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
        total = sum(r.length for r in pieces)
        assert total <= 1024
        waste += 0 if total & (total - 1) == 0 else 1024 - total
    assert waste == 0


def test_pieces_hold_every_token_once(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = list(enumerate(TEXTS))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("start", F.lit("clash"))
    for block in (64, 4 << 20):
        got = packing.pack_documents(df.coalesce(1), path, block_bytes=block).collect()
        check_pieces(got, texts, Tokenizer.from_file(path))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check_pieces(packing.pack_documents(docs.repartition(3), path).collect(), texts, Tokenizer.from_file(path))
    assert packing.pack_documents(df.limit(0), path).collect() == []


def test_words_are_encoded_as_the_file_says():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    words = [t or "" for t in TEXTS]
    assert packing.word_encoder(path)(words) == [own.encode(w, add_special_tokens=False).ids for w in words]


def test_costs_are_balanced():
    packer = packing.Packer(1024, 1024, 0)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 400, 400)
    rest = [(k, np.full(n, k, "<u4").tobytes(), 0, int(n)) for k, n in enumerate(sizes)]
    rows = list(packer.pack(rest, last=True))
    assert sum(r[2] for r in rows) == sizes.sum()
    cost = {}
    for r in rows:
        cost[r[5]] = cost.get(r[5], 0) + packing.piece_cost(r[2], 1024)
    full = sorted(cost.values())[8:]
    assert max(full) < 1.5 * min(full)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = language.fit_languages(docs.filter(~third))
    found = language.identify(docs.filter(third), model).join(docs, "doc_id")
    right = found.filter("lang = lang_pred").count() / found.count()
    assert right > 0.98
    english, french = (docs.filter(~third & (F.col("lang") == x)).orderBy(F.length("text").desc()).first().text for x in ("en", "fr"))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, english[:1500] + " " + french[:1500]), (5, english[:1500]), (None, french[:500]), (5, english[:1500])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(7)).withColumn("score", F.lit("x"))
    got = language.identify(df, model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[k].lang_pred, by_id[k].score) == ("und", 0.0) for k in (1, 2, 3))
    assert by_id[5].lang_pred == "en" and by_id[None].lang_pred == "fr"
    # a text in two languages has two shares of about a half
    shares = {s.lang: s.share for s in by_id[4].shares}
    assert abs(shares["en"] - 0.5) < 0.15 and abs(shares["fr"] - 0.5) < 0.15
    assert [s.lang for s in by_id[5].shares] == ["en"]
    kept = language.with_known_language(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) in ([0, 4, 5, 5], [0, 5, 5])


def even_mixture(languages, grams=3000):
    """A model of distinct languages and the text of all of them in equal parts."""
    rng = np.random.default_rng(8)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"[4 * j : 4 * j + 5]), 5)) for _ in range(60)] for j in range(languages)]
    text = lambda j: " ".join(rng.choice(words[j], grams // 6))
    own = [text(j) for j in range(languages)]
    counts = [language._counts(*language._grams(pa.array([t]), 4096), 0, 1, 4096)[0] + 0.5 for t in own]
    p = np.array(counts, np.float64)
    model = language.LanguageModel([f"l{j}" for j in range(languages)], np.log(p / p.sum(axis=1, keepdims=True)))
    return model, " ".join(text(j) for j in range(languages))


def test_an_even_mixture_of_languages_is_kept(spark):
    for n in (4, 6):
        model, text = even_mixture(n)
        df = spark.createDataFrame([(1, text), (2, "12 ?"), (3, None), (4, "a"), (5, "abcd")], "doc_id long, text string")
        shares = {r.doc_id: r.shares for r in language.identify(df, model).collect()}
        assert sorted(s.lang for s in shares[1]) == model.languages
        assert all(abs(s.share - 1 / n) < 0.05 for s in shares[1])
        assert sorted(r.doc_id for r in language.with_known_language(df, model).collect()) == [1, 5]


def test_the_penalty_alone_ends_the_language_set():
    model, _ = even_mixture(3)
    p = np.exp(model.log_p)
    # half a percent of a long text pays its penalty, of a short one it does not
    counts = np.outer([400_000, 400], 0.995 * p[0] + 0.005 * p[1]).astype(np.float32)
    share = language.infer(counts, model, 2.0)
    assert 0 < share[0, 1] < 0.01 and share[0, 2] == 0
    assert (share[1] == [1, 0, 0]).all()


def test_language_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit_languages(empty)
    assert model.languages == []
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(one, model).collect()] == [("und", 0.0)]
    assert language.identify(empty, model).collect() == []


def test_mixture_shares_by_expectation_maximisation():
    p = np.array([[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]])
    counts = (1000 * (0.3 * p[0] + 0.7 * p[1]))[None, :]
    share, _ = language.mixture(counts, p, np.full((1, 2), 0.5), rounds=200)
    assert abs(share[0, 0] - 0.3) < 0.01


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = quality.fit_quality(docs, labels.filter(~held).unionByName(labels.limit(1).withColumn("quality", F.lit(None).cast("int"))))
    found = quality.score_quality(docs, model).join(labels.filter(held), "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == bool(r.quality) for r in found]) > 0.93
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "A plain text.")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = quality.score_quality(rows, model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    none = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(rows, none).collect()} == {0.5}


def test_features_do_not_depend_on_slabs():
    text = pa.array(["ab cd ab", None, "x" * 3_000_000 + " é"])
    from shelfmark.llm.frames import text_bytes

    offsets, data = text_bytes(text)
    whole = np.zeros(3, np.int64)
    for doc, _ in quality.features(data, offsets):
        whole += np.bincount(doc, minlength=3)
    n = [8, 0, 3_000_003]
    # words, pairs, and n-grams of both sizes
    want = [(3 if k == 0 else 2 if k == 2 else 0) + (2 if k == 0 else 1 if k == 2 else 0) + sum(max(0, n[k] - s + 1) for s in quality.SIZES) for k in range(3)]
    assert whole.tolist() == want
