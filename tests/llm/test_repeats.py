"""Repeated strings and phrases against brute force, over several groups and buckets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import packs, phrases, repeats
from shelfmark.llm.suffixes import adjacent_prefixes, eight_bytes, suffix_array


def corpus(seed, count=120, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    passages = [rng.choices(vocabulary, k=rng.randint(15, 40)) for _ in range(5)]
    rows, made = [], []
    for i in range(count):
        kind = rng.random()
        if kind < 0.15 and made:
            text = rng.choice(made)
        elif kind < 0.4 and made:
            parts = rng.choice(made).split(" ")
            parts[rng.randrange(len(parts))] = "edited"
            text = " ".join(parts)
        else:
            parts = rng.choices(vocabulary, k=rng.randint(1, words))
            if kind < 0.8:
                at = rng.randint(0, len(parts))
                parts[at:at] = rng.choice(passages) * rng.randint(1, 2)
            text = rng.choice([" ", "\n", "  "]).join(parts)
        made.append(text)
        rows.append((i, text))
    rows += [(count, None), (count + 1, ""), (count + 2, " \n "), (count + 3, "x" * 900), (count + 4, "ab" * 400)]
    rng.shuffle(rows)
    return rows


def brute_bytes(rows, window):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for s in range(len(body) - window + 1):
            part = body[s : s + window]
            if part in seen:
                gone[s : s + window] = True
            seen.add(part)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[doc] = (len(body), int(gone.sum()), spans, bytes(np.frombuffer(body, np.uint8)[~gone]))
    return out


def brute_words(rows, window):
    first, out, cut = {}, {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        cut[doc] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for s in range(len(cut[doc]) - window + 1):
            first.setdefault(tuple(cut[doc][s : s + window]), doc)
    for doc, words in cut.items():
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < doc:
                gone[s : s + window] = True
        out[doc] = (len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # names that the operators use themselves must not clash
    return df.withColumn("grp", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("doc", F.lit(None).cast("string"))


@pytest.mark.parametrize("most", [1, 50_000])
def test_byte_strings_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4000)
    rows = corpus(most)
    got = repeats.remove_repeats(frame(spark, rows), window=100, most=most, group_bytes=3000).collect()
    want = brute_bytes(rows, 100)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
        assert len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("window", [2, 13, 30])
def test_phrases_equal_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 4000)
    rows = corpus(window)
    got = phrases.remove_phrases(frame(spark, rows), window=window, group_bytes=3000).collect()
    want = brute_words(rows, window)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_levels_double_up_to_the_window():
    assert phrases.levels(13) == [7, 13]
    assert phrases.levels(50) == [7, 13, 25, 50]
    assert phrases.levels(2) == [1, 2]


def test_empty_tables_and_repeated_or_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).collect() == []
    assert phrases.remove_phrases(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in repeats.remove_repeats(rows).collect())
    assert got == [(False, 0), (False, len(text)), (True, 0), (True, len(text))]
    got = sorted((r.doc_id is None, r.n_removed) for r in phrases.remove_phrases(rows).collect())
    assert got == [(False, 0), (False, 0), (True, 0), (True, 40)]


def test_a_text_beyond_one_slab(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60_000))
    rows = [(1, long), (2, "head " + long[1000:300_000] + " tail"), (3, "y" * 600_000)]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and bytes(got[1].kept).decode() == long
    assert got[2].n_removed in (299_000, 299_001, 299_002) and got[2].n_spans == 1
    assert got[3].n_removed == 599_999
    # a word longer than a slab is one word
    got = {r.doc_id: r for r in phrases.remove_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].n_words == 1 and got[1].n_removed == 0 and got[2].n_words - got[2].n_removed <= 4


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n, depth = int(rng.integers(1, 150)), int(rng.integers(1, 20))
        text = rng.integers(0, 4, n).astype(np.uint8)
        if trial % 3 == 0:
            text = np.repeat(rng.integers(0, 3, n // 5 + 1), 5)[:n].astype(np.uint8)
        words = eight_bytes(text, depth + 8)
        order = suffix_array(text, depth, words)
        assert sorted(order) == list(range(n))
        shown = [bytes(text[i : i + depth]).split(b"\0")[0] for i in order]
        assert shown == sorted(shown)
        for i, found in enumerate(adjacent_prefixes(order, words, depth)):
            a, b = (bytes(text[order[k] : order[k] + depth]).ljust(depth, b"\0") for k in (i, i + 1))
            assert found == next((k for k in range(depth) if a[k] != b[k]), depth)


def test_packs_keep_their_rows():
    rows = [(2, 1, 0, b"x"), packs.own(3, 1, b"y")]
    assert packs.pack_rows(packs.pack_table(rows)) == sorted(rows)
