"""Importance resampling, lexical search and best-fit packing against plain re-tellings."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import bestfit, lexical, resample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, "The quick brown Fox, the QUICK fox; naïve Ünïcode über 日本 x-1 " * 3),
    (2, None), (3, ""), (4, "  ,.;\x00--"), (5, "w" * 3000 + " tail end"), (6, "alpha beta " * 30_000),
    (7, "one two"), (7, "one two"), (7, "another text of the same id " * 5), (None, "no id but words enough to be drawn " * 4),
    (8, "ÀÉ b c K"), (9, "last"),
]


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame(rows, f"{name} long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))


def resampled_by_hand(docs, target, percent, least, longest, buckets):
    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    s, t = Counter(b for _, x in docs for b in runs(x)[1]), Counter(b for x in target for b in runs(x)[1])
    ratio = lambda b: (t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))
    out = []
    for doc, text in docs:
        words, found = runs(text)
        weight = sum(math.floor(1000 * math.log(ratio(b))) for b in found) // max(1, len(found))
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= least)
    return Counter(out), fit[: percent * len(fit) // 100]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 97), (2, 70_000)])
def test_resampling_equals_a_plain_count(spark, longest, buckets):
    many = [(100 + i, " ".join(f"w{(i * j) % 53}" for j in range(i))) for i in range(60)]
    target = ["w1 w2 w3 w4 w5", None, "", "the QUICK fox"]
    got = resample.resample(
        frame(spark, ODD + many).repartition(3), frame(spark, list(enumerate(target)), "n"), percent=30, min_words=5, longest=longest, buckets=buckets
    ).collect()
    want, drawn = resampled_by_hand(ODD + many, target, 30, 5, longest, buckets)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == want
    ranked = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[1:] for r in ranked] == drawn


def test_resampling_of_equal_rows_and_empty_tables(spark):
    same = frame(spark, [(5, "a b c d e f")] * 40)
    got = resample.resample(same, same, percent=25, min_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, 11)) and len(got) == 40
    none = same.limit(0)
    assert resample.resample(none, same).collect() == []
    assert {r.weight for r in resample.resample(same, none).collect()} != {None}


@given(st.lists(st.binary(max_size=90), max_size=12), st.binary(max_size=5))
@settings(max_examples=60, deadline=None)
def test_growing_a_crc(words, head):
    data = np.frombuffer(b"".join(words) + b"x", np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    before = np.full(len(words), zlib.crc32(head), np.uint32)
    got = resample.crc_extend(before, data, ends - [len(w) for w in words], ends) if words else []
    assert [int(x) for x in got] == [zlib.crc32(head + w) for w in words]


def searched_by_hand(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=str):
        own, found = set(terms(text)), []
        for d, bag in bags:
            m = 10 + 90 * bag.total() * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in own if bag[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, *f) for i, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf,tree,block", [(48, 16_384, 1 << 20), (1, 40, 200), (3, 7, 1)])
def test_search_equals_scoring_every_document(spark, monkeypatch, leaf, tree, block):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    some = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 40)) if x < 200)) for i in range(20, 420)]
    docs = ODD + some + [(900 + i, some[5][1] + " Extra") for i in range(30)]
    items = [(1, "t1 t2 T3 t150 t150"), (2, some[7][1]), (2, "another item t9"), (3, None), (4, "--"), (5, "quick 日本 alpha"), (5, "quick 日本 alpha"), (None, "t4 t5 t6 extra"), (6, "unheard")]
    got = lexical.lexical_search(frame(spark, docs).repartition(3), frame(spark, items, "item_id"), top=10, block_bytes=block, tree=tree).collect()
    rows = sorted(((r.item_id, r["rank"], -r.score, r.doc_id is None, r.doc_id or 0) for r in got), key=str)
    assert rows == searched_by_hand(docs, items, 10)


def test_a_tree_bounds_what_lies_below(monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", 4)
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(60, rng.integers(1, 9), replace=False)) for _ in range(300)]
    begin = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    counts = rng.integers(1, 5, begin[-1])
    t = lexical.Tree(np.arange(300), rng.integers(10, 99, 300), begin, np.concatenate(sets), counts, 16)
    assert len(t.first) > 50
    for node, kids in enumerate(t.kids):
        a, b = t.first[node], t.last[node]
        if kids is not None:
            assert [t.first[k] for k in kids] == [a, *[t.last[k] for k in kids[:-1]]] and t.last[kids[-1]] == b
        assert t.least[node] == t.m[a:b].min() and t.least_id[node] == t.ids[a:b].min()
        for c in range(16):
            mine = t.counts[t.begin[a] : t.begin[b]][t.terms[t.begin[a] : t.begin[b]] % 16 == c]
            assert t.most[node, c] == mine.max(initial=0)


def test_search_leaves_subtrees_out():
    # documents of the item's own terms come first, so that the bar keeps the rest out
    ids = np.arange(4000)
    terms = np.concatenate([[i % 40, 40 + i % 7] for i in ids])
    t = lexical.Tree(ids, np.full(4000, 50), np.arange(0, 8001, 2), terms, np.ones(8000, np.int64), 47)
    best, weights = lexical.Best(10), np.full(47, 1000)
    seen = []
    offer = best.offer
    best.offer = lambda score, docs: (seen.append(len(docs)), offer(score, docs))
    own = np.array([3, 41])
    all_weights = np.zeros(47, np.int64)
    all_weights[own] = weights[own]
    t.search(own, weights[own], all_weights, best)
    assert best.ids.tolist() == [i for i in range(4000) if i % 40 == 3 and i % 7 == 1][:10]
    assert sum(seen) < 400


def test_norms_do_not_overflow():
    big = np.array([1, 10**7, 10**9])
    assert lexical.norms(big, 10**12, 10**15 + 7).tolist() == [10 + 90 * int(n) * 10**12 // (10**15 + 7) for n in big]


def test_search_of_empty_tables(spark):
    some, none = frame(spark, ODD), frame(spark, ODD).limit(0)
    items = frame(spark, [(1, "fox")], "item_id")
    assert lexical.lexical_search(none, items).collect() == []
    assert lexical.lexical_search(some, items.limit(0)).collect() == []
    assert len(lexical.lexical_search(some, items).collect()) == 1


def check_sequences(rows, docs, tok, room):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for doc, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        over = len(ids) - (len(ids) - 1) // room * room
        cuts = [0, *range(over, len(ids) + 1, room)]
        want[doc] += [(i, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for doc, parts in want.items():
        assert sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in by_doc[doc]) == sorted(parts)
    assert set(by_doc) == set(want)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= room
    return len(by_sequence)


def test_pieces_lie_gapless_in_few_sequences(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = bestfit.pack_best_fit(frame(spark, docs).repartition(3), path).collect()
    least = sum(r.length for r in rows) / 2048
    assert check_sequences(rows, docs, tok, 2048) <= math.ceil(least) + 1
    odd = ODD + [(50, " a" * 15), (51, " a" * 16), (52, " a" * 31)]
    assert check_sequences(bestfit.pack_best_fit(frame(spark, odd).repartition(2), path, room=16).collect(), odd, tok, 16)
    assert bestfit.pack_best_fit(frame(spark, odd).limit(0), path).collect() == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
@settings(max_examples=40, deadline=None)
def test_any_histogram_is_packed_whole(counts):
    lengths = np.array(sorted(counts), np.int64)
    count = np.array([counts[x] for x in sorted(counts)], np.int64)
    found = bestfit.solve(lengths, count, 64, rounds=6)
    for plan in (found.plan, bestfit.best_fit(lengths, count, 64)):
        used = Counter()
        for own, number in plan:
            assert number > 0 and sum(n * t for n, t in own) <= 64
            for n, t in own:
                used[n] += t * number
        assert used == Counter(counts)
    plain = sum(n for _, n in bestfit.best_fit(lengths, count, 64))
    assert math.ceil(found.bound - 1e-6) <= found.sequences <= plain * 1.1 + 1
    if counts:
        places = bestfit.Places(found.plan)
        length = np.repeat(lengths, count)
        sequence, offset = places(length, np.concatenate([np.arange(n) for n in count]))
        order = np.lexsort((offset, sequence))
        s, o, size = sequence[order], offset[order], length[order]
        new = np.append(True, s[1:] != s[:-1])
        assert (np.where(new, 0, np.append(0, (o + size)[:-1])) == o).all() and len(set(s.tolist())) == found.sequences


def test_best_fit_of_groups_is_best_fit_of_pieces():
    rng = np.random.default_rng(5)
    lengths, count = np.unique(rng.integers(1, 101, 400), return_counts=True)
    free: list[int] = []
    for x in sorted(np.repeat(lengths, count).tolist(), reverse=True):
        fit = min((f for f in free if f >= x), default=None)
        if fit is not None:
            free.remove(fit)
        free.append((fit if fit is not None else 100) - x)
    assert sum(n for _, n in bestfit.best_fit(lengths, count, 100)) == len(free)


def test_the_program_finds_what_best_fit_misses():
    # 4 + 3 + 3 fill a sequence of 10; longest first, the fours meet each other
    lengths, count = np.array([3, 4]), np.array([200, 100])
    assert bestfit.solve(lengths, count, 10).sequences == 100
    assert sum(n for _, n in bestfit.best_fit(lengths, count, 10)) > 110
