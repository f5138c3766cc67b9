"""Keyed changes beside a version, their log, and the merging of open objects."""

import copy
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.operators import registry as rg
from shelfmark.operators import writes as wr
from shelfmark.plans.changes import SEAL, Sealed
from shelfmark.plans.publish import BlueGreenCatalog
from shelfmark.plans.store import ConcurrentPublish
from shelfmark.schema import undeclared_texts
from tests.conftest import make_products


@pytest.fixture
def catalog(spark, root):
    return BlueGreenCatalog(spark, root)


def prices(catalog, alias="shop"):
    return {r["id"]: r["Price"] for r in catalog.table(alias).collect()}


def files_below(path):
    import os

    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith((".parquet", ".json")))


def test_a_write_of_one_document_writes_its_row_alone(spark, catalog, root):
    catalog.deploy("shop", make_products(spark, 40), rg.AUTO_SWAP)
    before = files_below(root.removeprefix("file://"))
    assert catalog.update("shop", "test-7", '{"Price": 1}') == "updated"
    new = sorted(set(files_below(root.removeprefix("file://"))) - set(before))
    assert new and all("/changes/" in f for f in new) and sum(f.endswith(".json") for f in new) == 1
    assert spark.read.parquet(*[f for f in new if f.endswith(".parquet")]).count() == 1
    assert prices(catalog)["test-7"] == 1.0 and catalog.count("shop") == 40
    assert catalog.get("shop", "test-7")["Price"] == 1.0
    # the id reaches the scan below the changes
    plan = catalog.table("shop").filter(F.col("id") == "test-8")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,test-8)" in plan


def test_the_order_of_changes_decides(spark, catalog):
    catalog.deploy("shop", make_products(spark, 3), rg.AUTO_SWAP)
    catalog.update("shop", "test-1", '{"Price": 5}')
    catalog.index_one("shop", make_products(spark, 1).withColumn("Price", F.lit(9.0)))
    assert prices(catalog)["test-1"] == 9.0  # a whole document undoes partial ones before it
    catalog.update("shop", "test-1", '{"Locale": "de"}')
    catalog.delete("shop", "test-2")
    catalog.update("shop", "test-2", '{"Price": 2}')
    got = {r["id"]: (r["Price"], r["Locale"], r["RecordId"]) for r in catalog.table("shop").collect()}
    assert got == {"test-1": (9.0, "de", 1), "test-2": (2.0, None, None), "test-3": (65.0, "en-US", 3)}
    both = spark.createDataFrame([("test-3", 1, '{"Price": 1}'), ("test-3", 2, '{"Price": 2}')], "id string, o int, t string")
    catalog.write_changes("shop", patches=both.select("id", "o", F.parse_json("t").alias("patch")), order="o")
    assert prices(catalog)["test-3"] == 2.0
    with pytest.raises(ValueError, match="Changes are required"):
        catalog.write_changes("shop")


def test_compaction_keeps_what_is_written_meanwhile(spark, catalog, monkeypatch):
    catalog.deploy("shop", make_products(spark, 3), rg.AUTO_SWAP)
    catalog.update("shop", "test-1", '{"Price": 1}')
    first = catalog.resolve("shop")
    audit = catalog._audit

    def slow_audit(*args):
        monkeypatch.setattr(catalog, "_audit", audit)
        catalog.update("shop", "test-2", '{"Price": 2}')
        return audit(*args)

    monkeypatch.setattr(catalog, "_audit", slow_audit)
    state = catalog.compact("shop")
    assert state.active_version != first
    assert [e.ops for e in catalog.changes("shop", state.active_version).entries()] == [("patch",)]
    assert prices(catalog) == {"test-1": 1.0, "test-2": 2.0, "test-3": 65.0}
    # the old version takes no changes any more, unless it is published again
    with pytest.raises(Sealed):
        catalog.changes("shop", first).append(lambda n: None, ("delete",))
    catalog.rollback("shop")
    assert catalog.update("shop", "test-3", '{"Price": 3}') == "updated"
    assert prices(catalog) == {"test-1": 1.0, "test-2": 2.0, "test-3": 3.0}


def test_a_failed_compaction_opens_the_log_again(spark, catalog, monkeypatch):
    catalog.deploy("shop", make_products(spark, 2), rg.AUTO_SWAP)
    catalog.update("shop", "test-1", '{"Price": 1}')
    record = catalog.files.record

    def broken(alias, action, *args, **kw):
        if action == rg.PUBLISH:
            raise ConcurrentPublish("someone was first")
        return record(alias, action, *args, **kw)

    monkeypatch.setattr(catalog.files, "record", broken)
    with pytest.raises(ConcurrentPublish):
        catalog.compact("shop")
    monkeypatch.setattr(catalog.files, "record", record)
    catalog.update("shop", "test-2", '{"Price": 2}')
    assert prices(catalog) == {"test-1": 1.0, "test-2": 2.0}
    catalog.changes("shop", catalog.resolve("shop")).mark(SEAL)
    with pytest.raises(Sealed):
        catalog.update("shop", "test-2", '{"Price": 3}')
    catalog.reopen("shop")
    catalog.update("shop", "test-2", '{"Price": 3}')
    assert prices(catalog)["test-2"] == 3.0


def test_of_two_writers_both_changes_count(spark, catalog):
    catalog.deploy("shop", make_products(spark, 2), rg.AUTO_SWAP)
    log = catalog.changes("shop", catalog.resolve("shop"))
    seen = []

    def slow(n):
        if not seen:
            seen.append(n)
            catalog.update("shop", "test-2", '{"Price": 2}')
        from shelfmark.operators import changes as ch

        gone = spark.createDataFrame([("test-1",)], "id string")
        return ch.change_rows(catalog._stored("shop", catalog.resolve("shop")), n, deletes=gone)

    assert log.append(slow, ("delete",)) == 2
    assert prices(catalog) == {"test-2": 2.0}


def test_many_changes_are_compacted(spark, root):
    catalog = BlueGreenCatalog(spark, root, compact_after=2)
    catalog.deploy("shop", make_products(spark, 2), rg.AUTO_SWAP, text_fields=None)
    first = catalog.resolve("shop")
    catalog.update("shop", "test-1", '{"Price": 1}')
    assert catalog.resolve("shop") == first
    catalog.update("shop", "test-1", '{"Price": 2}')
    assert catalog.resolve("shop") != first
    assert prices(catalog) == {"test-1": 2.0, "test-2": 60.0}


def test_a_default_search_reads_the_index_after_changes(spark, catalog, monkeypatch):
    rows = make_products(spark, 6).withColumn("_extra", F.parse_json(F.lit('{"a":{"b":{"c":{"d":{"e":{"f":"teal"}}}}}}')))
    catalog.deploy("shop", rows, rg.AUTO_SWAP)
    catalog.update("shop", "test-2", '{"a": {"b": {"x": ["amber"]}}}')
    catalog.update("shop", "test-3", '{"SearchName": "violet teal", "a": null}')
    catalog.delete("shop", "test-4")
    whole = catalog.table("shop")
    from shelfmark.operators.relevance import TextIndex
    from shelfmark.plans.search import text_search

    for query, fuzzy in (("teal", 0), ("amber", 0), ("violet prodct", "AUTO"), ("test", 0)):
        want = text_search(whole, query, fuzziness=fuzzy).hits.select("id", "_score").collect()
        got = catalog.search_text("shop", query, fuzziness=fuzzy).hits.select("id", "_score").collect()
        assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want], query
    # nothing but the changed rows is split into words
    sizes, of = [], TextIndex.of.__func__
    monkeypatch.setattr(TextIndex, "of", classmethod(lambda cls, df, *a, **k: sizes.append(df.count()) or of(cls, df, *a, **k)))
    catalog.search_text("shop", "teal")
    assert sizes == [3, 2]


def test_a_search_merges_the_changes_once(spark, catalog):
    """What scores the hits was written down: neither the version nor its changes are read again for it."""
    rows = spark.createDataFrame([(f"p{i}", "red kettle" if i % 2 else "lamp") for i in range(6)], "id string, SearchName string")
    catalog.deploy("kettles", rows, rg.AUTO_SWAP, unique=True)
    catalog.write_changes("kettles", upserts=spark.createDataFrame([("p0", "green kettle")], "id string, SearchName string"))
    found = catalog.search_text("kettles", "kettle", highlight=False, fuzziness=0).matches
    assert {r["id"] for r in found.collect()} == {"p0", "p1", "p3", "p5"}
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_page_is_fetched_by_literals(spark, catalog):
    catalog.deploy("shop", make_products(spark, 30), rg.AUTO_SWAP)
    plan = catalog.search_text("shop", "product", highlight=False).hits._jdf.queryExecution().executedPlan().toString()
    assert "In(id, [" in plan


def merged_by_hand(old, new):
    out = dict(old)
    for k, v in new.items():
        out[k] = merged_by_hand(out[k] if isinstance(out.get(k), dict) else {}, v) if isinstance(v, dict) else v
    return out


VALUES = st.recursive(
    st.one_of(st.none(), st.integers(-3, 3), st.text("ab\"\\'", max_size=2), st.lists(st.integers(0, 2), max_size=2)),
    lambda inner: st.dictionaries(st.sampled_from(["x", "y", "z'"]), inner, max_size=3),
    max_leaves=6,
)
DOCUMENTS = st.dictionaries(st.sampled_from(["p", "q"]), VALUES, max_size=2)


@given(st.lists(st.tuples(DOCUMENTS, st.lists(DOCUMENTS, max_size=4)), min_size=15, max_size=30))
@settings(max_examples=2, deadline=None)
def test_open_objects_merge_like_documents(spark, documents):
    base = [(f"d{i}", json.dumps(old)) for i, (old, _) in enumerate(documents)]
    patches = [(f"d{i}", n, json.dumps(p)) for i, (_, some) in enumerate(documents) for n, p in enumerate(some)]
    rows = spark.createDataFrame(base, "id string, t string").select("id", F.parse_json("t").alias("_extra"))
    changes = spark.createDataFrame(patches, "id string, o int, t string").select("id", "o", F.parse_json("t").alias("patch"))
    got = {r[0]: json.loads(r[1]) if r[1] else {} for r in wr.patch(rows, changes, ["o"]).select("id", F.to_json("_extra")).collect()}
    for i, (old, some) in enumerate(documents):
        want = copy.deepcopy(old)
        for p in some:
            want = merged_by_hand(want, p)
        assert got[f"d{i}"] == want


def test_patches_of_open_objects_are_judged_once(spark, monkeypatch):
    """Each patch is made once, and what a later value of its entry ends is not taken apart."""
    from shelfmark.operators import open_objects

    made, apart = spark.sparkContext.accumulator(0), []

    def text(t):
        made.add(1)
        return t

    def events(rows, *names):
        apart.append(rows.count())
        return whole(rows, *names)

    whole = open_objects.events
    monkeypatch.setattr(open_objects, "events", events)
    sent = [("a", 1, '{"p": {"x": 1}}'), ("a", 2, '{"p": null}'), ("a", 3, '{"p": {"y": 2}}'), ("b", 1, '{"p": {"z": 3}, "q": 4}')]
    patches = spark.createDataFrame(sent, "id string, o int, t string").select("id", "o", F.parse_json(F.udf(text)("t")).alias("patch"))
    base = spark.createDataFrame([("a", '{"p": {"w": 0}}'), ("b", '{"p": {"w": 0}}')], "id string, t string")
    done = wr.patch(base.select("id", F.parse_json("t").alias("_extra")), patches, ["o"])
    got = {r[0]: json.loads(r[1]) for r in done.select("id", F.to_json("_extra")).collect()}
    assert got == {"a": {"p": {"y": 2}}, "b": {"p": {"w": 0, "z": 3}, "q": 4}}
    assert made.value == len(sent)
    # the null and the object after it; the old object and the one sent
    assert apart == [4]


def strings(value):
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return [s for v in inner for s in strings(v)]


def test_texts_of_every_depth_are_found(spark):
    deep = "end"
    for i in range(40):
        deep = {f"k{i}:": deep, "n": i} if i % 2 else [deep, f"s{i}\\\"\n", ":"]
    values = [deep, {"a\"b": "c\":d", "e\\": "\\", "u": "é\u0001 "}, [], {}, "alone", None, 5, {"x": "y" * 70_000, "lines": "a\n" * 20_000}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    got = rows.select("i", undeclared_texts(F.parse_json("t")).alias("s")).collect()
    assert {r.i: sorted(r.s) for r in got} == {i: sorted(strings(v)) for i, v in enumerate(values)}
    assert rows.select(undeclared_texts(F.lit(None).cast("variant")).alias("s")).first().s == []
    assert np.all([len(r.s) < 200 for r in got])


def test_fuzzy_terms_come_from_the_stored_vocabulary(spark, catalog):
    from shelfmark.functions import text as tx
    from shelfmark.operators import relevance as rv
    from shelfmark.plans.side_tables import read_text_index
    from shelfmark.schema import CatalogSchema

    names = ["kettle", "ketle", "tekttle", "kettles", "nettel", "k", "é" * 23 + "x", "ab" * 14, "ab" * 13 + "a", "two words", None, ""]
    rows = make_products(spark, len(names)).withColumn("SearchName", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("RecordId").cast("int")))
    catalog.deploy("shop", rows, rg.AUTO_SWAP, text_fields=["SearchName"])
    path = f"{catalog.files.version_path('shop', catalog.resolve('shop'))}/text"
    stored = read_text_index(spark, path, CatalogSchema.of(rows), ["SearchName"])
    plain = rv.TextIndex.of(rows, ["SearchName"])
    for query in ("kettle", "ktetle nettle", "é" * 24, "ab" * 14 + "b", "ba" + "ab" * 12, "k", "abababababababababababab"):
        got = {tuple(r) for r in rv.near_terms(stored, query).collect()}
        assert got == {tuple(r) for r in rv.near_terms(plain, query).collect()}, query
    read = rv.near_terms(stored, "kettle")
    assert all("/variants/" in f for f in read.inputFiles())
    assert "In(variant" in read._jdf.queryExecution().executedPlan().toString()
    some = spark.createDataFrame([(t,) for t in ("abc", "a", "", "aab", "x" * 25)], "t string")
    got = {r.t: set(r.d) for r in some.select("t", tx.deletions(F.col("t")).alias("d")).collect()}
    assert got == {t: tx.deletions_of(t, 2) if len(t) <= 24 else {tx.LONG_MARK} for t in got}


def test_the_registry_is_read_from_its_checkpoint(spark, catalog, monkeypatch):
    from shelfmark.plans import store

    def publish(alias, every):
        monkeypatch.setattr(store, "CHECKPOINT_EVERY", every)
        catalog.create_version(alias, "v0", "blue")
        for i in range(10):
            catalog.files.record(alias, rg.PUBLISH, "v0", "blue" if i % 2 else "green", "safe")
        rows = catalog.files.registry(alias)
        return rows, [(r.seq, r.action, r.version, r.color, r.strategy, r.label) for r in rows.orderBy("seq").collect()]

    rows, events = publish("shop", 4)
    files = {f.rsplit("/", 1)[1] for f in rows.inputFiles()}
    assert files == {f"checkpoint-{8:020d}.json", *(f"{i:020d}.json" for i in (9, 10, 11))}
    assert [e[0] for e in events] == list(range(1, 12)) and events == publish("other", 1000)[1]
    assert catalog.files.last_seq("shop") == 11
    assert catalog.status("shop").active_color == catalog.status("other").active_color
    assert [r["at"] is not None for r in rows.collect()] == [True] * 11


def test_health_comes_from_the_audit(spark, catalog):
    catalog.deploy("shop", make_products(spark, 3), rg.AUTO_SWAP, text_fields=None)
    catalog.delete("shop", "test-2")
    stats = catalog.stats("shop").first()
    assert (stats["documents"], stats["health"]) == (2, "green") and stats["files"] >= 1
    version = catalog.resolve("shop")
    make_products(spark, 1).write.mode("append").parquet(catalog.files.data_path("shop", version))
    assert catalog.stats("shop").first()["health"] == "red"  # an id is there twice


def test_near_terms_share_a_rest_of_a_half(spark):
    import itertools

    from shelfmark.functions import text as tx
    from shelfmark.operators import relevance as rv

    words = ["".join(w) for n in (1, 2, 3, 4, 5) for w in itertools.product("ab", repeat=n)]
    words += ["kettle", "ktetle", "ekttle", "kettel", "kelttle", "abcdefgh", "badcefgh", "abdcfegh", "abcedfgh", "x" * 24, "x" * 25, "x" * 26]
    df = spark.createDataFrame([(w,) for w in words], "t string").select("t", tx.half_rests(F.col("t")).alias("d")).cache()
    stored = {r.t: set(r.d) for r in df.collect()}
    # about as many as characters: two deletions anywhere in 24 characters would leave up to 301
    assert all(len(r.d) <= len(r.t) + 2 for r in df.collect())
    asked = ["kettle", "abcdefgh", "abab", "bb", "aabba", "x" * 24, "x" * 26]
    near = df.select("t", *[tx.edit_distance(F.col("t"), a, k).alias(f"{i}_{k}") for i, a in enumerate(asked) for k in (1, 2)]).collect()
    for i, a in enumerate(asked):
        for k in (1, 2):
            found = [r["t"] for r in near if r[f"{i}_{k}"] is not None]
            assert found and all(stored[t] & tx.half_rests_of(a, k) for t in found), (a, k)
    # more edits than the rests are made for are looked for in all terms
    rows = spark.createDataFrame([("1", "abcdefgh"), ("2", "xyzdefgh")], "id string, text string")
    index = rv.TextIndex.of(rows, ["text"])
    halves = index.occurrences.select(F.explode(tx.half_rests(F.col("term"))).alias("variant"), "analysis", "term")
    held = rv.TextIndex(index.occurrences, index.stats, index.fields, halves)
    assert {r.term for r in rv.near_terms(held, "abcdefgh", 3).collect()} == {"abcdefgh", "xyzdefgh"}
