"""Criteria semantics, sorting, facets, lookup and text search on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as tx
from shelfmark.operators import criteria as cr
from shelfmark.operators import facets as fc
from shelfmark.operators import lookup as lk
from shelfmark.operators import paging as pg
from shelfmark.operators import relevance as rv
from shelfmark.plans.search import criteria_search, text_search
from shelfmark.plans.side_tables import read_text_index, write_text_index
from shelfmark.schema import PRODUCT, PRODUCT_SCHEMA, CatalogSchema, describe, number

COLUMNS = ["id", "RecordId", "Locale", "Name", "SearchName", "Price", "CategoryIds", "IsKit", "Images", "Color"]


@pytest.fixture(scope="module")
def shop(spark):
    kinds = {f.name: f for f in PRODUCT.fields}
    schema = T.StructType([kinds.get(c) or T.StructField(c, T.StringType()) for c in COLUMNS])
    rows = [
        ("a", 1, "en-US", "Red", "Red Widget", 10.0, [9, 10], True, None, "Deep Red"),
        ("b", 2, "de-DE", "Red", "red widget", 20.0, [10], False, None, "red"),
        ("c", 3, "100%", "x", "50%_off\\now", None, [], None, None, None),
        ("d", 4, "k" * 256, "x", "Gizmo", 30.0, None, True, None, "blue?"),
        ("e", 5, "k" * 257, "x", "", 30.0, [None], True, None, "a*b"),
        ("f", 6, None, None, None, 30.0, [1, 20], False, None, ""),
    ]
    return spark.createDataFrame(rows, schema)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("criteria", "want"),
    [
        ({"Locale": "en-US"}, "a"),
        ({"Locale": "EN-us"}, ""),
        ({"Locale": {"value": "EN-us", "case_insensitive": True}}, "a"),
        ({"Locale": {"value": "en-US"}}, "a"),
        ({"Locale": "k" * 256}, "d"),
        ({"Locale": "k" * 257}, ""),
        ({"Locale": "k*"}, "d"),
        ({"Locale": None}, "ef"),
        ({"Locale": ["en-US", "de-DE", None]}, "ab"),
        ({"Locale": []}, ""),
        ({"Locale": "100%*"}, "c"),
        ({"SearchName": "red"}, "ab"),
        ({"SearchName": "Red"}, ""),
        ({"SearchName": ["gizmo", "widget"]}, "abd"),
        ({"SearchName.keyword": "Red Widget"}, "a"),
        ({"SearchName.keyword": "50%_off\\*"}, "c"),
        ({"SearchName.keyword": "*_*"}, "c"),
        ({"SearchName": "wid*"}, "ab"),
        ({"SearchName": "wid?et"}, ""),
        ({"SearchName": None}, "ef"),
        ({"CategoryIds": 10}, "ab"),
        ({"CategoryIds": "10"}, "ab"),
        ({"CategoryIds": "010"}, ""),
        ({"CategoryIds": [9, 20]}, "af"),
        ({"CategoryIds": None}, "cde"),
        ({"CategoryIds": {"range": {"lt": "2"}}}, "abf"),
        ({"CategoryIds": {"range": {"gt": 10, "lt": 9}}}, "f"),
        ({"CategoryIds": "1*"}, "abf"),
        ({"Price": {"range": {"gte": 20, "lt": 30}}}, "b"),
        ({"Price": {"range": {"gt": "10"}}}, "bdef"),
        ({"Price": None}, "c"),
        ({"Price": 30}, "def"),
        ({"RecordId": "3"}, "c"),
        ({"RecordId": 3.5}, ""),
        ({"RecordId": [1, 2.0, 7]}, "ab"),
        ({"IsKit": True}, "ade"),
        ({"IsKit": "false"}, "bf"),
        ({"IsKit": None}, "c"),
        ({"Name": "Red"}, ""),
        ({"Name": "R*"}, ""),
        ({"Name": None}, "abcdef"),
        ({"Images.Items.Url": "x"}, ""),
        ({"Nowhere": 1}, ""),
        ({"Nowhere": None}, "abcdef"),
        ({"Color": "red"}, "ab"),
        ({"Color.keyword": "blue?"}, "d"),
        ({"Color.keyword": "a*b"}, "e"),
        ({"Locale": "en-US", "IsKit": False}, ""),
        ({"Locale": ["en-US", "de-DE"], "Price": {"range": {"lte": 15}}}, "a"),
    ],
)
def test_criteria(shop, criteria, want):
    assert ids(cr.criteria_filter(shop, criteria)) == sorted(want)


def test_plain_form_sets_kinds_aside(shop):
    assert ids(cr.criteria_filter(shop, {"Name": "Red"}, honor_field_kinds=False)) == ["a", "b"]
    assert ids(cr.criteria_filter(shop, {"SearchName": "Red Widget"}, honor_field_kinds=False)) == ["a"]


def test_criteria_errors(shop):
    for bad in ({}, None, "x"):
        with pytest.raises(ValueError, match="non-empty object"):
            cr.validate_criteria(bad)
    with pytest.raises(ValueError, match="Unsupported criterion"):
        cr.criteria_filter(shop, {"Locale": {"fuzzy": "x"}})
    with pytest.raises(ValueError, match="cannot be compared"):
        cr.criteria_filter(shop, {"Price": "cheap"})
    with pytest.raises(ValueError, match="Limit cannot exceed 100"):
        criteria_search(shop, {"Price": 1}, limit=101)
    with pytest.raises(ValueError, match="Filter predicate is required"):
        cr.caller_filter(shop, None)
    with pytest.raises(ValueError, match="Unsupported number type"):
        number("x", "short")


def test_score_counts_scoring_clauses_and_zero_is_null(shop):
    found = cr.with_score(shop, {"Price": 30, "IsKit": True, "Color": None})
    assert [r["_score"] for r in found.collect()] == []
    found = cr.with_score(shop, {"Price": 30, "IsKit": True})
    assert {r["_score"] for r in found.collect()} == {2.0}
    assert {r["_score"] for r in cr.with_score(shop, {"Name": None}).collect()} == {None}


def test_simple_filters_reach_the_scan(spark, shop, tmp_path):
    path = f"file://{tmp_path}/shop"
    shop.write.parquet(path)
    df = cr.criteria_filter(spark.read.parquet(path), {"Locale": "en-US", "Price": {"range": {"gte": 5}}})
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Locale,en-US)" in plan and "GreaterThanOrEqual(Price,5.0)" in plan
    assert "SearchName" not in plan.split("ReadSchema")[1]


def test_pages_join_up_to_the_whole_sort(shop):
    sort = [{"field": "Price", "order": "desc"}]
    whole = [r["id"] for r in pg.page(shop, sort, limit=100).collect()]
    pieces = [r["id"] for o in range(0, 6, 2) for r in pg.page(shop, sort, limit=2, offset=o).collect()]
    assert pieces == whole == ["d", "e", "f", "b", "a", "c"]
    up = [r["id"] for r in pg.page(shop, [("Price", "asc")]).collect()]
    assert up == ["a", "b", "d", "e", "f", "c"]
    with pytest.raises(ValueError, match="cannot be sorted on"):
        pg.page(shop, [("SearchName", "asc")])
    with pytest.raises(ValueError, match="No mapping"):
        pg.page(shop, [("Name", "asc")])


def test_totals(spark):
    df = spark.range(10_500).withColumn("_score", F.col("id") * 0.5)
    assert pg.totals(df).first() == (10_500, 10_000, 5249.5)


def test_facets_hold_the_top_buckets_of_all_matches(spark):
    """One key holds a third of all products; every bucket count is exact."""
    n = 3000
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))
    leaf = F.struct(key.alias("KeyName"), F.upper(key).alias("Translation"), F.lit("f").alias("FriendlyName"))
    df = spark.range(n).select(
        F.lpad(F.col("id").cast("string"), 5, "0").alias("id"),
        F.create_map(F.lit("Color"), leaf).alias("DefaultProductProperties"),
        (F.col("id") % 5).cast("double").alias("_score"),
    )
    rows = fc.facets(df, ["Color", "Absent"], score="_score").orderBy("rank").collect()
    counts = {}
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{i % 97}"
        counts[k] = counts.get(k, 0) + 1
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50]
    assert [(r["key"], r["count"]) for r in rows] == want
    assert rows[0]["key"] == "hot" and rows[0]["top"]["id"] == "00009"


def test_facet_rank_is_cut_before_the_shuffle(spark):
    df = spark.range(10).select(
        F.col("id").cast("string").alias("id"),
        F.create_map(F.lit("A"), F.struct(F.lit("x").alias("KeyName"), F.lit("y").alias("Translation"), F.lit("z").alias("FriendlyName"))).alias("DefaultProductProperties"),
    )
    plan = fc.facets(df, ["A"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_lookup_by_id_then_record_number(spark, shop):
    keys = spark.createDataFrame([("a",), ("2",), ("3.0",), ("x9",), ("",), (None,), ("4e0",)], "key string")
    got = {r["key"]: r["product"]["id"] if r["product"] else None for r in lk.lookup(shop, keys).collect()}
    assert got == {"a": "a", "2": "b", "3.0": "c", "x9": None, "": None, None: None, "4e0": "d"}


# --- text ------------------------------------------------------------------------------------


def damerau(a, b):
    """True Damerau-Levenshtein distance, by the textbook table."""
    last = {}
    big = len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            cost = 0 if a[i - 1] == b[j - 1] else 1
            if not cost:
                seen = j
            d[i, j] = min(
                d[i - 1, j - 1] + cost,
                d[i, j - 1] + 1,
                d[i - 1, j] + 1,
                d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1),
            )
        last[a[i - 1]] = i
    return d[len(a), len(b)]


@pytest.mark.parametrize(("term", "limit"), [("ab", 0), ("abc", 1), ("abca", 1), ("abcabc", 2), ("aabbcc", 2), ("éabcd1", 2)])
def test_edit_distance_equals_the_table(spark, term, limit):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcé1") for _ in range(rng.randint(1, 9))) for _ in range(800)} | {term}
    for _ in range(400):  # words near the term
        w = list(term)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w)) if w else 0
            op = rng.randint(0, 3)
            if op == 0 and w:
                del w[i]
            elif op == 1:
                w.insert(i, rng.choice("abc"))
            elif op == 2 and w:
                w[i] = rng.choice("abc")
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        if w:
            words.add("".join(w))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = dict(df.select("w", tx.edit_distance(F.col("w"), term, limit)).collect())
    want = {w: (damerau(term, w) if damerau(term, w) <= limit else None) for w in words}
    assert got == want


def test_allowed_edits():
    assert [tx.allowed_edits("x" * n) for n in range(1, 8)] == [0, 0, 1, 1, 1, 2, 2]
    assert tx.allowed_edits("abcdef", 1) == 1


def test_query_is_required():
    for bad in ("", "   ", None):
        with pytest.raises(ValueError, match="Query parameter is required"):
            tx.normalise_query(bad)
    assert tx.query_terms(" Red, red  Ünder_score ") == {"red": 2, "ünder": 1, "score": 1}


@pytest.fixture(scope="module")
def texts(spark):
    kinds = {f.name: f for f in PRODUCT.fields}
    schema = T.StructType([kinds["id"], kinds["ItemId"], kinds["SearchName"], kinds["Name"]])
    rows = [
        ("1", "red widget", "Red widget, red-hot!", "gadget"),
        ("2", "X", "A blue wigdet", "red"),
        ("3", "red", "Green gear", "red"),
        ("4", None, None, "red"),
        ("5", "X", "Éclair red RED", None),
    ]
    return spark.createDataFrame(rows, schema)


def test_search_covers_text_and_keyword_fields(texts):
    found = text_search(texts, "red widget", highlight=True)
    hits = {r["id"]: r for r in found.hits.collect()}
    # keyword field matches the whole query; a swapped spelling is one edit; Name is disabled
    assert set(hits) == {"1", "2", "5"}
    assert hits["1"]["_highlight"] == {
        "ItemId": "<em>red widget</em>",
        "SearchName": "<em>Red</em> <em>widget</em>, <em>red</em>-hot!",
    }
    assert hits["2"]["_highlight"] == {"SearchName": "A blue <em>wigdet</em>"}
    assert hits["5"]["_highlight"] == {"SearchName": "Éclair <em>red</em> <em>RED</em>"}
    assert found.summary.first()["total"] == 3
    assert [r["id"] for r in found.hits.collect()][0] == "1"


def test_search_without_fuzziness_or_match(texts):
    assert {r["id"] for r in text_search(texts, "widget", ["SearchName"], fuzziness=0).hits.collect()} == {"1"}
    assert text_search(texts, "zebra", ["SearchName"]).hits.collect() == []
    assert text_search(texts, "zebra", ["SearchName"]).summary.first() == (0, 0, None)


def test_expansion_shuffled_or_sent_gives_the_same_scores(texts, monkeypatch):
    def scores():
        return {r["id"]: r["_score"] for r in text_search(texts, "red widget").matches.collect()}

    sent = scores()
    monkeypatch.setattr(rv, "BROADCAST_TERMS", 0)
    assert scores() == sent


def test_stored_index_gives_the_same_answer(spark, texts, tmp_path):
    path = f"file://{tmp_path}/index"
    write_text_index(texts, path, ["SearchName"])
    index = read_text_index(spark, path, CatalogSchema.of(texts), ["SearchName"])
    for fuzz in ("AUTO", 0):
        a = text_search(texts, "red widget", ["SearchName"], fuzziness=fuzz).matches.collect()
        b = text_search(texts, "red widget", index=index, fuzziness=fuzz).matches.collect()
        assert sorted(a) == sorted(b)
    plan = rv.matched_terms(index, rv.exact_terms(spark, index, "red widget"))._jdf.queryExecution().executedPlan()
    assert "In(term" in plan.toString()


def test_schema_as_rows(spark):
    rows = {r["path"]: r["kind"] for r in describe(spark, PRODUCT_SCHEMA).collect()}
    assert rows["DefaultProductProperties.*.KeyName"] == "keyword"
    assert rows["Rules.IsBlocked"] == "disabled"
    assert rows["RetailContext.ChannelId"] == "long"


def test_hits_carry_their_id(shop):
    hits = criteria_search(shop, {"Price": 30}, sort=[("RecordId", "asc")], limit=2).hits
    assert [(r["_id"], r["_score"]) for r in hits.collect()] == [("d", None), ("e", None)]
    assert pg.hit_projection(shop, ["Price"]).columns == ["Price", "_id"]


def test_search_without_fields_covers_the_property_map(spark):
    rows = [("1", "plain", {"Color": ("Red", "bright red"), "Size": ("L", None)}), ("2", "other", {"Size": ("Red", None)}), ("3", "x", None)]
    df = spark.createDataFrame(
        rows, "id string, SearchName string, DefaultProductProperties map<string, struct<KeyName: string, ValueString: string>>"
    )
    found = {r["id"]: r["_highlight"] for r in text_search(df, "Red", fuzziness=0, highlight=True).hits.collect()}
    assert set(found) == {"1", "2"}
    assert set(found["1"]) == {"DefaultProductProperties.KeyName", "DefaultProductProperties.ValueString"}
    assert found["1"]["DefaultProductProperties.ValueString"] == "bright <em>red</em>"
    assert found["2"] == {"DefaultProductProperties.KeyName": "<em>Red</em>"}
    assert set(found["1"]["DefaultProductProperties.KeyName"].split(",")) == {"<em>Red</em>", "L"}


def test_texts_in_an_array_with_nulls(spark):
    df = spark.createDataFrame([("1", ["Red thing", None]), ("2", [None]), ("3", None)], "id string, tags array<string>")
    assert ids(cr.criteria_filter(df, {"tags": "red"})) == ["1"]
    assert ids(cr.criteria_filter(df, {"tags": None})) == ["2", "3"]
    assert {r["id"] for r in text_search(df, "thing", ["tags"]).hits.collect()} == {"1"}


def test_a_text_index_splits_its_documents_once(spark, tmp_path):
    """Terms, lengths and statistics come from one reading of the documents."""
    made = spark.sparkContext.accumulator(0)

    def text(t):
        made.add(1)
        return t

    said = [("a", "red red kettle", "x"), ("b", "kettle", None), ("c", None, None), ("a", "red", "y")]
    rows = spark.createDataFrame(said, "id string, t string, note string")
    counted = rows.select("id", F.udf(text)("t").alias("text"), "note")
    write_text_index(counted, f"{tmp_path}/text", ["text", "note"])
    assert made.value == len(said)
    plain = rows.select("id", F.col("t").alias("text"), "note")
    index = read_text_index(spark, f"{tmp_path}/text", CatalogSchema.of(plain), ["text", "note"])
    whole = rv.TextIndex.of(plain, ["text", "note"])
    assert {tuple(r) for r in index.stats.collect()} == {tuple(r) for r in whole.stats.collect()}
    assert index.occurrences.schema.names == ["id", "field", "analysis", "length", "term", "tf"]
    by = ["id", "field", "analysis", "length", "term"]
    summed = whole.occurrences.groupBy(*by).agg(F.sum("tf"))
    assert sorted(tuple(r) for r in index.occurrences.collect()) == sorted(tuple(r) for r in summed.collect())


def test_the_catalog_is_made_on_all_cores(spark):
    from shelfmark.sources.star import catalog

    made = catalog(spark, "/root/testdata/sf0.001", categories=False)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
