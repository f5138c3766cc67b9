"""Numbering, ingest, keyed writes, sessions and synthesis against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import hooks as hk
from shelfmark.operators import ingest as ing
from shelfmark.operators import sessions as ss
from shelfmark.operators import synth as sy
from shelfmark.operators import writes as wr
from shelfmark.plans.numbering import number_rows, running_totals
from shelfmark.schema import PRODUCT
from shelfmark.sources import products as src


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(1000, numPartitions=7).select(((F.col("id") * 37) % 1000).alias("k"), (F.col("id") % 3).alias("hot"))
    got = number_rows(df, ["hot", "k"]).collect()
    want = sorted((r["hot"], r["k"]) for r in got)
    assert [(r["hot"], r["k"]) for r in sorted(got, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in got) == list(range(1, 1001))


@pytest.mark.parametrize(("bits", "span"), [(2, 6), (2, 14), (4, 12), (20, 40)])
def test_running_totals_over_blocks(spark, bits, span):
    rng = random.Random(3)
    rows = []
    for g in ("hot", "b", None):
        for p in rng.sample(range(4000), 600 if g == "hot" else 40):
            rows.append((g, p, rng.randint(-5, 9)))
    df = spark.createDataFrame(rows, "g string, p long, v long")
    got = running_totals(df, ["g"], "p", {"total": "v", "n": F.lit(1)}, span, bits).collect()
    seen = {(r["g"], r["p"]): (r["total"], r["n"]) for r in got}
    for g in ("hot", "b", None):
        total = n = 0
        for _, p, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total, n = total + v, n + 1
            assert seen[g, p] == (total, n)
    assert len(got) == len(rows)


def test_slices_keep_the_short_last_batch(spark):
    sizes = ing.slice_batches(spark.range(23), 10, ["id"]).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [10, 10, 3]


def test_ids(spark):
    rows = [("x", 1), ("", 7), (None, 0), (None, None), ("", 5_000_000_000)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, rec long, pos int")
    out = df.select("pos", ing.derive_id(F.col("id"), F.col("rec"), F.lit("s"), F.lit(2), "pos").alias("k"))
    want = ["x", "7", "0", "doc_s_2_3", "5000000000"]
    assert [r["k"] for r in out.orderBy("pos").collect()] == want
    # deriving again changes nothing
    again = out.select("pos", ing.derive_id(F.col("k"), F.lit(None).cast("long")).alias("k"))
    assert [r["k"] for r in again.orderBy("pos").collect()] == want


@pytest.mark.parametrize("taken", [[], [100, 101, 102], [101, 103, 104, 150, 99], list(range(100, 160, 2))])
def test_allocated_ids_are_the_next_free_ones(spark, taken):
    have, want = set(taken), []
    for i in range(40):
        n = 100 + i
        while n in have:
            n += 1
        have.add(n)
        want.append(n)
    existing = spark.createDataFrame([(t,) for t in taken], "t long")
    rows = spark.range(40).withColumnRenamed("id", "i")
    got = ing.allocate_ids(rows, "i", existing, "t", start=100).orderBy("i").collect()
    assert [r["RecordId"] for r in got] == want


def test_read_modes(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"id": "a", "Price": 1.5}\n{"id": "b", "Price": 2}\n')
    assert src.read_products(spark, str(path), strict=True).count() == 2
    source = src.ProductSource(spark, str(path))
    assert source.load() is source.load()
    source.clear_cache()
    assert source.load().count() == 2
    source.clear_cache()
    path.write_text('{"id": "a"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        src.read_products(spark, str(path), strict=True).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.read_products(spark, str(tmp_path / "none.json"))
    empty = tmp_path / "empty.json"
    empty.write_text("")
    assert src.read_products(spark, str(empty)).count() == 0


def test_array_files_keep_nested_values_as_text(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"id": "a", "Rules": {"IsBlocked": True}}, {"id": "b", "Price": 3}], indent=1))
    rows = src.read_array_files(spark, str(path), ["id", "Price", "Rules"], 4).orderBy("id").collect()
    assert [(r["id"], r["Price"]) for r in rows] == [("a", None), ("b", "3")]
    assert json.loads(rows[0]["Rules"]) == {"IsBlocked": True} and rows[1]["Rules"] is None


def test_parsed_lines_keep_undeclared_fields_and_shapes(spark):
    doc = {
        "id": "a",
        "RecordId": 68719500001,
        "Price": "12.5",
        "Rules": {"IsBlocked": False, "DateToBlock": "2024-01-02T03:04:05Z"},
        "DefaultProductProperties": [{"KeyName": "Color", "ValueString": "red"}, {"KeyName": "Color", "ValueString": "blue"}],
        "AdjustedPrice": 3.25,
    }
    lines = spark.createDataFrame([(json.dumps(doc),), ('["no object"]',), (None,)], "value string")
    rows = src.parse_lines(lines).select(
        "id", "RecordId", "Price", "Rules.DateToBlock", F.col("DefaultProductProperties")["Color"]["ValueString"].alias("color"),
        F.try_variant_get("_extra", "$.AdjustedPrice", "double").alias("extra"), "error.reason",
    ).collect()
    good = next(r for r in rows if r["id"])
    assert good["RecordId"] == 68719500001 and good["Price"] == 12.5 and good["color"] == "blue"
    assert good["extra"] == 3.25 and good["reason"] is None and good["DateToBlock"].year == 2024
    assert [r["reason"] for r in rows if not r["id"]] == ["malformed JSON document"] * 2


def test_wrong_values_inside_disabled_fields_are_kept_whole(spark):
    wrong = {
        "Rules": {"ProductId": "none", "IsBlocked": True},
        "Images": {"Items": [{"Url": "u", "Priority": 1}, {"Url": "v", "Priority": "first"}]},
        "LinkedProducts": [{"id": "a", "quantity": "many"}],
        "DisplayOrderInCategories": [{"CategoryId": "x", "DisplayOrder": 1}],
        "ProductProperties": [{"PropertyName": {"deep": 1}}],
    }
    right = {"Rules": {"ProductId": 5}, "Images": {"Items": [{"Url": "u", "Priority": 1}]}, "LinkedProducts": None}
    docs = [wrong, right, {"Rules": "none", "Images": {"Items": {"Url": "u"}}}]
    lines = spark.createDataFrame([(str(i), json.dumps({"id": str(i), **d})) for i, d in enumerate(docs)], "no string, value string")
    rows = src.parse_lines(lines).select("no", F.to_json("_extra").alias("extra"), "error", "Rules.IsBlocked").orderBy("no").collect()
    assert [r.error for r in rows] == [None] * 3 and rows[0].IsBlocked
    assert [json.loads(r.extra) if r.extra else None for r in rows] == [docs[0], None, docs[2]]


def test_upsert_with_a_hot_key_and_any_partitioning(spark):
    base = spark.createDataFrame([("hot", 0), ("old", 1)], "id string, v long")
    changes = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("id"),
        F.col("id").alias("v"),
        F.col("id").alias("pos"),
    )
    results = []
    for parts in (1, 5):
        out = wr.upsert(base, changes.repartition(parts), ["pos"])
        results.append(sorted((r["id"], r["v"]) for r in out.collect()))
    assert results[0] == results[1]
    assert dict(results[0])["hot"] == 2997 and dict(results[0])["old"] == 1 and len(results[0]) == 52


def merge(base, patch):
    """What applying one partial document does, field by field."""
    if not isinstance(patch, dict):
        return patch
    out = dict(base) if isinstance(base, dict) else {}
    for k, v in patch.items():
        out[k] = merge(out.get(k), v)
    return out


def test_patches_equal_applying_them_one_by_one(spark):
    rng = random.Random(11)

    def leaf():
        return rng.choice([None, rng.randint(0, 9)])

    def make():
        p = {}
        if rng.random() < 0.4:
            p["Price"] = leaf()
        if rng.random() < 0.4:
            p["Tags"] = rng.choice([None, ["x"], ["y", "z"], []])
        if rng.random() < 0.5:
            p["Rules"] = rng.choice([None, {}, {"A": leaf()}, {"B": leaf()}, {"A": leaf(), "In": rng.choice([None, {"C": leaf()}])}])
        if rng.random() < 0.6:
            p["Props"] = rng.choice(
                [None, {}, {"k1": {"A": leaf()}}, {"k2": {"B": leaf()}, "k1": None}, {"k3": {"A": 1, "B": leaf()}}]
            )
        return p

    schema = (
        "id string, Price long, Tags array<string>, Rules struct<A: long, B: long, In: struct<C: long>>, "
        "Props map<string, struct<A: long, B: long>>"
    )
    full = {"A": None, "B": None}
    start = {
        f"d{i}": {"Price": i, "Tags": ["t"], "Rules": {"A": 1, "B": 2, "In": {"C": 3}}, "Props": {"k1": {"A": 5, "B": 6}}}
        for i in range(12)
    }
    start["d0"] = {"Price": None, "Tags": None, "Rules": None, "Props": None}
    base = spark.createDataFrame(
        [(k, v["Price"], v["Tags"], (1, 2, (3,)) if v["Rules"] else None, {"k1": (5, 6)} if v["Props"] else None) for k, v in start.items()],
        schema,
    )
    patches, state = [], {k: dict(v) for k, v in start.items()}
    for o in range(260):
        key = "d1" if o % 3 == 0 else f"d{rng.randint(0, 15)}"
        p = make()
        patches.append((key, o, json.dumps(p)))
        state[key] = merge(state.get(key, {}), p)
    df = spark.createDataFrame(patches, "id string, o long, t string").select("id", "o", F.parse_json("t").alias("patch"))
    got = {r["id"]: r.asDict(recursive=True) for r in wr.patch(base, df, ["o"]).collect()}

    def norm_struct(v, names):
        return None if v is None else {n: v.get(n) for n in names}

    assert set(got) == set(state)
    for k, want in state.items():
        row = got[k]
        assert row["Price"] == want.get("Price"), k
        assert row["Tags"] == want.get("Tags"), k
        rules = norm_struct(want.get("Rules"), ["A", "B", "In"])
        if rules is not None:
            rules["In"] = norm_struct(rules["In"], ["C"])
        assert row["Rules"] == rules, k
        props = want.get("Props")
        props = None if props is None else {n: (None if v is None else {**full, **v}) for n, v in props.items()}
        assert row["Props"] == props, (k, [p for p in patches if p[0] == k])


def test_patch_errors(spark):
    df = spark.createDataFrame([("a", "{}"), (" ", "{}"), ("b", None)], "id string, t string").select(
        "id", F.parse_json("t").alias("patch")
    )
    assert {r["reason"] for r in wr.patch_errors(df).collect()} == {"Document ID must be specified", "Document is required"}


def test_filtered_load_reports_its_count(spark):
    rows, seen = wr.load_filtered(spark.range(10), lambda d: d["id"] > 6)
    assert rows.count() == 3 and seen.get["loaded"] == 3
    with pytest.raises(ValueError, match="Filter predicate is required"):
        wr.load_filtered(spark.range(1), None)
    with pytest.raises(ValueError, match="Products array is required"):
        wr.load_enriched(None)


def test_a_session_ends_after_strictly_more_than_the_gap(spark):
    rows = [("a", "2024-01-01 00:59:59.5"), ("a", "2024-01-01 01:59:59.5"), ("a", "2024-01-01 02:59:59.500001")]
    df = spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    got = ss.idle_sessions(df, "k", "ts").orderBy("session_no").collect()
    assert [r["batches"] for r in got] == [2, 1]


def test_idle_sessions_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.34 else f"u{rng.randint(0, 30)}", rng.randint(0, 400_000)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    want = 0
    for k in {k for k, _ in rows}:
        at = sorted(s for x, s in rows if x == k)
        want += 1 + sum(b - a > 3600 for a, b in zip(at, at[1:]))
    assert ss.idle_sessions(df, "k", "ts").count() == want


def test_synthesis_does_not_depend_on_partitioning(spark):
    one = sy.simple_products(sy.sequence(spark, 200).coalesce(1)).collect()
    many = sy.simple_products(sy.sequence(spark, 200).repartition(7)).orderBy("RecordId").collect()
    assert one == many
    assert one[0]["id"] == "prod_000001" and one[4]["category"] == "Electronics"
    share = sum(r["inStock"] for r in one) / 200
    assert 0.8 < share < 0.98
    assert sy.variations(spark).filter("attribute like 'product_types%'").count() == 39


def test_declared_schema_has_every_property_leaf():
    props = next(f for f in PRODUCT.fields if f.name == "DefaultProductProperties")
    assert len(props.dataType.valueType.fields) == 23


def test_plain_python_hooks(spark):
    df = spark.range(10).select("id", (F.col("id") * 1.5).alias("Price"))

    def dearer(batch):
        batch["Price"] = batch["Price"] + 1
        return batch

    out = wr.load_enriched(df, hk.enrich_batches(dearer))
    assert [r["Price"] for r in out.orderBy("id").collect()] == [i * 1.5 + 1 for i in range(10)]
    rows, _ = wr.load_filtered(df, hk.row_predicate(lambda i, p: (i > 2) & (p < 9), ["id", "Price"]))
    assert [r["id"] for r in rows.collect()] == [3, 4, 5]


def test_templates_are_numbered(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps([{"RecordId": 5, "ProductName": n, "Rules": {"ProductId": 1}} for n in "abc"]))
    templates = src.read_templates(spark, str(path))
    assert sorted(r["template_no"] for r in templates.collect()) == [0, 1, 2]
    made = sy.template_products(sy.sequence(spark, 30, start=0), templates, brief=True).collect()
    assert len(made) == 30 and {r["ProductName"].split()[-1] for r in made} == set("abc")
    assert all(r["Rules"]["ProductId"] == r["RecordId"] == 68719500000 + r["i"] for r in made)
    assert all(len(r["SearchName"]) <= 20 for r in made)


def test_a_line_is_judged_by_what_it_holds(spark):
    """Fields in doubt are judged part by part; the others are told from one cast of the whole document."""
    rules = {"ProductId": 5, "DefaultUnitOfMeasure": "{each}", "ExtensionProperties": [{"name": "n", "value": {"x": 1}}]}
    docs = [
        ({"id": "a", "Price": 1, "Rules": rules, "Locale": None, "RetailContext": None}, None, None),
        ({"id": "b", "Rules": rules | {"Odd": 1}, "CategoryIds": [1, None]}, None, {"Rules": {"Odd": 1}}),
        ({"id": "c", "Rules": rules | {"ProductId": "none"}}, None, {"Rules": rules | {"ProductId": "none"}}),
        ({"id": "d", "ParentKits": [{"id": "k", "components": [{"quantity": 1}, {"quantity": 2, "odd": []}]}]}, None, {"ParentKits": {"0": {"components": {"1": {"odd": []}}}}}),
        ({"id": "e", "DefaultProductProperties": {"S": {"Distance": "far"}}}, "DefaultProductProperties.Distance", None),
        ({"id": "f", "DefaultProductProperties": [{"Name": "S", "Value": 4, "Odd": 1}]}, None, {"DefaultProductProperties": {"0": {"Odd": 1}}}),
        ({"id": "g", "SearchName": ["x"], "Odd": None}, "SearchName", {"Odd": None}),
        ({"id": "h", "SearchName": "[x]", "Images": 7}, None, {"Images": 7}),
        ({"id": "i", "RetailContext": {"ChannelId": None, "CatalogId": "1", "Odd": {}}}, None, {"RetailContext": {"Odd": {}}}),
        ({"id": "j", "CategoryIds": [1, "x"], "RetailContext": 3}, "CategoryIds", None),
        ([1], "malformed", None),
    ]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, (d, *_) in enumerate(docs)], "n int, value string")
    parsed = src.parse_lines(rows)
    got = parsed.select("n", F.col("error.reason").alias("why"), F.to_json("_extra").alias("extra")).collect()
    for r in got:
        _, why, extra = docs[r.n]
        assert (r.why is None) == (why is None) and (why or "") in (r.why or ""), (r.n, r.why)
        assert (json.loads(r.extra) if r.extra else None) == extra, (r.n, r.extra)
    # as part by part, for every field
    variants = rows.select("n", F.try_parse_json("value").alias("patch"))
    slow = [src.mismatch("patch", f"$.{f.name}", f.dataType, f.name, src.kind_of(f)) for f in PRODUCT.fields]
    slow = F.expr(f"coalesce({', '.join(filter(None, slow))})")
    both = variants.select("n", slow.alias("a"), src.faults("patch", PRODUCT.fields).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and any(r.a for r in both)
    assert {r.id for r in wr.patch_errors(variants.withColumn("id", F.col("n").cast("string"))).collect()} == {str(r.n) for r in both if r.a} | {"10"}


def test_a_cast_that_failed_is_not_tried_again(spark):
    """A field in doubt is judged from its typed value, object by object: no path for each declared field, no second cast."""
    props = next(f for f in PRODUCT.fields if f.name == src.PROPERTIES)
    entry = props.dataType.valueType
    known = src.mismatch("v", "$", entry, props.name, stored="t")
    assert "'bigint'" not in known and "$." not in known and "$." not in src.mismatch("v", "$", entry, props.name)
    assert "$.ExtensionProperties" not in src.undeclared("v", f"$.{props.name}", props.dataType)
    docs = [
        {"S": {"Distance": "far", "KeyName": "{"}}, {"S": {"KeyName": "a"}, "T": {"KeyName": {"x": 1}, "Distance": None}},
        [{"Name": "S", "Value": 4}, {"Distance": "far"}], {"S": {"ExtensionProperties": [{"name": "n", "odd": 1}], "Odd": 2, "Source": "7"}},
        {"S": None}, {"S": 3}, "none", {"S": {"ExtensionProperties": 1}},
    ]
    rows = spark.createDataFrame([(i, json.dumps({props.name: d})) for i, d in enumerate(docs)], "n int, value string")
    got = src.parse_lines(rows).select("n", "error.reason", F.to_json("_extra").alias("extra")).orderBy("n").collect()
    wrong = [(r.reason or "")[len("failed to parse field [DefaultProductProperties"):].split(" ")[0] for r in got]
    assert wrong == [".Distance]", ".KeyName]", ".Distance]", "", "", "]", "]", ".ExtensionProperties]"]
    extra = {"DefaultProductProperties": {"S": {"Odd": 2, "ExtensionProperties": {"0": {"odd": 1}}}}}
    assert [json.loads(r.extra) if r.extra else None for r in got] == [None, None, None, extra, None, None, None, None]


def test_patches_are_condensed_once(spark):
    base = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 6)], "id string, Price double, RecordId long")
    rows = [("a", 1, '{"Price": 3}'), ("a", 2, '{"RecordId": null}'), ("c", 1, '{"Price": 4}')]
    patches = spark.createDataFrame(rows, "id string, o int, t string").select("id", "o", F.parse_json("t").alias("patch"))
    done = wr.patch(base, patches, ["o"])
    assert {tuple(r) for r in done.collect()} == {("a", 3.0, None), ("b", 2.0, 6), ("c", 4.0, None)}
    # the rows it changes and the new ones both start from one condensed table
    assert "Aggregate" not in done._jdf.queryExecution().optimizedPlan().toString()
