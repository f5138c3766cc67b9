"""Array files in splits, beside the parser of the standard library."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import arrays
from shelfmark.sources import products as src


def write(path, *texts):
    path.mkdir()
    for i, text in enumerate(texts):
        (path / f"part-{i}.json").write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{path}"


def read(spark, path, slab):
    rows = arrays.array_elements(spark, path, slab=slab).select("value", "_source.file", "_source.block").collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.file, r.block)):
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(r.value)
    return found


def awkward(rng):
    """A value whose strings hold every character that means something to the scan."""
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "\n", "ä", "x", " "]) for _ in range(rng.randint(0, 12)))
    return rng.choice([text, {"a": text, text: [text, {"b": [1, None]}]}, [text, []], {}, [], None, 1.5, True, {"k" * 40: "}" * 30}])


@pytest.mark.parametrize("slab", [5, 64, 1 << 20])
def test_elements_are_those_of_a_parser(spark, tmp_path, slab):
    rng = random.Random(slab)
    values = [[awkward(rng) for _ in range(40)] for _ in range(3)]
    texts = [json.dumps(v, ensure_ascii=i == 0, indent=2 if i == 1 else None) for i, v in enumerate(values)]
    found = read(spark, write(tmp_path / "in", *texts), slab)
    for i, v in enumerate(values):
        assert [json.loads(x) for x in found[f"part-{i}.json"]] == v


def test_small_splits_give_the_same_elements(spark, tmp_path):
    rng = random.Random(5)
    values = [awkward(rng) for _ in range(30_000)]
    path = write(tmp_path / "in", json.dumps(values))
    keys = {"spark.sql.files.maxPartitionBytes": str(64 << 10), "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        found = read(spark, path, 20_000)["part-0.json"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [json.loads(x) for x in found] == values


def test_odd_files(spark, tmp_path):
    path = write(tmp_path / "in", "", "  \n", "[]", " [ \n ] ", "[1][2,3]\n[]\n[4]", b"\xef\xbb\xbf[5]", "[1,,2]", '["\\\\"]')
    for slab in (1, 2, 1000):
        assert read(spark, path, slab) == {
            "part-4.json": ["1", "2", "3", "4"],
            "part-5.json": ["5"],
            "part-6.json": ["1", "", "2"],
            "part-7.json": ['"\\\\"'],
        }


@pytest.mark.parametrize(
    "text", ['{"a": 1}\n{"b": 2}', "[1, 2", '["open]', "[1]]", "[1] tail", "7", "[1]]["], ids=range(7)
)
def test_files_that_are_no_array_fail(spark, tmp_path, text):
    path = write(tmp_path / "in", text)
    for slab in (2, 1000):
        with pytest.raises(Exception, match="JSON array"):
            arrays.array_elements(spark, path, slab=slab).collect()


def test_one_long_element_and_products(spark, tmp_path):
    long = {"id": "1", "RecordId": 1, "Name": "}{" * 5000}
    path = write(tmp_path / "in", json.dumps([long, {"id": "2", "RecordId": 2, "Price": "cheap"}]))
    rows = src.parse_lines(arrays.array_elements(spark, path, slab=700)).orderBy("_source.block").collect()
    assert [r["RecordId"] for r in rows][0] == 1 and rows[0]["Name"] == "}{" * 5000
    assert rows[0]["error"] is None and "Price" in rows[1]["error"]["reason"]


def test_written_arrays_come_back(spark, tmp_path):
    df = spark.range(5000).select("id", F.concat(F.lit('"}\\'), F.col("id").cast("string")).alias("t, [x"))
    path = f"file://{tmp_path}/out"
    arrays.write_array_files(df.repartition(3).filter("id % 2 = 0"), path)
    rows = arrays.array_elements(spark, path, slab=4096).select(F.from_json("value", df.schema).alias("r")).select("r.*")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.filter("id % 2 = 0").collect()))


def test_slabs_stay_where_they_are(spark, tmp_path):
    path = write(tmp_path / "in", json.dumps(list(range(1000))))
    plan = arrays.array_elements(spark, path, slab=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
