"""The registered queries: rows of all, and those that SQL can express beside it."""

import pytest
from pyspark.sql import functions as F

from shelfmark.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_one_query_of_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    ok, why, _, _ = compare(spark, con, SF, QUERIES[name], ORACLE[name])
    assert ok, why


@pytest.mark.parametrize("name,columns", [
    ("op1_language", {"doc_id", "held_out", "lang_pred", "score"}),
    ("op5_packing", {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}),
    ("op10_quality", {"doc_id", "held_out", "score", "predicted"}),
])
def test_rows_cover_every_document(spark, name, columns):
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.select("doc_id").distinct().count() == docs.count()
    assert got.filter(F.col("doc_id").isNull()).isEmpty()
