import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shelfmark.runtime import local_session

    yield local_session("tests", 4)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/catalog"


def make_products(spark, count, prefix="test", base=50.0):
    """Products in the shape the publish scenarios use."""
    from pyspark.sql import functions as F

    i = F.col("i")
    text = i.cast("string")
    return spark.range(1, count + 1).withColumnRenamed("id", "i").select(
        F.concat_ws("-", F.lit(prefix), text).alias("id"),
        i.alias("RecordId"),
        F.concat(F.lit(f"ITEM-{prefix}-"), text).alias("ItemId"),
        F.concat(F.lit("Test Product "), text, F.lit(f" ({prefix})")).alias("Name"),
        F.concat(F.lit("test product "), text, F.lit(f" {prefix}")).alias("SearchName"),
        F.lit("en-US").alias("Locale"),
        (F.lit(base) + i * 5).alias("BasePrice"),
        (F.lit(base) + i * 5).alias("Price"),
        F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("CategoryIds"),
        (i == 1).alias("IsMasterProduct"),
    )
