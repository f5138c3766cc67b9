"""Catalog, load stream and registry frames derived from the star-schema tables.

They grow with their tables, and every column follows from table columns alone,
so that the same rows can be written down in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.registry import REGISTRY
from shelfmark.operators.sessions import LEDGER
from shelfmark.runtime import spread
from shelfmark.schema import PRODUCT, PROPERTY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def property_entry(**values: str) -> str:
    """SQL for one property struct with the given leaves; the others are null."""
    leaves = [
        f"'{f.name}', CAST({values.get(f.name, 'NULL')} AS {f.dataType.simpleString()})"
        for f in PROPERTY.fields
    ]
    return f"named_struct({', '.join(leaves)})"


def catalog(spark: SparkSession, sf_dir: str, categories: bool = True) -> DataFrame:
    """One product per part; a part sold in no line has no categories."""
    # a row of a part makes four entries of properties
    part = spread(table(spark, sf_dir, "part"))
    key = F.col("p_partkey")
    brand = property_entry(
        KeyName="'Brand'", Translation="p_brand", FriendlyName="'Brand name'", RecordId="p_partkey"
    )
    kind = property_entry(
        KeyName="'Type'",
        Translation="initcap(p_type)",
        FriendlyName="'Product type'",
        ValueString="p_type",
        RecordId="p_partkey",
    )
    size = property_entry(
        KeyName="'Size'",
        Translation="p_size",
        FriendlyName="'Size'",
        Distance="p_size",
        RecordId="p_partkey",
    )
    maker = property_entry(
        KeyName="concat_ws('/', p_brand, p_type)",
        Translation="p_brand",
        FriendlyName="concat('Made as ', p_type)",
        RecordId="p_partkey",
    )
    facets = F.expr(
        f"map_filter(map('Brand', {brand}, 'Type', {kind}, 'Size', {size}, 'Maker', {maker}),"
        " (k, v) -> NOT ((k = 'Brand' AND p_partkey % 5 = 0) OR (k = 'Size' AND p_partkey % 7 = 0)))"
    )
    number = F.lpad((90000 + key % 10000).cast("string"), 5, "0")
    kinds = {f.name: f.metadata for f in PRODUCT.fields}

    def col(name: str, c: Column) -> Column:
        return c.alias(name, metadata=kinds.get(name) or {})

    base = part.select(
        col("id", F.when(key % 3 != 0, F.concat(F.lit("P"), key.cast("string")))),
        col("RecordId", key),
        col("ItemId", number),
        col("ProductNumber", number),
        col("Locale", F.when(key % 4 == 0, F.lit("de-DE")).otherwise(F.lit("en-US"))),
        col("Name", F.col("p_name")),
        col("SearchName", F.initcap("p_name")),
        col("BasePrice", F.col("p_retailprice")),
        col("Price", F.when(key % 11 != 0, F.col("p_retailprice"))),
        col("IsMasterProduct", key % 10 == 0),
        col("RetailContext", F.struct((key % 6).alias("ChannelId"), (key % 3).alias("CatalogId"))),
        col(
            "Rules",
            F.struct(key.alias("ProductId"), (key % 8 != 0).alias("IsActiveInSalesProcess")),
        ),
        col("DefaultProductProperties", facets),
    )
    base = base.withColumn("id", F.coalesce("id", F.col("RecordId").cast("string")))
    base = base.withMetadata("id", kinds["id"])
    if not categories:
        return base
    sold = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 8)).alias("CategoryIds"))
    )
    return base.join(sold, base["RecordId"] == sold["l_partkey"], "left").select(
        *base.columns, F.col("CategoryIds").alias("CategoryIds", metadata=kinds["CategoryIds"])
    )


# The same catalog in SQL, flat: the oracle side of the checks.
CATALOG_SQL = """
  SELECT coalesce(CASE WHEN p_partkey % 3 <> 0 THEN 'P' || p_partkey END,
                  CAST(p_partkey AS VARCHAR)) AS id,
         p_partkey AS record_id,
         lpad(CAST(90000 + p_partkey % 10000 AS VARCHAR), 5, '0') AS item_id,
         CASE WHEN p_partkey % 4 = 0 THEN 'de-DE' ELSE 'en-US' END AS locale,
         array_to_string(list_transform(string_split(p_name, ' '),
             lambda w: upper(w[1]) || lower(w[2:])), ' ') AS search_name,
         p_name, p_brand, p_type, p_size,
         p_retailprice AS base_price,
         CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS price,
         p_partkey % 10 = 0 AS is_master,
         p_partkey % 6 AS channel_id,
         p_partkey % 8 <> 0 AS is_active,
         categories
  FROM part LEFT JOIN (
    SELECT l_partkey, list_sort(list(DISTINCT l_suppkey % 8)) AS categories
    FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey
"""


def load_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as product documents sent in batches.

    A session is a group of suppliers and a batch one order, so a product turns
    up again within a batch (a duplicate) and across batches (an upsert). Rows
    are ordered by ``STREAM_ORDER``.
    """
    line = table(spark, sf_dir, "lineitem")
    no, part = F.col("l_linenumber"), F.col("l_partkey")
    return line.select(
        (F.col("l_orderkey") % 10).cast("string").alias("session"),
        F.col("l_orderkey").alias("batch"),
        no.cast("bigint").alias("pos"),
        F.when(no % 3 == 0, F.lit("")).when(no % 3 == 1, F.concat(F.lit("P"), part.cast("string"))).alias("id"),
        F.when(no % 5 != 0, part).alias("RecordId"),
        part.alias("source_part"),
        F.col("l_suppkey").alias("source_supplier"),
        F.col("l_extendedprice").alias("Price"),
        F.col("l_quantity").alias("Quantity"),
        F.col("l_shipdate").alias("sent_at"),
    )


# A total order on the rows of a load stream.
STREAM_ORDER = ["batch", "pos", "source_part", "source_supplier", "Price", "Quantity"]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the ledger of load sessions: a session per customer, a batch per order.

    Every fifth batch was sent twice; some sessions were completed or cancelled.
    """
    orders = table(spark, sf_dir, "orders")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    failed = key % 7
    batch = orders.select(
        cust.cast("string").alias("session"),
        F.lit("batch").alias("event"),
        key.alias("batch"),
        F.explode(F.sequence(F.lit(1), F.when(key % 5 == 0, 2).otherwise(1))).alias("attempt"),
        at.alias("at"),
        F.floor(F.col("o_totalprice") / 1000).alias("input"),
        (F.floor(F.col("o_totalprice") / 1000) - failed).alias("successful"),
        failed.alias("failed"),
    )
    start = orders.groupBy("o_custkey").agg(F.min(at).alias("at")).select(
        cust.cast("string").alias("session"),
        F.lit("start").alias("event"),
        "at",
        F.when(cust % 3 != 0, F.lit(5000).cast("bigint")).alias("estimated_total"),
        F.concat(F.lit("shop"), (cust % 20).cast("string")).alias("alias"),
        F.when(cust % 2 == 0, "blue").otherwise("green").alias("color"),
        F.when(cust % 4 == 0, "auto-swap").otherwise("safe").alias("strategy"),
    )
    end = (
        orders.groupBy("o_custkey")
        .agg(F.max(at).alias("at"))
        .filter((cust % 4 == 0) | (cust % 9 == 0))
        .select(
            cust.cast("string").alias("session"),
            F.when(cust % 4 == 0, "complete").otherwise("cancel").alias("event"),
            "at",
        )
    )
    return conform(batch, LEDGER).unionByName(conform(start, LEDGER)).unionByName(conform(end, LEDGER))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; absent ones are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as publish events: an alias per customer, a version per order.

    Every order stages a version; an F order publishes it, every third O order drops it.
    """
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    follow = F.when(F.col("o_orderstatus") == "F", F.lit("publish")).when(
        (F.col("o_orderstatus") == "O") & (key % 3 == 0), F.lit("drop")
    )
    actions = F.filter(F.array(F.lit("stage"), follow), lambda a: a.isNotNull())
    rows = orders.select(F.posexplode(actions).alias("step", "action"), "*").select(
        (key * 2 + F.col("step")).alias("seq"),
        F.concat(F.lit("shop"), F.col("o_custkey").cast("string")).alias("alias"),
        "action",
        F.concat(F.lit("v"), key.cast("string")).alias("version"),
        F.when(key % 2 == 0, "blue").otherwise("green").alias("color"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.lit("safe").alias("strategy"),
    )
    return conform(rows, REGISTRY)
