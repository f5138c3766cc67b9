"""Synthetic catalogs, scalar functions and version statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import scalar as sc
from shelfmark.operators import reports as rp
from shelfmark.operators import synth as sy
from shelfmark.sources.star import table
from shelfmark.suite import query


def word(seed, i, block, slot):
    return f"CAST('0x' || substr(md5('{seed}:' || {i} || ':{block}'), {slot * 8 + 1}, 8) AS UBIGINT)"


def unit(seed, i, block, slot):
    return f"(CAST({word(seed, i, block, slot)} AS DOUBLE) / 4294967296.0)"


def half_up(expr, digits):
    scale = float(10**digits)
    return f"floor(({expr}) * {scale}::DOUBLE + 0.5) / {scale}::DOUBLE"


def u(block, slot):
    return unit("simple", "i", block, slot)


@query(f"""WITH s AS (SELECT o_orderkey + 1 AS i FROM orders)
SELECT 'prod_' || CASE WHEN i < 100000 THEN lpad(CAST(i AS VARCHAR), 6, '0') ELSE CAST(i AS VARCHAR) END AS id,
  i AS record_id, 'Test Product ' || i AS name, {half_up(u(0, 0) + '*1000.0::DOUBLE+10.0::DOUBLE', 2)} AS price,
  ['Electronics', 'Clothing', 'Books', 'Home & Garden', 'Sports'][i % 5 + 1] AS category, {u(0, 1)} > 0.1 AS in_stock,
  {half_up(u(1, 1) + '*100.0::DOUBLE+1.0::DOUBLE', 1)} AS height, 'tag_' || i % 10 || ',category_' || i % 5 || ',type_' || i % 3 AS tags,
  {u(1, 2)} > 0.05 AS active, {u(2, 1)} > 0.9 AS serialized, CAST({word('simple', 'i', 2, 3)} % 5 + 1 AS BIGINT) AS version,
  CAST(floor({u(2, 2)} * 31536000) AS BIGINT) AS age FROM s""")
def synth_simple(spark, sf):
    """One simple product per order."""
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("i"))
    age = F.unix_seconds("metadata.updatedAt") - F.unix_seconds("metadata.createdAt")
    return sy.simple_products(rows).select(
        "id",
        F.col("RecordId").alias("record_id"),
        "name",
        "price",
        "category",
        F.col("inStock").alias("in_stock"),
        "dimensions.height",
        F.concat_ws(",", "tags").alias("tags"),
        F.col("rules.isActiveInSalesProcess").alias("active"),
        F.col("rules.isSerialized").alias("serialized"),
        "metadata.version",
        age.alias("age"),
    )


def templates(spark, sf):
    key = F.col("p_partkey")
    date = F.when(key % 3 == 0, sy.NO_DATE).when(key % 3 == 1, "2020-05-05T00:00:00+00:00")
    entry = F.struct(F.col("p_brand").alias("KeyName"), date.alias("DateTimeOffsetValue"))
    return table(spark, sf, "part").select(
        key.alias("template_no"),
        (key * 3 + 68719500000).alias("RecordId"),
        F.initcap("p_name").alias("ProductName"),
        F.col("p_type").alias("Description"),
        F.struct(key.alias("ProductId"), F.lit(True).alias("IsActiveInSalesProcess")).alias("Rules"),
        F.struct(F.lit("x").alias("ModifiedDateTime"), F.lit(1).alias("ChangeActionValue")).alias(
            "ChangeTrackingInformation"
        ),
        F.create_map(F.lit("Brand"), entry).alias("DefaultProductProperties"),
        "p_size",
    )


def sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def template_sql(seed, colors, materials):
    def w(block, slot):
        return word(seed, "i", block, slot)

    def x(block, slot):
        return unit(seed, "i", block, slot)

    return f"""drawn AS (SELECT o_orderkey AS i, CAST({w(0, 0)} % (SELECT count(*) FROM part) AS BIGINT) AS no,
    {sql_list(colors)}[CAST({w(0, 1)} % {len(colors)} AS BIGINT) + 1] AS color,
    {sql_list(materials)}[CAST({w(0, 2)} % {len(materials)} AS BIGINT) + 1] AS material,
    {x(0, 3)} * 490.0::DOUBLE + 10.0::DOUBLE AS base, {x(1, 0)} * 0.4::DOUBLE + 0.9::DOUBLE AS f, {x(1, 1)} * 0.1::DOUBLE + 0.95::DOUBLE AS g,
    strftime(DATE '2024-01-01' - CAST({w(1, 2)} % 365 + 1 AS INTEGER), '%Y-%m-%d') || 'T00:00:00+00:00' AS stamp
  FROM (SELECT o_orderkey, o_orderkey AS i FROM orders)),
priced AS (SELECT *, {half_up('base', 2)} AS base_price, {half_up('base * f', 2)} AS price FROM drawn),
made AS (SELECT *, {half_up('price * g', 2)} AS adjusted,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS base_name
  FROM priced JOIN part ON p_partkey = no)"""


@query(f"""WITH {template_sql('template', sy.COLORS, sy.MATERIALS)},
taken AS (SELECT 68719500000 + p_partkey * 3 AS id FROM part),
free AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (
  SELECT 68719500000 + r AS id FROM range((SELECT 2 * count(*) FROM orders) + 100) t(r)) WHERE id NOT IN (SELECT id FROM taken))
SELECT i, free.id AS record_id, CAST(90000 + i % 10000 AS VARCHAR) AS item_id, color || ' ' || material || ' ' || base_name AS name,
  substr(color || ' ' || material || ' ' || base_name, 1, 20) AS search_name,
  'Premium ' || lower(color) || ' ' || lower(material) || ' ' || lower(p_type) AS description,
  base_price, price, adjusted, free.id AS rules_product, stamp AS modified,
  CASE no % 3 WHEN 0 THEN '1900-01-01T00:00:00+00:00' WHEN 1 THEN stamp END AS property_date
FROM made JOIN free ON free.n = i""")
def synth_template(spark, sf):
    """One product per order, made from parts as templates; record numbers avoid the templates'."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"))
    return sy.template_products(rows, templates(spark, sf)).select(
        "i",
        F.col("RecordId").alias("record_id"),
        F.col("ItemId").alias("item_id"),
        F.col("ProductName").alias("name"),
        F.col("SearchName").alias("search_name"),
        F.col("Description").alias("description"),
        F.col("BasePrice").alias("base_price"),
        F.col("Price").alias("price"),
        F.col("AdjustedPrice").alias("adjusted"),
        F.col("Rules.ProductId").alias("rules_product"),
        F.col("ChangeTrackingInformation.ModifiedDateTime").alias("modified"),
        F.col("DefaultProductProperties")["Brand"]["DateTimeOffsetValue"].alias("property_date"),
    )


@query(f"""WITH {template_sql('batch', sy.COLORS[:10], sy.MATERIALS[:8])}
SELECT i, 68719500000 + i AS record_id, color || ' ' || material || ' ' || base_name AS name,
  substr(color || ' ' || material, 1, 20) AS search_name, p_type AS description, base_price, price, adjusted FROM made""")
def synth_batches(spark, sf):
    """The batch form: fewer variations, short search name, description as in the template."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"))
    return sy.template_products(rows, templates(spark, sf), seed="batch", brief=True).select(
        "i",
        F.col("RecordId").alias("record_id"),
        F.col("ProductName").alias("name"),
        F.col("SearchName").alias("search_name"),
        F.col("Description").alias("description"),
        F.col("BasePrice").alias("base_price"),
        F.col("Price").alias("price"),
        F.col("AdjustedPrice").alias("adjusted"),
    )


@query("""SELECT c_custkey, length(trim(c_name)) = 0 AS blank, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS truthy,
  lower(c_mktsegment) AS low, contains(c_name, '77') AS has_77, substr(c_name || ' ' || c_mktsegment, 1, 20) AS prefix,
  lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, CASE WHEN c_custkey % 2 = 0 THEN 'blue' ELSE 'green' END AS color,
  CASE WHEN c_custkey % 2 = 0 THEN 'green' ELSE 'blue' END AS other, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS number,
  ['a', 'b', 'c'][c_custkey % 3 + 1] AS picked FROM customer""")
def scalar_text(spark, sf):
    key = F.col("c_custkey")
    name = F.concat(F.lit("shop"), F.when(key % 2 == 0, F.lit("-blue-")).otherwise(F.lit("_green_")), key.cast("string"))
    sniffed = F.when(key % 3 == 0, F.concat(F.lit(" "), key.cast("string"), F.lit(".0 "))).when(
        key % 3 == 1, F.concat(F.lit("0x"), key.cast("string"))
    ).otherwise("")
    return table(spark, sf, "customer").select(
        "c_custkey",
        sc.is_blank(F.col("c_name")).alias("blank"),
        sc.first_truthy_text(
            F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")), F.col("c_name")
        ).alias("truthy"),
        F.lower("c_mktsegment").alias("low"),
        F.col("c_name").contains("77").alias("has_77"),
        F.substring(F.concat_ws(" ", "c_name", "c_mktsegment"), 1, 20).alias("prefix"),
        F.lpad(key.cast("string"), 8, "0").alias("padded"),
        sc.color_of_name(name).alias("color"),
        sc.opposite_color(sc.color_of_name(name)).alias("other"),
        sc.numeric_key(sniffed).alias("number"),
        sc.pick(["a", "b", "c"], key % 3).alias("picked"),
    )


@query("""SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') AS digits17,
  strftime(ts, '%Y%m%d%H%M%S') AS digits14,
  strftime(ts, '%Y%m%d%H%M%S') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') AS extracted FROM events""")
def scalar_time(spark, sf):
    digits = sc.compact_timestamp(F.col("ts"))
    name = F.concat(F.col("event_type"), F.lit("_"), digits, F.lit("-x"))
    return table(spark, sf, "events").select(
        "event_id",
        digits.alias("digits17"),
        sc.compact_timestamp(F.col("ts"), 14).alias("digits14"),
        sc.version_timestamp(name, F.col("event_type")).alias("extracted"),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS changed,
  CASE WHEN value > 50 THEN 'late' ELSE 'early' END AS stamp, event_type || ':' || event_type AS pair,
  1 AS distinct_pair FROM events""")
def scalar_nested(spark, sf):
    """JSON text to a struct, one field changed, map values changed where they qualify."""
    parsed = F.from_json("props", "k bigint")
    stamps = F.create_map(F.lit("a"), F.when(F.col("value") > 50, F.lit("open")).otherwise(F.lit("early")))
    pair = F.array("event_type", "event_type")
    return table(spark, sf, "events").select(
        "event_id",
        parsed["k"].alias("k"),
        parsed.withField("k", parsed["k"] + 1)["k"].alias("changed"),
        F.transform_values(stamps, lambda _, v: F.when(v == "open", F.lit("late")).otherwise(v))["a"].alias("stamp"),
        F.concat_ws(":", pair).alias("pair"),
        F.size(F.array_distinct(pair)).alias("distinct_pair"),
    )


@query("""WITH b AS (SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 16 WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey * 54321
    ELSE o_orderkey * 987654321 END AS BIGINT) AS bytes FROM orders),
s AS (SELECT *, CASE WHEN bytes >= 1099511627776 THEN 4 WHEN bytes >= 1073741824 THEN 3 WHEN bytes >= 1048576 THEN 2 WHEN bytes >= 1024 THEN 1 ELSE 0 END AS step FROM b)
SELECT o_orderkey, bytes, CASE WHEN bytes = 0 THEN '0 B' ELSE
  regexp_replace(printf('%.2f', floor(bytes / pow(1024.0, step) * 100.0 + 0.5) / 100.0), '\\.?0+$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][step + 1] END AS shown FROM s""")
def human_bytes(spark, sf):
    key = F.col("o_orderkey")
    size = (
        F.when(key % 4 == 0, key % 16).when(key % 4 == 1, key).when(key % 4 == 2, key * 54321).otherwise(key * 987654321)
    )
    return table(spark, sf, "orders").select("o_orderkey", size.alias("bytes"), sc.human_bytes(size).alias("shown"))


@query("SELECT count(*) AS documents, CAST(1 AS BIGINT) AS files, true AS has_size, 'green' AS health FROM lineitem")
def version_stats(spark, sf):
    """Documents, files and size of a stored table."""
    stats = rp.version_stats(table(spark, sf, "lineitem"))
    return stats.select("documents", "files", (F.col("bytes") > 0).alias("has_size"), "health")


@query("""SELECT l_returnflag, count(*) AS processed, count(*) FILTER (l_quantity < 10) AS failed,
  floor(count(*) FILTER (l_quantity >= 10) * 100.0 / count(*) * 10 + 0.5) / 10 AS success_percent FROM lineitem GROUP BY l_returnflag""")
def success_share(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("l_quantity") < 10).alias("failed")
    )
    ok = F.col("processed") - F.col("failed")
    return rows.withColumn("success_percent", sc.percent(ok, F.col("processed")))
