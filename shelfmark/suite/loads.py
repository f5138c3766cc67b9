"""Ingest and keyed-write queries over order lines sent as product documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import ingest as ing
from shelfmark.operators import writes as wr
from shelfmark.runtime import spread, work_path
from shelfmark.sources import arrays
from shelfmark.sources import products as src
from shelfmark.sources.star import CATALOG_SQL, STREAM_ORDER, catalog, load_stream, table
from shelfmark.suite import query

STREAM = """WITH stream AS (
  SELECT CAST(l_orderkey % 10 AS VARCHAR) AS session, l_orderkey AS batch,
         CAST(l_linenumber AS BIGINT) AS pos,
         CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'P' || l_partkey END AS given_id,
         CASE WHEN l_linenumber % 5 <> 0 THEN l_partkey END AS record_id,
         l_partkey AS source_part, l_suppkey AS source_supplier,
         l_extendedprice AS price, l_quantity AS quantity, l_shipdate AS sent_at
  FROM lineitem), keyed AS (
  SELECT *, coalesce(nullif(given_id, ''), CAST(record_id AS VARCHAR),
    concat_ws('_', 'doc', session, batch, pos, source_part, source_supplier)) AS id FROM stream)"""
PLACE = ("session", "batch", "pos", "source_part", "source_supplier")


def keyed_stream(spark, sf):
    df = load_stream(spark, sf)
    return df.withColumn("id", ing.derive_id(F.col("id"), F.col("RecordId"), *PLACE))


# --- sources ---------------------------------------------------------------------------------


@query(f"""WITH catalog AS ({CATALOG_SQL})
SELECT id, record_id, search_name, price, is_active, CAST(len(coalesce(categories, [])) AS BIGINT) AS categories,
  CASE WHEN record_id % 5 <> 0 THEN p_brand END AS brand FROM catalog""")
def read_products(spark, sf):
    """The catalog written as JSON Lines and read back with the declared schema."""
    path = work_path(spark, "products-json")
    src.write_products(catalog(spark, sf), path)
    df = src.read_products(spark, path, strict=True)
    return df.select(
        "id",
        F.col("RecordId").alias("record_id"),
        F.col("SearchName").alias("search_name"),
        F.col("Price").alias("price"),
        F.col("Rules.IsActiveInSalesProcess").alias("is_active"),
        F.coalesce(F.size("CategoryIds"), F.lit(0)).cast("bigint").alias("categories"),
        F.col("DefaultProductProperties")["Brand"]["Translation"].alias("brand"),
    ).withColumn("categories", F.greatest("categories", F.lit(0)))


@query("SELECT doc_id, lang, source, md5(text) AS text_md5, length(text) AS characters FROM documents")
def array_scan(spark, sf):
    """Documents written as files of one JSON array each and read back in slabs."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    path = work_path(spark, "documents-arrays")
    arrays.write_array_files(docs, path)
    df = arrays.array_elements(spark, path).select(F.from_json("value", docs.schema).alias("d")).select("d.*")
    return df.select(
        "doc_id", "lang", "source", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("characters")
    )


@query("""SELECT event_id, key_name, value_string FROM (
  SELECT event_id, event_type AS key_name, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS value_string
  FROM events WHERE event_id % 3 IN (0, 1)
  UNION ALL SELECT event_id, 'kind', event_type FROM events WHERE event_id % 3 = 1
  UNION ALL SELECT event_id, 'short', CAST(json_extract(props, '$.k') AS VARCHAR) FROM events WHERE event_id % 3 = 2)""")
def normalise_properties(spark, sf):
    """Map form, list form (with a repeated key) and short form become one map."""
    k = F.get_json_object("props", "$.k")
    as_map = F.format_string('{"%s": {"KeyName": "%s", "ValueString": "%s"}}', "event_type", "event_type", k)
    as_list = F.format_string(
        '[{"KeyName": "%s", "ValueString": "old"}, {"KeyName": "kind", "ValueString": "%s"}, '
        '{"KeyName": "%s", "ValueString": "%s"}]',
        "event_type",
        "event_type",
        "event_type",
        k,
    )
    short = F.format_string('{"x": {"Name": "short", "Value": %s, "DataType": "Integer"}}', k)
    n = F.col("event_id") % 3
    text = F.when(n == 0, as_map).when(n == 1, as_list).otherwise(short)
    df = spread(table(spark, sf, "events")).select(
        "event_id", src.normalise_properties(F.parse_json(text)).alias("props")
    )
    return df.select("event_id", F.explode(F.map_values("props")).alias("p")).select(
        "event_id", F.col("p.KeyName").alias("key_name"), F.col("p.ValueString").alias("value_string")
    )


LINES = """WITH lines AS (SELECT l_orderkey AS batch, CAST(l_linenumber AS BIGINT) AS pos, l_partkey, l_suppkey,
  l_extendedprice, (l_partkey + l_suppkey) % 9 AS fault FROM lineitem)"""


def product_lines(spark, sf):
    """Order lines as JSON text, some of it broken."""
    fault = (F.col("l_partkey") + F.col("l_suppkey")) % 9
    price = (
        F.when(fault == 1, F.lit('"cheap"'))
        .when(fault == 2, F.lit("null"))
        .when(fault == 3, F.concat(F.lit('"'), F.col("l_quantity").cast("int").cast("string"), F.lit('"')))
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
    )
    record = F.when(fault == 4, F.lit('{"n": 1}')).otherwise(F.col("l_partkey").cast("string"))
    text = F.concat(
        F.lit('{"RecordId": '),
        record,
        F.lit(', "Price": '),
        price,
        F.lit(', "Name": '),
        F.when(fault == 6, F.lit("[1, 2]")).otherwise(F.lit('"n"')),
        F.lit(', "Color": "red"'),
        F.when(fault == 5, F.lit("")).otherwise(F.lit("}")),
    )
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").alias("batch"),
        F.col("l_linenumber").cast("bigint").alias("pos"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        text.alias("value"),
    )


@query(f"""{LINES} SELECT batch, pos, l_partkey AS part, 'mapper_parsing_exception' AS type,
  CASE fault WHEN 5 THEN 'malformed JSON document' WHEN 4 THEN 'failed to parse field [RecordId] of type [long]'
    ELSE 'failed to parse field [Price] of type [double]' END AS reason, 400 AS status
FROM lines WHERE fault IN (1, 4, 5)""")
def quarantine(spark, sf):
    """Rows set aside with the reason; their neighbours pass."""
    parsed = src.parse_lines(product_lines(spark, sf))
    return ing.failed_rows(parsed).select("batch", "pos", "part", "error.*")


NESTED = """WITH lines AS (SELECT l_orderkey AS batch, CAST(l_linenumber AS BIGINT) AS pos, l_partkey AS part, l_suppkey % 7 AS fault FROM lineitem)"""


def nested_lines(spark, sf):
    """Order lines as whole product documents, with faults and undeclared fields below the top."""
    fault = F.col("l_suppkey") % 7
    part = F.col("l_partkey").cast("string")
    context = (
        F.when(fault == 1, F.lit('{"ChannelId": "abc"}'))
        .when(fault == 2, F.concat(F.lit('{"ChannelId": '), part, F.lit(', "Zone": {"Deep": '), part, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"ChannelId": '), part, F.lit("}")))
    )
    categories = F.when(fault == 3, F.lit('[1, "x"]')).otherwise(F.lit("[1, 2]"))
    size = F.when(fault == 4, F.lit('{"KeyName": "S", "Distance": "far"}')).otherwise(
        F.lit('{"Name": "S", "Value": 4, "DataType": "Integer"}')
    )
    text = F.concat(
        F.lit('{"RecordId": '), part, F.lit(', "RetailContext": '), context, F.lit(', "CategoryIds": '), categories,
        F.lit(', "DefaultProductProperties": {"Size": '), size, F.lit("}}"),
    )
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").alias("batch"), F.col("l_linenumber").cast("bigint").alias("pos"), F.col("l_partkey").alias("part"), text.alias("value")
    )


@query(f"""{NESTED} SELECT batch, pos, part, CASE fault WHEN 1 THEN 'failed to parse field [RetailContext.ChannelId] of type [long]'
  WHEN 3 THEN 'failed to parse field [CategoryIds] of type [keyword]'
  WHEN 4 THEN 'failed to parse field [DefaultProductProperties.Distance] of type [integer]' END AS reason,
  CASE WHEN fault = 2 THEN part END AS zone, CASE WHEN fault <> 4 THEN 'Integer' END AS data_type FROM lines""")
def quarantine_nested(spark, sf):
    """Wrong values below the top are set aside; undeclared ones below the top are kept. Whole product schema."""
    parsed = src.parse_lines(nested_lines(spark, sf))
    return parsed.select(
        "batch", "pos", "part", F.col("error.reason").alias("reason"),
        F.try_variant_get("_extra", "$.RetailContext.Zone.Deep", "bigint").alias("zone"),
        F.try_variant_get("_extra", "$.DefaultProductProperties.Size.DataType", "string").alias("data_type"),
    )


@query(f"""{LINES} SELECT batch, count(*) AS input, count(*) FILTER (fault NOT IN (1, 4, 5)) AS successful,
  count(*) FILTER (fault IN (1, 4, 5)) AS failed, true AS balanced FROM lines GROUP BY batch""")
def reconcile(spark, sf):
    return ing.reconcile(src.parse_lines(product_lines(spark, sf)), ["batch"])


@query("""SELECT o_orderkey, o_orderstatus AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN 'version_conflict'
       WHEN o_orderstatus = 'F' THEN 'unexpected_status' END AS type,
  CASE WHEN o_orderkey % 7 = 0 THEN 'unknown error'
       WHEN o_orderstatus = 'F' THEN 'Unexpected status code: 503' END AS reason
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderstatus = 'F'""")
def failed_items(spark, sf):
    """Own errors, and odd statuses, of rows that came back from a write."""
    df = table(spark, sf, "orders")
    error = F.when(
        F.col("o_orderkey") % 7 == 0,
        F.struct(
            F.lit("version_conflict").alias("type"),
            F.lit(None).cast("string").alias("reason"),
            F.lit(409).alias("status"),
        ),
    )
    status = F.when(F.col("o_orderstatus") == "O", 200).when(F.col("o_orderstatus") == "P", 201).otherwise(503)
    df = df.withColumn("error", ing.outcome(error, status))
    return ing.failed_rows(df).select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), "error.type", "error.reason"
    )


# --- batches and ids -------------------------------------------------------------------------


@query("""SELECT CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 500 + 1 AS BIGINT) AS batch,
  o_orderkey AS order_key FROM orders""")
def batch_slices(spark, sf):
    df = table(spark, sf, "orders").select("o_orderdate", F.col("o_orderkey").alias("order_key"))
    return ing.slice_batches(df, 500, ["o_orderdate", "order_key"]).select("batch", "order_key")


@query(f"{STREAM} SELECT session, count(*) AS rows, count(*) <= 1000 AS within_limit FROM stream GROUP BY session")
def batch_limits(spark, sf):
    return ing.batch_limits(load_stream(spark, sf), ["session"])


@query(f"{STREAM} SELECT id, session, batch, pos, source_part FROM keyed")
def derive_id(spark, sf):
    return keyed_stream(spark, sf).select("id", "session", "batch", "pos", "source_part")


@query(f"""{STREAM} SELECT session, batch, id, count(*) - 1 AS copies FROM keyed
GROUP BY ALL HAVING count(*) > 1""")
def duplicate_ids(spark, sf):
    return ing.duplicate_ids(keyed_stream(spark, sf), ["session", "batch"])


@query(f"""{STREAM}, d AS (SELECT session, batch FROM keyed GROUP BY session, batch HAVING count(*) > count(DISTINCT id))
SELECT session, batch, count(*) AS rows FROM keyed ANTI JOIN d USING (session, batch) GROUP BY ALL""")
def accepted_batches(spark, sf):
    """Batches without a repeated id."""
    kept = ing.without_duplicate_batches(keyed_stream(spark, sf), ["session", "batch"])
    return kept.groupBy("session", "batch").agg(F.count(F.lit(1)).alias("rows"))


@query(f"{STREAM} SELECT session, count(*) AS processed, count(DISTINCT id) AS stored FROM keyed GROUP BY session")
def cross_batch_counts(spark, sf):
    return ing.cross_batch_counts(keyed_stream(spark, sf), ["session"])


@query("""WITH taken AS (SELECT DISTINCT 68719500000 + (l_partkey * 37) % 5003 AS id FROM lineitem),
free AS (SELECT 68719500000 + i AS id FROM range((SELECT count(*) FROM orders) + 5003) t(i)
  ANTI JOIN taken ON 68719500000 + i = id)
SELECT order_key, id AS record_id FROM (SELECT o_orderkey AS order_key FROM orders)
JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM free) ON n = order_key""")
def allocate_ids(spark, sf):
    """Next free record numbers past those already taken."""
    taken = table(spark, sf, "lineitem").select((F.col("l_partkey") * 37 % 5003 + 68719500000).alias("taken"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"))
    return ing.allocate_ids(rows, "order_key", taken, "taken").select(
        "order_key", F.col("RecordId").alias("record_id")
    )


@query("""WITH ids AS (SELECT DISTINCT l_partkey AS id FROM lineitem)
SELECT edge, id, (SELECT count(*) FROM ids) AS distinct_ids FROM (
  (SELECT 'smallest' AS edge, id FROM ids ORDER BY id LIMIT 5)
  UNION ALL (SELECT 'largest', id FROM ids ORDER BY id DESC LIMIT 5))""")
def uniqueness_report(spark, sf):
    return ing.uniqueness_report(table(spark, sf, "lineitem"), "l_partkey")


# --- keyed writes ----------------------------------------------------------------------------

BASE = f"""base AS (SELECT id, record_id, price FROM ({CATALOG_SQL}))"""
LAST = """last AS (SELECT id, record_id, price FROM keyed
  QUALIFY row_number() OVER (PARTITION BY id
    ORDER BY batch DESC, pos DESC, source_part DESC, source_supplier DESC, price DESC, quantity DESC) = 1)"""


def base_rows(spark, sf):
    return catalog(spark, sf, categories=False).select("id", "RecordId", "Price")


def named(df):
    return df.select("id", F.col("RecordId").alias("record_id"), F.col("Price").alias("price"))


@query(f"""WITH catalog AS ({CATALOG_SQL}), t AS (SELECT record_id, price FROM catalog
  UNION ALL SELECT record_id + 1000000000, base_price FROM catalog)
SELECT record_id, price FROM t""")
def append(spark, sf):
    """Two appends to one table; the rows of both are there."""
    path = work_path(spark, "append")
    df = catalog(spark, sf, categories=False)
    wr.append(df.select("RecordId", "Price"), path)
    wr.append(df.select((F.col("RecordId") + 1000000000).alias("RecordId"), F.col("BasePrice").alias("Price")), path)
    return spark.read.parquet(path).select(F.col("RecordId").alias("record_id"), F.col("Price").alias("price"))


@query(f"{STREAM}, {BASE}, {LAST} SELECT * FROM last UNION ALL SELECT * FROM base ANTI JOIN last USING (id)")
def upsert(spark, sf):
    """The last write of each id wins over the stored row."""
    return named(wr.upsert(base_rows(spark, sf), keyed_stream(spark, sf), STREAM_ORDER))


@query(f"""{STREAM}, {BASE} SELECT DISTINCT k.id, CASE WHEN b.id IS NULL THEN 'created' ELSE 'updated' END AS result
FROM keyed k LEFT JOIN base b ON b.id = k.id""")
def index_one(spark, sf):
    """What each keyed write does: created or updated."""
    return wr.write_results(base_rows(spark, sf), keyed_stream(spark, sf))


@query(f"""{STREAM}, {BASE} SELECT * FROM base
WHERE id NOT IN (SELECT id FROM keyed WHERE quantity >= 49)""")
def delete(spark, sf):
    gone = keyed_stream(spark, sf).filter("Quantity >= 49").select("id")
    return named(wr.delete(base_rows(spark, sf), gone))


@query(f"""{STREAM}, {BASE} SELECT DISTINCT id FROM keyed WHERE quantity >= 49 AND id NOT IN (SELECT id FROM base)""")
def delete_unknown(spark, sf):
    gone = keyed_stream(spark, sf).filter("Quantity >= 49").select("id")
    return wr.delete_unknown(base_rows(spark, sf), gone)


@query(f"""WITH catalog AS ({CATALOG_SQL}) SELECT id, record_id, floor(price * 110 + 0.5) / 100 AS price FROM catalog""")
def load_enriched(spark, sf):
    def dearer(d):
        return d.withColumn("Price", F.floor(F.col("Price") * 110 + 0.5) / 100)

    return named(wr.load_enriched(base_rows(spark, sf), dearer))


@query(f"WITH catalog AS ({CATALOG_SQL}) SELECT id, record_id, price FROM catalog WHERE price > 950")
def load_filtered(spark, sf):
    rows, _ = wr.load_filtered(base_rows(spark, sf), lambda d: d["Price"] > 950)
    return named(rows)


PATCHES = """patches AS (SELECT 'P' || (l_partkey + 20 * CAST(l_quantity = 50 AS BIGINT)) AS id,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o,
    l_suppkey % 6 AS form, l_extendedprice AS price, l_linenumber AS line, l_partkey AS part FROM lineitem)"""


def patch_stream(spark, sf):
    """Partial documents: a price, a nulled price, nested rules, a property entry, a nulled entry."""
    part = F.col("l_partkey") + F.when(F.col("l_quantity") == 50, 20).otherwise(0)
    form = F.col("l_suppkey") % 6
    line = F.col("l_linenumber").cast("string")
    text = (
        F.when(form == 0, F.concat(F.lit('{"Price": '), F.col("l_linenumber").cast("string"), F.lit("}")))
        .when(form == 1, F.lit('{"Price": null}'))
        .when(form == 2, F.concat(F.lit('{"Rules": {"ProductId": '), line, F.lit("}}")))
        .when(
            form == 3,
            F.concat(
                F.lit('{"DefaultProductProperties": {"Brand": {"Translation": "B'),
                line,
                F.lit('"}, "Extra": {"KeyName": "X'),
                line,
                F.lit('"}}}'),
            ),
        )
        .when(form == 4, F.lit('{"Rules": null}'))
        .otherwise(F.lit('{"SearchName": "Patched", "Unknown": 1}'))
    )
    return spread(table(spark, sf, "lineitem")).select(
        F.concat(F.lit("P"), part.cast("string")).alias("id"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        F.parse_json(text).alias("patch"),
    )


PATCH_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(f"""WITH {PATCHES}, catalog AS ({CATALOG_SQL}), p AS (SELECT id,
    max(o) FILTER (form IN (0, 1)) AS price_o,
    arg_max(CASE form WHEN 0 THEN CAST(line AS DOUBLE) END, o) FILTER (form = 0) AS price_set,
    max(o) FILTER (form = 0) AS set_o, max(o) FILTER (form = 4) AS rules_null, max(o) FILTER (form = 2) AS rules_o,
    arg_max(line, o) FILTER (form = 2) AS rules_line, max(o) FILTER (form = 3) AS props_o,
    arg_max(line, o) FILTER (form = 3) AS props_line, max(o) FILTER (form = 5) AS name_o
  FROM patches GROUP BY id)
SELECT coalesce(c.id, p.id) AS id,
  CASE WHEN price_o IS NULL THEN price WHEN set_o = price_o THEN price_set END AS price,
  CASE WHEN name_o IS NOT NULL THEN 'Patched' ELSE search_name END AS search_name,
  CAST(CASE WHEN rules_o IS NOT NULL AND rules_o > coalesce(rules_null, 0) THEN rules_line
       WHEN rules_null IS NULL THEN record_id END AS BIGINT) AS rules_product,
  CASE WHEN rules_null IS NULL THEN is_active END AS is_active,
  CASE WHEN props_o IS NOT NULL THEN 'B' || props_line WHEN record_id % 5 <> 0 THEN p_brand END AS brand,
  CASE WHEN record_id % 5 <> 0 THEN 'Brand' END AS brand_key,
  CASE WHEN props_o IS NOT NULL THEN 'X' || props_line END AS extra,
  CASE WHEN record_id IS NOT NULL THEN p_brand || '/' || p_type END AS maker
FROM catalog c FULL JOIN p ON p.id = c.id""")
def patch(spark, sf):
    """Partial updates: absent keeps, null clears, objects and entries merge, new ids appear."""
    base = catalog(spark, sf, categories=False).select(
        "id", "RecordId", "SearchName", "Price", "Rules", "DefaultProductProperties"
    )
    done = wr.patch(base, patch_stream(spark, sf), PATCH_ORDER)
    props = F.col("DefaultProductProperties")
    return done.select(
        "id",
        F.col("Price").alias("price"),
        F.col("SearchName").alias("search_name"),
        F.col("Rules.ProductId").alias("rules_product"),
        F.col("Rules.IsActiveInSalesProcess").alias("is_active"),
        props["Brand"]["Translation"].alias("brand"),
        props["Brand"]["KeyName"].alias("brand_key"),
        props["Extra"]["KeyName"].alias("extra"),
        props["Maker"]["KeyName"].alias("maker"),
    )


@query(f"""WITH catalog AS ({CATALOG_SQL}), p AS (SELECT id, record_id % 4 AS form, record_id FROM catalog)
SELECT id, CASE form WHEN 0 THEN 'failed to parse field [Price] of type [double]'
  WHEN 1 THEN 'failed to parse field [Rules.ProductId] of type [long]' END AS reason,
  CASE WHEN form = 2 THEN 7.5 ELSE price END AS price,
  CASE WHEN form = 3 THEN 9 ELSE record_id END AS rules_product FROM catalog JOIN p USING (id, record_id)""")
def patch_refused(spark, sf):
    """A partial document with a value of a wrong type is refused as a whole; its row stays as it was."""
    base = catalog(spark, sf, categories=False).select("id", "RecordId", "SearchName", "Price", "Rules")
    form = F.col("RecordId") % 4
    text = (
        F.when(form == 0, F.lit('{"Price": "dear", "SearchName": "lost"}'))
        .when(form == 1, F.lit('{"Price": 1, "Rules": {"ProductId": "none"}}'))
        .when(form == 2, F.lit('{"Price": 7.5}'))
        .otherwise(F.lit('{"Rules": {"ProductId": 9}}'))
    )
    patches = base.select("id", F.parse_json(text).alias("patch"), F.lit(1).alias("o"))
    done = wr.patch(base, patches, ["o"])
    faults = wr.patch_errors(patches, base.schema).select("id", "reason")
    return done.join(faults, "id", "left").select(
        "id", "reason", F.col("Price").alias("price"), F.col("Rules.ProductId").alias("rules_product")
    )


@query(f"""{STREAM}, {BASE}, {LAST}, all_rows AS (SELECT id, record_id, price, true AS fresh FROM last
  UNION ALL SELECT id, record_id, price, false FROM base ANTI JOIN last USING (id))
SELECT id, record_id, price, CASE WHEN fresh THEN 'shade' || CAST(floor(price) AS BIGINT) % 3 END AS shade FROM all_rows""")
def upsert_new_fields(spark, sf):
    """Fields that the stored table lacks are kept beside the declared ones."""
    base = base_rows(spark, sf).withColumn("_extra", F.lit(None).cast("variant"))
    whole = F.col("Price").cast("bigint") % 3
    changes = keyed_stream(spark, sf).select(
        "id", "RecordId", "Price", *[c for c in STREAM_ORDER if c != "Price"], F.concat(F.lit("shade"), whole.cast("string")).alias("Shade")
    )
    done = wr.upsert(base, changes, STREAM_ORDER)
    return done.select(
        "id", F.col("RecordId").alias("record_id"), F.col("Price").alias("price"),
        F.try_variant_get("_extra", "$.Shade", "string").alias("shade"),
    )


OPEN_PATCHES = """patches AS (SELECT 'P' || (l_partkey + 20 * CAST(l_quantity = 50 AS BIGINT)) AS id,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o,
    l_suppkey % 5 AS form, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)"""


@query(f"""WITH {OPEN_PATCHES}, catalog AS ({CATALOG_SQL}), p AS (SELECT id,
    coalesce(max(o) FILTER (form = 0), 0) AS b_o, arg_max(line, o) FILTER (form = 0) AS b,
    coalesce(max(o) FILTER (form = 1), 0) AS y_o, arg_max(line, o) FILTER (form = 1) AS y,
    coalesce(max(o) FILTER (form = 2), 0) AS null_o, coalesce(max(o) FILTER (form = 3), 0) AS seven_o,
    coalesce(max(o) FILTER (form = 4), 0) AS flat_o, arg_max(line, o) FILTER (form = 4) AS k FROM patches GROUP BY id),
  j AS (SELECT coalesce(c.id, p.id) AS id, record_id, coalesce(b_o, 0) AS b_o, b, coalesce(y_o, 0) AS y_o, y,
    coalesce(null_o, 0) AS null_o, coalesce(seven_o, 0) AS seven_o, coalesce(flat_o, 0) AS flat_o, k FROM catalog c FULL JOIN p ON p.id = c.id)
SELECT id, CASE WHEN null_o = 0 THEN record_id END AS a, CASE WHEN b_o > null_o THEN b END AS b,
  CASE WHEN null_o = 0 AND seven_o = 0 AND record_id IS NOT NULL THEN CAST(1 AS BIGINT) END AS deep_x,
  CASE WHEN y_o > greatest(null_o, seven_o) THEN y END AS deep_y,
  CASE WHEN seven_o > greatest(null_o, y_o) THEN CAST(7 AS BIGINT) END AS deep,
  CASE WHEN flat_o = 0 THEN record_id END AS flat, CASE WHEN flat_o > 0 THEN k END AS flat_k FROM j""")
def patch_open_objects(spark, sf):
    """Partial documents of undeclared objects: they merge at every depth, values and nulls replace what was below."""
    number = F.col("RecordId").cast("string")
    held = F.concat(F.lit('{"Nested": {"a": '), number, F.lit(', "deep": {"x": 1}}, "Flat": '), number, F.lit("}"))
    base = catalog(spark, sf, categories=False).select("id", "RecordId", F.parse_json(held).alias("_extra"))
    line, form = F.col("l_linenumber").cast("string"), F.col("l_suppkey") % 5
    text = (
        F.when(form == 0, F.concat(F.lit('{"Nested": {"b": '), line, F.lit("}}")))
        .when(form == 1, F.concat(F.lit('{"Nested": {"deep": {"y": '), line, F.lit("}}}")))
        .when(form == 2, F.lit('{"Nested": null}'))
        .when(form == 3, F.lit('{"Nested": {"deep": 7}}'))
        .otherwise(F.concat(F.lit('{"Flat": {"k": '), line, F.lit("}}")))
    )
    part = F.col("l_partkey") + F.when(F.col("l_quantity") == 50, 20).otherwise(0)
    patches = table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), part.cast("string")).alias("id"), *PATCH_ORDER, F.parse_json(text).alias("patch")
    )
    done = wr.patch(base, patches, PATCH_ORDER)
    at = {"a": "Nested.a", "b": "Nested.b", "deep_x": "Nested.deep.x", "deep_y": "Nested.deep.y", "deep": "Nested.deep", "flat": "Flat", "flat_k": "Flat.k"}
    return done.select("id", *[F.try_variant_get("_extra", f"$.{path}", "bigint").alias(name) for name, path in at.items()])
