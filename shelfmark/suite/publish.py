"""Version, pointer and audit queries over orders as a publish registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import scalar as sc
from shelfmark.operators import lookup as lk
from shelfmark.operators import registry as rg
from shelfmark.operators import writes as wr
from shelfmark.operators.ingest import derive_id
from shelfmark.schema import PRODUCT
from shelfmark.sources.star import CATALOG_SQL, catalog, registry, table
from shelfmark.suite import query
from shelfmark.suite.loads import STREAM, keyed_stream

REGISTRY = """WITH v AS (SELECT 'shop' || o_custkey AS alias, 'v' || o_orderkey AS version, o_orderkey * 2 AS staged,
    CASE WHEN o_orderkey % 2 = 0 THEN 'blue' ELSE 'green' END AS color, o_orderdate AS at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 2 + 1 END AS published,
    o_orderstatus = 'O' AND o_orderkey % 3 = 0 AS dropped FROM orders),
act AS (SELECT * FROM v WHERE published IS NOT NULL QUALIFY row_number() OVER (PARTITION BY alias ORDER BY published DESC) = 1),
stg AS (SELECT v.* FROM v LEFT JOIN act USING (alias) WHERE v.published IS NULL AND NOT v.dropped AND v.staged > coalesce(act.staged, -1)
  QUALIFY row_number() OVER (PARTITION BY alias ORDER BY v.staged DESC) = 1),
names AS (SELECT DISTINCT alias FROM v WHERE NOT dropped)"""


@query(f"""{REGISTRY} SELECT alias, act.version AS active_version, act.color AS active_color, stg.version AS staging_version,
  stg.color AS staging_color, CASE WHEN stg.version IS NULL THEN 'IDLE' ELSE 'READY_FOR_SWAP' END AS status,
  act.at AS last_deployment, CASE WHEN stg.version IS NOT NULL THEN stg.color WHEN act.color = 'blue' THEN 'green' ELSE 'blue' END AS next_color
FROM names LEFT JOIN act USING (alias) LEFT JOIN stg USING (alias)""")
def deployment_status(spark, sf):
    df = rg.deployment_status(registry(spark, sf))
    return df.withColumn("last_deployment", F.col("last_deployment").cast("timestamp_ntz"))


@query(f"""{REGISTRY} SELECT alias, CAST(row_number() OVER w AS BIGINT) AS rank, version, color FROM v
WHERE published IS NOT NULL WINDOW w AS (PARTITION BY alias ORDER BY published DESC) QUALIFY row_number() OVER w <= 2""")
def version_history(spark, sf):
    """Active and previous version of every alias."""
    return rg.published_history(registry(spark, sf)).select(
        "alias", F.col("rank").cast("bigint").alias("rank"), "version", "color"
    )


@query(f"""{REGISTRY} SELECT alias, version, color FROM v WHERE published IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY alias ORDER BY published DESC) = 2""")
def rollback_target(spark, sf):
    return rg.rollback_target(registry(spark, sf)).select("alias", "version", "color")


@query(f"""{REGISTRY}, kept AS (SELECT alias, version FROM v WHERE published IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY alias ORDER BY published DESC) <= 2
  UNION ALL SELECT alias, version FROM stg)
SELECT alias, version, color FROM v ANTI JOIN kept USING (alias, version) WHERE NOT dropped""")
def cleanup(spark, sf):
    """Versions that may go: never the active one, its predecessor or the one awaiting promotion."""
    return rg.cleanup_candidates(registry(spark, sf)).select("alias", "version", "color")


NAMES = """WITH names AS (SELECT 'shop' || o_custkey AS alias, 'shop' || o_custkey ||
    CASE WHEN o_orderkey % 4 = 0 THEN '_old' || o_orderkey
         ELSE '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS name FROM orders)"""


def version_names(spark, sf):
    alias = F.concat(F.lit("shop"), F.col("o_custkey").cast("string"))
    stamp = F.concat(
        sc.compact_timestamp(F.col("o_orderdate"), 14), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    )
    suffix = F.when(
        F.col("o_orderkey") % 4 == 0, F.concat(F.lit("old"), F.col("o_orderkey").cast("string"))
    ).otherwise(stamp)
    return table(spark, sf, "orders").select(alias.alias("alias"), F.concat_ws("_", alias, suffix).alias("name"))


@query(f"""{NAMES} SELECT alias, coalesce(max(name) FILTER (regexp_matches(name, '_[0-9]{{17}}')), min(name)) AS name
FROM names GROUP BY alias""")
def latest_version(spark, sf):
    """Newest name by its time suffix, else the first."""
    return lk.newest_version(version_names(spark, sf))


@query(f"{NAMES} SELECT alias, max(name) AS name FROM names GROUP BY alias")
def last_name(spark, sf):
    return lk.last_by_name(version_names(spark, sf))


@query(f"""{STREAM}, n AS (SELECT count(*) AS n, count(*) FILTER (given_id IS NULL) AS nulls, count(DISTINCT given_id) AS ids FROM stream)
SELECT 'exists' AS check, 'fail' AS severity, true AS passed, n AS observed, CAST(NULL AS BIGINT) AS wanted FROM n
UNION ALL SELECT 'null_id', 'fail', nulls = 0, nulls, 0 FROM n
UNION ALL SELECT 'duplicate_id', 'fail', n - nulls - ids = 0, n - nulls - ids, 0 FROM n
UNION ALL SELECT 'schema', 'fail', false, 1, 0 FROM n
UNION ALL SELECT 'types', 'fail', false, 2, 0 FROM n
UNION ALL SELECT 'expected_count', 'fail', n >= 1000, n, 1000 FROM n
UNION ALL SELECT 'surplus', 'warn', n <= 1000, n, 1000 FROM n
UNION ALL SELECT 'minimum_count', 'fail', n >= 1, n, 1 FROM n""")
def audit(spark, sf):
    """Checks of a staged version that has faults, two fields of a wrong type among them."""
    from shelfmark.sources.star import load_stream

    staged = load_stream(spark, sf).withColumn("Price", F.col("Price").cast("string"))
    staged = staged.withColumn("RetailContext", F.struct(F.lit("1").alias("ChannelId")))
    columns = ["id", "Price", "Locale"]
    return rg.audit(staged, expected=1000, minimum=1, columns=columns, types=PRODUCT)


@query(f"""{STREAM}, last AS (SELECT id, price FROM keyed WHERE price > 50000
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC, pos DESC, source_part DESC, source_supplier DESC, price DESC, quantity DESC) = 1)
SELECT count(*) AS documents, count(DISTINCT id) AS ids, min(price) AS low, max(price) AS high FROM last""")
def deploy_filtered(spark, sf):
    """Filter, key, keep the last write of each id: the rows a filtered deployment stages."""
    from shelfmark.sources.star import STREAM_ORDER

    rows, _ = wr.load_filtered(keyed_stream(spark, sf), lambda d: d["Price"] > 50000)
    return wr.latest(rows, STREAM_ORDER).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct("id").alias("ids"),
        F.min("Price").alias("low"),
        F.max("Price").alias("high"),
    )
