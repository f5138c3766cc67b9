"""Whole flows: streamed loads, closing sessions, a publish cycle, stored facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import registry as rg
from shelfmark.plans import side_tables as st
from shelfmark.plans.publish import BlueGreenCatalog
from shelfmark.plans.search import criteria_search
from shelfmark.runtime import work_path
from shelfmark.sources import products as src
from shelfmark.sources.star import CATALOG_SQL, catalog, table
from shelfmark.streaming.load import LoadSession, closed_sessions
from shelfmark.suite import query
from shelfmark.suite.criteria import CATALOG, FACET_ROWS, top_buckets

@query("""SELECT 'completed' AS status, count(*) FILTER (p_partkey % 10 <> 3) AS processed,
  count(*) FILTER (p_partkey % 10 = 3) AS failed, count(*) FILTER (p_partkey % 10 <> 3) AS published,
  CAST(sum(p_partkey) FILTER (p_partkey % 10 <> 3) AS BIGINT) AS key_sum FROM part""")
def stream_load(spark, sf):
    """Parts as JSON Lines through a streaming load session, with bad lines set aside, then published."""
    root = work_path(spark, "stream-load")
    key = F.col("p_partkey")
    good = F.to_json(
        F.struct(
            F.concat(F.lit("P"), key.cast("string")).alias("id"),
            key.alias("RecordId"),
            F.col("p_name").alias("SearchName"),
            F.col("p_retailprice").alias("Price"),
        )
    )
    bad = F.concat(F.lit('{"id": "P'), key.cast("string"), F.lit('", "Price": "dear"}'))
    lines = table(spark, sf, "part").select(F.when(key % 10 == 3, bad).otherwise(good).alias("value"))
    lines.repartition(3).write.text(f"{root}/in")
    store = BlueGreenCatalog(spark, f"{root}/catalog")
    session = LoadSession(store, "shop", rg.AUTO_SWAP)
    session.run(src.stream_lines(spark, f"{root}/in", files_per_batch=2)).awaitTermination()
    session.complete()
    stored = store.table("shop").agg(F.count(F.lit(1)).alias("n"), F.sum("RecordId").alias("s"))
    both = stored.select(F.struct("n", "s")).scalar()
    return session.status().select(
        "status",
        F.col("processed_documents").alias("processed"),
        F.col("failed_documents").alias("failed"),
        both["n"].alias("published"),
        both["s"].alias("key_sum"),
    )


@query("""WITH ev AS (SELECT user_id % 5 AS session, ts FROM events),
marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM ev),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts) AS no FROM marked),
found AS (SELECT session, min(ts) AS opened, max(ts) AS last_batch_at, count(*) AS batches FROM numbered GROUP BY session, no)
SELECT session, opened, last_batch_at, batches FROM found
WHERE last_batch_at + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf):
    """Sessions a stream gives out once they have been idle past the watermark."""
    root = work_path(spark, "stream-sessions")
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    batches = events.select(
        (F.col("user_id") % 5).alias("session"), F.col("ts").cast("timestamp").alias("at")
    )
    closed_sessions(batches, "session", "at").writeStream.format("parquet").option(
        "checkpointLocation", f"{root}/checkpoint"
    ).trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select(
        "session",
        F.col("opened").cast("timestamp_ntz").alias("opened"),
        F.col("last_batch_at").cast("timestamp_ntz").alias("last_batch_at"),
        "batches",
    )


@query(f"""WITH catalog AS ({CATALOG_SQL})
SELECT 'first' AS step, 'blue' AS color, count(*) AS documents FROM catalog
UNION ALL SELECT 'swapped', 'green', count(*) FILTER (price > 950) FROM catalog
UNION ALL SELECT 'rolled back', 'blue', count(*) FROM catalog""")
def publish_cycle(spark, sf):
    """Publish the catalog, replace it by a filtered version, go back."""
    store = BlueGreenCatalog(spark, work_path(spark, "publish-cycle"))
    df = catalog(spark, sf, categories=False)
    out = None

    def note(step):
        nonlocal out
        active = store.status("shop")
        row = store.table("shop").agg(F.count(F.lit(1)).alias("documents")).select(
            F.lit(step).alias("step"), F.lit(active.active_color).alias("color"), "documents"
        )
        out = row if out is None else out.unionByName(row)

    store.deploy("shop", df, rg.AUTO_SWAP)
    note("first")
    store.deploy_filtered("shop", df, lambda d: d["Price"] > 950)
    store.swap("shop", "green")
    note("swapped")
    store.rollback("shop")
    note("rolled back")
    return out


@query(f"{CATALOG}, hits AS (SELECT * FROM catalog WHERE price >= 910), {FACET_ROWS} {top_buckets('key_name')}")
def facets_stored(spark, sf):
    """Facets from the side table that a published version carries."""
    path = work_path(spark, "facets")
    df = catalog(spark, sf, categories=False)
    st.write_facets(df, path)
    matches = criteria_search(df, {"Price": {"range": {"gte": 910}}}).matches
    stored = st.read_facets(spark, path, ["Brand", "Type", "Size", "Maker"])
    return st.facets_of(matches, stored, score="_score").select(
        "facet", F.col("rank").cast("bigint").alias("rank"), "key", F.col("count").alias("hits")
    )


@query("""SELECT 'P' || p_partkey AS id, p_retailprice + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS price,
  p_retailprice + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS deployed FROM part""")
def stream_last_writer(spark, sf):
    """Of two sets of files the later one wins, though its files are larger and so would be read first."""
    root = work_path(spark, "last-writer")
    key = F.col("p_partkey")
    files = spark.sparkContext.defaultParallelism

    def lines(price, pad):
        doc = F.struct(F.concat(F.lit("P"), key.cast("string")).alias("id"), key.alias("RecordId"), price.alias("Price"), F.lit(pad).alias("Description"))
        return table(spark, sf, "part").select(F.to_json(doc).alias("value"), key.alias("k"))

    lines(F.col("p_retailprice"), "short").select("value").repartition(files).write.text(f"{root}/in")
    later = lines(F.col("p_retailprice") + 1, "x" * 500).filter("k % 2 = 0")
    later.select("value").repartition(files).write.mode("append").text(f"{root}/in")
    store = BlueGreenCatalog(spark, f"{root}/catalog")
    # one micro-batch holds both sets; parts come in hundreds, so no batch of rows does
    session = LoadSession(store, "shop", rg.AUTO_SWAP, batch_size=100)
    session.run(src.stream_lines(spark, f"{root}/in", files_per_batch=2 * files)).awaitTermination()
    session.complete()
    fine = src.read_products(spark, f"{root}/in")
    store.deploy("again", fine, rg.AUTO_SWAP)
    again = store.table("again").select("id", F.col("Price").alias("deployed"))
    return store.table("shop").select("id", F.col("Price").alias("price")).join(again, "id")


@query(f"""WITH catalog AS ({CATALOG_SQL}) SELECT id, price FROM catalog ORDER BY price DESC, id LIMIT 50 OFFSET 100""")
def page_after(spark, sf):
    """The page behind the hundredth hit, found by its place and not by counting."""
    from shelfmark.operators.paging import page, page_after as after

    df = catalog(spark, sf, categories=False)
    order = [("Price", "desc")]
    mark = page(df, order, limit=1, offset=99).select("Price", "id").first()
    return after(df, [mark["Price"], mark["id"]], order, limit=50).select("id", F.col("Price").alias("price"))


CHANGED = f"""WITH c AS (SELECT id, record_id AS r, search_name, price FROM ({CATALOG_SQL}))
SELECT id, CASE WHEN r % 9 = 0 OR r % 8 <> 0 THEN r END AS record_id,
  CASE WHEN r % 9 <> 0 AND r % 8 = 0 THEN 'back' ELSE search_name END AS search_name,
  CASE WHEN r % 9 = 0 THEN 1 WHEN r % 8 = 0 THEN NULL WHEN r % 3 = 0 THEN r WHEN r % 5 = 0 THEN price + 100 ELSE price END AS price
FROM c WHERE r % 9 = 0 OR r % 8 = 0 OR r % 4 <> 0
UNION ALL SELECT 'N' || r, r, search_name, price + 100 FROM c WHERE r % 10 = 0"""


def changed_catalog(spark, sf, name):
    """The catalog as a version with five batches of changes beside it."""
    store = BlueGreenCatalog(spark, work_path(spark, name))
    df = catalog(spark, sf, categories=False).select("id", "RecordId", "SearchName", "Price")
    store.deploy("shop", df, rg.AUTO_SWAP, unique=True, text_fields=None)
    number = F.col("RecordId")
    dearer = df.filter(number % 5 == 0).withColumn("Price", F.col("Price") + 100)
    fresh = dearer.filter(number % 10 == 0).withColumn("id", F.concat(F.lit("N"), number.cast("string")))
    store.write_changes("shop", upserts=dearer.unionByName(fresh))
    priced = F.parse_json(F.concat(F.lit('{"Price": '), number.cast("string"), F.lit("}")))
    store.write_changes("shop", patches=df.filter(number % 3 == 0).select("id", priced.alias("patch")))
    store.write_changes("shop", deletes=df.filter(number % 4 == 0).select("id"))
    renamed = df.filter(number % 8 == 0).select("id", F.parse_json(F.lit('{"SearchName": "back"}')).alias("patch"))
    store.write_changes("shop", patches=renamed)
    store.write_changes("shop", upserts=df.filter(number % 9 == 0).withColumn("Price", F.lit(1.0)))
    return store


def changed_rows(store):
    return store.table("shop").select(
        "id", F.col("RecordId").alias("record_id"), F.col("SearchName").alias("search_name"), F.col("Price").alias("price")
    )


@query(CHANGED)
def change_merged(spark, sf):
    """Whole, partial and deleted documents beside a version, merged when it is read."""
    return changed_rows(changed_catalog(spark, sf, "change-merged"))


@query(f"SELECT *, CAST(0 AS BIGINT) AS pending, 'green' AS color FROM ({CHANGED})")
def change_compacted(spark, sf):
    """The same changes merged into a new version, which has none beside it."""
    store = changed_catalog(spark, sf, "change-compacted")
    state = store.compact("shop")
    pending = len(store.changes("shop", state.active_version).entries())
    return changed_rows(store).select("*", F.lit(pending).cast("bigint").alias("pending"), F.lit(state.active_color).alias("color"))


@query(f"""WITH c AS (SELECT id, record_id AS r FROM ({CATALOG_SQL}))
SELECT id, CASE WHEN r % 11 = 0 THEN 'changed' ELSE 'stored' END AS found_in FROM c WHERE r % 11 = 0 OR (r % 7 = 3 AND r % 13 <> 0)""")
def indexed_changes(spark, sf):
    """A default search after changes: words deep inside undeclared objects, from the stored index and from the changes."""
    store = BlueGreenCatalog(spark, work_path(spark, "indexed-changes"))
    number = F.col("RecordId")
    deep = F.concat(F.lit('{"a": ' * 12 + '"'), F.when(number % 7 == 3, F.lit("crimson")).otherwise(F.lit("plain")), F.lit('"' + "}" * 12))
    df = catalog(spark, sf, categories=False).select("id", "RecordId", "SearchName", F.parse_json(deep).alias("_extra"))
    store.deploy("shop", df, rg.AUTO_SWAP, unique=True)
    store.write_changes("shop", deletes=df.filter(number % 13 == 0).select("id"))
    words = F.parse_json(F.lit('{"note": {"to": ["find", "Crimson"]}}')).alias("patch")
    store.write_changes("shop", patches=df.filter(number % 11 == 0).select("id", words))
    found = store.search_text("shop", "crimson", highlight=False, fuzziness=0).matches
    changed = F.regexp_extract("id", r"(\d+)", 1).cast("bigint") % 11 == 0
    return found.select("id", F.when(changed, "changed").otherwise("stored").alias("found_in"))
