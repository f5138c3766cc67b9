"""Session queries: running totals and status over orders as a ledger, idle expiry over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import sessions as ss
from shelfmark.sources.star import ledger, table
from shelfmark.suite import query
from shelfmark.suite.loads import STREAM, keyed_stream

LEDGER = """WITH once AS (SELECT CAST(o_custkey AS VARCHAR) AS session, o_custkey AS cust, o_orderkey AS batch, o_orderdate AS sent,
    CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS attempts, CAST(floor(o_totalprice / 1000) AS BIGINT) AS input,
    CAST(floor(o_totalprice / 1000) AS BIGINT) - o_orderkey % 7 AS successful, o_orderkey % 7 AS failed FROM orders),
state AS (SELECT session, any_value(cust) AS cust, count(*) AS batches, CAST(sum(input) AS BIGINT) AS total,
    CAST(sum(successful) AS BIGINT) AS processed, CAST(sum(failed) AS BIGINT) AS failed, min(sent) AS first_at, max(sent) AS last_at
  FROM once GROUP BY session)"""


@query(f"""{LEDGER} SELECT session, batch, attempts, successful, failed FROM once""")
def replay_once(spark, sf):
    """A batch sent twice counts once; its attempts stay known."""
    return ss.replay_once(ledger(spark, sf)).select("session", "batch", "attempts", "successful", "failed").withColumn(
        "attempts", F.col("attempts").cast("int")
    )


@query(f"""{LEDGER} SELECT session, batch, row_number() OVER w AS batch_number,
  CAST(sum(successful) OVER w AS BIGINT) AS total_processed, CAST(sum(failed) OVER w AS BIGINT) AS total_failed,
  CASE WHEN cust % 3 <> 0 THEN round(sum(successful) OVER w / 5000.0 * 100, 6) END AS progress
FROM once WINDOW w AS (PARTITION BY session ORDER BY batch)""")
def running_totals(spark, sf):
    return ss.progress(ledger(spark, sf)).select(
        "session",
        "batch",
        "batch_number",
        "total_processed",
        "total_failed",
        F.round("progress", 6).alias("progress"),
    )


STATUS = """CASE WHEN cust % 4 = 0 THEN 'completed' WHEN cust % 9 = 0 THEN 'failed' ELSE 'active' END"""


@query(f"""{LEDGER} SELECT session, 'shop' || cust % 20 AS alias, CASE WHEN cust % 2 = 0 THEN 'blue' ELSE 'green' END AS color,
  batches, total, processed, failed, last_at, {STATUS} AS status FROM state""")
def session_status(spark, sf):
    return ss.session_status(ledger(spark, sf)).select(
        "session",
        "alias",
        "color",
        F.col("processed_batches").alias("batches"),
        F.col("total_documents").alias("total"),
        F.col("processed_documents").alias("processed"),
        F.col("failed_documents").alias("failed"),
        F.col("last_batch_at").cast("timestamp_ntz").alias("last_at"),
        "status",
    )


@query(f"""{LEDGER} SELECT session, batches FROM state
WHERE {STATUS} = 'active' AND last_at + INTERVAL 1 HOUR >= TIMESTAMP '2001-06-01 00:00:00'""")
def active_sessions(spark, sf):
    """Neither ended nor idle at a given moment."""
    now = F.lit("2001-06-01 00:00:00").cast("timestamp")
    return ss.active_sessions(ledger(spark, sf), now).select(
        "session", F.col("processed_batches").alias("batches")
    )


@query(f"""{LEDGER} SELECT count(*) AS total_batches, CAST(sum(successful) AS BIGINT) AS total_processed,
  CAST(sum(failed) AS BIGINT) AS total_failed,
  floor(sum(successful) / (epoch_us(max(sent)) - epoch_us(min(sent))) * 1e6 * 10 + 0.5) / 10 AS per_second,
  floor(sum(successful) * 100.0 / (sum(successful) + sum(failed)) * 10 + 0.5) / 10 AS success_percent FROM once""")
def load_summary(spark, sf):
    return ss.load_summary(ledger(spark, sf)).drop("seconds")


EVENTS = """WITH ev AS (SELECT event_id, user_id % 5 AS session, ts, event_type, value FROM events)"""


@query(f"""{EVENTS}, marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh
  FROM ev WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts, event_id) AS no FROM marked)
SELECT session, CAST(no AS BIGINT) AS session_no, min(ts) AS opened, max(ts) AS last_batch_at, count(*) AS batches,
  count(*) FILTER (event_type = 'error') AS failed FROM numbered GROUP BY session, no""")
def sessions(spark, sf):
    """Idle expiry: a gap of more than an hour ends a session."""
    ev = table(spark, sf, "events").withColumn("session", F.col("user_id") % 5)
    failed = {"failed": (F.col("event_type") == "error").cast("bigint")}
    return ss.idle_sessions(ev, "session", "ts", failed).select(
        "session", "session_no", "opened", "last_batch_at", "batches", "failed"
    )


@query(f"""{EVENTS}, b AS (SELECT * FROM ev WHERE event_type <> 'purchase'),
marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS gap FROM b),
numbered AS (SELECT *, sum(gap) OVER (PARTITION BY session ORDER BY ts) AS no FROM marked),
first AS (SELECT session, min(ts) AS opened, max(ts) AS ended FROM numbered WHERE no = 0 GROUP BY session),
done AS (SELECT f.session, min(e.ts) AS completed FROM ev e JOIN first f USING (session)
  WHERE e.event_type = 'purchase' AND e.value > 20 AND e.ts BETWEEN opened AND ended + INTERVAL 1 HOUR GROUP BY f.session),
span AS (SELECT session, least(ended, coalesce(completed, ended)) AS until, completed FROM first LEFT JOIN done USING (session)),
last AS (SELECT session, max(ts) AS last FROM b JOIN span USING (session) WHERE ts <= until GROUP BY session)
SELECT event_id, session, CASE WHEN completed IS NOT NULL AND ts <= last + INTERVAL 1 HOUR THEN 'not active'
  ELSE 'not found or expired' END AS reason FROM b JOIN span USING (session) JOIN last USING (session) WHERE ts > until""")
def late_batches(spark, sf):
    """Batches refused because their session was completed or had expired."""
    ev = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 5).alias("session"), "ts", "event_type", "value"
    )
    batches = ev.filter("event_type <> 'purchase'").drop("event_type", "value")
    done = ev.filter("event_type = 'purchase' AND value > 20").select("session", "ts")
    return ss.late_batches(batches, done, "session", "ts").select("event_id", "session", "reason")


@query("SELECT event_type, count(*) AS errors FROM events WHERE value < 30 GROUP BY event_type")
def error_summary(spark, sf):
    return ss.error_summary(table(spark, sf, "events").filter("value < 30"), "event_type")


@query("""SELECT event_id, ts, (SELECT greatest(count(*) - 5, 0) FROM events WHERE event_type = 'error') AS more
FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 5""")
def first_errors(spark, sf):
    """Five errors and how many more there are."""
    errors = table(spark, sf, "events").filter("event_type = 'error'").select("event_id", "ts")
    return ss.first_errors(errors, ["ts", "event_id"])


@query(f"""{STREAM}, {LEDGER[5:]}, expected AS (SELECT k.source_supplier % 7 AS s, k.* FROM keyed k),
acc AS (SELECT session, count(DISTINCT id) AS expected, count(*) AS rows,
  count(DISTINCT id) FILTER (source_supplier % 13 <> 0) AS actual FROM expected GROUP BY session)
SELECT session, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(actual, 0) >= coalesce(expected, 0) AS healthy,
  CASE WHEN coalesce(actual, 0) < coalesce(expected, 0) THEN 'failed' WHEN cust % 4 = 0 THEN 'completed'
    ELSE 'ready-for-swap' END AS deployment_status
FROM state LEFT JOIN acc USING (session)""")
def session_complete(spark, sf):
    """Completion audit: distinct accepted ids against stored documents."""
    accepted = keyed_stream(spark, sf).select("session", "id", "source_supplier")
    stored = accepted.filter("source_supplier % 13 <> 0").select("session", "id").distinct()
    return ss.completion(ledger(spark, sf), stored, accepted).select(
        "session", "expected", "actual", "healthy", "deployment_status"
    )
