"""Load sessions on micro-batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import registry as rg
from shelfmark.operators import sessions as ss
from shelfmark.plans.publish import BlueGreenCatalog
from shelfmark.plans.store import ConcurrentPublish
from shelfmark.sources import products as src
from shelfmark.streaming.load import LoadSession, all_sessions, closed_sessions, load_and_publish, purge_expired


def write_lines(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")


def product(i, price=1.0):
    return {"id": f"p{i}", "RecordId": i, "Price": price, "SearchName": f"thing {i}"}


def test_load_and_publish(spark, root, tmp_path):
    folder = f"{tmp_path}/in"
    write_lines(folder, "a.json", [product(i) for i in range(10)] + ["{broken", {"RecordId": "x1"}])
    catalog = BlueGreenCatalog(spark, root)
    session, state = load_and_publish(catalog, "shop", folder, batch_size=500, estimated_total=20)
    assert state.active_version and catalog.count("shop") == 10
    row = session.status().first()
    assert (row["processed_documents"], row["failed_documents"], row["status"]) == (10, 2, "completed")
    reasons = {r["reason"] for r in session.rejected().collect()}
    assert reasons == {"malformed JSON document", "failed to parse field [RecordId] of type [long]"}
    with pytest.raises(ValueError, match="is not active"):
        session.process(spark.createDataFrame([("{}",)], "value string"))


def test_resume_reads_only_new_files_and_last_epoch_wins(spark, root, tmp_path):
    folder = f"{tmp_path}/in"
    catalog = BlueGreenCatalog(spark, root)
    session = LoadSession(catalog, "shop")
    write_lines(folder, "a.json", [product(i, 1.0) for i in range(6)])
    session.run(src.stream_lines(spark, folder)).awaitTermination()
    write_lines(folder, "b.json", [product(i, 2.0) for i in range(3, 9)])
    session.run(src.stream_lines(spark, folder)).awaitTermination()
    assert session.status().first()["processed_documents"] == 12
    session.complete()
    staged = catalog.status("shop").staging_version
    prices = {r["id"]: r["Price"] for r in catalog.table("shop", staged).collect()}
    assert prices == {**{f"p{i}": 1.0 for i in range(3)}, **{f"p{i}": 2.0 for i in range(3, 9)}}


def test_an_epoch_that_runs_twice_counts_once(spark, root):
    session = LoadSession(BlueGreenCatalog(spark, root), "shop")
    lines = spark.createDataFrame([(json.dumps(product(i)),) for i in range(5)], "value string")
    session.process(lines, 0)
    session.process(lines, 0)
    row = session.status().first()
    assert (row["processed_batches"], row["processed_documents"]) == (1, 5)
    assert session.accepted().count() == 5


def test_a_batch_with_a_repeated_id_is_refused(spark, root):
    session = LoadSession(BlueGreenCatalog(spark, root), "shop", batch_size=2)
    rows = [product(1), product(1), product(2), product(3)]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1)
    session.process(lines)
    assert {r["id"] for r in session.accepted().collect()} == {"p2", "p3"}
    refused = session.ledger().filter("event = 'error'").first()
    assert refused["message"].startswith("Duplicate document IDs detected in batch")
    assert session.status().first()["processed_documents"] == 2


def test_cancel_drops_rows_and_fails_the_session(spark, root):
    catalog = BlueGreenCatalog(spark, root)
    session = LoadSession(catalog, "shop")
    session.process(spark.createDataFrame([(json.dumps(product(1)),)], "value string"))
    session.cancel()
    assert session.status().first()["status"] == "failed"
    assert session.accepted().count() == 0
    assert catalog.status("shop").staging_version is None


def test_auto_swap_and_argument_checks(spark, root):
    catalog = BlueGreenCatalog(spark, root)
    session = LoadSession(catalog, "shop", rg.AUTO_SWAP)
    session.process(spark.createDataFrame([(json.dumps(product(1)),)], "value string"))
    assert session.complete().status == rg.DONE
    with pytest.raises(ValueError, match="Batch size"):
        LoadSession(catalog, "shop", batch_size=0)
    assert LoadSession(catalog, "shop", batch_size=5000).batch_size == 1000


def test_closed_sessions_come_out_once_idle(spark, tmp_path):
    folder, out = f"{tmp_path}/ev", f"{tmp_path}/out"
    rows = [("a", "2024-01-01T00:00:00"), ("a", "2024-01-01T01:00:00"), ("a", "2024-01-01T02:00:01")]
    write_lines(folder, "1.json", [{"session": s, "at": t} for s, t in rows])
    # a much later row moves the watermark past the sessions above
    write_lines(folder, "2.json", [{"session": "z", "at": "2024-01-02T00:00:00"}])
    stream = (
        spark.readStream.schema("session string, at timestamp").option("maxFilesPerTrigger", 1).json(folder)
    )
    query = (
        closed_sessions(stream, "session", "at")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    got = sorted((r["opened"].hour, r["batches"]) for r in spark.read.parquet(out).filter(F.col("session") == "a").collect())
    assert [n for _, n in got] == [2, 1]


def test_expired_sessions_are_purged_and_active_ones_listed(spark, root):
    catalog = BlueGreenCatalog(spark, root)
    line = spark.createDataFrame([(json.dumps(product(1)),)], "value string")
    left, done = LoadSession(catalog, "shop"), LoadSession(catalog, "shop")
    left.process(line)
    done.process(line)
    done.complete()
    assert [r["session"] for r in ss.active_sessions(all_sessions(catalog, "shop")).collect()] == [left.session]
    assert purge_expired(catalog, "shop") == []
    later = F.current_timestamp() + F.expr("INTERVAL 2 HOURS")
    assert purge_expired(catalog, "shop", later) == [left.session]
    assert left.accepted().count() == 0 and done.accepted().count() == 1


def test_undeclared_fields_are_kept_and_found(spark, root):
    catalog = BlueGreenCatalog(spark, root)
    session = LoadSession(catalog, "shop", rg.AUTO_SWAP)
    rows = [{**product(i), "AdjustedPrice": i * 1.5, "ProductName": f"Red thing {i}", "Nested": {"on": i % 2 == 0}} for i in range(4)]
    session.process(spark.createDataFrame([(json.dumps(r),) for r in rows + [product(9)]], "value string"))
    session.complete()

    def ids(criteria):
        return sorted(r["id"] for r in catalog.search_criteria("shop", criteria).hits.collect())

    assert ids({"AdjustedPrice": {"range": {"gte": 3}}}) == ["p2", "p3"]
    assert ids({"AdjustedPrice": [1.5, 3]}) == ["p1", "p2"]
    assert ids({"ProductName": "red", "Nested.on": True}) == ["p0", "p2"]
    assert ids({"ProductName.keyword": "Red thing 1"}) == ["p1"]
    assert ids({"ProductName": None}) == ["p9"]
    # a partial update keeps them too
    catalog.update("shop", "p1", '{"Price": 5, "AdjustedPrice": 50, "New": "x"}')
    assert ids({"ProductName.keyword": "Red*", "Price": 5, "AdjustedPrice": 50, "New": "x"}) == ["p1"]


def test_the_later_file_wins_whatever_its_size(spark, root, tmp_path):
    folder = f"{tmp_path}/in"
    write_lines(folder, "a.json", [product(1, 1.0)])
    write_lines(folder, "b.json", [{**product(1, 2.0), "Description": "x" * 5000}])
    os.utime(f"{folder}/a.json", (1_700_000_000, 1_700_000_000))
    os.utime(f"{folder}/b.json", (1_700_000_100, 1_700_000_100))
    catalog = BlueGreenCatalog(spark, root)
    session = LoadSession(catalog, "shop", rg.AUTO_SWAP, batch_size=1)
    session.run(src.stream_lines(spark, folder)).awaitTermination()
    session.complete()
    assert catalog.get("shop", "p1")["Price"] == 2.0
    catalog.deploy("other", src.read_products(spark, folder), rg.AUTO_SWAP)
    assert catalog.get("other", "p1")["Price"] == 2.0
    assert "error" not in catalog.table("other").columns
    write_lines(folder, "c.json", ["{broken"])
    with pytest.raises(Exception, match="a row was set aside"):
        catalog.deploy("other", src.read_products(spark, folder))


def test_rows_with_errors_take_part_in_the_duplicate_test(spark, root):
    session = LoadSession(BlueGreenCatalog(spark, root), "shop")
    rows = [product(1), {**product(1), "Price": "dear"}, product(2)]
    session.process(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1))
    assert session.accepted().count() == 0
    assert [(r["id"], r["copies"]) for r in session.duplicates().collect()] == [("p1", 1)]


def test_only_active_sessions_can_be_cancelled(spark, root):
    catalog = BlueGreenCatalog(spark, root)
    session = LoadSession(catalog, "shop")
    session.process(spark.createDataFrame([(json.dumps(product(1)),), ("{broken",)], "value string"))
    session.complete()
    with pytest.raises(ValueError, match="is not active"):
        session.cancel()
    assert session.accepted().count() == 1 and session.rejected().count() == 1


def test_a_lost_swap_keeps_the_completed_load(spark, root, tmp_path, monkeypatch):
    folder = f"{tmp_path}/in"
    write_lines(folder, "a.json", [product(1), "{broken"])
    catalog = BlueGreenCatalog(spark, root)

    def lost(*_):
        raise ConcurrentPublish("someone else was first")

    monkeypatch.setattr(catalog, "swap", lost)
    with pytest.raises(ConcurrentPublish):
        load_and_publish(catalog, "shop", folder)
    staged = catalog.status("shop").staging_version
    assert catalog.count("shop", staged) == 1
    left = catalog.files._fs(f"{root}/shop/sessions")
    folders = [s.getPath().toString() for s in left[0].listStatus(left[1])]
    assert all(catalog.files.exists(f"{f}/{part}") for f in folders for part in ("accepted", "rejected"))


def test_broken_lines_are_reported_and_nested_fields_kept(spark, tmp_path):
    rows = ["{broken", {"RecordId": 1, "RetailContext": {"ChannelId": "abc"}}, {"RecordId": 2, "CategoryIds": [1, "x"]}]
    rows += [{"RecordId": 3, "RetailContext": {"ChannelId": 5, "Zone": "n"}, "DefaultProductProperties": [{"KeyName": "a", "ValueString": "v", "More": 1}]}]
    rows += [{"RecordId": 4, "Rules": "free text"}, {"RecordId": 5, "CategoryIds": None, "RetailContext": None}]
    write_lines(f"{tmp_path}/in", "a.json", rows)
    got = src.read_products(spark, f"{tmp_path}/in").selectExpr(
        "RecordId", "error.reason as reason", "document", "DefaultProductProperties['a'].ValueString as v", "to_json(_extra) as extra"
    ).collect()
    by_id = {r["RecordId"]: r for r in got}
    assert by_id[None]["reason"] == "malformed JSON document" and by_id[None]["document"] == "{broken"
    assert "RetailContext.ChannelId" in by_id[1]["reason"] and "CategoryIds" in by_id[2]["reason"]
    assert by_id[3]["reason"] is None and by_id[3]["v"] == "v"
    assert json.loads(by_id[3]["extra"]) == {"RetailContext": {"Zone": "n"}, "DefaultProductProperties": {"0": {"More": 1}}}
    assert by_id[4]["reason"] is None and json.loads(by_id[4]["extra"]) == {"Rules": "free text"}
    assert by_id[5]["reason"] is None and by_id[5]["extra"] is None
    with pytest.raises(Exception):
        src.read_products(spark, f"{tmp_path}/in", strict=True).collect()


def test_only_rows_set_aside_keep_their_text(spark, root, monkeypatch):
    """The rows that a session holds meanwhile are parsed; their text is not held beside them."""
    from shelfmark.operators import ingest as ing

    held, whole = [], ing.duplicate_ids
    monkeypatch.setattr(ing, "duplicate_ids", lambda df, *by: held.append(df.select("id", "document").collect()) or whole(df, *by))
    session = LoadSession(BlueGreenCatalog(spark, root), "shop")
    bad = '{"id": "x", "Price": "dear"}'
    session.process(spark.createDataFrame([(json.dumps(product(1)),), (bad,)], "value string"))
    assert {tuple(r) for r in held[0]} == {("p1", None), ("x", bad)}
    assert [r["document"] for r in session.rejected().collect()] == [bad]
    assert [r["id"] for r in session.accepted().collect()] == ["p1"]
