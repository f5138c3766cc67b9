"""The publish state machine: deploy, swap, roll back, clean up."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import registry as rg
from shelfmark.operators import writes as wr
from shelfmark.plans import side_tables as st
from shelfmark.plans.publish import AuditFailed, BlueGreenCatalog
from shelfmark.plans.store import ConcurrentPublish
from shelfmark.schema import PRODUCT
from shelfmark.plans.store import ConcurrentPublish
from tests.conftest import make_products


@pytest.fixture
def catalog(spark, root):
    return BlueGreenCatalog(spark, root)


def test_first_deployment_is_blue_and_waits(spark, catalog):
    state = catalog.deploy("shop", make_products(spark, 3))
    assert (state.alias, state.staging_color, state.status) == ("shop", "blue", rg.READY)
    assert state.active_version is None
    assert catalog.status("shop").staging_version == state.staging_version
    assert not catalog.alias_exists("shop")


def test_auto_swap_publishes(spark, catalog):
    state = catalog.deploy("shop", make_products(spark, 2), rg.AUTO_SWAP)
    assert (state.status, state.active_color) == (rg.DONE, "blue")
    assert catalog.table("shop").count() == 2
    assert catalog.status("shop").status == rg.IDLE


def test_blue_to_green_swap_and_rollback(spark, catalog):
    blue = catalog.deploy("shop", make_products(spark, 2, "blue"), rg.AUTO_SWAP)
    staged = catalog.deploy("shop", make_products(spark, 3, "green"))
    assert (staged.active_color, staged.staging_color) == ("blue", "green")
    with pytest.raises(ValueError, match="does not match staging color"):
        catalog.swap("shop", "blue")
    after = catalog.swap("shop", "green")
    assert (after.active_color, after.status) == ("green", rg.IDLE)
    assert after.last_deployment is not None
    assert catalog.count("shop") == 3
    back = catalog.rollback("shop")
    assert (back.active_color, back.active_version) == ("blue", blue.active_version)
    assert catalog.count("shop") == 2
    # going back again returns to the version left a moment ago
    assert catalog.rollback("shop").active_color == "green"


def test_rollback_needs_a_previous_version(spark, catalog):
    with pytest.raises(ValueError, match="No active index"):
        catalog.rollback("shop")
    catalog.deploy("shop", make_products(spark, 1), rg.AUTO_SWAP)
    with pytest.raises(ValueError, match="No previous index"):
        catalog.rollback("shop")


def test_empty_deployment_and_unknown_alias(spark, catalog):
    state = catalog.deploy("shop", make_products(spark, 0))
    assert (state.staging_color, state.status) == ("blue", rg.READY)
    unknown = catalog.status("nowhere")
    assert (unknown.alias, unknown.active_color, unknown.status) == ("nowhere", None, rg.IDLE)


def test_filtered_deployment_keeps_what_passes(spark, catalog):
    mix = make_products(spark, 2, "expensive", 100.0).unionByName(make_products(spark, 2, "cheap", 10.0))
    state = catalog.deploy_filtered("shop", mix, lambda d: d["Price"] > 50)
    assert catalog.count("shop", state.staging_version) == 2
    with pytest.raises(ValueError, match="Filter predicate is required"):
        catalog.deploy_filtered("shop", mix, None)


def test_workflow_initialises_then_deploys(spark, catalog):
    def enrich(d):
        return d.withColumn("Price", F.col("Price") * 2)

    first = catalog.workflow("shop", make_products(spark, 3), auto_promote=True, enrich=enrich)
    assert (first.status, first.active_color) == (rg.DONE, "green")
    # enrichment applies to a new alias too
    assert catalog.table("shop").agg(F.min("Price")).first()[0] == 110.0
    with pytest.raises(ValueError, match="already exists"):
        catalog.initialise("shop", make_products(spark, 1))
    second = catalog.workflow("shop", make_products(spark, 1))
    assert (second.status, second.staging_color) == (rg.READY, "blue")


def test_health_and_statistics(spark, catalog):
    state = catalog.deploy("shop", make_products(spark, 3), rg.AUTO_SWAP)
    assert catalog.healthy("shop", state.active_version)
    assert not catalog.healthy("nowhere")
    assert not catalog.healthy("shop", "missing-version")
    stats = catalog.stats("shop").first()
    assert stats["documents"] == 3 and stats["health"] == "green" and stats["bytes"] > 0
    assert stats["store_size"].endswith("B")


def test_argument_errors(spark, catalog):
    with pytest.raises(ValueError, match="Alias name must be specified"):
        catalog.deploy("", make_products(spark, 1))
    with pytest.raises(ValueError, match="Products array is required"):
        catalog.deploy("shop", None)
    with pytest.raises(ValueError, match="No staging index available"):
        catalog.swap("non-existent", "blue")
    with pytest.raises(ValueError, match="Unknown strategy"):
        catalog.deploy("shop", make_products(spark, 1), "sometimes")
    with pytest.raises(LookupError, match="does not exist"):
        catalog.publish_version("shop", "v0")


def test_fixed_colour_strategies(spark, catalog):
    catalog.deploy("shop", make_products(spark, 1), rg.AUTO_SWAP)
    assert catalog.deploy("shop", make_products(spark, 1), rg.BLUE_ONLY).staging_color == "blue"
    assert catalog.deploy("shop", make_products(spark, 1), rg.GREEN_ONLY).staging_color == "green"


def test_cleanup_spares_active_previous_and_staged(spark, catalog):
    names = [catalog.deploy("shop", make_products(spark, 1), rg.AUTO_SWAP).active_version for _ in range(4)]
    abandoned = catalog.deploy("shop", make_products(spark, 1)).staging_version
    staged = catalog.deploy("shop", make_products(spark, 1)).staging_version
    gone = set(catalog.cleanup("shop"))
    assert gone == {names[0], names[1], abandoned}
    left = {r["version"] for r in catalog.versions("shop").collect()}
    assert left == {names[2], names[3], staged}
    assert not catalog.files.exists(catalog.files.version_path("shop", abandoned))
    with pytest.raises(ValueError, match="is active"):
        catalog.drop_version("shop", names[3])


def test_publish_by_name_can_delete_the_others(spark, catalog):
    catalog.deploy("shop", make_products(spark, 1), rg.AUTO_SWAP)
    staged = catalog.deploy("shop", make_products(spark, 2)).staging_version
    state = catalog.publish_version("shop", staged, delete_old=True)
    assert state.active_version == staged
    assert catalog.versions("shop").count() == 1


def test_of_two_writers_one_fails(spark, catalog):
    catalog.deploy("shop", make_products(spark, 1), rg.AUTO_SWAP)
    seen = catalog.files.last_seq("shop")
    catalog.files.record("shop", rg.PUBLISH, "a", "blue", seen=seen)
    with pytest.raises(ConcurrentPublish):
        catalog.files.record("shop", rg.PUBLISH, "b", "green", seen=seen)


def test_audit_stops_a_short_version(spark, catalog):
    with pytest.raises(AuditFailed):
        catalog.deploy("shop", make_products(spark, 2), expected=3)
    assert catalog.status("shop").staging_version is None
    catalog.deploy("shop", make_products(spark, 4), expected=3)


def test_empty_versions_and_labels(spark, catalog):
    catalog.create_version("shop", "v1", "blue")
    with pytest.raises(ValueError, match="already exists"):
        catalog.create_version("shop", "v1", "blue")
    assert catalog.count("shop", "v1") == 0
    warm = catalog.create_warming_version("shop")
    label = catalog.files.registry("shop").filter(F.col("version") == warm).first()["label"]
    assert label == "warming"


def test_repeated_ids_keep_the_last_and_missing_ids_come_from_the_record_number(spark, catalog):
    rows = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 1, 2.0), ("", 7, 3.0), (None, 0, 4.0)], "id string, RecordId long, Price double"
    )
    with pytest.raises(AuditFailed, match="duplicate_id"):
        catalog.deploy("shop", rows)  # nothing says which of two rows is the last
    catalog.deploy("shop", rows, rg.AUTO_SWAP, order_by=["Price"])
    got = {r["id"]: r["Price"] for r in catalog.table("shop").collect()}
    assert got == {"a": 2.0, "7": 3.0, "0": 4.0}


def test_a_row_without_any_id_fails_the_deployment(spark, catalog):
    rows = spark.createDataFrame([(None, None)], "id string, RecordId long")
    with pytest.raises(Exception, match="document without id"):
        catalog.deploy("shop", rows)


def test_change_makes_a_new_version(spark, catalog):
    catalog.deploy("shop", make_products(spark, 3), rg.AUTO_SWAP)
    gone = spark.createDataFrame([("test-2",)], "id string")
    catalog.change("shop", lambda d: wr.delete(d, gone))
    assert {r["id"] for r in catalog.table("shop").collect()} == {"test-1", "test-3"}
    assert catalog.rollback("shop").active_color == "blue"
    assert catalog.count("shop") == 3


def test_schema_and_view(spark, catalog):
    catalog.deploy("shop-a", make_products(spark, 2), rg.AUTO_SWAP)
    kinds = {r["path"]: r["kind"] for r in catalog.schema_of("shop-a").collect()}
    assert kinds["Name"] == "disabled" and kinds["SearchName"] == "text+keyword"
    assert kinds["CategoryIds"] == "keyword" and kinds["Price"] == "double"
    assert spark.sql(f"SELECT count(*) FROM {catalog.view('shop-a')}").first()[0] == 2


def test_single_documents(spark, catalog):
    catalog.deploy("shop", make_products(spark, 2), rg.AUTO_SWAP)
    one = make_products(spark, 1).withColumn("Price", F.lit(1.0))
    assert catalog.index_one("shop", one) == "updated"
    assert catalog.index_one("shop", make_products(spark, 1, "new").select("id", "RecordId")) == "created"
    assert catalog.update("shop", "test-1", '{"Price": 2.5}') == "updated"
    assert catalog.update("shop", 77, '{"Price": 3.5}') == "created"
    catalog.delete("shop", "test-2")
    got = {r["id"]: r["Price"] for r in catalog.table("shop").collect()}
    assert got == {"test-1": 2.5, "new-1": None, "77": 3.5}
    with pytest.raises(LookupError, match="not found"):
        catalog.delete("shop", "test-2")
    with pytest.raises(ValueError, match="Document ID must be specified"):
        catalog.delete("shop", " ")


def test_searches_follow_the_alias(spark, catalog):
    leaf = F.struct(F.lit("Red").alias("KeyName"), F.lit("Rot").alias("Translation"), F.lit("Color").alias("FriendlyName"))
    rows = make_products(spark, 5).withColumn("DefaultProductProperties", F.create_map(F.lit("Color"), leaf))
    catalog.deploy("shop", rows, rg.AUTO_SWAP, text_fields=["SearchName"])
    found = catalog.search_criteria("shop", {"Price": {"range": {"gte": 60}}}, aggs=["Color"], limit=2)
    assert [r["id"] for r in found.hits.collect()] == ["test-2", "test-3"]
    assert [(r["key"], r["count"], r["top"]["id"]) for r in found.facets.collect()] == [("Red", 4, "test-2")]
    for fields in (["SearchName"], None):
        hits = catalog.search_text("shop", "prodcut 3", fields).hits.collect()
        assert hits[0]["id"] == "test-3" and len(hits) == 5
        assert hits[0]["_highlight"]["SearchName"] == "test <em>product</em> <em>3</em> test"
    assert catalog.get("shop", "test-4")["RecordId"] == 4
    assert catalog.get("shop", 4)["id"] == "test-4"
    assert catalog.get("shop", "nope") is None
    with pytest.raises(LookupError, match="Alias 'other' does not exist"):
        catalog.search_text("other", "x")


def test_a_change_overtaken_by_another_is_applied_to_the_newer_version(spark, catalog):
    catalog.deploy("shop", make_products(spark, 3), rg.AUTO_SWAP)
    gone = spark.createDataFrame([("test-2",)], "id string")
    seen = []

    def slow_delete(rows):
        if not seen:  # another writer finishes while this one is at work
            seen.append(1)
            catalog.update("shop", "test-1", '{"Price": 5}')
        return wr.delete(rows, gone)

    catalog.change("shop", slow_delete)
    assert {r["id"]: r["Price"] for r in catalog.table("shop").collect()} == {"test-1": 5.0, "test-3": 65.0}


def test_a_version_published_meanwhile_is_not_dropped(spark, catalog, monkeypatch):
    catalog.deploy("shop", make_products(spark, 1), rg.AUTO_SWAP)
    staged = catalog.deploy("shop", make_products(spark, 2)).staging_version
    versions = catalog.versions

    def swap_between(alias):
        monkeypatch.setattr(catalog, "versions", versions)
        catalog.swap("shop", "green")
        return versions(alias)

    monkeypatch.setattr(catalog, "versions", swap_between)
    with pytest.raises(ConcurrentPublish):
        catalog.drop_version("shop", staged)
    assert catalog.status("shop").active_version == staged and catalog.count("shop") == 2


def test_publishing_spares_the_version_that_waits(spark, catalog):
    first = catalog.deploy("shop", make_products(spark, 1), rg.AUTO_SWAP).active_version
    catalog.deploy("shop", make_products(spark, 2), rg.AUTO_SWAP)
    waiting = catalog.deploy("shop", make_products(spark, 3)).staging_version
    catalog.publish_version("shop", first, delete_old=True)
    assert {r["version"] for r in catalog.versions("shop").collect()} == {first, waiting}


def test_audit_refuses_wrong_types_and_short_writes(spark, catalog):
    with pytest.raises(AuditFailed, match="types"):
        catalog.deploy("shop", make_products(spark, 2).withColumn("Price", F.lit("dear")))
    wrong = make_products(spark, 2).withColumn("RetailContext", F.struct(F.lit("1").alias("ChannelId")))
    with pytest.raises(AuditFailed, match="types"):
        catalog.deploy("shop", wrong)
    assert rg.mistyped(wrong.schema, PRODUCT) == ["RetailContext.ChannelId"]
    report = rg.audit(make_products(spark, 2), written=3)
    assert [r["check"] for r in report.filter("not passed").collect()] == ["written"]


def test_a_broken_registry_entry_is_not_passed_over(spark, catalog, root):
    catalog.deploy("shop", make_products(spark, 1), rg.AUTO_SWAP)
    fs, path = catalog.files._fs(f"{root}/shop/registry/{9:020d}.json")
    out = fs.create(path, False)
    out.write(bytearray(b'{"seq": 9, "alias": "sh'))
    out.close()
    with pytest.raises(Exception):
        catalog.status("shop")


def test_a_wrongly_typed_update_is_refused(spark, catalog):
    catalog.deploy("shop", make_products(spark, 2), rg.AUTO_SWAP)
    with pytest.raises(ValueError, match=r"\[Price\]"):
        catalog.update("shop", "test-1", '{"Price": "dear"}')
    assert catalog.get("shop", "test-1")["Price"] == 55.0


def test_an_undeclared_column_is_kept(spark, catalog):
    catalog.deploy("shop", make_products(spark, 1).withColumn("_extra", F.lit(None).cast("variant")), rg.AUTO_SWAP)
    catalog.index_one("shop", make_products(spark, 1, "new").withColumn("Shade", F.lit("teal")))
    got = {r[0]: r[1] for r in catalog.table("shop").select("id", F.try_variant_get("_extra", "$.Shade", "string")).collect()}
    assert got == {"test-1": None, "new-1": "teal"}


def test_one_id_is_read_by_a_pushed_filter(spark, catalog):
    catalog.deploy("shop", make_products(spark, 50), rg.AUTO_SWAP)
    plan = catalog.table("shop").filter(F.col("id") == "test-7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,test-7)" in plan
    assert catalog.get("shop", "test-7")["RecordId"] == 7


def test_changes_keep_the_text_index(spark, catalog, root):
    catalog.deploy("shop", make_products(spark, 3), rg.AUTO_SWAP, text_fields=["SearchName"])
    catalog.update("shop", "test-1", '{"SearchName": "violet lamp"}')
    active = catalog.resolve("shop")
    assert catalog.files.exists(f"{catalog.files.version_path('shop', active)}/text/occurrences")
    assert [r["id"] for r in catalog.search_text("shop", "violet", ["SearchName"]).hits.collect()] == ["test-1"]


def test_facet_names_stay_text(spark, tmp_path):
    leaf = F.struct(F.lit("K").alias("KeyName"), F.lit("T").alias("Translation"), F.lit("F").alias("FriendlyName"))
    rows = make_products(spark, 3).withColumn("DefaultProductProperties", F.create_map(F.lit("007"), leaf))
    st.write_facets(rows, f"file://{tmp_path}/facets")
    stored = st.read_facets(spark, f"file://{tmp_path}/facets", ["007"])
    assert {r["facet"] for r in stored.collect()} == {"007"}
