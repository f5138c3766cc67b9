"""Merging of undeclared objects, path by path and at every depth.

A document without a declared shape is a set of events ``(key, path, order, value)``: each
says that at a moment the path held a value, or was open as an object. Partial documents
applied in order leave the events that nothing later undid:

- a value replaces what its path held before, and all that lay below it;
- an object leaves what lies below its path, but ends a value that stood in its place.

So the last value and the last opening of each path are partial aggregates, and what an
ancestor undid is found by a join of a path's prefixes with the values: neither gathers the
changes of a document, however many there are. Only building the final object brings the
entries of one object together, as the object itself does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import cut_lineage

ENTRIES = "map<string,variant>"


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def events(rows: DataFrame, key: str, path: str, order: str, value: str) -> tuple[DataFrame, int]:
    """Every value and every opening below the given values, and the length of the longest path.

    One step per depth that the documents have; each step sees only the objects of the one
    before.
    """

    def written(level: DataFrame) -> DataFrame:
        # what is an object is found once and written with its row
        return cut_lineage(level.select("key", "path", "order", "value", is_object(F.col("value")).alias("open")))

    level = written(rows.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(order).alias("order"), F.col(value).alias("value")))
    found, depth = [], 1
    while True:
        found.append(level.select("key", "path", "order", F.when(~F.col("open"), F.col("value")).alias("value"), "open"))
        inner = level.filter("open").select(
            "key", "path", "order", F.explode(F.try_variant_get("value", "$", ENTRIES)).alias("name", "inner")
        )
        inner = written(inner.select("key", F.array_append("path", F.col("name")).alias("path"), "order", F.col("inner").alias("value")))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found), depth
        level, depth = inner, depth + 1


def surviving(found: DataFrame) -> DataFrame:
    """``key, path, value, open`` of the paths that hold something after all events."""
    last = found.groupBy("key", "path").agg(
        F.max_by(F.struct("value"), F.when(~F.col("open"), F.col("order"))).alias("kept"),
        F.max(F.when(~F.col("open"), F.col("order"))).alias("set"),
        F.max(F.when(F.col("open"), F.col("order"))).alias("opened"),
    )
    last = cut_lineage(last)
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    prefixes = last.filter(F.size("path") > 1).select("key", "path", F.explode(above).alias("_above"))
    values = last.filter("set is not null").select(F.col("key").alias("_key"), F.col("path").alias("_path"), F.col("set").alias("_set"))
    # null keys are no keys: changes name theirs
    undone = prefixes.join(values, (F.col("key") == F.col("_key")) & (F.col("_above") == F.col("_path")))
    undone = undone.groupBy("key", "path").agg(F.max("_set").alias("undone"))
    both = last.join(undone, ["key", "path"], "left")
    since = F.greatest("undone", "set")  # nulls are passed over
    is_open = F.col("opened").isNotNull() & (since.isNull() | (F.col("opened") > since))
    is_set = (
        F.col("set").isNotNull()
        & (F.col("undone").isNull() | (F.col("set") > F.col("undone")))
        & (F.col("opened").isNull() | (F.col("set") > F.col("opened")))
    )
    return both.filter(is_open | is_set).select("key", "path", F.when(is_set, F.col("kept.value")).alias("value"), is_open.alias("open"))


def rebuilt(paths: DataFrame, depth: int) -> DataFrame:
    """``key, name, value``: the entries of each document, built from the deepest object up."""
    below = None
    for level in range(depth, 0, -1):
        own = paths.filter(F.size("path") == level)
        if below is None:
            whole = own.select("key", "path", F.when(F.col("open"), F.to_variant_object(F.create_map().cast(ENTRIES))).otherwise(F.col("value")).alias("value"))
        else:
            joined = own.join(below, ["key", "path"], "left")
            entries = F.coalesce("entries", F.create_map().cast(ENTRIES))
            whole = joined.select("key", "path", F.when(F.col("open"), F.to_variant_object(entries)).otherwise(F.col("value")).alias("value"))
        if level == 1:
            return whole.select("key", F.col("path")[0].alias("name"), "value")
        entry = F.struct(F.element_at("path", -1).alias("name"), "value")
        below = whole.groupBy("key", F.slice("path", F.lit(1), F.lit(level - 1)).alias("path")).agg(
            F.map_from_entries(F.collect_list(entry)).alias("entries")
        )
    raise ValueError("no depth")


def ends_of(value: Column, order: Column) -> list[Column]:
    """Of the changes of an entry, the last that opened it as an object and the last that set it to a value."""
    return [F.max(F.when(is_object(value), order)).alias("_opened"), F.max(F.when(~is_object(value), order)).alias("_set")]


def merge_open(base: DataFrame, patches: DataFrame, ends: DataFrame | None = None) -> DataFrame | None:
    """Entries of documents after partial documents that open objects in them, or nothing if none does.

    ``base`` has ``key, entries`` (a map of variants) and ``patches`` ``key, name, order,
    value``, and are read again: write down what is costly to make. ``ends`` has ``key,
    name`` and ``ends_of`` all patches, where the caller has condensed them already.
    Returns ``key, name, value`` of exactly those entries that some patch opens; other
    entries follow the plain rule of the last value.
    """
    if ends is None:
        ends = patches.groupBy("key", "name").agg(*ends_of(F.col("value"), F.col("order")))
    # of an entry count what its last value leaves: that value, and the objects sent since
    opening = cut_lineage(ends.filter("_opened is not null").select("key", "name", "_set"))
    if opening.isEmpty():
        return None
    first = F.lit(None).cast(patches.schema["order"].dataType)
    mine = patches.join(opening, ["key", "name"]).filter(F.col("_set").isNull() | (F.col("order") >= F.col("_set")))
    held = opening.filter("_set is null").select("key", "name")
    old = base.join(held.select("key").distinct(), "key").select("key", F.explode("entries").alias("name", "value"))
    old = old.join(held, ["key", "name"], "left_semi").select("key", "name", F.lit(0).alias("later"), first.alias("order"), "value")
    rows = old.unionByName(mine.select("key", "name", F.lit(1).alias("later"), "order", "value"))
    rows = rows.select("key", F.array("name").alias("path"), F.struct("later", "order").alias("at"), "value")
    found, depth = events(rows, "key", "path", "at", "value")
    return rebuilt(surviving(found), depth)
