"""Keyed writes as pure functions: old rows and changes in, new rows out.

The result is stored as a new version. The large side is the old one, so every
operator joins it with a compact table of changes: the optimizer may broadcast
that table when it measures it small, and the old rows then never move.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import scalar as sc
from shelfmark.operators.open_objects import ENTRIES, ends_of, merge_open
from shelfmark.runtime import computed_once, cut_lineage
from shelfmark.schema import EXTRA, PRODUCT, nullable
from shelfmark.sources.products import NAMES, faults

Enrich = Callable[[DataFrame], DataFrame]


def append(df: DataFrame, path: str) -> None:
    """Append rows to a table; the commit takes all of them or none."""
    df.write.mode("append").parquet(path)


def latest(
    changes: DataFrame, order_by: Sequence[str], key: str = "id", columns: Sequence[str] | None = None
) -> DataFrame:
    """The last row of each key, with the given columns or all.

    An aggregation, not a window: copies of a key combine in every task before
    the shuffle, so a key with very many copies reaches its task as a few rows.
    """
    row = F.struct(*[F.col(c) for c in (columns or changes.columns)])
    last = changes.groupBy(key).agg(F.max_by(row, F.struct(*order_by)).alias("_row"))
    return last.select("_row.*")


def upsert(
    base: DataFrame, changes: DataFrame, order_by: Sequence[str], key: str = "id"
) -> DataFrame:
    """``base`` with the last change of each key in place of the old row.

    Columns that changes lack are null in their rows. Columns that ``base`` lacks go to
    its ``_extra``, or where it has none they are added.
    """
    replaced = base.join(changes.select(key).distinct(), key, "left_anti")
    named = [c for c in changes.columns if c in base.columns]
    other = [c for c in changes.columns if c not in base.columns and c not in order_by]
    kept = latest(changes, order_by, key, named + other)
    if other and EXTRA in base.columns:
        own = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in other]))
        fields = F.map_filter(F.try_variant_get(own, "$", "map<string,variant>"), lambda _, v: ~F.is_variant_null(v))
        if EXTRA in named:
            had = F.coalesce(F.try_variant_get(EXTRA, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
            fields = F.map_concat(F.map_filter(had, lambda k, _: ~k.isin(other)), fields)
        kept = kept.withColumn(EXTRA, F.when(F.size(fields) > 0, F.to_variant_object(fields))).drop(*other)
    return replaced.unionByName(kept, allowMissingColumns=True)


def write_results(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """What a keyed write does to each key: ``created`` or ``updated``."""
    known = base.select(F.col(key), F.lit(True).alias("_known"))
    result = F.when(F.col("_known"), F.lit("updated")).otherwise(F.lit("created"))
    return (
        changes.select(key).distinct().join(known, key, "left").select(key, result.alias("result"))
    )


def delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``base`` without the listed ids."""
    return base.join(ids.select(key).distinct(), key, "left_anti")


def delete_unknown(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Listed ids that ``base`` does not hold."""
    return ids.select(key).distinct().join(base.select(key), key, "left_anti")


def load_enriched(products: DataFrame, enrich: Enrich | None = None) -> DataFrame:
    if products is None:
        raise ValueError("Products array is required")
    return products.transform(enrich) if enrich else products


def load_filtered(
    products: DataFrame, keep: Callable[[DataFrame], Column]
) -> tuple[DataFrame, Observation]:
    """Rows to load, and an observation whose ``loaded`` is their number once written."""
    if keep is None:
        raise ValueError("Filter predicate is required")
    seen = Observation("load_filtered")
    return products.filter(keep(products)).observe(seen, F.count(F.lit(1)).alias("loaded")), seen


def _patch_fault(schema: T.StructType, key: str, body: str) -> Column:
    """Why a patch cannot be applied: a blank id, no document, or a value of a wrong type at any depth."""
    doc = F.col(body)
    fields = [f for f in schema.fields if f.name not in (key, EXTRA)]
    whole = F.schema_of_variant(doc).startswith("OBJECT")
    return (
        F.when(sc.is_blank(F.col(key)), F.lit("Document ID must be specified"))
        .when(doc.isNull(), F.lit("Document is required"))
        .when(~whole, F.lit("a partial document has to be an object"))
        .otherwise(faults(f"`{body}`", fields))
    )


def patch_errors(
    patches: DataFrame, schema: T.StructType = PRODUCT, key: str = "id", body: str = "patch"
) -> DataFrame:
    """Patches that cannot be applied, each with its ``reason``; ``patch`` leaves their rows alone."""
    return computed_once(patches, "reason", _patch_fault(schema, key, body)).filter("reason is not null")


class _Node:
    """One field of the stored type, with the aggregates that condense all its patches.

    A leaf remembers the last patch that names it. A struct or a map also
    remembers the last patch that replaced it as a whole (an explicit null),
    because older patches below it no longer count.
    """

    def __init__(self, dtype: T.DataType, tag: str, path: str | None):
        self.dtype, self.tag, self.path = dtype, tag, path
        self.children: dict[str, _Node] = {}
        self.value: _Node | None = None
        self.entries_type: T.DataType | None = None
        self.skip: list[str] = []
        if isinstance(dtype, T.StructType):
            for i, f in enumerate(dtype.fields):
                below = f"{path}.{f.name}" if path else f"$.{f.name}"
                self.children[f.name] = _Node(f.dataType, f"{tag}_{i}", below)
        elif isinstance(dtype, T.MapType):
            self.value = _Node(dtype.valueType, "v", None)

    def raw(self, doc: Column) -> Column:
        return F.try_variant_get(doc, self.path or "$", "variant")

    def aggregates(self, doc: Column, order: Column, held: Column | None = None) -> list[Column]:
        """``held`` is a cheap test that is false where the document surely lacks the field."""
        raw = self.raw(doc)
        given = raw.isNotNull() if held is None else held & raw.isNotNull()
        if not self.children and self.value is None:
            typed = F.try_variant_get(doc, self.path or "$", self.dtype.simpleString())
            row = F.struct(order.alias("o"), typed.alias("v"))
            # an atomic value may take part in the order, which spares a second copy of it
            last = (
                F.max(F.when(given, row))
                if isinstance(self.dtype, T.AtomicType) and not isinstance(self.dtype, T.VariantType)
                else F.max_by(row, F.when(given, order))
            )
            return [last.alias(self.tag)]
        # a document is an object, or it would have been refused
        whole = F.lit(True) if self.path == "$" else F.schema_of_variant(raw).startswith("OBJECT")
        out = [
            F.max(F.when(given & whole, order)).alias(f"{self.tag}_open"),
            F.max(F.when(given & ~whole, order)).alias(f"{self.tag}_reset"),
        ]
        for child in self.children.values():
            out += child.aggregates(doc, order, held)
        return out

    def maps(self) -> list["_Node"]:
        own = [self] if self.value is not None else []
        return own + [m for c in self.children.values() for m in c.maps()]

    def merged(self, base: Column, patch: Callable[[str], Column], reset: Column | None) -> Column:
        """The value after all patches, from the old value and the condensed patches."""
        if not self.children and self.value is None:
            last = patch(self.tag)
            counts = last["o"].isNotNull()
            if reset is None:
                return F.when(counts, last["v"]).otherwise(base)
            counts = counts & (reset.isNull() | (last["o"] > reset))
            return F.when(counts, last["v"]).when(reset.isNull(), base)
        opened, own = patch(f"{self.tag}_open"), patch(f"{self.tag}_reset")
        reset = own if reset is None else F.greatest(own, reset)
        fresh = opened.isNotNull() & (reset.isNull() | (opened > reset))
        kept = reset.isNull() & base.isNotNull()
        if self.value is not None:
            old = F.when(kept, base).otherwise(F.create_map().cast(self.dtype))
            entries = F.coalesce(patch(f"{self.tag}_entries"), F.create_map().cast(self.entries_type))
            node = self.value

            def entry(_: Column, b: Column, p: Column) -> Column:
                return F.when(p.isNull(), b).otherwise(node.merged(b, lambda t: p[t], reset))

            both = F.map_zip_with(old, entries, entry)
            # an entry only older patches named is gone with the old map
            alive = F.map_filter(both, lambda k, _: _entry_lives(k, old, entries, reset))
            return F.when(fresh | kept, alive)
        fields = [
            c.merged(base[n], patch, reset).cast(c.dtype).alias(n) for n, c in self.children.items()
        ]
        return F.when(fresh | kept, F.struct(*fields))


def _entry_lives(k: Column, old: Column, entries: Column, reset: Column) -> Column:
    seen = F.element_at(entries, k)["_seen"]
    return F.map_contains_key(old, k) | reset.isNull() | (seen > reset)


def _opened(
    base: DataFrame, patches: DataFrame, schema: T.StructType, order: Column, key: str, body: str, ends: DataFrame | None
) -> DataFrame | None:
    """``_opened`` of each key: its undeclared entries and variant columns that patches open as objects, merged path by path.

    ``ends`` are those of the undeclared entries (see ``merge_open``).
    """
    variants = [f.name for f in schema.fields if isinstance(f.dataType, T.VariantType)]
    has_extra = EXTRA in base.columns
    if not variants and not has_extra:
        return None
    given = F.explode(F.try_variant_get(F.col(body), "$", ENTRIES)).alias("name", "value")
    given = patches.select(F.col(key).alias("key"), order.alias("order"), given)
    declared = [c for c in base.columns if c not in variants]
    given = given.filter(~F.col("name").isin(declared) if has_extra else F.col("name").isin(variants))
    own = [x for n in variants for x in (F.lit(n), F.col(f"`{n}`"))]
    held = F.create_map(*own).cast(ENTRIES)
    if has_extra:
        held = F.map_concat(held, F.coalesce(EXTRA, F.create_map().cast(ENTRIES)))
    held = base.select(F.col(key).alias("key"), F.map_filter(held, lambda _, v: v.isNotNull()).alias("entries"))
    merged = merge_open(held, given, None if variants else ends)
    if merged is None:
        return None
    entries = F.map_from_entries(F.collect_list(F.struct("name", "value")))
    return merged.groupBy(F.col("key").alias(key)).agg(entries.alias("_opened"))


def _with_opened(name: str, plain: Column, schema: T.StructType, opened: DataFrame | None) -> Column:
    """``plain``, with what was merged path by path in place of its plainly replaced entries."""
    if opened is None:
        return plain
    found = F.coalesce("_opened", F.create_map().cast(ENTRIES))
    if name == EXTRA:
        kept = F.map_filter(F.coalesce(plain, F.create_map().cast(ENTRIES)), lambda k, _: ~F.map_contains_key(found, k))
        return F.map_concat(kept, F.map_filter(found, lambda k, _: ~k.isin(schema.names)))
    if isinstance(schema[name].dataType, T.VariantType):
        return F.when(F.map_contains_key(found, F.lit(name)), F.element_at(found, F.lit(name))).otherwise(plain)
    return plain


def patch(
    base: DataFrame,
    patches: DataFrame,
    order_by: Sequence[str],
    key: str = "id",
    body: str = "patch",
) -> DataFrame:
    """Apply partial documents, in order, and insert those whose id is new.

    A patch with a value of a wrong type is left out as a whole (see ``patch_errors``).
    ``body`` is a variant: an absent field keeps the old value, an explicit null
    sets null, objects and map entries merge, arrays and scalars replace. Fields
    without a column go to ``_extra``, where the table has it; objects among them, and
    in columns of the type variant, merge at every depth. All
    patches of an id are condensed field by field in one aggregation, so many
    patches of one document combine before the shuffle.
    """
    columns = base.columns
    if EXTRA in columns:
        base = base.withColumn(EXTRA, F.try_variant_get(EXTRA, "$", "map<string,variant>"))
    schema = nullable(T.StructType([f for f in base.schema.fields if f.name != key]))
    root = _Node(schema, "f", None)
    if EXTRA in columns:
        # undeclared fields are entries of the document itself
        root.children[EXTRA].path, root.children[EXTRA].skip = "$", columns
    order = F.struct(*order_by)
    given = patches.select(*dict.fromkeys([key, *order_by, body]))
    usable = computed_once(given, "_fault", _patch_fault(schema, key, body)).filter("_fault is null").drop("_fault")
    doc = F.col(body)
    if root.maps() or any(isinstance(f.dataType, T.VariantType) for f in schema.fields):
        # fields, entries and open objects are condensed from the same judged patches
        usable = cut_lineage(usable)
    # the names that a patch holds, so that nothing is looked for below those it lacks
    named = computed_once(usable, "_names", F.map_keys(F.try_variant_get(doc, "$", NAMES)))
    aggs = []
    for n, c in root.children.items():
        held = None if n == EXTRA else F.array_contains("_names", F.lit(n))
        aggs += c.aggregates(doc, order, held)
    condensed = named.groupBy(key).agg(*aggs)
    ends = None
    for m in root.maps():
        entries = usable.select(
            key,
            order.alias("_o"),
            F.explode(F.try_variant_get(doc, m.path, "map<string,variant>")).alias("_k", "_e"),
        ).filter(~F.col("_k").isin(m.skip))
        per_key = entries.groupBy(key, "_k")
        states = [F.max("_o").alias("_seen"), *m.value.aggregates(F.col("_e"), F.col("_o"))]
        if m.path == "$":
            # undeclared entries: the same condensed rows say which were opened as objects
            per_key = cut_lineage(per_key.agg(*states, *ends_of(F.col("_e"), F.col("_o"))))
            ends = per_key.select(F.col(key).alias("key"), F.col("_k").alias("name"), "_opened", "_set")
            per_key = per_key.drop("_opened", "_set")
        else:
            per_key = per_key.agg(*states)
        states = [c for c in per_key.columns if c not in (key, "_k")]
        whole = per_key.groupBy(key).agg(
            F.map_from_entries(
                F.collect_list(F.struct("_k", F.struct(*states).alias("_s")))
            ).alias(f"{m.tag}_entries")
        )
        m.entries_type = whole.schema[f"{m.tag}_entries"].dataType
        condensed = condensed.join(whole, key, "left")
    opened = _opened(base, usable, schema, order, key, body, ends)
    if opened is not None:
        condensed = condensed.join(opened, key, "left")
    # both the rows it changes and the new ones start from it
    state = cut_lineage(condensed.withColumnRenamed(key, "_key"))
    fields = [
        _with_opened(n, c.merged(F.col(f"`{n}`"), F.col, None), schema, opened).cast(c.dtype).alias(n, metadata=schema[n].metadata)
        for n, c in root.children.items()
    ]
    changed = base.join(state, base[key] == state["_key"], "left")
    touched = F.col("_key").isNotNull()
    merged = [
        F.when(touched, f).otherwise(F.col(f"`{n}`")).alias(n, metadata=schema[n].metadata)
        for n, f in zip(root.children, fields)
    ]
    updated = changed.select(F.col(key), *merged)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    fresh = (
        state.join(base.select(key), F.col("_key") == base[key], "left_anti")
        .select("*", *empty)
        .select(F.col("_key").alias(key), *fields)
    )
    merged_rows = updated.select(*columns).unionByName(fresh.select(*columns))
    if EXTRA in columns:
        extra = F.when(F.size(EXTRA) > 0, F.to_variant_object(EXTRA))
        merged_rows = merged_rows.withColumn(EXTRA, extra)
    return merged_rows
