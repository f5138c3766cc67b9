"""Keyed changes kept beside a table and merged with it when it is read.

A change is a row ``(id, _seq, _n, _op, _row, _patch)``: a whole document (``upsert``), a
partial one (``patch``) or the end of one (``delete``). ``_seq`` orders the batches of
changes and ``_n`` the rows inside a batch. Merging moves the changes, not the table: the
table is anti-joined with the keys that were replaced, and joined with condensed patches.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import writes as wr
from shelfmark.schema import nullable

UPSERT, PATCH, DELETE = "upsert", "patch", "delete"
OPS = (UPSERT, PATCH, DELETE)


def change_schema(rows: T.StructType, key: str = "id") -> T.StructType:
    """The schema of changes to a table of such rows."""
    return T.StructType(
        [
            T.StructField(key, rows[key].dataType),
            T.StructField("_seq", T.LongType()),
            T.StructField("_n", T.LongType()),
            T.StructField("_op", T.StringType()),
            T.StructField("_row", nullable(rows)),
            T.StructField("_patch", T.VariantType()),
        ]
    )


def change_rows(
    table: DataFrame,
    seq: int,
    upserts: DataFrame | None = None,
    patches: DataFrame | None = None,
    deletes: DataFrame | None = None,
    key: str = "id",
    body: str = "patch",
    order: str | None = None,
) -> DataFrame:
    """One batch of changes to ``table``: deletes come first, then whole documents, then partial ones.

    ``upserts`` may have fields that the table lacks, which go to its ``_extra``; a key
    counts once in them. ``order`` is a whole-number column of the patches.
    """
    schema = change_schema(table.schema, key)
    none = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields}
    parts = []

    def rows(df: DataFrame, op: str, **given):
        made = none | {"_seq": F.lit(seq).cast("bigint"), "_n": F.lit(OPS_ORDER[op]).cast("bigint"), "_op": F.lit(op), key: F.col(key)} | given
        parts.append(df.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]))

    if deletes is not None:
        rows(deletes.select(key).distinct(), DELETE)
    if upserts is not None:
        # the rows of an upsert into nothing have the shape of the table
        whole = wr.upsert(table.limit(0), upserts.withColumn("_one", F.lit(0)), ["_one"], key).select(*table.columns)
        rows(whole, UPSERT, _row=F.struct(*[F.col(f"`{c}`") for c in table.columns]))
    if patches is not None:
        at = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
        rows(patches, PATCH, _n=at + OPS_ORDER[PATCH], _patch=F.col(body))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Places of the kinds of change inside a batch; patches count on from theirs.
OPS_ORDER = {DELETE: -2, UPSERT: -1, PATCH: 0}


def merge_changes(base: DataFrame, changes: DataFrame, key: str = "id", ops: Collection[str] = OPS) -> DataFrame:
    """``base`` after all ``changes``; ``ops`` says which kinds there can be."""
    at = F.struct("_seq", "_n")
    out, last = base, None
    if UPSERT in ops or DELETE in ops:
        whole = changes.filter(F.col("_op") != PATCH)
        last = whole.groupBy(key).agg(F.max_by(F.struct("_op", "_row"), at).alias("_last"), F.max(at).alias("_at"))
        kept = base.join(last.select(key), key, "left_anti")
        fresh = last.filter(F.col("_last._op") == UPSERT).select("_last._row.*")
        out = kept.unionByName(fresh) if UPSERT in ops else kept
    if PATCH in ops:
        patches = changes.filter(F.col("_op") == PATCH).select(key, "_seq", "_n", F.col("_patch").alias("patch"))
        if last is not None:
            # a whole document, or its end, undoes the partial ones before it
            since = patches.join(last.select(key, "_at"), key, "left")
            patches = since.filter(F.col("_at").isNull() | (at > F.col("_at"))).drop("_at")
        out = wr.patch(out, patches, ["_seq", "_n"], key)
    return out
