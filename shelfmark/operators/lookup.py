"""Lookup of many keys at once, and resolution of version names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import scalar as sc


def lookup(catalog: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """For each key the product with that id, else the first with that record number.

    The choice is made on ids and record numbers alone: both joins run on their own key,
    and the better match is kept by an aggregation, so a record number shared by many
    products is combined before it is shuffled. Whole products are fetched once, for the
    chosen ids. Ids are unique, as in a published version. A key without a match has a
    null ``product``.
    """
    wanted = keys.select(F.col(key)).distinct()
    numbered = wanted.select(key, sc.numeric_key(F.col(key)).alias("_number")).filter("_number is not null")
    known = catalog.select(F.col("id").alias("_id"), F.col("RecordId").alias("_record"))
    by_id = known.join(wanted, known["_id"] == wanted[key]).select(key, F.lit(0).alias("_pass"), "_id")
    by_number = known.join(numbered, known["_record"] == numbered["_number"]).select(key, F.lit(1).alias("_pass"), "_id")
    best = by_id.unionByName(by_number).groupBy(key).agg(F.min(F.struct("_pass", "_id")).alias("_best"))
    chosen = wanted.join(best, key, "left").select(key, F.col("_best._id").alias("_id"))
    product = F.struct(*[F.col(f"`{c}`") for c in catalog.columns])
    rows = catalog.select(F.col("id").alias("_found"), product.alias("product"))
    return chosen.join(rows, chosen["_id"] == rows["_found"], "left").select(key, "product")


def newest_version(names: DataFrame, alias: str = "alias", name: str = "name") -> DataFrame:
    """Per alias the name with the latest 17-digit suffix, else the first name."""
    stamp = sc.version_timestamp(F.col(name), F.col(alias))
    return names.groupBy(alias).agg(
        F.coalesce(
            F.max_by(name, F.when(stamp.isNotNull(), F.struct(stamp, name))), F.min(name)
        ).alias("name")
    )


def last_by_name(names: DataFrame, alias: str = "alias", name: str = "name") -> DataFrame:
    """Per alias the name that sorts last."""
    return names.groupBy(alias).agg(F.max(name).alias("name"))
