"""Synthetic catalogs: seeded, so that the same numbers give the same products on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import scalar as sc
from shelfmark.operators.ingest import FIRST_RECORD_ID, allocate_ids

# Categories of the simple generator.
CATEGORIES = ["Electronics", "Clothing", "Books", "Home & Garden", "Sports"]

# Variations of the template generator.
COLORS = [
    "Red", "Blue", "Green", "Yellow", "Black", "White", "Gray", "Pink", "Purple", "Orange",
    "Brown", "Navy", "Maroon", "Teal", "Beige",
]
MATERIALS = [
    "Cotton", "Leather", "Wool", "Silk", "Denim", "Polyester", "Linen", "Cashmere", "Suede",
    "Canvas", "Nylon", "Spandex",
]
SIZES = ["XS", "S", "M", "L", "XL", "XXL", "6", "7", "8", "9", "10", "11", "12"]
STYLES = [
    "Classic", "Modern", "Vintage", "Contemporary", "Traditional", "Minimalist", "Elegant",
    "Casual", "Formal", "Sporty",
]
BRANDS = [
    "Premium", "Elite", "Signature", "Classic", "Modern", "Vintage", "Designer", "Luxury",
    "Contemporary", "Traditional",
]
PRODUCT_TYPES = {
    "bags": [
        "Handbag", "Shoulder Bag", "Crossbody Bag", "Tote Bag", "Clutch", "Backpack", "Satchel",
        "Wallet",
    ],
    "clothing": [
        "Shirt", "Sweater", "Jacket", "Coat", "Dress", "Pants", "Skirt", "Blouse", "Cardigan",
    ],
    "shoes": [
        "Sneakers", "Boots", "Sandals", "Loafers", "Heels", "Flats", "Athletic Shoes",
        "Dress Shoes",
    ],
    "jewelry": ["Necklace", "Bracelet", "Ring", "Earrings", "Pendant", "Watch", "Cufflinks"],
    "accessories": ["Scarf", "Gloves", "Hat", "Belt", "Sunglasses", "Tie", "Bow Tie"],
}

# How many colours and materials the batch generator uses.
BATCH_COLORS, BATCH_MATERIALS = 10, 8

# Fixed value: a date that stands for "no date" and is left as it is.
NO_DATE = "1900-01-01T00:00:00+00:00"

# Generated dates count back from here, so that a run does not depend on the clock.
ANCHOR = "2024-01-01 00:00:00"


def sequence(spark: SparkSession, count: int, start: int = 1) -> DataFrame:
    return spark.range(start, start + count).withColumnRenamed("id", "i")


def variations(spark: SparkSession) -> DataFrame:
    """The variation lists as rows (attribute, position, value)."""
    lists = {"colors": COLORS, "materials": MATERIALS, "sizes": SIZES, "styles": STYLES, "brands": BRANDS}
    lists.update({f"product_types.{k}": v for k, v in PRODUCT_TYPES.items()})
    rows = [(name, i, v) for name, vs in lists.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "attribute string, position int, value string")


def _draw(seed: str, i: Column, block: int) -> Column:
    return F.concat_ws(":", F.lit(seed), i.cast("string"), F.lit(str(block)))


def simple_products(rows: DataFrame, index: str = "i", seed: str = "simple") -> DataFrame:
    """One product per row of ``rows``; twelve draws from three digests."""
    i = F.col(index)
    d0, d1, d2 = (_draw(seed, i, b) for b in range(3))

    def measure(key: Column, slot: int, span: float, low: float, digits: int) -> Column:
        return sc.round_half_up(sc.hash_unit(key, slot) * span + low, digits)

    text = i.cast("string")
    anchor = F.lit(ANCHOR).cast("timestamp")
    age = F.floor(sc.hash_unit(d2, 2) * (365 * 86400))
    return rows.select(
        F.concat(F.lit("prod_"), F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)).alias("id"),
        i.alias("RecordId"),
        F.concat(F.lit("Test Product "), text).alias("name"),
        measure(d0, 0, 1000.0, 10.0, 2).alias("price"),
        F.concat(F.lit("This is a test product #"), text, F.lit(" for batch processing validation")).alias(
            "description"
        ),
        sc.pick(CATEGORIES, i % 5).alias("category"),
        (sc.hash_unit(d0, 1) > 0.1).alias("inStock"),
        measure(d0, 2, 10.0, 0.1, 2).alias("weight"),
        F.struct(
            measure(d0, 3, 100.0, 1.0, 1).alias("length"),
            measure(d1, 0, 100.0, 1.0, 1).alias("width"),
            measure(d1, 1, 100.0, 1.0, 1).alias("height"),
        ).alias("dimensions"),
        F.array(
            F.concat(F.lit("tag_"), (i % 10).cast("string")),
            F.concat(F.lit("category_"), (i % 5).cast("string")),
            F.concat(F.lit("type_"), (i % 3).cast("string")),
        ).alias("tags"),
        F.struct(
            (sc.hash_unit(d1, 2) > 0.05).alias("isActiveInSalesProcess"),
            (sc.hash_unit(d1, 3) > 0.8).alias("canPriceBeZero"),
            (sc.hash_unit(d2, 0) > 0.7).alias("mustScaleItem"),
            (sc.hash_unit(d2, 1) > 0.9).alias("isSerialized"),
        ).alias("rules"),
        F.struct(
            F.timestamp_seconds(F.unix_seconds(anchor) - age).alias("createdAt"),
            anchor.alias("updatedAt"),
            (sc.hash_pick(d2, 3, 5) + 1).alias("version"),
        ).alias("metadata"),
    )


def template_products(
    rows: DataFrame,
    templates: DataFrame,
    index: str = "i",
    seed: str = "template",
    brief: bool = False,
) -> DataFrame:
    """Products made from templates with a colour, a material, prices and a date each.

    ``templates`` carries ``template_no`` 0..n-1 beside the template's columns; row
    ``i`` takes the template its digest picks. Record numbers pass over those the
    templates hold. ``brief`` is the batch form: fewer variations, a short search
    name, no date and no description.
    """
    i = F.col(index)
    d0, d1 = _draw(seed, i, 0), _draw(seed, i, 1)
    colors = COLORS[:BATCH_COLORS] if brief else COLORS
    materials = MATERIALS[:BATCH_MATERIALS] if brief else MATERIALS
    have = {f.name: f.dataType for f in templates.schema.fields}
    count = templates.agg(F.count(F.lit(1))).scalar()
    chosen = rows.select(index).withColumn("_no", sc.hash_pick(d0, 0, count))
    if "RecordId" in have and not brief:
        chosen = allocate_ids(chosen, index, templates, "RecordId")
    else:
        chosen = chosen.withColumn("RecordId", F.lit(FIRST_RECORD_ID) + i)
    body = templates.drop("RecordId", "ItemId", "ProductNumber", "BasePrice", "Price", "AdjustedPrice")
    joined = chosen.join(body, chosen["_no"] == body["template_no"])

    color, material = sc.pick(colors, sc.hash_pick(d0, 1, len(colors))), sc.pick(
        materials, sc.hash_pick(d0, 2, len(materials))
    )
    base = sc.hash_unit(d0, 3) * 490.0 + 10.0
    price = sc.round_half_up(base * (sc.hash_unit(d1, 0) * 0.4 + 0.9), 2)
    day = F.date_sub(F.lit(ANCHOR).cast("date"), (sc.hash_pick(d1, 2, 365) + 1).cast("int"))
    stamp = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00+00:00"))
    item = F.lpad((90000 + i % 10000).cast("string"), 5, "0")
    out: dict[str, Column] = {
        index: i,
        "RecordId": F.col("RecordId"),
        "ItemId": item,
        "ProductNumber": item,
        "BasePrice": sc.round_half_up(base, 2),
        "Price": price,
        "AdjustedPrice": sc.round_half_up(price * (sc.hash_unit(d1, 1) * 0.1 + 0.95), 2),
    }
    if "ProductName" in have:
        name = F.concat_ws(" ", color, material, "ProductName")
        out["ProductName"] = name
        out["SearchName"] = F.substring(F.concat_ws(" ", color, material) if brief else name, 1, 20)
    if "Rules" in have:
        out["Rules"] = F.col("Rules").withField("ProductId", F.col("RecordId"))
    if not brief:
        if "Description" in have:
            out["Description"] = F.concat_ws(
                " ", F.lit("Premium"), F.lower(color), F.lower(material), F.lower("Description")
            )
        if "ChangeTrackingInformation" in have:
            out["ChangeTrackingInformation"] = F.col("ChangeTrackingInformation").withField(
                "ModifiedDateTime", stamp
            )
        if isinstance(have.get("DefaultProductProperties"), T.MapType):
            out["DefaultProductProperties"] = F.transform_values(
                "DefaultProductProperties", lambda _, v: _redated(v, stamp)
            )
    rest = {c: F.col(c) for c in body.columns if c not in out and c != "template_no"}
    return joined.select(*[c.alias(n) for n, c in {**out, **rest}.items()])


def _redated(entry: Column, stamp: Column) -> Column:
    old = entry["DateTimeOffsetValue"]
    return F.when(
        (F.coalesce(old, F.lit("")) != "") & (old != NO_DATE), entry.withField("DateTimeOffsetValue", stamp)
    ).otherwise(entry)
