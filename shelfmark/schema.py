"""Product schema, field kinds and path resolution.

A field kind says how a field behaves in a search. It is kept as metadata on
the Spark field, so that a schema read back from a table still carries it.
Fields without a kind get the one that dynamic inference would give them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "text"
KEYWORD = "keyword"
TEXT_KEYWORD = "text+keyword"
DISABLED = "disabled"
DATE = "date"
INTEGER = "integer"
LONG = "long"
FLOAT = "float"
DOUBLE = "double"
BOOLEAN = "boolean"
OBJECT = "object"
UNMAPPED = "unmapped"

# Column that keeps the undeclared fields of a document, as one variant object.
EXTRA = "_extra"

NUMERIC = (INTEGER, LONG, FLOAT, DOUBLE)
IGNORE_ABOVE = 256

_NUMBER_TYPES = {
    INTEGER: T.IntegerType(),
    LONG: T.LongType(),
    FLOAT: T.FloatType(),
    DOUBLE: T.DoubleType(),
}


def field(name: str, dtype: T.DataType, kind: str, **extra: int | str) -> T.StructField:
    return T.StructField(name, dtype, True, {"kind": kind, **extra})


def text(name: str) -> T.StructField:
    return field(name, T.StringType(), TEXT)


def keyword(
    name: str, dtype: T.DataType | None = None, ignore_above: int = IGNORE_ABOVE
) -> T.StructField:
    return field(name, dtype or T.StringType(), KEYWORD, ignore_above=ignore_above)


def text_keyword(name: str) -> T.StructField:
    return field(name, T.StringType(), TEXT_KEYWORD, ignore_above=IGNORE_ABOVE)


def disabled(name: str, dtype: T.DataType) -> T.StructField:
    return field(name, dtype, DISABLED)


def date(name: str, format: str | None = None) -> T.StructField:
    return field(name, T.TimestampType(), DATE, **({"format": format} if format else {}))


def number(name: str, kind: str) -> T.StructField:
    if kind not in _NUMBER_TYPES:
        raise ValueError(f"Unsupported number type: {kind}")
    return field(name, _NUMBER_TYPES[kind], kind)


def boolean(name: str) -> T.StructField:
    return field(name, T.BooleanType(), BOOLEAN)


def plain(name: str, dtype: T.DataType) -> T.StructField:
    return T.StructField(name, dtype, True)


_S, _L, _I, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([plain(n, t) for n, t in fields.items()])


EXTENSION = _struct(name=_S, value=T.VariantType(), type=_S)

# One entry of the property map, 23 fields.
PROPERTY = T.StructType(
    [
        number("PropertyTypeValue", LONG),
        keyword("KeyName"),
        text_keyword("FriendlyName"),
        number("RecordId", LONG),
        boolean("IsDimensionProperty"),
        number("AttributeValueId", LONG),
        keyword("SwatchImageUrl"),
        keyword("SwatchColorHexCode"),
        text("ValueString"),
        text("UnitText"),
        number("GroupId", LONG),
        number("GroupTypeValue", INTEGER),
        text("GroupName"),
        keyword("Language"),
        keyword("Translation"),
        disabled("ExtensionProperties", T.ArrayType(EXTENSION)),
        boolean("IsReference"),
        number("ProductId", LONG),
        number("CategoryId", LONG),
        number("CatalogId", LONG),
        number("Distance", INTEGER),
        number("Source", INTEGER),
        date("DateTimeOffsetValue"),
    ]
)

RULES = _struct(
    ProductId=_L,
    HasLinkedProducts=_B,
    IsBlocked=_B,
    DateOfBlocking=_TS,
    DateToActivate=_TS,
    DateToBlock=_TS,
    PriceKeyingRequirementValue=_I,
    QuantityKeyingRequirementValue=_I,
    MustKeyInComment=_B,
    CanQuantityBecomeNegative=_B,
    MustScaleItem=_B,
    CanPriceBeZero=_B,
    IsSerialized=_B,
    IsActiveInSalesProcess=_B,
    DefaultUnitOfMeasure=_S,
    ExtensionProperties=T.ArrayType(EXTENSION),
)

RELATED = _struct(id=_S, relationshipType=_S, quantity=_L)
IMAGE = _struct(Url=_S, AltText=_S, IsSelfHosted=_B, IsDefault=_B, Priority=_I)

PRODUCT = T.StructType(
    [
        keyword("id"),
        number("RecordId", LONG),
        keyword("ItemId"),
        keyword("ProductNumber"),
        keyword("Locale"),
        keyword("DefaultUnitOfMeasure"),
        disabled("Name", _S),
        disabled("OfflineImage", _S),
        text_keyword("SearchName"),
        number("BasePrice", DOUBLE),
        number("Price", DOUBLE),
        keyword("CategoryIds", T.ArrayType(_L)),
        disabled(
            "DisplayOrderInCategories", T.ArrayType(_struct(CategoryId=_L, DisplayOrder=_I))
        ),
        disabled("Images", _struct(Items=T.ArrayType(IMAGE))),
        plain("RetailContext", T.StructType([number("ChannelId", LONG), number("CatalogId", LONG)])),
        disabled("Rules", RULES),
        boolean("HasLinkedProducts"),
        boolean("IsMasterProduct"),
        boolean("IsKit"),
        boolean("IsRemote"),
        disabled("ProductsRelatedToThis", T.ArrayType(RELATED)),
        disabled("LinkedProducts", T.ArrayType(RELATED)),
        disabled(
            "ParentKits", T.ArrayType(_struct(id=_S, name=_S, components=T.ArrayType(RELATED)))
        ),
        disabled("ProductSchema", T.ArrayType(_S)),
        disabled(
            "ProductProperties",
            T.ArrayType(_struct(PropertyName=_S, LanguageId=_S, DisplayName=_S, Value=T.VariantType())),
        ),
        disabled("CompositionInformation", T.VariantType()),
        plain("DefaultProductProperties", T.MapType(_S, PROPERTY)),
        disabled(
            "ChangeTrackingInformation",
            _struct(ModifiedDateTime=_TS, ChangeActionValue=_I, RequestedActionValue=_I),
        ),
    ]
)


@dataclass(frozen=True)
class Path:
    """A resolved field path: its column, element type and search kind."""

    name: str
    kind: str
    column: Column | None = None
    dtype: T.DataType | None = None
    many: bool = False
    ignore_above: int | None = None

    @property
    def searchable(self) -> bool:
        return self.kind not in (DISABLED, UNMAPPED, OBJECT)


def inferred_kind(dtype: T.DataType) -> str:
    """The kind that dynamic inference gives a field of this type."""
    if isinstance(dtype, T.ArrayType):
        return inferred_kind(dtype.elementType)
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT_KEYWORD
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return INTEGER
    if isinstance(dtype, T.LongType):
        return LONG
    if isinstance(dtype, T.FloatType):
        return FLOAT
    if isinstance(dtype, (T.DoubleType, T.DecimalType)):
        return DOUBLE
    return OBJECT


def kind_of(f: T.StructField) -> str:
    return f.metadata.get("kind") or inferred_kind(f.dataType)


class CatalogSchema:
    """A StructType with field kinds; the one place that knows how paths resolve."""

    def __init__(self, struct: T.StructType):
        self.struct = struct

    @classmethod
    def of(cls, df: DataFrame, declared: T.StructType = PRODUCT) -> "CatalogSchema":
        """The schema of ``df``, with kinds restored from ``declared`` by column name."""
        known = {f.name: f for f in declared.fields}
        fields = []
        for f in df.schema.fields:
            d = known.get(f.name)
            if d is None or f.metadata.get("kind"):
                fields.append(f)
            else:
                fields.append(T.StructField(f.name, _with_kinds(f.dataType, d.dataType), True, d.metadata))
        return cls(T.StructType(fields))

    def resolve(self, path: str, honor_kinds: bool = True, like: Any = None) -> Path:
        """Resolve ``A.B``, ``Map.key.leaf`` or ``Array.leaf`` to a column.

        An undeclared field is looked up in ``_extra``, where it has the type of
        the value it is compared ``like``.
        """
        if path == EXTRA and self._declared(EXTRA):
            # undeclared fields are found by name; under this one, all their texts are
            return Path(EXTRA, TEXT, undeclared_texts(F.col(EXTRA)), T.StringType(), True, IGNORE_ABOVE)
        exact = False
        parts = path.split(".")
        if len(parts) > 1 and parts[-1] == "keyword" and self._declared(parts[0]):
            parent = self.resolve(".".join(parts[:-1]), honor_kinds)
            if parent.kind == TEXT_KEYWORD:
                exact, parts = True, parts[:-1]
        by_name = {f.name: f for f in self.struct.fields}
        if parts[0] not in by_name:
            if EXTRA not in by_name:
                return Path(path, UNMAPPED)
            if parts[-1] == "keyword" and len(parts) > 1:
                exact, parts = True, parts[:-1]
            return _undeclared(path, parts, KEYWORD if exact else _kind_like(like))
        f = by_name[parts[0]]
        col, dtype, meta, many = F.col(f"`{f.name}`"), f.dataType, f.metadata, False
        off = meta.get("kind") == DISABLED
        for i, part in enumerate(parts[1:], start=1):
            if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
                sub = _field(dtype.elementType, part)
                if sub is None:
                    return Path(path, DISABLED if off and honor_kinds else UNMAPPED)
                col = F.transform(col, _leaf(part))
                if isinstance(sub.dataType, T.ArrayType):
                    col, dtype = F.flatten(col), sub.dataType
                else:
                    dtype = T.ArrayType(sub.dataType)
                meta = sub.metadata
            elif isinstance(dtype, T.StructType):
                sub = _field(dtype, part)
                if sub is None:
                    return Path(path, DISABLED if off and honor_kinds else UNMAPPED)
                col, dtype, meta = col[part], sub.dataType, sub.metadata
            elif isinstance(dtype, T.MapType):
                value = dtype.valueType
                sub = _field(value, part) if isinstance(value, T.StructType) else None
                if sub is not None and i == len(parts) - 1:
                    # the list form of the map: any entry's leaf counts
                    col = F.transform(F.map_values(col), _leaf(part))
                    dtype, meta = T.ArrayType(sub.dataType), sub.metadata
                else:
                    col, dtype, meta = F.element_at(col, F.lit(part)), value, {}
            else:
                return Path(path, DISABLED if off and honor_kinds else UNMAPPED)
            off = off or meta.get("kind") == DISABLED
        kind = meta.get("kind") or inferred_kind(dtype)
        if isinstance(dtype, T.ArrayType):
            many, dtype = True, dtype.elementType
        if off:
            kind = DISABLED if honor_kinds else inferred_kind(dtype)
        if exact:
            kind = KEYWORD
        return Path(path, kind, col, dtype, many, meta.get("ignore_above", IGNORE_ABOVE))

    def _declared(self, name: str) -> bool:
        return any(f.name == name for f in self.struct.fields)

    def leaves(self) -> Iterable[tuple[str, T.DataType, str]]:
        """Every (path, type, kind); map values appear under ``*``."""
        yield from _walk("", self.struct, None)

    def text_fields(self) -> list[str]:
        """Paths a search without a field list covers: text and keyword kinds.

        A leaf of a map counts as one field with the values of all entries; so do all
        texts of undeclared fields.
        """
        declared = [
            path.replace(".*", "")
            for path, _, kind in self.leaves()
            if kind in (TEXT, KEYWORD, TEXT_KEYWORD)
        ]
        return declared + ([EXTRA] if self._declared(EXTRA) else [])


def _kind_like(value: Any) -> str:
    """The kind that dynamic inference would have given a field with such values."""
    if isinstance(value, Mapping):
        value = value.get("range", value)
        value = next(iter(value.values()), None) if isinstance(value, Mapping) else value
    if isinstance(value, (list, tuple, set)):
        value = next(iter(value), None)
    if isinstance(value, bool):
        return BOOLEAN
    return DOUBLE if isinstance(value, (int, float)) else TEXT_KEYWORD


def undeclared_texts(value: Column) -> Column:
    """All strings inside a variant, at every depth, as an array.

    They are read off its JSON text, whose strings are keys where a colon follows. The
    characters 1 and 2, which JSON text never holds, stand for escaped backslashes and
    quotes meanwhile, so that the quotes left are the ends of strings.
    """
    plain = F.replace(F.replace(F.to_json(value), F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    strings = F.filter(F.regexp_extract_all(plain, F.lit('("[^"]*+":?)'), F.lit(1)), lambda s: ~F.endswith(s, F.lit(":")))
    whole = F.transform(strings, lambda s: F.replace(F.replace(s, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\")))
    texts = F.transform(whole, lambda s: F.try_variant_get(F.try_parse_json(s), "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def _step(name: str) -> str:
    """A name as a step of a variant path, in the quotes that it does not hold itself."""
    quote = '"' if "'" in name else "'"
    return f"[{quote}{name}{quote}]"


def _undeclared(path: str, parts: list[str], kind: str) -> Path:
    steps = "".join(_step(p) for p in parts)
    dtype: T.DataType = T.StringType()
    if kind == BOOLEAN:
        dtype = T.BooleanType()
    elif kind == DOUBLE:
        dtype = T.DoubleType()
    column = F.try_variant_get(EXTRA, f"${steps}", dtype.simpleString())
    return Path(path, kind, column, dtype, False, IGNORE_ABOVE)


def _leaf(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def _field(struct: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in struct.fields if f.name == name), None)


def _with_kinds(actual: T.DataType, declared: T.DataType) -> T.DataType:
    if isinstance(actual, T.StructType) and isinstance(declared, T.StructType):
        known = {f.name: f for f in declared.fields}
        return T.StructType(
            [
                T.StructField(
                    f.name, _with_kinds(f.dataType, known[f.name].dataType), True, known[f.name].metadata
                )
                if f.name in known
                else f
                for f in actual.fields
            ]
        )
    if isinstance(actual, T.ArrayType) and isinstance(declared, T.ArrayType):
        return T.ArrayType(_with_kinds(actual.elementType, declared.elementType))
    if isinstance(actual, T.MapType) and isinstance(declared, T.MapType):
        return T.MapType(actual.keyType, _with_kinds(actual.valueType, declared.valueType))
    return actual


def nullable(dtype: T.DataType) -> T.DataType:
    """The same type with every nested value allowed to be null."""
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in dtype.fields]
        )
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(nullable(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, nullable(dtype.valueType))
    return dtype


def _walk(prefix: str, struct: T.StructType, inherited: str | None):
    for f in struct.fields:
        path = f"{prefix}{f.name}"
        kind = inherited or kind_of(f)
        below = DISABLED if kind == DISABLED else None
        yield path, f.dataType, kind
        inner, mark = f.dataType, ""
        if isinstance(inner, T.ArrayType):
            inner = inner.elementType
        elif isinstance(inner, T.MapType):
            inner, mark = inner.valueType, ".*"
        if isinstance(inner, T.StructType):
            yield from _walk(f"{path}{mark}.", inner, below)


PRODUCT_SCHEMA = CatalogSchema(PRODUCT)


def describe(spark: SparkSession, schema: CatalogSchema) -> DataFrame:
    """The schema as rows (path, type, kind); its size is that of the schema, not of the data."""
    rows = [(p, t.simpleString(), k) for p, t, k in schema.leaves()]
    return spark.createDataFrame(rows, "path string, type string, kind string")
