"""Product readers: JSON Lines, streams, and array files of chosen fields (``arrays`` reads those in splits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.plans.numbering import number_rows
from shelfmark.runtime import computed_once
from shelfmark.schema import DISABLED, EXTRA, PRODUCT, PROPERTY, inferred_kind, kind_of

# How a rejected row is reported.
PARSE_ERROR = "mapper_parsing_exception"
PARSE_STATUS = 400

PROPERTIES = "DefaultProductProperties"


def read_products(
    spark: SparkSession, path: str, schema: T.StructType = PRODUCT, strict: bool = False
) -> DataFrame:
    """JSON Lines with a declared schema, and the place of each row.

    Nothing is lost on the way: undeclared fields are in ``_extra``, properties may be
    in list form, and a line that cannot be stored as it is keeps its text and reason in
    ``document`` and ``error``. ``strict`` fails on the first such line instead.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return parse_lines(read_lines(spark, path), schema)


#: Where a row was read: file time, file, and start of the block.
SOURCE = "_source"
#: The order of rows by their place: files by time and name, blocks, rows.
PLACE = ["_file_time", "_file", "_block", "_row"]


def with_source(df: DataFrame) -> DataFrame:
    """Rows of a file source with their place, so that a later write can tell which came last."""
    place = F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return df.select("*", place.alias(SOURCE))


def placed(df: DataFrame) -> DataFrame:
    """The place as sortable columns; rows of a block keep the order in which they were read."""
    time, file, block, row = PLACE
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != SOURCE],
        F.col(f"{SOURCE}.time").alias(time),
        F.col(f"{SOURCE}.file").alias(file),
        F.col(f"{SOURCE}.block").alias(block),
        F.monotonically_increasing_id().alias(row),
    )


def without_errors(df: DataFrame) -> DataFrame:
    """Parsed rows without the columns of the parser; fails on a row that was set aside.

    Split such rows off first (``operators.ingest.split_outcomes``): a table is not
    published with some of its rows left out unsaid.
    """
    if "error" not in df.columns or not dict(df.dtypes)["error"].startswith("struct<type:string,reason:string"):
        return df
    first = df.columns[0]
    refused = F.raise_error(F.concat(F.lit("a row was set aside: "), F.col("error.reason")))
    checked = F.when(F.col("error").isNotNull(), refused).otherwise(F.col(f"`{first}`"))
    return df.withColumn(first, checked.cast(df.schema[first].dataType)).drop("document", "error")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their place, for ``parse_lines``."""
    return with_source(spark.read.text(path))


def stream_products(
    spark: SparkSession, path: str, schema: T.StructType = PRODUCT, files_per_batch: int = 100
) -> DataFrame:
    """A stream over a folder that receives JSON Lines files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of raw lines with their place."""
    return with_source(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def read_array_files(spark: SparkSession, path: str, fields: list[str], partitions: int) -> DataFrame:
    """Files that hold one JSON array each, as one line of JSON text per element.

    One task parses a file; fields are read as text, which keeps nested values as they
    are, and the rows are spread out at once. ``arrays.array_elements`` splits large files.
    """
    text = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.read.schema(text).option("multiLine", True).json(path).repartition(partitions)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """A file of template products, an array or JSON Lines, numbered 0, 1, ... as ``template_no``."""
    rows = spark.read.option("multiLine", True).json(path)
    return number_rows(rows, name="_n").withColumn("template_no", F.col("_n") - 1).drop("_n")


def write_products(df: DataFrame, path: str) -> None:
    """JSON Lines, one file per partition."""
    df.write.json(path)


class ProductSource:
    """A reader that keeps its rows until ``clear_cache``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = PRODUCT):
        self._spark, self._path, self._schema = spark, path, schema
        self._rows: DataFrame | None = None

    def load(self) -> DataFrame:
        if self._rows is None:
            self._rows = read_products(self._spark, self._path, self._schema, strict=True).cache()
        return self._rows

    def clear_cache(self) -> None:
        if self._rows is not None:
            self._rows.unpersist()
            self._rows = None


def property_struct(entry: Column) -> Column:
    """A property entry, cast as ``_stored_type`` says, as the 23-field struct.

    The short form ``{Name, Value, DataType}`` fills KeyName and ValueString.
    """
    short = {"KeyName": "Name", "ValueString": "Value"}
    return F.struct(
        *[
            (F.coalesce(entry[f.name], entry[short[f.name]]) if f.name in short else entry[f.name]).alias(f.name)
            for f in PROPERTY.fields
        ]
    )


def normalise_properties(v: Column) -> Column:
    """The property map from a variant in map form or in list form (last entry of a key wins)."""
    return _properties(F.try_variant_get(v, "$", f"map<string,{_stored_type(PROPERTY)}>"), v, "$")


def _properties(by_key: Column, v: Column, path: str) -> Column:
    """The property map from its cast map form, else from the list form at ``path`` of a variant."""
    by_key = F.transform_values(by_key, lambda _, e: property_struct(e))
    entries = F.transform(F.try_variant_get(v, path, f"array<{_stored_type(PROPERTY)}>"), property_struct)
    # the one-element array binds the entries to a name, so that they are made once
    listed = F.transform(F.array(entries), _last_of_each_key)[0]
    return F.coalesce(by_key, listed)


def _last_of_each_key(entries: Column) -> Column:
    last = F.filter(
        entries,
        lambda p, i: p["KeyName"].isNotNull()
        & ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda q: q["KeyName"].eqNullSafe(p["KeyName"])
        ),
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["KeyName"], p)))


def _field(v: Column, fields: Column, f: T.StructField) -> Column:
    """A field of the cast document; the property map also from its list form."""
    if f.name != PROPERTIES:
        return fields[f.name]
    if f.dataType == T.MapType(T.StringType(), PROPERTY):
        return _properties(fields[f.name], v, f"$.{f.name}")
    return normalise_properties(F.try_variant_get(v, f"$.{PROPERTIES}", "variant"))


def mismatch(
    root: str, path: str, dtype: T.DataType, name: str, kind: str | None = None, depth: int = 0, stored: str | None = None
) -> str | None:
    """SQL for why the variant at ``path`` of ``root`` cannot be stored as ``dtype``, at the first place where it cannot.

    The SQL is null where it can; None says that nothing can be wrong. Nulls and absent
    fields always fit. Text takes numbers and booleans, but no objects or lists. A
    property map may be in list form. ``stored`` is the typed value, if it is known: a
    cast that failed is not tried again. One text per field is much faster to build than
    columns part by part.
    """
    raw = root if path == "$" else f"try_variant_get({root}, '{path}', 'variant')"
    given = f"{raw} IS NOT NULL AND NOT is_variant_null({raw})"
    wrong = f"'failed to parse field [{name}] of type [{kind or inferred_kind(dtype)}]'"
    if isinstance(dtype, T.VariantType):
        return None
    if isinstance(dtype, T.StructType):
        below = [
            mismatch(f"o{depth}.`{f.name}`", "$", f.dataType, f"{name}.{f.name}", kind_of(f), depth + 1, stored and f"{stored}.`{f.name}`")
            for f in dtype.fields
        ]
        found = f"CASE WHEN o{depth} IS NOT NULL THEN coalesce({', '.join(['CAST(NULL AS STRING)', *filter(None, below)])}) WHEN {given} THEN {wrong} END"
        return f"transform(array({_parts(root, path, dtype.fields)}), o{depth} -> {found})[0]"
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        inner = _inner(dtype)
        each = mismatch(f"e{depth}", "$", inner, name, kind, depth + 1)
        known = stored and mismatch(f"e{depth}", "$", inner, name, kind, depth + 1, f"t{depth}")
        listed, by_key = (f"try_variant_get({root}, '{path}', '{t}')" for t in ("array<variant>", "map<string,variant>"))
        if isinstance(dtype, T.ArrayType):
            entries, ours, values = listed, listed, stored
        else:
            ours, values = f"map_values({by_key})", f"map_values({stored})"
            entries = f"coalesce({ours}, {listed})"
        none = f"CASE WHEN {given} AND {entries} IS NULL THEN {wrong} END"
        if each is None:
            return none
        first = f"x{depth} -> x{depth} IS NOT NULL), 0)"
        found = f"coalesce({none}, get(filter(transform({entries}, e{depth} -> {each}), {first})"
        if not known:
            return found
        beside = f"get(filter(zip_with({values}, {ours}, (t{depth}, e{depth}) -> {known}), {first}"
        return f"CASE WHEN {stored} IS NOT NULL THEN {beside} ELSE {found} END"
    if isinstance(dtype, T.StringType):
        given = _like_json(stored) if stored else given
        return f"CASE WHEN {given} AND schema_of_variant({raw}) RLIKE '^(OBJECT|ARRAY)' THEN {wrong} END"
    stored = stored or f"try_variant_get({root}, '{path}', '{dtype.simpleString()}')"
    return f"CASE WHEN {stored} IS NULL AND {given} THEN {wrong} END"


def _like_json(text: str) -> str:
    return f"(startswith({text}, '{{') OR startswith({text}, '['))"


def _parts(root: str, path: str, fields: list[T.StructField]) -> str:
    """SQL for the fields of an object as variants, in one walk that passes over absent fields."""
    types = ", ".join(f"`{f.name}`: variant" for f in fields)
    return f"try_variant_get({root}, '{path}', 'struct<{types}>')"


def _stored_type(dtype: T.DataType, short: bool = True) -> str:
    """The declared type as SQL; with ``short`` a property also takes the fields of its short form."""
    if isinstance(dtype, T.StructType):
        fields = [f"`{f.name}`: {_stored_type(f.dataType, short)}" for f in dtype.fields]
        if short and dtype == PROPERTY:
            fields += ["`Name`: string", "`Value`: string"]
        return f"struct<{', '.join(fields)}>"
    if isinstance(dtype, T.ArrayType):
        return f"array<{_stored_type(dtype.elementType, short)}>"
    if isinstance(dtype, T.MapType):
        return f"map<string, {_stored_type(dtype.valueType, short)}>"
    return dtype.simpleString()


def _names_type(dtype: T.DataType) -> str | None:
    """The names of the fields of each object that a top field holds, as a type, where these are declared."""
    if not _has_fields(dtype):
        return None
    return NAMES if isinstance(dtype, T.StructType) else f"array<{NAMES}>" if isinstance(dtype, T.ArrayType) else f"map<string, {NAMES}>"


def typed(root: str, fields: list[T.StructField]) -> str:
    """SQL for the given fields of a variant as one struct: one walk of the variant, which passes over absent fields."""
    types = ", ".join(f"`{f.name}`: {_stored_type(f.dataType, f.name == PROPERTIES)}" for f in fields)
    return f"try_variant_get({root}, '$', 'struct<{types}>')"


def _fits(stored: str, names: str | None, dtype: T.DataType, absent: str = "false") -> str:
    """SQL that is true only where a value surely can be stored; the rest is judged by ``mismatch``.

    ``stored`` is the typed value, ``names`` are those of the fields given in each of its
    objects (see ``_names_type``), and ``absent`` says that nothing was given.
    """
    if isinstance(dtype, T.VariantType):
        return "true"
    if isinstance(dtype, T.StringType):
        return f"({stored} IS NULL OR NOT {_like_json(stored)})"
    if isinstance(dtype, T.StructType):
        parts = [(f, f"{stored}.`{f.name}`") for f in dtype.fields]
        texts = [_fits(p, None, f.dataType) for f, p in parts if isinstance(f.dataType, (T.StringType, T.VariantType))]
        others = [f for f, _ in parts if not isinstance(f.dataType, (T.StringType, T.VariantType))]
        if others and names:
            keys, some = f"map_keys({names})", _among("n", [f.name for f in others])
            checks = [_fits(p, None, f.dataType, f"NOT exists({keys}, n -> n = '{f.name}')") for f, p in parts if f in others]
            texts.append(f"(NOT exists({keys}, n -> {some}) OR {' AND '.join(checks)})")
        else:
            texts += [_fits(p, None, f.dataType) for f, p in parts if f in others]
        return f"({stored} IS NOT NULL AND {' AND '.join(texts) or 'true'} OR {absent})"
    if not isinstance(dtype, (T.ArrayType, T.MapType)):
        return f"({stored} IS NOT NULL OR {absent})"
    values = stored if isinstance(dtype, T.ArrayType) else f"map_values({stored})"
    if names:
        names = names if isinstance(dtype, T.ArrayType) else f"map_values({names})"
        each = f"forall(zip_with({values}, {names}, (a, b) -> {_fits('a', 'b', _inner(dtype))}), a -> a)"
    else:
        name = f"a{stored.count('.')}"
        each = f"forall({values}, {name} -> {_fits(name, None, _inner(dtype))})"
    return f"({stored} IS NOT NULL AND {each} OR {absent})"


def _absent(root: str, f: T.StructField) -> str:
    """No name is found faster than a null."""
    return f"(NOT exists(q.n, n -> n = '{f.name}') OR is_variant_null(try_variant_get({root}, '$.{f.name}', 'variant')))"


def _doubt(root: str, f: T.StructField, then: str) -> str:
    """SQL for ``then`` where the field of ``q.t`` (typed) may not fit, else null."""
    names = f"q.s.`{f.name}`" if _names_type(f.dataType) else None
    return f"CASE WHEN {_fits(f'q.t.`{f.name}`', names, f.dataType, _absent(root, f))} THEN NULL ELSE {then} END"


def _mismatch_of(root: str, f: T.StructField) -> str | None:
    return mismatch(root, f"$.{f.name}", f.dataType, f.name, kind_of(f), stored=f"q.t.`{f.name}`")


def _reason(root: str, fields: list[T.StructField]) -> str:
    found = [(f, _mismatch_of(root, f)) for f in fields]
    return f"coalesce({', '.join(['CAST(NULL AS STRING)', *(_doubt(root, f, m) for f, m in found if m)])})"


def _judged(root: str, fields: list[T.StructField], made: str, stored: str | None = None) -> Column:
    """``made``, SQL over ``q``, made once a row: ``t`` are the fields typed, ``n`` the names of the given ones, ``s`` those of the fields below."""
    types = [(f.name, _names_type(f.dataType)) for f in fields]
    inside = f"try_variant_get({root}, '$', 'struct<{', '.join(f'`{n}`: {t}' for n, t in types if t)}>')"
    names = f"map_keys(try_variant_get({root}, '$', '{NAMES}'))"
    return F.expr(f"transform(array(named_struct('t', {stored or typed(root, fields)}, 's', {inside}, 'n', {names})), q -> {made})[0]")


def faults(root: str, fields: list[T.StructField]) -> Column:
    """Why the first of the fields that cannot be stored cannot, else null.

    The variant column ``root`` is cast as a whole. Only a field in doubt after that is
    judged part by part.
    """
    return _judged(root, fields, _reason(root, fields))


def undeclared(root: str, path: str, dtype: T.DataType, depth: int = 0) -> str:
    """SQL for what a variant holds beside its declared fields, at every depth, in the same shape; null without any.

    Entries of a list appear under their place. The short form of a property fills two
    declared fields.
    """
    objects = "map<string,variant>"
    if isinstance(dtype, T.StructType):
        return f"transform(array(try_variant_get({root}, '{path}', '{objects}')), o{depth} -> {_rest(f'o{depth}', dtype, depth)})[0]"
    each = _rest(f"o{depth}", dtype.elementType if isinstance(dtype, T.ArrayType) else dtype.valueType, depth)
    pairs = (
        f"transform(try_variant_get({root}, '{path}', 'array<{objects}>'), "
        f"(o{depth}, i{depth}) -> named_struct('k', CAST(i{depth} AS STRING), 'v', {each}))"
    )
    found = _given_sql(pairs, depth)
    if isinstance(dtype, T.MapType):
        entries = f"try_variant_get({root}, '{path}', 'map<string,{objects}>')"
        by_key = f"map_filter(transform_values({entries}, (k{depth}, o{depth}) -> {each}), (k{depth}, v{depth}) -> v{depth} IS NOT NULL)"
        found = f"coalesce({by_key}, {found})"
    return _object(found, f"m{depth}")


def _rest(entries: str, dtype: T.StructType, depth: int) -> str:
    """``undeclared`` of an object, given as its entries."""
    found = f"map_filter({entries}, (k{depth}, v{depth}) -> NOT {_among(f'k{depth}', _declared(dtype))})"
    values = {f.name: f"try_element_at({entries}, '{f.name}')" for f in dtype.fields if _has_fields(f.dataType)}
    if values:
        below = ", ".join(
            f"named_struct('k', '{f.name}', 'v', CASE WHEN {values[f.name]} IS NOT NULL THEN {undeclared(values[f.name], '$', f.dataType, depth + 1)} END)"
            for f in dtype.fields
            if f.name in values
        )
        none = " AND ".join(f"{v} IS NULL" for v in values.values())
        found = f"CASE WHEN {none} THEN {found} ELSE map_concat({found}, {_given_sql(f'array({below})', depth)}) END"
    return _object(found, f"m{depth}")


def _inner(dtype: T.DataType) -> T.DataType:
    return dtype.elementType if isinstance(dtype, T.ArrayType) else dtype.valueType if isinstance(dtype, T.MapType) else dtype


def _has_fields(dtype: T.DataType) -> bool:
    return isinstance(_inner(dtype), T.StructType)


def _declared(dtype: T.StructType) -> list[str]:
    return [f.name for f in dtype.fields] + (["Name", "Value"] if dtype == PROPERTY else [])


def _among(name: str, names: list[str]) -> str:
    return f"{name} IN ({', '.join(f"'{n}'" for n in names)})" if names else "false"


#: Names of fields without their values.
NAMES = "map<string, struct<>>"


def _strays(root: str, path: str, dtype: T.DataType, way: tuple[tuple[str, str], ...] = ()) -> list[str]:
    """SQL conditions, one for each declared object: whether it has a field that is not declared. Reads names alone."""
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        if isinstance(dtype, T.MapType) and way:
            return ["true"]  # its list form would not be seen
        step = "array<{}>" if isinstance(dtype, T.ArrayType) else "map<string, {}>"
        return _strays(root, path, _inner(dtype), (*way, (step, ""))) if _has_fields(dtype) else []
    kind = NAMES
    for step, _ in reversed(way):
        kind = step.format(kind)
    at, inside = f"try_variant_get({root}, '{path}', '{kind}')", "{}"
    for i, (step, name) in enumerate(way):
        if name:
            at = f"{at}.`{name}`"
            continue
        values = at if step.startswith("array") else f"map_values({at})"
        inside, at = inside.format(f"exists({values}, w{i} -> {{}})"), f"w{i}"
    found = [f"coalesce({inside.format(f'exists(map_keys({at}), n -> NOT {_among('n', _declared(dtype))})')}, false)"]
    for f in dtype.fields:
        if _has_fields(f.dataType):
            found += _strays(root, path, f.dataType, (*way, (f"struct<`{f.name}`: {{}}>", f.name)))
    return found


def _undeclared_of(root: str, f: T.StructField) -> str:
    """``undeclared`` of a field, built only where the field is in no declared form or holds a name that is not declared."""
    path, stored, names, inner = f"$.{f.name}", f"q.t.`{f.name}`", f"q.s.`{f.name}`", _inner(f.dataType)
    stray = f"exists(map_keys(w), n -> NOT {_among('n', _declared(inner))})"
    if inner is f.dataType:
        own, below = stray.replace("map_keys(w)", f"map_keys({names})"), [(f"{stored}.`{g.name}` IS NOT NULL", g) for g in inner.fields]
    else:
        each = "{}" if isinstance(f.dataType, T.ArrayType) else "map_values({})"
        own = f"exists({each.format(names)}, w -> {stray})"
        below = [(f"exists({each.format(stored)}, w -> w.`{g.name}` IS NOT NULL)", g) for g in inner.fields]
    deeper = _strays(root, path, f.dataType)[1:]
    if deeper:
        # what is deeper is looked at only where there is some; the list form of a map is not seen in the typed value
        some = [held for held, g in below if _has_fields(g.dataType) and not isinstance(g.dataType, T.MapType)]
        held = "true" if any(isinstance(g.dataType, T.MapType) and _has_fields(g.dataType) for _, g in below) else " OR ".join(some)
        own = f"coalesce({own}, false) OR (({held}) AND ({' OR '.join(deeper)}))"
    return (
        f"CASE WHEN {stored} IS NOT NULL AND NOT coalesce({own}, false) THEN NULL WHEN {stored} IS NULL AND {_absent(root, f)} THEN NULL "
        f"ELSE {undeclared(root, path, f.dataType, 1)} END"
    )


def _given_sql(pairs: str, depth: int) -> str:
    return f"map_from_entries(filter({pairs}, p{depth} -> p{depth}.v IS NOT NULL))"


NOTHING = "CAST(map() AS map<string, variant>)"


def _object(entries: str, name: str) -> str:
    return f"transform(array({entries}), {name} -> CASE WHEN size({name}) > 0 THEN to_variant_object({name}) END)[0]"


def _of_given(values: dict[str, str]) -> str:
    """SQL over ``q`` for entries of the given fields among ``values``: work goes by what a document holds."""
    cases = " ".join(f"WHEN '{n}' THEN {v}" for n, v in values.items())
    return f"transform(filter(q.n, n -> {_among('n', list(values))}), n -> named_struct('k', n, 'v', CASE n {cases} END))"


def _beside(root: str, schema: T.StructType) -> str:
    """SQL over ``q`` for ``_extra``: undeclared fields, and values that disabled columns, which take anything, cannot hold."""
    entries = f"try_variant_get({root}, '$', 'map<string,variant>')"
    stray = f"coalesce(exists(q.n, n -> NOT {_among('n', _declared(schema))}), false)"
    own = f"map_filter({entries}, (k0, v0) -> NOT {_among('k0', _declared(schema))})"
    # the more often used fields first, as branches are tried in order
    below = {f.name: _undeclared_of(root, f) for f in sorted(schema.fields, key=lambda f: kind_of(f) == DISABLED) if _has_fields(f.dataType)}
    inside = _given_sql(_of_given(below), 0) if below else NOTHING
    found = f"transform(array({inside}), b -> CASE WHEN {stray} THEN map_concat({own}, b) ELSE b END)[0]"
    extra = _object(found, "m0")
    off = [f for f in schema.fields if kind_of(f) == DISABLED and not isinstance(f.dataType, (T.StringType, T.VariantType))]
    if not off:
        return extra
    lost = {}
    for f in off:
        whole = f"CASE WHEN {_mismatch_of(root, f)} IS NOT NULL THEN try_variant_get({root}, '$.{f.name}', 'variant') END"
        lost[f.name] = _doubt(root, f, whole)
    kept = _given_sql(_of_given(lost), 0)
    some = f"exists(q.n, n -> {_among('n', list(lost))})"
    # values that were kept whole need no second entry for what is undeclared inside them
    own = f"coalesce(try_variant_get(x, '$', 'map<string,variant>'), {NOTHING})"
    both = _object(f"map_concat(map_filter({own}, (k, v) -> NOT map_contains_key(whole, k)), whole)", "m")
    both = f"transform(array({kept}), whole -> CASE WHEN size(whole) = 0 THEN x ELSE {both} END)[0]"
    return f"transform(array({extra}), x -> CASE WHEN {some} THEN {both} ELSE x END)[0]"


def parse_lines(
    lines: DataFrame, schema: T.StructType = PRODUCT, value: str = "value"
) -> DataFrame:
    """Parse JSON text row by row; a bad row gets an ``error`` and never stops its neighbours.

    A value of a wrong type counts at any depth. Returns the other columns, the text as
    ``document``, the declared fields, the undeclared ones of every depth as one variant
    object ``_extra`` (null where there are none) and ``error`` struct<type, reason, status>.
    """
    passed = [c for c in lines.columns if c != value]
    doc = computed_once(lines.select(*passed, value), "_doc", F.try_parse_json(value))
    doc = computed_once(doc, "_t", F.expr(typed("_doc", schema.fields)))
    reason = _reason("_doc", [f for f in schema.fields if kind_of(f) != DISABLED])
    # only an object has fields
    reason = f"CASE WHEN _t IS NULL THEN 'malformed JSON document' ELSE {reason} END"
    judged = f"named_struct('reason', {reason}, 'extra', {_beside('_doc', schema)})"
    doc = computed_once(doc, "_judged", _judged("_doc", schema.fields, judged, "_t"))
    reason = F.col("_judged.reason")
    error = F.when(
        reason.isNotNull(),
        F.struct(
            F.lit(PARSE_ERROR).alias("type"), reason.alias("reason"), F.lit(PARSE_STATUS).alias("status")
        ),
    )
    return doc.select(
        *passed,
        F.col(value).alias("document"),
        *[_field(F.col("_doc"), F.col("_t"), f).alias(f.name, metadata=f.metadata) for f in schema.fields],
        F.col("_judged.extra").alias(EXTRA),
        error.alias("error"),
    )
