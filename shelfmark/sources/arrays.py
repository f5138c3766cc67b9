"""Files that hold one JSON array, read in splits.

Where an element ends depends on all the text before it: whether a string is open, and
how deep the brackets are. Both are sums, so they can be had without reading in order:

1. Every split is cut into slabs. A slab says how many quotes it has and, for either case
   of what was open before it, how its depth moves and how many elements begin at which
   depth. Slabs are written to the shared folder, so later steps see the same ones.
2. Sums over the slabs of a file, of a few numbers each, tell every slab its beginning.
3. Every slab cuts out its elements by itself. Elements across slabs are put together
   from their parts; all others are not moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.runtime import work_path
from shelfmark.sources.products import SOURCE, with_source

#: Bytes of a slab.
SLAB = 1 << 20

_QUOTE, _COMMA, _OPEN = b'",['
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")] = 1
_STEP[list(b"]}")] = -1
_BYTE_ORDER_MARK = b"\xef\xbb\xbf"

_SLABS = """time timestamp, file string, block bigint, slab int, text binary, quotes bigint,
    moves array<bigint>, outer_depths array<int>, outer_counts array<bigint>, inner_depths array<int>, inner_counts array<bigint>"""
_PIECES = "number bigint, value binary, at_open boolean, at_close boolean"


def write_array_files(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, one file a partition, each file one array."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = "["
        for batch in batches:
            if len(batch):
                marks = pd.Series(",", index=batch.index)
                marks.iloc[0] = begin
                begin = ","
                yield pd.DataFrame({"value": marks + batch["value"]})
        yield pd.DataFrame({"value": ["[]" if begin == "[" else "]"]})

    documents = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    documents.mapInPandas(lines, "value string").write.text(path)


def array_elements(spark: SparkSession, path: str, slab: int = SLAB) -> DataFrame:
    """Every element of every array as one row of JSON text, ``value``, with its place.

    The place (``_source``) numbers the elements in the order of the file, from 1. A file
    may hold several arrays one after the other, be compressed (then one task cuts its
    slabs) or be empty. An empty array has no elements; an element left out between two
    commas is an empty text, which a parser sets aside. Text that is no array, or an array
    that does not end, fails and names the file.
    """
    folder = work_path(spark, "array-slabs")
    # rows end at a brace, so no row is longer than what lies between two braces
    chunks = with_source(spark.read.option("lineSep", "}").text(path)).select(
        f"{SOURCE}.*", F.col("value").cast("binary").alias("value")
    )
    chunks.mapInPandas(lambda batches: _slabs(batches, slab), _SLABS).write.parquet(folder)
    slabs = spark.read.parquet(folder)
    # written, so that the planner knows its size: broadcast while it is small, else the slabs are shuffled to it
    _beginnings(slabs).select("file", "block", "slab", "inside", "depth", "number").write.parquet(f"{folder}-begin")
    placed = slabs.select("time", "file", "block", "slab", "text").join(
        spark.read.parquet(f"{folder}-begin"), ["file", "block", "slab"]
    )
    whole = placed.mapInPandas(lambda batches: _cut(batches, borders=False), f"time timestamp, file string, {_PIECES}")
    parts = placed.mapInPandas(
        lambda batches: _cut(batches, borders=True), f"time timestamp, file string, block bigint, slab int, {_PIECES}"
    )
    in_order = F.array_sort(F.collect_list(F.struct("block", "slab", "value")))
    joined = parts.groupBy("time", "file", "number").agg(
        F.concat_ws("", F.transform(in_order, lambda p: p["value"].cast("string"))).alias("value"),
        (F.max("at_open") & F.max("at_close")).alias("bare"),
    )
    rows = whole.select("time", "file", "number", F.col("value").cast("string").alias("value")).unionByName(
        joined.withColumn("value", F.trim("value", F.lit(" \t\r\n"))).filter("not (bare and value = '')").drop("bare")
    )
    return rows.select("value", F.struct("time", "file", F.col("number").alias("block")).alias(SOURCE))


def _beginnings(slabs: DataFrame) -> DataFrame:
    """For every slab: whether a string is open, the depth, and the elements begun before it."""
    order = Window.partitionBy("file").orderBy("block", "slab")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column: str):
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    outer = F.col("inside") == 0
    counts = F.when(outer, F.map_from_arrays("outer_depths", "outer_counts")).otherwise(
        F.map_from_arrays("inner_depths", "inner_counts")
    )
    found = (
        slabs.drop("text")
        .withColumn("inside", so_far("quotes") % 2)
        .withColumn("move", F.when(outer, F.col("moves")[0]).otherwise(F.col("moves")[1]))
        .withColumn("depth", so_far("move"))
        .withColumn("begun", F.coalesce(F.try_element_at(counts, (1 - F.col("depth")).cast("int")), F.lit(0)))
        .withColumn("number", so_far("begun"))
        .withColumn("last", F.lead("file").over(order).isNull())
    )
    ended = ((F.col("inside") + F.col("quotes")) % 2 == 0) & (F.col("depth") + F.col("move") == 0)
    fault = F.raise_error(F.concat(F.lit("the JSON array does not end: "), F.col("file"))).cast("bigint")
    return found.withColumn("depth", F.when(F.col("last") & ~ended, fault).otherwise(F.col("depth")))


def _scan(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes without escapes, and for each whether an odd number of quotes came before or at it."""
    plain = np.frombuffer(_ESCAPED.sub(b"__", text), np.uint8)
    return plain, np.cumsum(plain == _QUOTE, dtype=np.uint8) & 1


def _slabs(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows of a split, which come in order, as slabs of about ``size`` bytes."""
    place, held, number = None, bytearray(), 0
    for batch in batches:
        for (file, block), rows in batch.groupby(["file", "block"], sort=False):
            if place is None or place[1:] != (file, block):
                if held:
                    yield _summary(place, number, bytes(held))
                place, held, number = (rows["time"].iloc[0], file, block), bytearray(), 0
                if block:
                    held += b"}"
            else:
                held += b"}"
            held += b"}".join(rows["value"])
            begin = 0
            while len(held) - begin > size:
                end = begin + size
                run = held[begin:end]
                if (len(run) - len(run.rstrip(b"\\"))) % 2 and size > 1:
                    end -= 1  # an escape stays in one slab
                yield _summary(place, number, bytes(held[begin:end]))
                begin, number = end, number + 1
            del held[:begin]
    if held:
        yield _summary(place, number, bytes(held))


def _summary(place: tuple, number: int, text: bytes) -> pd.DataFrame:
    plain, parity = _scan(text)
    moves, begun = [], []
    for inside in (0, 1):
        outside = parity == inside
        steps = np.where(outside, _STEP[plain], 0)
        depth = np.cumsum(steps, dtype=np.int32)
        moves.append(int(depth[-1]))
        begun += np.unique(depth[(outside & (plain == _COMMA)) | (steps == 1)], return_counts=True)
    row = [*place, number, text, int((plain == _QUOTE).sum()), moves, *[x.tolist() for x in begun]]
    names = "time file block slab text quotes moves outer_depths outer_counts inner_depths inner_counts"
    return pd.DataFrame([row], columns=names.split())


def _pieces(file: str, text: bytes, inside: int, depth: int, number: int) -> Iterator[tuple]:
    """Parts of elements in a slab: number, text, whether it begins and ends here, and at a bracket."""
    plain, parity = _scan(text)
    outside = parity == inside
    steps = np.where(outside, _STEP[plain], 0)
    after = depth + np.cumsum(steps, dtype=np.int64)
    starts = (after == 1) & ((outside & (plain == _COMMA)) | (steps == 1))
    if after.min() < 0 or np.any((steps == 1) & (after == 1) & (plain != _OPEN)):
        raise ValueError(f"not a JSON array: {file}")
    at, within, begun, bracket = 0, depth > 0, False, False
    for cut in [*np.flatnonzero(starts | ((steps == -1) & (after == 0))).tolist(), len(text)]:
        piece, ends = text[at:cut], cut < len(text)
        if within:
            yield number, piece, begun, ends, bracket, ends and not starts[cut]
        elif piece.strip().removeprefix(_BYTE_ORDER_MARK).strip():
            raise ValueError(f"not a JSON array: {file}")
        if ends:
            at, within, begun, bracket = cut + 1, bool(starts[cut]), True, plain[cut] == _OPEN
            number += within


def _cut(batches: Iterator[pd.DataFrame], borders: bool) -> Iterator[pd.DataFrame]:
    """The whole elements of each slab, or the parts of elements that cross its borders."""
    place = ["time", "file", "block", "slab"] if borders else ["time", "file"]
    names = ["number", "value", "at_open", "at_close"]
    for batch in batches:
        for slab in batch.itertuples(index=False):
            made = []
            for n, piece, begun, ends, first, last in _pieces(slab.file, slab.text, slab.inside, slab.depth, slab.number):
                if borders != (begun and ends):
                    text = piece if borders else piece.strip(b" \t\r\n")
                    if borders or text or not (first and last):
                        made.append((n, text, bool(first), bool(last)))
            found = pd.DataFrame(made, columns=names)
            for i, column in enumerate(place):
                found.insert(i, column, getattr(slab, column))
            yield found
