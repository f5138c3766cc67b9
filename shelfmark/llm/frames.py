"""Reading, projecting and grouping the frames that the operators work on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.runtime import shared_dir

#: Bytes of text that one group of documents holds, about.
GROUP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The id and text alone, as ``doc`` and ``text``; other columns cannot clash with ours.

    With ``carry`` the whole row but its text comes along as the struct ``rest``.
    """
    own = [F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")]
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(*own, *([F.struct(*rest).alias("rest")] if carry else []))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    return int(df.select(F.sum(F.octet_length(text_col))).first()[0] or 0)


def grouped(df: DataFrame, size: int, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """Deal documents to groups of about ``group_bytes`` by a hash of id and text.

    A group is as large as its documents are: no key of the data decides it, so
    a hot source or a family of copies spreads over all groups.
    """
    groups = max(1, -(-size // group_bytes))
    grp: Column = F.pmod(F.xxhash64("doc", "text"), F.lit(groups))
    return df.withColumn("grp", grp), groups


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def sorted_group(tab: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """A group's documents in the order (id, text), nulls last: order ids, offsets, bytes, rows in that order.

    The order is a function of the rows alone, so that a task that runs again
    numbers everything alike.
    """
    tab = tab.combine_chunks()
    order = pc.sort_indices(tab, sort_keys=[("doc", "ascending"), ("text", "ascending")], null_placement="at_end")
    tab = tab.take(order)
    ids = tab.column("doc")
    offsets, data = text_bytes(tab.column("text"))
    keys = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy().astype(np.int64)
    return keys, offsets, data, tab


def row_slabs(column: pa.Array, size: int = 2 << 20, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes of text, or one longer text."""
    offsets, _ = text_bytes(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, a + most, max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1))
        yield a, b
        a = b
