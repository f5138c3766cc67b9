"""Global numbering and running totals that never gather all rows in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.runtime import cut_lineage

# Rows that one task may sort for a running total, as a power of two.
BLOCK_BITS = 20

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def number_rows(df: DataFrame, order_by: Sequence[str | Column] = (), name: str = "n") -> DataFrame:
    """Number rows from 1 across all partitions, in ``order_by`` order if given.

    The rows are range-partitioned and written down once, which fixes their
    places; then each partition's start is the sum of the sizes before it. The
    table of sizes has one row per partition, hence the broadcast.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    place = F.monotonically_increasing_id()
    fixed = cut_lineage(df)
    placed = fixed.withColumn("_part", F.shiftright(place, _LOCAL_BITS)).withColumn(
        "_local", place.bitwiseAND(_LOCAL_MASK)
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_local") + 1)
        .drop("_part", "_local", "_start")
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    totals: Mapping[str, Column | str],
    span_bits: int = 40,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Running sums per ``by`` group in the order of a whole-number ``position``.

    ``position`` must be unique within its group. A group is cut into blocks of
    positions: blocks are summed first, sums of earlier blocks are added to the
    running sum inside a block. So a task sorts one block of one group, however
    large the group. ``span_bits`` is the width of the positions; wider positions
    get one more level of blocks per ``block_bits``.
    """
    block = f"{position}_block"
    cut = df.withColumn(block, F.shiftright(F.col(position), block_bits))
    sums = cut.groupBy(*by, block).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    inner = {n: F.col(f"_sum_{n}") for n in totals}
    if span_bits - block_bits > block_bits:
        above = {f"_upto_{n}": v for n, v in inner.items()}
        upto = running_totals(sums, by, block, above, span_bits - block_bits, block_bits)
    else:
        w = W.partitionBy(*by).orderBy(block).rowsBetween(W.unboundedPreceding, W.currentRow)
        upto = sums.withColumns({f"_upto_{n}": F.sum(v).over(w) for n, v in inner.items()})
    starts = upto.select(
        *[F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)],
        F.col(block).alias("_at"),
        *[(F.col(f"_upto_{n}") - F.col(f"_sum_{n}")).alias(f"_start_{n}") for n in totals],
    )
    on = F.col(block) == F.col("_at")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{i}"))
    w = (
        W.partitionBy(*by, block)
        .orderBy(position)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    inside = cut.withColumns(
        {f"_in_{n}": F.sum(v if isinstance(v, Column) else F.col(v)).over(w) for n, v in totals.items()}
    )
    joined = inside.join(starts, on)
    return joined.select(
        *df.columns, *[(F.col(f"_start_{n}") + F.col(f"_in_{n}")).alias(n) for n in totals]
    )
