"""Connected components of a graph given as pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.frames import stored

#: Rounds after which a graph is taken for broken; each round at least halves long chains.
MOST_ROUNDS = 60


def components(pairs: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``a, b`` pairs.

    Large and small stars take turns: every node hands its larger neighbours to the
    least one it knows. Only pairs move, least neighbours are partial aggregates, and a
    hub's pairs are split by adaptive execution as any skewed join. Each round is a
    written table. Pairs of equal ends and nulls are left out.
    """
    edges = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.filter("a <> b").distinct(), "pairs")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # now every pair is (node, smaller node)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.filter("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
