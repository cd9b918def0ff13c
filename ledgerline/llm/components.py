"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, discard, merged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select("dst", "src"))
    least = both.groupBy("src").agg(F.min("dst").alias("m"), F.max("src").alias("n")).select("n", F.least("n", "m").alias("m"))
    return both.filter("dst > src").join(merged(least), F.col("src") == F.col("n")).select(F.col("m").alias("src"), "dst").filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of those."""
    down = edges.select(F.greatest("src", "dst").alias("n"), F.least("src", "dst").alias("s"))
    least = down.groupBy("n").agg(F.min("s").alias("m"), F.max("n").alias("k")).select("k", "m")
    moved = down.join(merged(least), F.col("n") == F.col("k")).select(F.col("m").alias("src"), F.col("s").alias("dst"))
    return moved.union(least.select(F.col("m").alias("src"), F.col("k").alias("dst"))).filter("src <> dst").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges``.

    ``edges`` has ``src`` and ``dst`` of one ordered type. Each round is written to the shared
    checkpoint folder, so lineage stays short, and the round before it is deleted. It ends when every edge points from a
    root to a node that is nobody's root, the fixed point of the two steps; rounds are about
    the logarithm of the longest path. Minima are pre-aggregated before each shuffle and the stars'
    hot centres sit on the side of a join that adaptive execution can split, and nothing is broadcast. It splits only between
    two shuffles, so the minima name their node by an aggregate, which Spark deals anew. No edge: no row.
    """
    edges = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct())
    while True:
        # Stars only: each dst has one src, and no src is a dst. One pass over grouped counts tells.
        roles = edges.select(F.col("src").alias("node"), F.lit(1).alias("is_src"), F.lit(0).alias("as_dst")).distinct().unionByName(
            edges.select(F.col("dst").alias("node"), F.lit(0).alias("is_src"), F.lit(1).alias("as_dst"))
        )
        odd = roles.groupBy("node").agg(F.max("is_src").alias("s"), F.sum("as_dst").alias("d")).filter("d > 1 or (s = 1 and d > 0)")
        if odd.isEmpty():
            break
        edges, old = cut(_small_star(_large_star(edges))), edges
        discard(old)
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("root")).union(edges.select(F.col("src").alias("node"), F.col("src").alias("root")).distinct())
