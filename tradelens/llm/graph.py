"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id in ``edges`` (``a long, b long``).

    Alternating large-star and small-star steps: each step hangs a node's neighbours on the smallest one,
    so the edges shrink to one star per component in about as many rounds as the logarithm of the
    longest path.  Every round writes its edges to the checkpoint folder; only counts reach the driver.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct())
    before = _state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut_lineage(large.join(small, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct())
        state = _state(edges)  # stars do not change any more
        if state == before:
            break
        before = state
    centres = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(centres)


def _state(edges: DataFrame) -> tuple:
    """Tells one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003),
                           F.sum(F.xxhash64("v", "u") % 998_244_353)).first())
