"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.skew import HOT, look_up
from quillon.session import discard, materialise


def _star(pairs: DataFrame, large: bool, hot: int) -> DataFrame:
    """One star step over (u, v): every neighbour is linked to the smallest node around, which partial aggregation finds."""
    around = pairs if not large else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    if not large:
        around = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    lowest = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    joined = look_up(around, lowest, ["u"], "v", "n", hot)
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, source: str, target: str, limit: int = 50, hot: int = HOT) -> DataFrame:
    """(node, component) of every node with an edge to another: the smallest node it is connected to.

    Direction and multiplicity of edges don't matter; loops and null ends are ignored. Each round writes its
    pairs to the shared folder, so that a lost executor costs one round only. The number of rounds grows with
    the logarithm of the longest chain.
    """
    pairs = materialise(edges.select(F.col(source).alias("u"), F.col(target).alias("v")).filter("u <> v").distinct(), "star")
    many, seen = pairs.count(), None
    for _ in range(limit):
        crowd = max(hot, many // 500)  # a large star has each pair twice
        step = materialise(_star(_star(pairs, True, crowd), False, crowd), "star")
        discard(pairs)
        pairs = step
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        many, seen = state[0], state
    else:
        raise RuntimeError(f"no fixpoint within {limit} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
