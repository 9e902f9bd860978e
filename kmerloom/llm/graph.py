"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 64) -> DataFrame:
    """(v, component) for every end of the edges (u, v): the smallest vertex reachable.

    A vertex never gathers its neighbours: each round takes their minimum, which tasks
    combine before the shuffle, and sends it back with joins that Spark can split.
    The rounds end when the edges are the stars of the components.  Every round is
    written, so neither the plan nor what a lost executor costs grows with the rounds.
    Self-loops and repeated edges do no harm; null ends are left out.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    e = scratch.write(e)
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        following = scratch.write(small)
        scratch.drop(e)
        e, after = following, _state(following)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(e.select("v", F.col("v").alias("component")).distinct())
