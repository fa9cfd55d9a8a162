"""Connected components by alternating large and small stars; every round is a join and an aggregate, cut by a written table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratalog.plans.scratch import cut, discard


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links to (u, v): each node that isn't the least of its component, with the least.

    Hubs are safe: minima are combined before the shuffle and written, so that each join is of two written tables, of
    which Spark broadcasts the small one or splits the links of a hub. Rounds that are done with are deleted.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e, "cc")
    was = _mark(e)
    for _ in range(rounds):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m")), "cc")
        # A larger neighbour v of u: of the links as they are, u is the smaller end.
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "cc")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m"), "cc")
        j = large.join(low, F.col("u") == F.col("_u"))
        new = cut(j.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct(), "cc")
        now = _mark(new)
        discard(e, least, large, low)
        e, done = new, now == was
        was = now
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e
