"""Optimistic concurrency control as joins of a pinned version with the current one."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _seqs(d: DataFrame, name: str, k: str) -> DataFrame:
    return d.select(F.col(k), F.col("seq").alias(name))


def range_conflicts(snap: DataFrame, cur: DataFrame, low, high, k: str = "k") -> DataFrame:
    """Keys of [low, high) that appeared, went or changed since ``snap``. The range is cut on both sides before the join."""
    inside = (F.col(k) >= F.lit(low)) & (F.col(k) < F.lit(high))
    j = _seqs(snap.filter(inside), "s", k).join(_seqs(cur.filter(inside), "c", k), k, "full_outer")
    j = j.select(k, F.coalesce("s", F.lit(0)).alias("snap_seq"), F.coalesce("c", F.lit(0)).alias("cur_seq"))
    return j.filter("snap_seq <> cur_seq")


def versions(keys: DataFrame, snap: DataFrame, cur: DataFrame, k: str = "k") -> DataFrame:
    """``keys`` with the sequences ``s`` in the snapshot and ``c`` now, null where absent."""
    return keys.join(_seqs(cur, "c", k), k, "left").join(_seqs(snap, "s", k), k, "left")


def verdicts(guards: DataFrame, snap: DataFrame, cur: DataFrame, k: str = "k", g: str = "g") -> DataFrame:
    """``ok`` for guards 1 (must be present now), 2 (must be absent now), 3 (as in the snapshot)."""
    bad = (
        ((F.col(g) == 1) & F.col("c").isNull())
        | ((F.col(g) == 2) & F.col("c").isNotNull())
        | ((F.col(g) == 3) & (F.coalesce("c", F.lit(0)) != F.coalesce("s", F.lit(0))))
    )
    return versions(guards, snap, cur, k).select(*guards.columns, F.when(bad, 0).otherwise(1).alias("ok"))


def write_conflicts(writes: DataFrame, snap: DataFrame, cur: DataFrame, k: str = "k") -> DataFrame:
    """Written keys that appeared, were deleted or modified since the snapshot."""
    kind = F.when(F.col("s").isNull(), "appeared").when(F.col("c").isNull(), "deleted").otherwise("modified")
    v = versions(writes.select(k), snap, cur, k)
    return v.filter(F.coalesce("c", F.lit(0)) != F.coalesce("s", F.lit(0))).select(k, kind.alias("kind"))


def overlay(d: DataFrame, writes: DataFrame, k: str = "k", v: str = "v", deleted: str = "del") -> DataFrame:
    """Read-your-writes: pending writes over the snapshot; rows of ``writes`` with ``deleted`` hide the key."""
    w = writes.select(F.col(k), F.col(v).alias("_wv"), F.col(deleted).alias("_wd"))
    j = d.select(k, v).join(w, k, "full_outer")
    return j.filter(F.col("_wd").isNull() | ~F.col("_wd")).select(k, F.when(F.col("_wd").isNotNull(), F.col("_wv")).otherwise(F.col(v)).alias(v))
