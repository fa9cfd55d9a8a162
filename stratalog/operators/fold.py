"""Folds of the log: the latest row of each key, batches, partial folds and keyed merges.

Each key's window is cut to one row per key and task before the shuffle (WindowGroupLimit), so a key with a
third of all rows costs its reducer one row per map task.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from stratalog.plans.model import BEGIN, DELETE, END, PUT


def latest(log: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """The row with the largest ``seq`` of each key; equal sequences count once."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def live(log: DataFrame, key: str = "k") -> DataFrame:
    """The relation key to value: latest rows that are puts. Liveness hangs on the entry type, never on the value."""
    return latest(log, key).filter(F.col("entry_type") == PUT)


def live_of(log: DataFrame, probes: DataFrame, key: str = "k") -> DataFrame:
    """live(), of the keys in ``probes`` only: the log is cut to them before it is folded."""
    return live(log.join(probes.select(key).distinct(), key, "left_semi"), key)


def with_live(log: DataFrame, key: str = "k") -> DataFrame:
    """Every row, with ``live`` 1 on those the index refers to.

    The index (one row per key) is joined back on key and sequence: a hot key is split over tasks by the join,
    which a window over all rows of the key could not do.
    """
    idx = live(log, key).select(F.col(key).alias("_k"), F.col("seq").alias("_s"))
    hit = (F.col(key) == F.col("_k")) & (F.col("seq") == F.col("_s"))
    return log.join(idx, hit, "left").withColumn("live", F.when(F.col("_s").isNull(), 0).otherwise(1)).drop("_k", "_s")


def as_of(log: DataFrame, seq: int, key: str = "k") -> DataFrame:
    return live(log.filter(F.col("seq") <= seq), key)


def tombstones(log: DataFrame, key: str = "k") -> DataFrame:
    return log.filter(F.col("entry_type") == DELETE).groupBy(key).agg(F.max("seq").alias("tomb_seq"))


def partial_fold(log: DataFrame, key: str = "k") -> DataFrame:
    """The latest row of each key in each file: what a hint file holds."""
    return latest(log, "file_id", key)


def merge_partials(partials: DataFrame, key: str = "k") -> DataFrame:
    """Fold partial folds of any grouping, in any order, with any repeats."""
    return live(partials, key)


def next_lsn(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("long").alias("next_lsn"))


def keyed_merge(a: DataFrame, b: DataFrame, key: str, resolve: Callable[[str], Column]) -> DataFrame:
    """Keyed union; ``resolve(column)`` is the aggregate that settles a column that both sides hold."""
    both = a.unionByName(b)
    return both.groupBy(key).agg(*[resolve(c).alias(c) for c in a.columns if c != key])


def upsert(base: DataFrame, new: DataFrame, key: str, replace: Column) -> DataFrame:
    """Insert rows of ``new``; where a key exists, replace it if ``replace`` (over aliases old, new) holds."""
    j = base.alias("old").join(new.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    take = F.col(f"old.{key}").isNull() | (F.col(f"new.{key}").isNotNull() & replace)
    return j.select(*[F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in base.columns])


def committed(log: DataFrame) -> DataFrame:
    """Puts and deletes outside batches, and those of batches that were ended; a second begin drops the open batch.

    A file is scanned in order, so the windows are by file: a file is at most one rotation long.
    """
    w = Window.partitionBy("file_id").orderBy("seq")
    mark = F.when(F.col("entry_type").isin(BEGIN, END), F.col("seq") * 10 + F.col("entry_type"))
    before = F.max(mark).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(mark).over(Window.partitionBy("file_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    return (
        log.withColumn("_b", before)
        .withColumn("_a", after)
        .filter(F.col("entry_type").isin(PUT, DELETE) & (F.col("_b").isNull() | (F.col("_b") % 10 == END) | (F.col("_a") % 10 == END)))
        .drop("_a", "_b")
    )
