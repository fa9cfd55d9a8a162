"""Liveness statistics by file, and what compaction would do."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratalog.operators.fold import with_live
from stratalog.plans.model import DELETE, entry_size


def file_stats(log: DataFrame, key: str = "k") -> DataFrame:
    size = entry_size(key, "value_size")
    return with_live(log, key).groupBy("file_id").agg(
        F.sum(F.col("live") * size).cast("long").alias("live_bytes"), F.sum(size).cast("long").alias("total_bytes")
    )


def fragmentation(stats: DataFrame) -> DataFrame:
    frag = F.when(F.col("total_bytes") > 0, 1.0 - F.col("live_bytes").cast("double") / F.col("total_bytes").cast("double")).otherwise(0.0)
    return stats.withColumn("fragmentation", frag)


def vacuum_candidate(stats: DataFrame, active_file: int, threshold: float = 0.5) -> DataFrame:
    """The most fragmented sealed file strictly above the threshold, the lowest id on ties; none, then no row."""
    f = fragmentation(stats).filter((F.col("file_id") < active_file) & (F.col("total_bytes") > 0) & (F.col("fragmentation") > threshold))
    return f.orderBy(F.desc("fragmentation"), "file_id").limit(1)


def compact_rows(log: DataFrame, file_id: int, key: str = "k") -> DataFrame:
    """What is kept of a file: live puts, and every tombstone. Only the file's own keys meet the rest of the log."""
    mine = log.filter(F.col("file_id") == file_id)
    newer = log.join(mine.select(key).distinct(), key, "left_semi")
    kept = with_live(newer, key)
    return kept.filter((F.col("file_id") == file_id) & ((F.col("live") == 1) | (F.col("entry_type") == DELETE)))
