"""Lineage cuts and distributed ranks.

Intermediate tables go, as Parquet, to the folder that the cluster names in
``spark.checkpoint.dir``: every executor can read them again after another one is lost.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder. Where the session names none, a fresh local one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: computed once, recoverable, no lineage behind it."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, *order: str, rank: str = "i", total: tuple[str, str] | None = None) -> DataFrame:
    """Dense 0-based global rank by ``order``, without a single-partition window.

    Rows are range-partitioned and sorted once; a row's rank is its place in its range plus the rows of the
    ranges before. Only one count per range (a few thousand rows at most) crosses between tasks. ``total`` (column, name)
    also gives the sum of a column over all rows before.
    """
    placed = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_p", F.shiftright("_m", 33))
        .withColumn("_r", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_m")
    )
    placed = cut(placed, "ranked")
    size = F.col(total[0]) if total else F.lit(0)
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_t"))
    if total:
        inside = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_c", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    # One row per range: as many as there are shuffle partitions, whatever the data.
    out = placed.join(F.broadcast(base), "_p").withColumn(rank, F.col("_b") + F.col("_r"))
    if total:
        out = out.withColumn(total[1], F.col("_t") + F.col("_c")).drop("_c")
    return out.drop("_p", "_r", "_b", "_t")
