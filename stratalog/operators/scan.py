"""Point, bulk, range, prefix, reverse and bound lookups over the live relation."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from stratalog.functions.keys import prefix_range
from stratalog.plans.scratch import cut, ranked


def get(d: DataFrame, key, k: str = "k") -> DataFrame:
    return d.filter(F.col(k) == F.lit(key))


def multi_get(d: DataFrame, probes: DataFrame, k: str = "k") -> DataFrame:
    """Values of many keys at once. Spark broadcasts the probes only where their measured size allows it."""
    return probes.join(d, k)


def contains(d: DataFrame, probes: DataFrame, k: str = "k") -> DataFrame:
    hit = d.select(F.col(k).alias("_k"))
    return probes.join(hit, F.col(k) == F.col("_k"), "left").select(*probes.columns, F.when(F.col("_k").isNull(), 0).otherwise(1).alias("found"))


def scan(d: DataFrame, start=None, stop=None, k: str = "k", keys_only: bool = False, limit: int | None = None) -> DataFrame:
    """Ascending from ``start`` (empty: from the first key) to below ``stop``."""
    if start:
        d = d.filter(F.col(k) >= F.lit(start))
    if stop is not None:
        d = d.filter(F.col(k) < F.lit(stop))
    d = (d.select(k) if keys_only else d).orderBy(k)
    return d if limit is None else d.limit(limit)


def rscan(d: DataFrame, start=None, k: str = "k", keys_only: bool = False, limit: int | None = None) -> DataFrame:
    """Descending from the last key at or below ``start`` (empty: from the last key)."""
    if start:
        d = d.filter(F.col(k) <= F.lit(start))
    d = (d.select(k) if keys_only else d).orderBy(F.desc(k))
    return d if limit is None else d.limit(limit)


def prefix_scan(d: DataFrame, prefix, k: str = "k", keys_only: bool = False) -> DataFrame:
    d = d.filter(prefix_range(F.col(k), prefix))
    return (d.select(k) if keys_only else d).orderBy(k)


def range_n_per_start(d: DataFrame, n: int = 50, k: str = "k", size: int = 100_000) -> DataFrame:
    """The ``n`` keys from each key on: ranks once, then windows over ``size`` ranks, each with the first n - 1 of the next ones."""
    r = ranked(d.select(k), k)
    size = max(size, n)
    p = F.floor(F.col("i") / size)
    halo = (F.col("i") % size < n - 1) & (F.col("i") >= size)
    r = r.select(k, "i", F.explode(F.when(halo, F.array(p, p - 1)).otherwise(F.array(p))).alias("p"))
    ahead = Window.partitionBy("p").orderBy("i").rowsBetween(0, n - 1)
    own = r.withColumn("ahead", F.collect_list(k).over(ahead)).where(p == F.col("p"))
    return own.select(F.col(k).alias("start_key"), F.posexplode("ahead").alias("pos", k)).select("start_key", k, "pos")


def bound(d: DataFrame, probes: DataFrame, k: str = "k", strict: bool = False, name: str = "lb") -> DataFrame:
    """The first key at or above (``strict``: above) each probe.

    Probes and keys are sorted together, range by range; each probe takes the next key of its range or, past the
    range's end, the least key of the ranges after, of which there is one row per range. Windows run downwards from the
    end, so that a frame only grows: one that shrinks is computed anew for each row. A null probe has no answer.
    """
    # A key sorts before equal probes where it may not answer them, and after them where it may.
    rows = d.select(F.col(k).alias("k"), F.lit(0 if strict else 1).alias("o"), F.col(k).alias("hit")).unionByName(
        probes.select(F.col(k).alias("k"), F.lit(1 if strict else 0).alias("o"), F.lit(None).cast(d.schema[k].dataType).alias("hit")).distinct()
    )
    placed = cut(rows.repartitionByRange("k", "o").withColumn("p", F.spark_partition_id()), "bound")
    ahead = Window.partitionBy("p").orderBy(F.desc("k"), F.desc("o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = placed.groupBy("p").agg(F.min("hit").alias("f"))
    later = firsts.select("p", F.min("f").over(Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    near = placed.withColumn("near", F.last("hit", ignorenulls=True).over(ahead)).filter((F.col("o") == 1) == F.lit(strict))
    found = F.when(F.col("k").isNotNull(), F.coalesce("near", "later"))
    return near.join(F.broadcast(later), "p").select(F.col("k").alias("probe"), found.alias(name))


def prefix_lengths(d: DataFrame, k: str = "k", cap: int = 255) -> DataFrame:
    """Bytes (characters, for text) that each key shares with the key before it."""
    from stratalog.functions.keys import common_prefix

    r = cut(ranked(d.select(k), k), "prefix")
    before = r.select(F.col(k).alias("_pk"), (F.col("i") + 1).alias("i"))
    return r.join(before, "i", "left").select(k, common_prefix(F.col(k), F.coalesce(F.col("_pk"), F.lit(""))).cast("int").alias("prefix_len"))
