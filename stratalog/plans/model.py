"""Row layouts of the log, and the log views over the event tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Entry types of the log.
PUT, DELETE, BEGIN, END = 1, 2, 3, 4
#: Bytes of an entry beside its key and value: a 15-byte header and a 4-byte checksum.
ENTRY_OVERHEAD = 19
MAX_KEY, MAX_VALUE = 0xFFFF, 0xFFFFFFFF

LOG = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("entry_type", T.ByteType()), T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()), T.StructField("file_id", T.LongType()),
    T.StructField("file_offset", T.LongType()), T.StructField("value_size", T.LongType()),
])
HINT = T.StructType([f for f in LOG if f.name != "value"])


def entry_size(key: str, value_size: str) -> Column:
    return (F.lit(ENTRY_OVERHEAD) + F.octet_length(key) + F.col(value_size)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(c: str | Column) -> Column:
    return F.concat(F.lit("user::"), F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), 6, "0"))


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: each is a put, an ``error`` a tombstone; a thousand to a file."""
    e, dead = table(spark, sf_dir, "events"), F.col("event_type") == "error"
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(dead, DELETE).otherwise(PUT).alias("entry_type"),
        user_key("user_id").alias("k"),
        F.when(~dead | F.col("event_type").isNull(), F.col("props")).alias("v"),
        F.when(dead, 0).otherwise(F.length("props")).cast("long").alias("value_size"),
        F.floor(F.col("event_id") / 1000).cast("int").alias("file_id"),
        "ts",
    )


def kvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log with batch markers: ``signup`` opens a batch, ``purchase`` closes it."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    marker = kind.isin("signup", "purchase")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(kind == "signup", BEGIN).when(kind == "purchase", END).when(kind == "error", DELETE).otherwise(PUT).alias("entry_type"),
        F.when(~marker, user_key("user_id")).alias("k"),
        F.when(kind.isin("view", "click"), F.col("props")).alias("v"),
        F.floor(F.col("event_id") / 1000).cast("int").alias("file_id"),
    )
