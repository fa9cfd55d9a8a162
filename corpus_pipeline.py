"""From raw documents to packed training sequences."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import lang_id, mixing, near_dup, packing, secrets
from stratalog.plans.scratch import cut

STAGES = [
    ("language_id", lang_id.stage),
    ("near_dedup", near_dup.stage),
    ("secret_scan", secrets.stage),
    ("source_mix", mixing.stage),
    ("packing", packing.stage),
]

#: Learned profiles, sketches, a forest and a tokenizer: SQL cannot express the stages; they are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
