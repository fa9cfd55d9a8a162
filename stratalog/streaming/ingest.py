"""Structured Streaming into the store, and latest-value tables of a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.sources.store import Store


def ingest(stream: DataFrame, store: Store, name: str, order: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch (columns key, value, op, ``order``) is one commit; a batch that is run again is a no-op."""
    w = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    w = w.foreachBatch(lambda df, batch: store.apply_frame(df, order, (name, batch)) and None)
    return (w.trigger(availableNow=True) if once else w).start()


def latest_values(stream: DataFrame, key: str = "k", seq: str = "seq") -> DataFrame:
    """The newest row of each key so far, in update mode. No watermark: a higher sequence wins however late it comes."""
    rest = [c for c in stream.columns if c not in (key, seq)]
    top = F.max_by(F.struct(*rest), F.col(seq)).alias("_r")
    return stream.groupBy(key).agg(F.max(seq).alias(seq), top).select(key, seq, "_r.*")
