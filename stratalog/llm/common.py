"""What the operators share."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: The white space that ends a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes up to which a table may be broadcast; larger ones are left to Spark, which shuffles them.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch on its way to a Python worker (Spark's own bound is far above what a small executor has room for).
BATCH_BYTES = 4 << 20
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""

    def of(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _FIXED):
            return F.lit(16)
        if not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            c = F.to_json(F.struct(c))
        return 16 + F.coalesce(F.octet_length(c), F.lit(0))

    return sum((of(f) for f in df.schema), F.lit(16)).cast("long")


def small(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, with a broadcast hint only if its measured bytes are within the bound; else Spark shuffles it."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= size else df


def slim(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES; a lower bound of its own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@cache
def _trim():
    """Gives free memory of the C heap back to the machine; does nothing where the C library has no such call."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


_HELD: dict = {}


def held(key: Hashable, make: Callable):
    """What a worker process keeps from task to task: ``make()`` at first, until a task of another operator lets it go."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of what tasks of another operator have held in this worker process."""
    if _HELD:
        _HELD.clear()
        _trim()(0)


def parts(b: pa.RecordBatch, text: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``b`` in slices of about ``size`` bytes of text, one row at least; free memory goes back after each."""
    n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(n), 0
    while lo < len(b):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield b.slice(lo, hi - lo)
        pa.default_memory_pool().release_unused()
        _trim()(0)
        lo = hi


def split_words(text: str | None) -> list[bytes]:
    """Words by WORD, in UTF-8: bytes.split() ends words at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (that of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for repeated words up to a bound."""

    BOUND = 60_000

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of ``k``-word windows, sorted; fewer words make one shingle, none make none."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    x = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        x = mix(x ^ h[j : n - k + 1 + j]) + np.uint64(j + 1)
    return np.unique(x)
