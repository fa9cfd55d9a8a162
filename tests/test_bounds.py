"""Bounds against bisection, within one range and over several."""
import bisect
import time

import pytest
from pyspark.sql import functions as F

from stratalog.operators import scan


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def expected(keys, probes, strict):
    find, keys = bisect.bisect_right if strict else bisect.bisect_left, sorted(k for k in keys if k is not None)
    at = {p: find(keys, p) for p in probes if p is not None}
    return {p: keys[i] if i < len(keys) else None for p, i in at.items()} | ({None: None} if None in probes else {})


@pytest.fixture
def one_range_each(spark):
    """Ranges as they are cut, not merged by size."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


STRICT = [False, True]


@pytest.mark.parametrize("strict", STRICT)
def test_many_rows_in_one_range(spark, strict):
    """Small rows are merged to one range: the seconds must not grow with the square of its rows."""
    n = 50_000
    keys = spark.range(n).select(F.format_string("user::%06d", F.col("id") * 3).alias("k"))
    probes = spark.range(n).select(F.format_string("user::%06d", F.col("id") * 4).alias("k"))
    began = time.time()
    got = {r[0]: r[1] for r in scan.bound(keys, probes, strict=strict).collect()}
    assert time.time() - began < 40
    assert got == expected([f"user::{i * 3:06d}" for i in range(n)], [f"user::{i * 4:06d}" for i in range(n)], strict)


@pytest.mark.parametrize("strict", STRICT)
@pytest.mark.parametrize("keys", [["c", "m", "z", None], ["b"], ["zz"], [], [f"k{i:03d}" for i in range(0, 500, 7)]])
def test_ranges_without_keys(spark, one_range_each, strict, keys):
    probes = [None, None, "a", "b", "c", "c", "m", "zz", "zzz"] + [f"k{i:03d}" for i in range(490)]
    got = scan.bound(frame(spark, keys), frame(spark, probes), strict=strict).collect()
    assert len(got) == len(set(probes)) and {r[0]: r[1] for r in got} == expected(keys, probes, strict)
