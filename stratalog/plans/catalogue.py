"""The query catalogue: one function of (spark, sf_dir) for each operator of the log."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratalog.operators import fold, guards, scan, stats
from stratalog.plans.model import kv, kvm, table, user_key

#: The versions that the snapshot queries pin.
SNAP_OLD, SNAP_NEW = 9000, 9950
ACTIVE_FILE = 9


def keydir(s, d) -> DataFrame:
    return fold.live(kv(s, d)).select("seq", "k", "v", "value_size", "file_id")


def _probes(s, d, name="customer", col="c_custkey", times=1) -> DataFrame:
    return table(s, d, name).select(user_key(F.col(col) * times).alias("k"))


def _snap(s, d, seq) -> DataFrame:
    return fold.as_of(kv(s, d), seq).select("k", "seq")


def _version(s, d, seq) -> DataFrame:
    return fold.as_of(kv(s, d), seq).select("k", "seq", "value_size")


def _guard_plan(s, d) -> DataFrame:
    return table(s, d, "customer").select(user_key("c_custkey").alias("k"), (F.col("c_custkey") % 4).cast("int").alias("g"))


def _writes(s, d) -> DataFrame:
    gone = F.col("s_suppkey") % 5 == 0
    return table(s, d, "supplier").select(user_key(F.col("s_suppkey") * 3).alias("k"), F.when(~gone, F.col("s_name")).alias("v"), gone.alias("del"))


def _tables(s, d) -> DataFrame:
    def enc(name, prefix, key, value):
        return table(s, d, name).select(F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 10, "0")).alias("k"), F.col(value).alias("v"))

    return enc("customer", "t00000001", "c_custkey", "c_name").unionByName(enc("supplier", "t00000002", "s_suppkey", "s_name"))


def _kv_cols(df: DataFrame) -> DataFrame:
    return df.select("k", "v")


QUERIES = {
    "keydir_fold": lambda s, d: keydir(s, d).select("k", "seq", "file_id", "value_size"),
    "get_point": lambda s, d: _kv_cols(scan.get(keydir(s, d), "user::000042")),
    "multi_get": lambda s, d: _kv_cols(scan.multi_get(fold.live_of(kv(s, d), _probes(s, d)), _probes(s, d))),
    "contains_key": lambda s, d: scan.contains(fold.live_of(kv(s, d).drop("v", "value_size"), _probes(s, d)), _probes(s, d)),
    "iter_from": lambda s, d: _kv_cols(scan.scan(keydir(s, d), "user::000040")),
    "iter_from_limit50": lambda s, d: _kv_cols(scan.scan(keydir(s, d), "user::000040", limit=50)),
    "keys_from_prefix": lambda s, d: scan.prefix_scan(keydir(s, d), "user::0001", keys_only=True),
    "riter_from_limit10": lambda s, d: _kv_cols(scan.rscan(keydir(s, d), "user::0001zz", limit=10)),
    "rkeys_from_all": lambda s, d: scan.rscan(keydir(s, d), keys_only=True),
    "range50_per_start": lambda s, d: scan.range_n_per_start(keydir(s, d), 50),
    "lower_bound": lambda s, d: scan.bound(keydir(s, d), _probes(s, d, "supplier", "s_suppkey", 2)),
    "upper_bound": lambda s, d: scan.bound(keydir(s, d), _probes(s, d, "supplier", "s_suppkey", 2), strict=True, name="ub"),
    "tombstone_map": lambda s, d: fold.tombstones(kv(s, d)),
    "hint_dedup_per_file": lambda s, d: fold.partial_fold(kv(s, d)).select("file_id", "k", "seq", "entry_type", "value_size"),
    "recovery_merge_from_hints": lambda s, d: fold.merge_partials(fold.partial_fold(kv(s, d))).select("k", "seq", "file_id", "value_size"),
    "upsert_newer": lambda s, d: fold.upsert(_version(s, d, SNAP_OLD), keydir(s, d).select("k", "seq", "value_size"), "k", F.col("new.seq") > F.col("old.seq")),
    "merge_resolved": lambda s, d: fold.keyed_merge(_version(s, d, SNAP_OLD), _version(s, d, SNAP_NEW), "k", F.max),
    "live_size": lambda s, d: keydir(s, d).agg(F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) == 0).alias("is_empty")),
    "next_lsn": lambda s, d: fold.next_lsn(kv(s, d)),
    "file_stats": lambda s, d: stats.file_stats(kv(s, d)),
    "vacuum_candidate": lambda s, d: stats.vacuum_candidate(stats.file_stats(kv(s, d)), ACTIVE_FILE).select("file_id"),
    "vacuum_compact_output": lambda s, d: stats.compact_rows(kv(s, d), 8).select("seq", "k", "entry_type", "value_size"),
    "batch_aware_scan": lambda s, d: fold.committed(kvm(s, d)).select("seq", "k", "entry_type"),
    "batch_fold": lambda s, d: fold.live(fold.committed(kvm(s, d))).select("k", "seq"),
    "snapshot_as_of": lambda s, d: _snap(s, d, SNAP_OLD),
    "range_guard_conflicts": lambda s, d: guards.range_conflicts(_snap(s, d, SNAP_NEW), keydir(s, d), "user::000010", "user::000050"),
    "point_guard_verdicts": lambda s, d: guards.verdicts(_guard_plan(s, d), _snap(s, d, SNAP_NEW), keydir(s, d)),
    "ww_conflicts": lambda s, d: guards.write_conflicts(_probes(s, d), _snap(s, d, SNAP_NEW), keydir(s, d)),
    "txn_merge_iter": lambda s, d: guards.overlay(keydir(s, d), _writes(s, d)),
    "hint_prefix_len": lambda s, d: scan.prefix_lengths(keydir(s, d)),
    "table_prefix_scan": lambda s, d: scan.prefix_scan(_tables(s, d), "t00000002").select(F.substring("k", 10, 10).cast("long").alias("pk"), "v"),
}


def queries() -> dict:
    return dict(QUERIES)
