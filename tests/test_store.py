import random

import pytest
from pyspark.sql import functions as F, types as T

from stratalog.functions.keys import crc32c, crc32c_many, decode_int, encode_int, int_key, succ
from stratalog.operators import fold
from stratalog.sources import codec
from stratalog.sources.relational import Table
from stratalog.sources.store import Batch, Store, WouldBlock, WritePlan
from stratalog.streaming.ingest import ingest, latest_values


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), max_file_bytes=200)


def as_dict(view):
    return {bytes(r["key"]): bytes(r["value"]) for r in view.relation().collect()}


def test_keys():
    assert crc32c(b"123456789") == 0xE3069283
    assert list(crc32c_many([b"", b"123456789", b"abc"])) == [crc32c(b""), 0xE3069283, crc32c(b"abc")]
    assert succ(b"a\xff") == b"b" and succ(b"\xff") is None
    assert sorted([5, -3, 0, -2**63], key=encode_int) == [-(2**63), -3, 0, 5] and decode_int(encode_int(-7)) == -7


def test_int_key_expression(spark):
    rows = spark.createDataFrame([(v,) for v in (-5, 0, 7, 2**62)], "v long").select("v", int_key(F.col("v")).alias("k")).collect()
    assert all(bytes(r["k"]) == encode_int(r["v"]) for r in rows)


def test_entry_and_hint_bytes():
    e = codec.encode_entry(42, 1, b"hello", b"world")
    assert len(e) == 29 and e[0:8] == (42).to_bytes(8, "little") and e[8] == 1 and e[9:11] == b"\x05\x00" and e[15:25] == b"helloworld"
    assert codec.decode_entries(e) == [(42, 1, b"hello", b"world", 0)]
    h = codec.encode_hints([(1, 1, b"user:alice", 0, 10), (2, 1, b"user:bob", 100, 20)])
    assert len(h) == 65 and [r[2] for r in codec.decode_hints(h)] == [b"user:alice", b"user:bob"]
    with pytest.raises(codec.Corrupt):
        codec.decode_hints(h[:3] + bytes([h[3] ^ 1]) + h[4:])
    with pytest.raises(codec.Corrupt):
        codec.decode_entries(e + e[:10])
    assert len(codec.decode_entries(e + e[:10], torn="truncate")) == 1


def test_binary_round_trip(spark, tmp_path):
    rows = [(1, 1, b"good", b"v", 7, None, 1), (2, 3, b"", b"", 7, None, 0), (3, 1, b"orphan", b"x", 7, None, 1), (4, 1, b"", b"", 8, None, 0)]
    from stratalog.plans.model import LOG

    for r in codec.to_binary(spark.createDataFrame(rows, LOG)).collect():
        (tmp_path / f"data_{r['file_id']}.data").write_bytes(r["data"])
        (tmp_path / f"data_{r['file_id']}.hint").write_bytes(r["hint"])
    log = codec.read_log(spark, str(tmp_path))
    assert sorted((r["seq"], r["entry_type"], bytes(r["key"])) for r in log.collect()) == [(1, 1, b"good"), (2, 3, b""), (3, 1, b"orphan"), (4, 1, b"")]
    assert {bytes(r["key"]) for r in fold.live(fold.committed(log), "key").collect()} == {b"good", b""}
    assert codec.read_hints(spark, str(tmp_path)).count() == 3


def test_against_a_dict(spark, store):
    rng, want = random.Random(98765), {}
    for _ in range(14):
        key = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 3))).encode()
        x = rng.random()
        if x < 0.4:
            k, v = key(), bytes(rng.choices(range(65, 123), k=rng.randint(0, 32)))
            store.put(k, v)
            want[k] = v
        elif x < 0.6:
            k = key()
            assert store.delete(k) == (k in want)
            want.pop(k, None)
        else:
            b = Batch()
            for _ in range(rng.randint(2, 5)):
                k = key()
                if rng.random() < 0.25:
                    b.delete(k)
                    want.pop(k, None)
                else:
                    want[k] = b"batch"
                    b.put(k, b"batch")
            store.apply(b)
    assert as_dict(store) == want
    for _ in range(20):
        if not store.vacuum():
            break
    store.gc()
    again = Store(spark, store.path)
    assert as_dict(again) == want
    assert [bytes(r[0]) for r in again.scan(b"c", keys_only=True).collect()] == sorted(k for k in want if k >= b"c")
    assert [bytes(r[0]) for r in again.rscan(b"c", keys_only=True, limit=3).collect()] == sorted((k for k in want if k <= b"c"), reverse=True)[:3]


def test_guards(store):
    store.apply(Batch().put(b"a", b"1").put(b"b", b"2").put(b"c", b"3"))
    snap = store.snapshot()
    store.put(b"b", b"new")
    yes, no = lambda p: store.apply_if(snap, p), lambda p: not store.apply_if(snap, p)
    assert no(WritePlan().put(b"b", b"x"))
    assert yes(WritePlan().ensure_present(b"a")) and no(WritePlan().ensure_present(b"zz"))
    assert yes(WritePlan().ensure_absent(b"zz")) and no(WritePlan().ensure_absent(b"a"))
    assert yes(WritePlan().ensure_unchanged(b"a")) and no(WritePlan().ensure_unchanged(b"b"))
    assert no(WritePlan().ensure_range_unchanged(b"a", b"c")) and yes(WritePlan().ensure_range_unchanged(b"c", b"d")) and yes(WritePlan())
    with pytest.raises(ValueError):
        WritePlan().ensure_present(b"a").ensure_absent(b"a")
    assert yes(WritePlan().put(b"c", b"4")) and store.get(b"c") == b"4" and snap.get(b"c") == b"3" and snap.get(b"b") == b"2"
    store.gc()
    assert snap.get(b"a") == b"1"


def test_transaction_and_lost_race(store):
    store.put(b"k", b"0")
    t = store.begin()
    t.put(b"n", b"1")
    t.delete(b"k")
    assert t.get(b"n") == b"1" and t.get(b"k") is None and [bytes(r["key"]) for r in t.scan().collect()] == [b"n"]
    assert t.commit() and as_dict(store) == {b"n": b"1"}
    real, lost = store._publish, []
    store._publish = lambda m: bool(lost) and real(m) or lost.append(1)
    with pytest.raises(WouldBlock):
        store.put(b"z", b"", try_lock=True)
    store.put(b"z", b"")
    assert store.get(b"z") == b"" and store.contains(b"z")


def test_tables_and_streams(spark, store, tmp_path):
    t = Table(store, "t", T.StructType.fromDDL("id long, name string"), "id")
    t.insert(spark.createDataFrame([(2, "b"), (-1, None)], "id long, name string"))
    assert sorted((r["id"], r["name"]) for r in t.frame().collect()) == [(-1, None), (2, "b")]
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(2, "again")], "id long, name string"))
    assert t.update(2, {"id": 2, "name": "c"}) and not t.update(9, {"id": 9, "name": "c"})
    t.drop()
    assert t.frame().count() == 0
    t.insert(spark.createDataFrame([(7, "seven")], "id long, name string"))
    assert t.get(7) == {"id": 7, "name": "seven"} and t.get(8) is None and t.count() == 1
    t.drop()
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "x", "1", "put"), (2, "y", "2", "put"), (3, "x", None, "delete")], "seq long, key string, value string, op string").write.parquet(src)
    stream = spark.readStream.schema("seq long, key string, value string, op string").parquet(src)
    ingest(stream, store, "s", "seq", str(tmp_path / "cp")).awaitTermination(60)
    assert as_dict(store) == {b"y": b"2"}
    assert not store.apply_frame(spark.createDataFrame([(1, b"q", b"", "put")], "seq long, key binary, value binary, op string"), "seq", ("s", 0))
    q = latest_values(stream, "key").writeStream.format("memory").queryName("lv").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["key"]: r["seq"] for r in spark.table("lv").collect()} == {"x": 3, "y": 2}


def frame(spark, rows):
    return spark.createDataFrame(rows, "o long, key binary, value binary, op string")


@pytest.fixture
def far(spark, tmp_path):
    """A store that goes through Hadoop's file systems only."""
    s = Store(spark, f"file://{tmp_path}/far", max_file_bytes=200)
    s._local = None
    return s


def test_file_systems_without_links(far):
    far.put(b"a", b"1")
    far.put(b"b", b"2")
    m = far._latest()
    assert far.get(b"a") == b"1" and not far._publish(m) and far._publish(m | {"version": m["version"] + 1})
    snap = far.snapshot()
    assert far.gc() == [] and snap.get(b"b") == b"2"
    snap.close()
    assert not [n for n in far._names("manifest") if n.startswith(".") and not n.endswith(".crc")] and not far._names("pins")


def test_torn_manifests_are_passed_over(spark, store, far):
    for s in (store, far):
        s.put(b"a", b"1")
        path = s.path.removeprefix("file://")
        for body in (b"", b"{", b"00000000\n{}"):
            with open(f"{path}/manifest/{s._versions()[-1] + 1:020d}.json", "wb") as f:
                f.write(body)
            assert s.get(b"a") == b"1" and Store(spark, s.path).get(b"a") == b"1"
        snap = s.snapshot()
        s.put(b"a", b"2")
        s.gc(keep=1)
        assert s.get(b"a") == b"2" and snap.get(b"a") == b"1"


def test_pins_hold_for_other_processes(spark, store):
    store.put(b"a", b"1")
    snap = store.snapshot()
    other = Store(spark, store.path)
    other.put(b"a", b"2")
    other.delete(b"a")
    assert other.gc() == [] or snap.get(b"a") == b"1"
    assert snap.get(b"a") == b"1"
    snap.close()
    other.gc()
    late = Store(spark, store.path, pin_seconds=-10).snapshot()
    other.put(b"b", b"1")
    other.gc()
    assert late.pinned not in other._versions()  # its time was over


def test_segments_that_no_manifest_names_go_after_a_while(store):
    store.put(b"a", b"1")
    store._append(store._latest(), [(1, b"lost", b"x")])  # written, never published
    assert store.gc() == [] and len(store.gc(grace=-5)) == 1
    assert store.get(b"a") == b"1" and store.get(b"lost") is None


def test_damaged_pages_are_found(spark, store):
    import glob
    import os

    value = random.Random(1).randbytes(2000)  # a page has it as it is
    store.put(b"k", value)
    path = next(p for p in glob.glob(f"{store.path}/segments/*/*.parquet"))
    data = bytearray(open(path, "rb").read())
    at = data.index(value[100:120])
    data[at] ^= 1
    open(path, "wb").write(bytes(data))
    for crc in glob.glob(f"{store.path}/segments/*/.*.crc"):
        os.unlink(crc)
    assert store.get(b"k") != value  # not looked at
    for view in (Store(spark, store.path, verify_checksums=True), store.snapshot()):
        with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
            view.get(b"k")


def test_bulk_writes_fill_files(spark, store):
    from stratalog.plans.model import BEGIN, END, ENTRY_OVERHEAD

    store.put(b"first", b"x" * 40)
    rows = [(i, f"k{i % 37:03d}".encode(), (b"v%d" % i) * 3, "delete" if i % 10 == 7 else "put") for i in range(60)]
    store.apply_frame(frame(spark, rows).repartition(5), "o")
    store.put(b"last", b"y")
    want = {b"first": b"x" * 40, b"last": b"y"}
    for _, k, v, op in rows:
        want.pop(k, None) if op == "delete" else want.__setitem__(k, v)
    assert as_dict(store) == want
    log = sorted(((r["seq"], r["entry_type"], bytes(r["key"]), len(r["value"]), r["file_id"], r["file_offset"]) for r in store.log().collect()))
    assert [r[0] for r in log] == list(range(1, len(log) + 1)) and store._latest()["next_lsn"] == len(log) + 1
    files = {f: [r for r in log if r[4] == f] for f in {r[4] for r in log}}
    assert len(files) > 8
    for rows_ in files.values():  # entries follow one another, a file begins below its bound, and batches are closed
        at = 0
        for _, _, k, n, _, offset in rows_:
            assert offset == at
            at += ENTRY_OVERHEAD + len(k) + n
        kinds = [r[1] for r in rows_]
        assert kinds.count(BEGIN) == kinds.count(END) and rows_[-1][5] < 200 + 4 * ENTRY_OVERHEAD
    assert {bytes(r["key"]) for r in fold.live(fold.committed(store.log()), "key").collect()} == set(want)
    assert store.vacuum() and as_dict(store) == want


def test_an_insert_that_loses_a_race_is_refused(spark, store):
    t = Table(store, "t", T.StructType.fromDDL("id long, name string"), "id")
    real, raced = store._publish, []

    def late(m):
        if not raced:
            raced.append(1)
            Table(Store(spark, store.path), "t", t.schema, "id").insert(spark.createDataFrame([(1, "other")], "id long, name string"))
        return real(m)

    store._publish = late
    with pytest.raises(ValueError, match="duplicate"):
        t.insert(spark.createDataFrame([(1, "mine")], "id long, name string"))
    assert t.get(1) == {"id": 1, "name": "other"}


def test_two_writers(spark, store):
    other = Store(spark, store.path, max_file_bytes=200)
    for i in range(4):
        (store if i % 2 else other).put(b"k%d" % i, b"%d" % i)
    assert as_dict(store) == as_dict(other) == {b"k%d" % i: b"%d" % i for i in range(4)} and store.size() == 4 and not store.empty()


def test_isolation_recipes(store):
    store.apply(Batch().put(b"doc:a", b"on").put(b"doc:b", b"on"))
    # Write skew: each of two takes one off call if the other stays; what was read is guarded, so the second fails.
    one, two = store.snapshot(), store.snapshot()
    assert store.apply_if(one, WritePlan().put(b"doc:a", b"off").ensure_unchanged(b"doc:b"))
    assert not store.apply_if(two, WritePlan().put(b"doc:b", b"off").ensure_unchanged(b"doc:a"))
    # Phantom: a key appears in a range that was read.
    snap = store.snapshot()
    store.put(b"doc:c", b"on")
    assert not store.apply_if(snap, WritePlan().put(b"count", b"2").ensure_range_unchanged(b"doc:", b"doc;"))
    # Unique names: the first takes it.
    snap = store.snapshot()
    assert store.apply_if(snap, WritePlan().ensure_absent(b"name:x").put(b"name:x", b"1"))
    assert not store.apply_if(snap, WritePlan().ensure_absent(b"name:x").put(b"name:x", b"2")) and store.get(b"name:x") == b"1"
    # A serializable transaction guards what it reads.
    from stratalog.sources.store import Transaction

    t = Transaction(store, serializable=True)
    assert t.get(b"doc:a") == b"off"
    t.put(b"sum", b"0")
    store.put(b"doc:a", b"on")
    assert not t.commit() and store.get(b"sum") is None
    t = Transaction(store, serializable=True)
    t.scan(b"doc:", b"doc;")
    t.put(b"sum", b"0")
    store.delete(b"doc:c")
    assert not t.commit()


def test_many_segments_become_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "m"))
    for i in range(5):
        store.put(b"k%d" % (i % 3), b"%d" % i)
    before = as_dict(store)
    snap = store.snapshot()
    assert not store.merge() and store.merge(at_least=5) and len(store._latest()["segments"]) == 1
    assert as_dict(store) == before == as_dict(snap) and store.get(b"k1") == b"4"
    store.put(b"k9", b"x")
    assert sorted((r["seq"], r["file_offset"]) for r in store.log().collect()) == [(i + 1, 22 * i) for i in range(6)]


def test_stale_reads(spark, store):
    store.put(b"a", b"1")
    stale = Store(spark, store.path, staleness=3600)
    assert stale.get(b"a") == b"1"
    store.put(b"a", b"2")
    assert stale.get(b"a") == b"1" and Store(spark, store.path).get(b"a") == b"2"
    stale.put(b"b", b"3")  # one's own write is seen, and what it follows
    assert stale.get(b"b") == b"3" and stale.get(b"a") == b"2"
