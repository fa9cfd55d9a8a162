"""The store: immutable Parquet segments, and manifests of which each names one version.

A commit writes its rows as segments, then publishes the next manifest under a name that must be free; whoever comes
second evaluates its guards anew. Nothing of a commit is visible before its manifest, so a batch is atomic and durable
before it is seen. A manifest is written beside its name and moved there whole, and carries its checksum: one that is
torn or damaged all the same is passed over. Pins are files too, so that no process deletes what another one reads.
"""
from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from stratalog.functions.keys import crc32c
from stratalog.operators import fold, guards, scan as scans
from stratalog.plans.model import BEGIN, DELETE, END, ENTRY_OVERHEAD, LOG, MAX_KEY, MAX_VALUE, PUT

MIB = 1 << 20


class WouldBlock(RuntimeError):
    """Another writer was first, and the caller didn't want to wait."""


@dataclass
class Batch:
    """Ordered puts and deletes; the last of a key wins."""

    ops: list[tuple[int, bytes, bytes]] = field(default_factory=list)

    def put(self, key: bytes, value: bytes) -> Batch:
        self.ops.append((PUT, key, value))
        return self

    def delete(self, key: bytes) -> Batch:
        self.ops.append((DELETE, key, b""))
        return self


class WritePlan:
    """Writes and the conditions under which they may be committed."""

    def __init__(self):
        self.writes: dict[bytes, tuple[int, bytes]] = {}
        self.guards: dict[bytes, int] = {}
        self.ranges: list[tuple[bytes, bytes]] = []

    def put(self, key: bytes, value: bytes) -> WritePlan:
        self.writes[key] = (PUT, value)
        return self

    def delete(self, key: bytes) -> WritePlan:
        self.writes[key] = (DELETE, b"")
        return self

    def _guard(self, key: bytes, kind: int) -> WritePlan:
        if self.guards.setdefault(key, kind) != kind:
            raise ValueError("a key can have one guard only")
        return self

    def ensure_present(self, key: bytes) -> WritePlan:
        return self._guard(key, 1)

    def ensure_absent(self, key: bytes) -> WritePlan:
        return self._guard(key, 2)

    def ensure_unchanged(self, key: bytes) -> WritePlan:
        return self._guard(key, 3)

    def ensure_range_unchanged(self, low: bytes, high: bytes) -> WritePlan:
        self.ranges.append((low, high))
        return self


class View:
    """Reads of one version."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest = store, manifest

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Rows of the segments whose key range meets [low, high]: the others are not opened."""
        spark, root = self.store.spark, self.store.path
        segs = [s for s in self.manifest["segments"] if (low is None or s["max_key"] is None or bytes.fromhex(s["max_key"]) >= low) and (high is None or s["min_key"] is None or bytes.fromhex(s["min_key"]) <= high)]
        if not segs:
            return spark.createDataFrame([], LOG)
        read = spark.read.schema(LOG).option("parquet.page.verify-checksum.enabled", str(self.verify).lower())
        return read.parquet(*[f"{root}/segments/{s['name']}" for s in segs])

    @property
    def verify(self) -> bool:
        """Whether what is read is held against the checksums of its pages; snapshots always are."""
        return True

    def _live(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        rows = self.log(low, high).filter(F.col("entry_type").isin(PUT, DELETE))
        if low is not None:
            rows = rows.filter(F.col("key") >= F.lit(low))
        if high is not None:
            rows = rows.filter(F.col("key") <= F.lit(high))
        return fold.live(rows, "key")

    def relation(self) -> DataFrame:
        """key, value, seq of every live key."""
        return self._live().select("key", "value", "seq")

    def get(self, key: bytes) -> bytes | None:
        r = self._live(key, key).select("value").first()
        return None if r is None else bytes(r["value"])

    def contains(self, key: bytes) -> bool:
        return not self._live(key, key).select("key").isEmpty()

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """Values of many keys: the log is cut to the probes' keys before it is folded."""
        rows = self.log().filter(F.col("entry_type").isin(PUT, DELETE)).join(probes.select("key").distinct(), "key", "left_semi")
        return scans.multi_get(fold.live(rows, "key").select("key", "value"), probes, "key")

    def scan(self, start: bytes = b"", stop: bytes | None = None, keys_only: bool = False, limit: int | None = None) -> DataFrame:
        return scans.scan(self._live(start or None, stop).select("key", "value"), None, stop, "key", keys_only, limit)

    def rscan(self, start: bytes = b"", keys_only: bool = False, limit: int | None = None) -> DataFrame:
        return scans.rscan(self._live(None, start or None).select("key", "value"), None, "key", keys_only, limit)

    def prefix(self, prefix: bytes, keys_only: bool = False) -> DataFrame:
        return scans.prefix_scan(self._live(prefix or None).select("key", "value"), prefix, "key", keys_only)

    def size(self) -> int:
        return self._live().count()

    def empty(self) -> bool:
        return self._live().isEmpty()


class Store(View):
    """An ordered key-value store in a folder that every executor can reach.

    The folder's file system must move a file to a name only if that is free (HDFS and local ones do).
    """

    def __init__(self, spark: SparkSession, path: str, max_file_bytes: int = 64 * MIB, staleness: float = 0.0, verify_checksums: bool = False, pin_seconds: float = 7 * 86400, sync: bool = True):
        self.spark, self.path, self.max_file_bytes, self.staleness = spark, path.rstrip("/"), max_file_bytes, staleness
        self.verify_checksums, self.pin_seconds, self.sync = verify_checksums, pin_seconds, sync
        self._local = self.path.removeprefix("file://") if "://" not in self.path or self.path.startswith("file://") else None
        self._cached: dict | None = None
        self._looked = 0.0
        self._pins: set[str] = set()
        if self._latest() is None:
            self._publish({"version": 0, "time": time.time(), "next_lsn": 1, "active": 0, "active_bytes": 0, "segments": [], "streams": {}, "tables": {}})

    open = classmethod(lambda cls, *a, **k: cls(*a, **k))

    @property
    def verify(self) -> bool:
        return self.verify_checksums

    # manifests

    def _fs(self, p: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(p)
        return jvm, path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> dict[str, float]:
        """Names in a folder of the store, with the seconds at which they were last changed."""
        if self._local:
            d = f"{self._local}/{folder}"
            return {e.name: e.stat().st_mtime for e in os.scandir(d)} if os.path.isdir(d) else {}
        _, p, fs = self._fs(f"{self.path}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, version: int) -> dict | None:
        """A manifest; None if it isn't whole."""
        name = f"manifest/{version:020d}.json"
        if self._local:
            try:
                with open(f"{self._local}/{name}", "rb") as f:
                    body = f.read()
            except FileNotFoundError:
                return None
        else:
            body = bytes((self.spark.read.format("binaryFile").load(f"{self.path}/{name}").first() or {"content": b""})["content"])
        crc, _, text = body.partition(b"\n")
        return json.loads(text) if crc == b"%08x" % crc32c(text) else None

    def _latest(self) -> dict | None:
        """The newest whole manifest; under the number of a newer one that isn't whole, so that the next is free."""
        versions = self._versions()
        for v in reversed(versions):
            if (m := self._read(v)) is not None:
                return m | {"version": versions[-1], "read_from": v}
        return None

    def _put(self, name: str, body: bytes) -> bool:
        """Write a file whole, unless there is one of this name."""
        folder, tmp = name.rpartition("/")[0], f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        if self._local:
            os.makedirs(f"{self._local}/{folder}", exist_ok=True)
            with open(f"{self._local}/{tmp}", "xb") as f:
                f.write(body)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{self._local}/{tmp}", f"{self._local}/{name}")  # fails if the name is taken
                at = os.open(f"{self._local}/{folder}", os.O_RDONLY)
                os.fsync(at)
                os.close(at)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self._local}/{tmp}")
        jvm, src, fs = self._fs(f"{self.path}/{tmp}")
        out = fs.create(src, False)
        out.write(bytearray(body))
        out.close()
        _, dst, _ = self._fs(f"{self.path}/{name}")
        none = jvm.java.lang.reflect.Array.newInstance(jvm.org.apache.hadoop.fs.Options.Rename.NONE.getClass(), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), self.spark._jsc.hadoopConfiguration()).rename(src, dst, none)
            return True
        except Exception as e:
            if "AlreadyExists" in str(e):
                fs.delete(src, False)
                return False
            raise

    def _publish(self, m: dict) -> bool:
        """Publish the manifest of this version, unless there is one."""
        text = json.dumps({k: v for k, v in m.items() if k != "read_from"}).encode()
        return self._put(f"manifest/{m['version']:020d}.json", b"%08x\n" % crc32c(text) + text)

    @property
    def manifest(self) -> dict:
        """The newest version; with a staleness tolerance the one found by the last look, unless that is longer ago."""
        if self._cached is None or time.monotonic() - self._looked >= self.staleness:
            self.manifest = self._latest()
        return self._cached

    @manifest.setter
    def manifest(self, m: dict) -> None:
        self._cached, self._looked = m, time.monotonic()

    # writes

    def _segment(self, m: dict, rows: DataFrame, size: int, file_id: int) -> dict:
        name = f"{file_id:010d}-{uuid.uuid4().hex}"
        rows.select(*LOG.names).sortWithinPartitions("key", F.desc("seq")).write.parquet(f"{self.path}/segments/{name}")
        self._sync(f"segments/{name}")
        b = self.spark.read.schema(LOG).parquet(f"{self.path}/segments/{name}").filter(F.col("entry_type").isin(PUT, DELETE)).agg(F.min("key"), F.max("key")).first()
        hexed = [None if x is None else bytes(x).hex() for x in b]
        return {"name": name, "file_id": file_id, "bytes": size, "min_key": hexed[0], "max_key": hexed[1]}

    def _append(self, m: dict, ops: list[tuple[int, bytes, bytes]]) -> dict:
        """The next manifest, with ``ops`` in the active file."""
        if len(ops) > 1:
            ops = [(BEGIN, b"", b""), *ops, (END, b"", b"")]
        rows, at = [], m["active_bytes"]
        for i, (kind, k, v) in enumerate(ops):
            if len(k) > MAX_KEY or len(v) > MAX_VALUE:
                raise ValueError("key or value too long")
            rows.append((m["next_lsn"] + i, kind, bytearray(k), bytearray(v), m["active"], at, len(v)))
            at += ENTRY_OVERHEAD + len(k) + len(v)
        seg = self._segment(m, self.spark.createDataFrame(rows, LOG).coalesce(1), at - m["active_bytes"], m["active"])
        return self._next(m, [*m["segments"], seg], m["next_lsn"] + len(ops), at)

    def _next(self, m: dict, segments: list[dict], next_lsn: int, active_bytes: int) -> dict:
        full = active_bytes >= self.max_file_bytes
        return m | {"version": m["version"] + 1, "time": time.time(), "segments": segments, "next_lsn": next_lsn, "active": m["active"] + full, "active_bytes": 0 if full else active_bytes}

    def _commit(self, make, try_lock: bool = False):
        """``make(manifest)`` gives the next manifest, or another result to return without a commit."""
        while True:
            m = self._latest()
            new = make(m)
            if not isinstance(new, dict):
                return new
            if self._publish(new):
                self.manifest = new
                return True
            if try_lock:
                raise WouldBlock("another commit was first")

    def put(self, key: bytes, value: bytes, try_lock: bool = False) -> None:
        self._commit(lambda m: self._append(m, [(PUT, key, value)]), try_lock)

    def delete(self, key: bytes, try_lock: bool = False) -> bool:
        """Writes a tombstone only if the key is there."""
        return self._commit(lambda m: self._append(m, [(DELETE, key, b"")]) if View(self, m).contains(key) else False, try_lock)

    def apply(self, batch: Batch, try_lock: bool = False) -> None:
        """All or nothing. Deletes write tombstones whether or not the key is there."""
        if batch.ops:
            self._commit(lambda m: self._append(m, batch.ops), try_lock)

    def apply_frame(self, ops: DataFrame, order: str, stream: tuple[str, int] | None = None, check=None) -> bool:
        """A batch of any size in one commit: columns key, value, op (put or delete), in order of ``order``.

        The entries fill the active file and, ``max_file_bytes`` at a time, new ones; in each they are a batch of its
        own, between markers if there are several, and the manifest makes them one. ``stream`` (name, batch number) makes
        a repeated micro-batch a no-op. ``check(view)`` is called with the version that the commit will follow and may
        raise.
        """
        from stratalog.plans.scratch import cut, ranked

        kind = F.when(F.lower("op") == "delete", DELETE).otherwise(PUT)
        rows = ops.select(F.col("key").cast("binary").alias("key"), F.when(kind == PUT, F.coalesce(F.col("value").cast("binary"), F.lit(b""))).otherwise(F.lit(b"")).alias("value"), kind.cast("byte").alias("entry_type"), F.col(order).alias("_o"))
        size = (F.lit(ENTRY_OVERHEAD) + F.octet_length("key") + F.octet_length("value")).cast("long")
        rows = cut(ranked(rows.withColumn("_size", size), "_o", rank="_i", total=("_size", "_before")), "ops")
        n = rows.count()
        if n and rows.agg(F.max(F.octet_length("key")), F.max(F.octet_length("value"))).first() > (MAX_KEY, MAX_VALUE):
            raise ValueError("key or value too long")

        def make(m: dict):
            if stream and m["streams"].get(stream[0], -1) >= stream[1]:
                return False
            if check:
                check(View(self, m))
            new = m | {"streams": m["streams"] | dict([stream])} if stream else m
            if not n:
                return new | {"version": m["version"] + 1} if stream else False
            # The file of an entry is the one in which it begins, if files were cut at every max_file_bytes.
            file = F.floor((F.col("_before") + m["active_bytes"]) / self.max_file_bytes).cast("long")
            placed = rows.withColumn("_f", file)
            per = placed.groupBy("_f").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("first"), F.min("_before").alias("start"), F.sum("_size").alias("bytes")).orderBy("_f").collect()  # a row for each file
            plan, lsn = [], m["next_lsn"]
            for r in per:
                marks = int(r["n"] > 1)
                at = m["active_bytes"] if r["_f"] == 0 else 0
                plan.append((r["_f"], lsn + marks - r["first"], at + marks * ENTRY_OVERHEAD - r["start"], m["active"] + r["_f"]))
                lsn += r["n"] + 2 * marks
            where = self.spark.createDataFrame(plan, "_f long, _seq long, _at long, file_id long")
            entries = placed.join(where, "_f").select((F.col("_i") + F.col("_seq")).alias("seq"), "entry_type", "key", "value", "file_id", (F.col("_before") + F.col("_at")).alias("file_offset"), F.octet_length("value").cast("long").alias("value_size"))
            marks = []
            for r, (_, seq, at, f) in zip(per, plan, strict=True):
                if r["n"] > 1:
                    marks += [(r["first"] + seq - 1, BEGIN, bytearray(), bytearray(), f, at + r["start"] - ENTRY_OVERHEAD, 0), (r["first"] + seq + r["n"], END, bytearray(), bytearray(), f, at + r["start"] + r["bytes"], 0)]
            if marks:
                entries = entries.unionByName(self.spark.createDataFrame(marks, LOG))
            sizes = {f: r["bytes"] + (2 * ENTRY_OVERHEAD if r["n"] > 1 else 0) for r, (*_, f) in zip(per, plan, strict=True)}
            segs = self._segments(entries, sizes)
            last = plan[-1][3]
            new = new | {"active": last}
            return self._next(new, [*m["segments"], *segs], lsn, sizes[last] + (m["active_bytes"] if last == m["active"] else 0))

        return bool(self._commit(make))

    def _segments(self, rows: DataFrame, sizes: dict[int, int]) -> list[dict]:
        """A segment for each file of ``rows``, written in one job."""
        name = f"bulk-{uuid.uuid4().hex}"
        path = f"{self.path}/segments/{name}"
        rows.select(*LOG.names, F.col("file_id").alias("f")).sortWithinPartitions("f", "key", F.desc("seq")).write.partitionBy("f").parquet(path)
        self._sync(f"segments/{name}")
        keys = self.spark.read.parquet(path).filter(F.col("entry_type").isin(PUT, DELETE)).groupBy("f").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        return [{"name": f"{name}/f={r['f']}", "file_id": r["f"], "bytes": sizes[r["f"]], "min_key": bytes(r["lo"]).hex(), "max_key": bytes(r["hi"]).hex()} for r in keys.collect()]

    def _sync(self, name: str) -> None:
        """On a local disk, waits until a segment is there; other file systems see to that when a file is closed."""
        if not (self.sync and self._local):
            return
        for folder, _, files in os.walk(f"{self._local}/{name}"):
            for x in [f"{folder}/{f}" for f in files] + [folder]:
                at = os.open(x, os.O_RDONLY)
                os.fsync(at)
                os.close(at)

    # versions and guarded commits

    def snapshot(self) -> Snapshot:
        while True:  # a version that went before its pin was there is not taken
            snap = Snapshot(self, self._latest())
            if snap.pinned in self._versions():
                return snap
            snap.close()

    def apply_if(self, snap: View, plan: WritePlan, try_lock: bool = False) -> bool:
        """Commit ``plan`` if its guards hold and none of its keys was written since ``snap``; else False."""
        ops = [(kind, k, v) for k, (kind, v) in plan.writes.items()]

        def make(m: dict):
            if self._conflict(snap, View(self, m), plan):
                return False
            return self._append(m, ops) if ops else None

        got = self._commit(make, try_lock)
        return got is None or bool(got)

    def _conflict(self, snap: View, now: View, plan: WritePlan) -> bool:
        for low, high in plan.ranges:
            if not guards.range_conflicts(snap._live(low, high), now._live(low, high), low, high, "key").isEmpty():
                return True
        keys = sorted(plan.guards.keys() | plan.writes.keys())
        if not keys:
            return False
        frame = self.spark.createDataFrame([(bytearray(k), plan.guards.get(k, 0), k in plan.writes) for k in keys], "key binary, g int, w boolean")
        # The plan's keys, which are in the driver's memory already, cut both versions before they are folded.
        part = [v.log(keys[0], keys[-1]).filter(F.col("entry_type").isin(PUT, DELETE)).join(F.broadcast(frame.select("key")), "key", "left_semi") for v in (snap, now)]
        s, c = (fold.live(p, "key") for p in part)
        bad = guards.verdicts(frame, s, c, "key").filter("ok = 0").select("key").unionByName(guards.write_conflicts(frame.filter("w"), s, c, "key").select("key"))
        return not bad.isEmpty()

    def begin(self) -> Transaction:
        return Transaction(self)

    # maintenance

    def file_stats(self, m: dict | None = None) -> DataFrame:
        from stratalog.plans.model import entry_size

        rows = View(self, m or self._latest()).log()
        idx = fold.live(rows.filter(F.col("entry_type").isin(PUT, DELETE)), "key").select("seq").withColumn("live", F.lit(1))
        size = entry_size("key", "value_size")
        return rows.join(idx, "seq", "left").groupBy("file_id").agg(F.coalesce(F.sum(F.col("live") * size), F.lit(0)).cast("long").alias("live_bytes"), F.sum(size).cast("long").alias("total_bytes"))

    def vacuum(self, threshold: float = 0.5, absorb_bytes: int = MIB) -> bool:
        """Rewrite the most fragmented sealed file, or move its little live rest to the active one. False: nothing to do."""
        from stratalog.operators.stats import fragmentation
        from stratalog.plans.model import entry_size

        def make(m: dict):
            f = fragmentation(self.file_stats(m)).filter((F.col("file_id") < m["active"]) & (F.col("total_bytes") > 0) & (F.col("fragmentation") > threshold))
            view = View(self, m)
            for c in f.orderBy(F.desc("fragmentation"), "file_id").toLocalIterator():  # the first one does, mostly
                rows = view.log()
                idx = fold.live(rows.filter(F.col("entry_type").isin(PUT, DELETE)), "key").select("seq")
                mine = rows.filter(F.col("file_id") == c["file_id"])
                keep = mine.join(idx, "seq", "left_semi").unionByName(mine.filter(F.col("entry_type") == DELETE))
                size = keep.agg(F.coalesce(F.sum(entry_size("key", "value_size")), F.lit(0))).first()[0]
                if size >= c["total_bytes"]:
                    continue  # tombstones only: a rewrite would free nothing
                absorb = c["live_bytes"] <= absorb_bytes and c["live_bytes"] + m["active_bytes"] <= self.max_file_bytes
                to = m["active"] if absorb else c["file_id"]
                segs = [s for s in m["segments"] if s["file_id"] != c["file_id"]]
                # Entries follow one another in the new file; it is one rotation long at most.
                ahead = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
                at = F.coalesce(F.sum(entry_size("key", "value_size")).over(ahead), F.lit(0)) + (m["active_bytes"] if absorb else 0)
                keep = keep.withColumn("file_offset", at.cast("long"))
                if size:
                    segs.append(self._segment(m, keep.withColumn("file_id", F.lit(to).cast("long")), size, to))
                return self._next(m, segs, m["next_lsn"], m["active_bytes"] + (size if absorb else 0))
            return False

        return bool(self._commit(make))

    def merge(self, at_least: int = 8) -> bool:
        """One segment in the place of many: of the file with the most segments, if it has ``at_least`` so many."""

        def make(m: dict):
            count: dict[int, int] = {}
            for x in m["segments"]:
                count[x["file_id"]] = count.get(x["file_id"], 0) + 1
            most = max(count, key=lambda f: (count[f], -f), default=None)
            if most is None or count[most] < at_least:
                return False
            mine = [x for x in m["segments"] if x["file_id"] == most]
            rows = View(self, m | {"segments": mine}).log()
            one = self._segment(m, rows.coalesce(1), sum(x["bytes"] for x in mine), most)
            return self._next(m, [x for x in m["segments"] if x["file_id"] != most] + [one], m["next_lsn"], m["active_bytes"])

        return bool(self._commit(make))

    def gc(self, keep: int = 1, grace: float = 86400) -> list[str]:
        """Delete manifests but the last ``keep`` and those that any process has pinned, and segments that none of the
        rest names; of segments that no manifest ever named, those of the last ``grace`` seconds stay: their commits may
        be on their way. Pins of which the time is over are deleted too."""
        now, pinned = time.time(), set()
        for name in self._names("pins"):
            version, until, _ = name.split("-")
            if int(until) < now:
                self._remove(f"pins/{name}")
            else:
                pinned.add(int(version))
        versions = self._versions()
        whole = {v: m for v in versions if (m := self._read(v)) is not None}
        stay = set(versions[-keep:]) | set(sorted(whole)[-keep:]) | pinned
        used = {s["name"] for v, m in whole.items() if v in stay for s in m["segments"]}
        before = {s["name"] for m in whole.values() for s in m["segments"]}
        for v in versions:
            if v not in stay:
                self._remove(f"manifest/{v:020d}.json")
        known = {n.partition("/")[0] for n in used | before}
        orphans = {n for n, at in self._names("segments").items() if n not in known and at < now - grace}
        for name in (before - used) | orphans:
            self._remove(f"segments/{name}")
        return sorted((before - used) | orphans)

    def _remove(self, name: str) -> None:
        _, p, fs = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def close(self) -> None:
        """Gives up this object's pins. Nothing is buffered: every commit is durable when it is seen."""
        for name in list(self._pins):
            self._unpin(name)

    def _pin(self, version: int) -> str:
        name = f"{version}-{int(time.time() + self.pin_seconds) + 1}-{uuid.uuid4().hex}"
        self._put(f"pins/{name}", b"")
        self._pins.add(name)
        return name

    def _unpin(self, name: str) -> None:
        self._pins.discard(name)
        self._remove(f"pins/{name}")


class Snapshot(View):
    """A pinned version: no process's garbage collection removes it until close(), or until the pin's time is over."""

    def __init__(self, store: Store, manifest: dict):
        super().__init__(store, manifest)
        self.pinned = manifest.get("read_from", manifest["version"])
        self._name = store._pin(self.pinned)

    def close(self) -> None:
        self.store._unpin(self._name)


# Store reads its own newest version.
Store.store = property(lambda self: self)


class Transaction:
    """Reads its own writes over a snapshot; commits if nothing it wrote (``serializable``: or read) was changed."""

    def __init__(self, store: Store, serializable: bool = False):
        self.store, self.snap, self.plan, self.serializable = store, store.snapshot(), WritePlan(), serializable

    def put(self, key: bytes, value: bytes) -> None:
        self.plan.put(key, value)

    def delete(self, key: bytes) -> None:
        self.plan.delete(key)

    def get(self, key: bytes) -> bytes | None:
        if key in self.plan.writes:
            kind, v = self.plan.writes[key]
            return v if kind == PUT else None
        if self.serializable and key not in self.plan.guards:
            self.plan.ensure_unchanged(key)
        return self.snap.get(key)

    def scan(self, start: bytes = b"", stop: bytes | None = None) -> DataFrame:
        if self.serializable and stop is not None:
            self.plan.ensure_range_unchanged(start, stop)
        w = self.store.spark.createDataFrame([(bytearray(k), bytearray(v), kind == DELETE) for k, (kind, v) in self.plan.writes.items()], "key binary, value binary, del boolean")
        return scans.scan(guards.overlay(self.snap._live(start or None, stop), w, "key", "value"), start, stop, "key")

    def commit(self) -> bool:
        try:
            return self.store.apply_if(self.snap, self.plan)
        finally:
            self.snap.close()

    def rollback(self) -> None:
        self.snap.close()
