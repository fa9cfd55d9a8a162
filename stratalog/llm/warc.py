"""WARC archives: written by Spark's own text writer, read back with boundary-chain verification.

Writing: of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a response,
the others are revisits of it. A record is one line of the text writer: its line end closes the record. Files may be
gzipped.

Reading: Spark's text reader splits files by ranges, with the start of a record's magic as the line end, so that a task
has its range of a file from the first magic in it to the first one after it. A task emits, for every magic that begins
the file or follows a blank line, with which every record ends, the offset to which the record's length leads. Offsets
are relative until the sizes of the ranges before are known. Headers may be of any length, files and payloads too. Within
a range the chains are followed at once; what remains, one row for each range that a chain enters, is joined up by
pointer jumping from the file's start, doubling the distance each round. Only records on the chain from the start are
kept: a magic string within a payload is on no chain. Headers and payloads with a magic in them may go on in the next
range: the bytes of these few are fetched in a pass of their own. Files that end in ``.gz``, of one gzip member or of many,
are read by one task each, offsets being those of the content.

Null payloads are empty. Null page ids are written and read as null; among equal payloads they come before every id, and
without an id to revisit they are responses. Rows that repeat the largest page_id of a payload are all responses; other
rows are returned as often as they are there. White space and control characters in a url are left out of the archive.
A chain that ends before the end of its file is an error; of archives that may be cut off (``whole=False``) the records
up to there are read. No pages make archives without records, which read as none.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import slim, small
from stratalog.plans.scratch import cut, scratch_dir

#: How a record begins (the last digit of its version follows), and how header and record end.
MAGIC, BLANK, VERSION = b"WARC/1.", b"\r\n\r\n", "WARC/1.0"
#: The digits of conv() to base 32, and those of RFC 4648.
CONV32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes by which pieces of a file meet what is fetched of it.
PIECE = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits, ten hexadecimal digits, at a time."""
    h = F.sha1(payload)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(h, a, 10), 16, 32), 8, "0"), CONV32, BASE32) for a in (1, 11, 21, 31)])


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload, bytes, digest, kind and refers_to of each page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    p = p.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1("payload"))
    # Only digests that come more than once are joined: payloads stay where they are unless these are too many to broadcast.
    many = p.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null")
    j = p.join(small(cut(many.select("digest", "top"), "digests")), "digest", "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.col("bytes") >= min_bytes)
    return j.withColumn("kind", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("top"))).drop("top")


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write(recs: DataFrame, path: str, gzip: bool = False) -> None:
    """Archive files under ``path``, through whatever file system Spark has for it."""
    body = F.when(F.col("kind") == "response", F.col("payload")).otherwise("")
    uri = F.regexp_replace("url", r"[\x00-\x20]", "")
    line = F.concat(
        F.lit(VERSION), F.lit("\r\nWARC-Type: "), "kind", F.lit("\r\nWARC-Record-ID: "), _name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(F.col("kind") == "revisit", F.concat(F.lit("\r\nWARC-Refers-To: "), _name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r"),
    )
    recs.select(line.alias("value")).write.option("lineSep", "\n").option("compression", "gzip" if gzip else "none").text(path)


def header(data: bytes, at: int, end: int) -> dict[str, str] | None:
    """The fields of a header from its magic to before its blank line; None if it isn't one with a length."""
    fields = {}
    first, *lines = bytes(data[at:end]).split(b"\r\n")
    for line in lines:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    n = fields.get("content-length", "")
    return fields if n.isdigit() and n.isascii() and len(n) < 19 and first[len(MAGIC) :].isdigit() else None


def _page(name: str | None) -> int | None:
    x = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x.removeprefix("-").isdigit() and x.isascii() else None


_SAYS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "payload"]
_KINDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, payload binary"
_SCHEMA = "file string, range long, at long, next long, exit long, whole boolean, total long, file_size long, " + _KINDS


def says(f: dict[str, str], payload: bytes, keep: bool) -> tuple:
    """_SAYS of a record."""
    kind, said = f.get("warc-type", ""), f.get("warc-payload-digest", "").removeprefix("sha1:")
    n = len(payload) if kind == "response" else int(f["x-payload-length"]) if f.get("x-payload-length", "").isdigit() else None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else said
    return _page(f.get("warc-record-id")), n, digest, kind, _page(f.get("warc-refers-to")), digest == said, payload if keep else None


class Range:
    """The candidates of a range of a file, from its bytes as the reader gives them, between one magic and the next."""

    def __init__(self, first: bool, keep: bool):
        self.first, self.keep, self.pos, self.tail, self.n = first, keep, 0, None, 0
        self.buf, self.base, self.open, self.out = bytearray(), 0, [], []

    def feed(self, between: bytes) -> None:
        before = self.first and not self.n  # what the file has before any magic
        at = self.pos - (0 if before else len(MAGIC))
        self.pos += len(between) + len(MAGIC)
        self.n += 1
        # Of the first magic in a range that isn't the file's, what is before is not known here.
        new = not before and (at == 0 and self.first or self.tail is None or self.tail == BLANK)
        if new and not self.open:
            self.buf, self.base = bytearray(), at
        if new or self.open:
            if not before:
                self.buf += MAGIC
            self.buf += between
        self.tail = ((self.tail or b"") + (b"" if before else MAGIC) + between[-4:])[-4:]
        if new:
            self.open.append([at, at, None, 0])  # start, where to look for the header's end, fields, start of the payload
        self._settle()

    def _settle(self) -> None:
        still = []
        for r in self.open:
            if r[2] is None:
                end = self.buf.find(BLANK, r[1] - self.base)
                if end < 0:
                    r[1] = max(r[0], self.base + len(self.buf) - 3)
                    still.append(r)
                    continue
                r[2], r[3] = header(self.buf, r[0] - self.base, end), self.base + end + 4
                if r[2] is None:
                    continue
            after = r[3] - self.base + int(r[2]["content-length"])
            if len(self.buf) < after + 4:
                still.append(r)
            elif self.buf[after : after + 4] == BLANK:
                self.out.append((r[0], self.base + after + 4, True, *says(r[2], bytes(self.buf[r[3] - self.base : after]), self.keep)))
        self.open = still

    def rows(self, file: str, start: int, size: int) -> Iterator[tuple]:
        """The candidates, with where their chains leave the range; last a row with the range's size."""
        for r in self.open:
            self.out.append((r[0], None if r[2] is None else r[3] + int(r[2]["content-length"]) + 4, False, *[None] * len(_SAYS)))
        exits = {}
        for r in sorted(self.out, key=lambda r: -r[0]):
            exits[r[0]] = exits.get(r[1], r[1])
        for at, nxt, whole, *said in self.out:
            yield file, start, at, nxt, exits[at], whole, None, None, *said
        yield file, start, None, None, None, None, self.pos, size, *[None] * len(_SAYS)


def _lines(path: str, spark) -> DataFrame:
    m = "_metadata."
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col(m + "file_path").alias("file"), F.col(m + "file_block_start").alias("range"), F.col(m + "file_size").alias("size"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bool, pa.Array]]:
    """(file, range, size, whether a new range begins, values) of rows in a row."""
    last = None
    for b in batches:
        file, start = b.column("file").to_pylist(), b.column("range").to_pylist()
        lo = 0
        for hi in range(1, len(b) + 1):
            if hi == len(b) or (file[hi], start[hi]) != (file[lo], start[lo]):
                yield file[lo], start[lo], b.column("size")[lo].as_py(), (file[lo], start[lo]) != last, b.column("value").slice(lo, hi - lo)
                last, lo = (file[lo], start[lo]), hi


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), schema.types, strict=True)], schema=schema)


def candidates(path: str, spark, keep: bool = False) -> DataFrame:
    """Every place that may begin a record, by file and range, relative to the range; and a row without a place for each range."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_SCHEMA))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for file, start, size, new, values in _by_range(batches):
            if new:
                if now is not None:
                    yield _frame(list(now.rows(*key)), schema)
                now, key = Range(start == 0, keep), (file, start, size)
            for v in values:
                now.feed(v.as_py())
        if now is not None:
            yield _frame(list(now.rows(*key)), schema)

    return _lines(path, spark).mapInArrow(scan, _SCHEMA)


def reachable(entries: DataFrame, rounds: int = 64) -> DataFrame:
    """(file, at) on the chain from offset 0, by pointer jumping over (file, at, exit): round k reaches 2^k steps further."""
    jump = cut(entries.select("file", "at", F.col("exit").alias("to")), "jump")
    nodes = jump.select("file", "at")
    known = cut(jump.where("at = 0").select("file", "at"), "known")
    count = known.count()
    for _ in range(rounds):
        far = known.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(nodes, ["file", "at"], "left_semi")
        known = cut(known.unionByName(far).distinct(), "known")
        if (n := known.count()) == count:
            break
        count = n
        on = jump.select("file", F.col("at").alias("to"), F.col("to").alias("_to"))
        jump = cut(jump.join(on, ["file", "to"]).select("file", "at", F.col("_to").alias("to")), "jump")
    return known


def fetch(path: str, spark, bases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, at, data): the bytes of each of ``wanted`` (file, at, end), from another pass over the archives."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = 0
        for file, start, _, new, values in _by_range(batches):
            if new:
                pos = 0 if start == 0 else -len(MAGIC)
            before = new and start == 0
            for v in values:
                data = (b"" if before else MAGIC) + v.as_py()
                before = False
                for lo in range(0, len(data), PIECE):
                    part = data[lo : lo + PIECE]
                    yield pa.RecordBatch.from_pydict({"file": [file], "range": pa.array([start], pa.int64()), "rel": pa.array([pos + lo], pa.int64()), "data": [part]})
                pos += len(data)

    p = _lines(path, spark).mapInArrow(pieces, "file string, range long, rel long, data binary").join(bases.select("file", "range", "base"), ["file", "range"])
    p = p.select("file", (F.col("rel") + F.col("base")).alias("from"), "data").withColumn("to", F.col("from") + F.octet_length("data"))
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / PIECE), F.floor((hi - 1) / PIECE)))
    w = wanted.select(F.col("file"), "at", "end", blocks(F.col("at"), F.col("end")).alias("block"))
    j = p.withColumn("block", blocks(F.col("from"), F.col("to"))).join(small(cut(w, "wanted")), ["file", "block"]).where("from < end and to > at")
    cut_ = F.struct(F.greatest("from", "at").alias("from"), F.expr("substring(data, cast(greatest(at - from, 0) + 1 as int), cast(least(end, to) - greatest(at, from) as int))").alias("data"))
    got = j.groupBy("file", "at").agg(F.array_sort(F.collect_set(cut_)).alias("x"))
    return got.select("file", "at", F.aggregate("x", F.lit(b""), lambda a, b: F.concat(a, b["data"])).alias("data"))


def _headers(path: str, spark, bases: DataFrame, cut_off: DataFrame) -> DataFrame:
    """(file, at, next) of candidates (file, at, end of the file) whose header goes on in the next range."""
    size, found = 1 << 16, []

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, at, data in zip(b["file"], b["at"], b["data"], strict=True):
                end = data.find(BLANK)
                f = header(data, 0, end) if end >= 0 else None
                out.append((file, at, None if f is None else at + end + 8 + int(f["content-length"]), end >= 0))
            yield pd.DataFrame(out, columns=["file", "at", "next", "over"]).astype({"next": "Int64"})

    left = cut_off
    while not left.isEmpty():
        want = left.select("file", "at", F.least(F.col("at") + size, F.col("end")).alias("end"))
        got = cut(fetch(path, spark, bases, want).mapInPandas(parse, "file string, at long, next long, over boolean"), "headers")
        found.append(got.where("next is not null").select("file", "at", "next"))
        left = cut(left.join(got.where("not over"), ["file", "at"], "left_semi").where(F.col("at") + size < F.col("end")), "left")
        size *= 16
    out = spark.createDataFrame([], "file string, at long, next long")
    for f in found:
        out = out.unionByName(f)
    return out


def read(path: str, spark, whole: bool = True, payload: bool = False) -> DataFrame:
    """The records on the chain from each file's start; with ``whole``, a chain that ends before its file is an error.

    Columns file, at, next, page_id, payload_bytes, payload_digest, record_type, refers_to, intact, and with ``payload``
    the bytes themselves.
    """
    slim(spark)
    c = cut(candidates(path, spark, payload), "candidates")
    upto = Window.partitionBy("file").orderBy("range")  # a row for each range of a file
    bases = c.where("at is null").select("file", "range", "total", "file_size", F.coalesce(F.sum("total").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("total").over(Window.partitionBy("file")).alias("all"))
    # The last bytes are not followed by a magic.
    end = F.when(F.col("file").endswith(".gz"), F.col("all") - len(MAGIC)).otherwise(F.col("file_size"))
    bases = cut(bases.select("file", "range", "base", end.alias("end")), "bases")
    c = c.where("at is not null").drop("total", "file_size").join(small(bases), ["file", "range"])
    # Places of later ranges count from the content of their first magic on; the first range's from the file's start.
    for name in ("at", "next", "exit"):
        c = c.withColumn(name, F.col(name) + F.col("base"))
    c = c.drop("base")
    cut_off = cut(c.where("next is null").select("file", "at", "end"), "cut_off")
    if not cut_off.isEmpty():
        late = cut(_headers(path, spark, bases, cut_off), "late")
        c = c.join(small(late.select("file", "at", F.col("next").alias("_next"))), ["file", "at"], "left")
        # Chains that led to such a record went no further.
        c = c.withColumn("exit", F.when(F.col("next").isNull(), F.col("_next")).otherwise(F.coalesce("exit", "next"))).withColumn("next", F.coalesce("next", "_next")).drop("_next")
        c = cut(c.where("next is not null"), "candidates")
    # A chain enters a range at the exit of another one, or at the file's start.
    into = c.select("file", F.col("exit").alias("at")).distinct()
    places = c.select("file", "range", "at", "exit")
    entry = cut(places.join(into, ["file", "at"], "left_semi").unionByName(places.where("at = 0")).distinct(), "entry")
    e = cut(reachable(entry).join(entry, ["file", "at"]).select("file", "range", F.col("at").alias("_e"), F.col("exit").alias("_x")), "entries")
    cols = ["file", "at", "next", *_SAYS[:-1], *(["payload"] if payload else [])]

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        nxt, on = dict(zip(g["at"], g["next"], strict=True)), set()
        for at in sorted(set(g["_e"])):
            while at in nxt and at not in on:
                on.add(at)
                at = nxt[at]
        g = g.drop_duplicates("at")
        return g[g["at"].isin(on)][[*cols, "whole", "end"]]

    kinds = {f.name: f.dataType.simpleString() for f in c.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*cols, "whole", "end"])
    on = cut(c.join(small(e), ["file", "range"]).select(*cols, "whole", "end", "range", "_e").groupBy("file", "range").applyInPandas(chain, schema), "chain")
    out = on.where("whole").select(*cols)
    broken = bases.select("file", "end").distinct().join(e.groupBy("file").agg(F.max("_x").alias("upto")), "file", "left").select("file", F.coalesce("upto", F.lit(0)).alias("upto"), "end").where("upto <> end")
    loose = cut(on.where("not whole").select("file", "at", "next", "end"), "loose")
    if not loose.isEmpty():
        # Payloads that go on in the next range, on the chain: one for each range at most.
        inside = loose.where("next <= end")
        got = fetch(path, spark, bases, inside.select("file", "at", F.col("next").alias("end"))).join(inside.select("file", "at", "next"), ["file", "at"])

        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for file, at, nxt, data in zip(b["file"], b["at"], b["next"], b["data"], strict=True):
                    to = data.find(BLANK)
                    f = header(data, 0, to) if to >= 0 else None
                    if f is not None and data.endswith(BLANK) and len(data) == nxt - at:
                        rows.append((file, at, nxt, *says(f, data[to + 4 : -4], payload)))
                got = pd.DataFrame(rows, columns=["file", "at", "next", *_SAYS]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
                yield got[cols]

        got = cut(got.select("file", "at", "next", "data").mapInPandas(finish, ", ".join(f"{n} {kinds[n]}" for n in cols)), "finished")
        wrong = cut(loose.join(got, ["file", "at"], "left_anti"), "wrong")
        out = out.unionByName(got)
        if not wrong.isEmpty():
            stop = wrong.groupBy("file").agg(F.min("at").alias("_stop"))
            broken = broken.unionByName(stop.join(bases.select("file", "end").distinct(), "file").select("file", F.col("_stop").alias("upto"), "end"))
            out = out.join(stop, "file", "left").where("_stop is null or at < _stop").drop("_stop")
    if whole and (bad := broken.take(3)):
        raise ValueError("; ".join(f"no whole record at byte {x['upto']} of {x['end']} of {x['file']}" for x in bad))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return read(path, spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT *, list_transform([1, 11, 21, 31], lambda a: ('0x' || substr(x, a, 10))::BIGINT) AS five FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(flatten(list_transform(five, lambda v: list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: (v >> s) & 31))),
  lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', i::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""
