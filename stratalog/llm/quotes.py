"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes; their number of marks is the level. A run of lines of one level is a
passage. Passages are normalised (one space, lower case) and hashed to 128 bits, and joined to the messages that say the
same outside quotes: as a whole, in one line, in one paragraph (between blank lines) or in one block between quotes. What
is left, passages of two or more lines, is joined by the hashes of its first two and kept where all its lines follow one
another in the message, blank ones aside. An original comes before its quotation: the match is with the least
message (conv_id, turn) of the hash, in the quoting conversation if it is there, and only if it is before the quoting
message. A message replies to the original of its first linked level-1 passage; without one, to the message before it in
its conversation. Threads are the trees of replies. Of a thread's messages only those with a linked reply and the first
of a conversation are followed up, by pointer jumping; the others hang on the last of these before them in their
conversation. ``clean_text`` is the message without quotes.

Null and empty texts have no passages and are never originals. Messages with a null conv_id or turn are returned
unlinked, each a thread of its own without a root. Rows that repeat a (conv_id, turn) are one message to reply to, which
replies to the least of their originals; each row has its own quotes, links and text. A conversation may hold any share
of the messages: no step gathers one. Other columns are not looked at.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import parts, slim, small
from stratalog.plans.scratch import cut, ranked

_QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_BLANK = re.compile(r"\n[^\S\n]*\n")
ROUNDS = 64
#: Messages of a range in which the last anchor is looked for.
RANGE = 100_000


def _words(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def _hash(text: str) -> bytes | None:
    words = _words(text)
    return xxhash.xxh3_128_digest(words) if words else None


def _line(text: str) -> int | None:
    words = _words(text)
    return xxhash.xxh3_64_intdigest(words) - 2**63 if words else None


def parse(text: str | None) -> tuple[str, list[tuple[int, bytes]], list[bytes], list[list[int]], list[int]]:
    """Text without quotes, (level, hash) of each quoted passage, hashes by which the message may be quoted, the line
    hashes of each passage, and those of the text without quotes; blank lines have none."""
    own, quoted, inner, runs = [], [], [], []
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line)
        level, body = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if not level:
            own.append(line)
            if not runs or runs[-1][0]:
                runs.append((0, []))
            runs[-1][1].append(line)
        else:
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(body)
    for level, lines in runs:
        if level and (h := _hash(" ".join(lines))) is not None:
            quoted.append((level, h))
            inner.append([x for line in lines if (x := _line(line)) is not None])
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    blocks = ["\n".join(lines) for level, lines in runs if not level]
    paragraphs = [p for block in blocks for p in _BLANK.split(block)]
    lines = [h for line in clean.split("\n") if (h := _line(line)) is not None]
    says = {h for part in [clean, *clean.split("\n"), *blocks, *paragraphs] if (h := _hash(part)) is not None}
    return clean, quoted, sorted(says), inner, lines


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean_text, n_quotes, n_linked, reply_conv, reply_turn, thread_conv, thread_turn, depth."""

    slim(messages.sparkSession)
    kinds = "conv_id long, turn long, role string, copy long, clean_text string, levels array<int>, hashes array<binary>, says array<binary>, inner array<array<long>>, lines array<long>"
    types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole, size=1 << 20)):
            got = [parse(t) for t in b.column("text").to_pylist()]
            cols = [[g[0] for g in got], [[x[0] for x in g[1]] for g in got], [[x[1] for x in g[1]] for g in got], *([g[i] for g in got] for i in (2, 3, 4))]
            cols = [*(b.column(c) for c in ("conv_id", "turn", "role", "copy")), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "turn", "role", "copy", "clean_text", "levels", "hashes", "says", "inner", "lines"])

    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.xxhash64("text").alias("copy"), F.col("text").cast("string").alias("text"))
    m = cut(m.mapInArrow(run, kinds), "messages")
    whole = m.where("conv_id is not null and turn is not null")
    passages = whole.where("size(hashes) > 0").select("conv_id", "turn", "copy", F.posexplode(F.arrays_zip("levels", "hashes", "inner")).alias("at", "q"))
    passages = passages.select("conv_id", "turn", "copy", "at", F.col("q.levels").alias("level"), F.col("q.hashes").alias("hash"), F.col("q.inner").alias("inner"))
    # Rows that repeat a message with the same text have the same passages.
    passages = cut(passages.dropDuplicates(["conv_id", "turn", "copy", "at"]), "passages")
    # One row a hash: passages that many messages share meet one original each.
    asked = passages.select("hash").distinct()
    said = whole.select("conv_id", "turn", F.explode("says").alias("hash")).join(asked, "hash", "left_semi")
    # Runs of lines: one row a different passage and place of its first two lines, then one a message that has all of them.
    many = passages.where("size(inner) > 1").select("hash", "inner").distinct().select("hash", "inner", F.col("inner")[0].alias("l0"), F.col("inner")[1].alias("l1"))
    places = whole.where("size(lines) > 1").select("conv_id", "turn", "lines", F.posexplode("lines").alias("_i", "l0")).withColumn("l1", F.get("lines", F.col("_i") + 1))
    heads = many.select("l0", "l1").distinct()
    places = places.join(heads, ["l0", "l1"], "left_semi")
    run_of = F.slice("lines", F.col("_i") + 1, F.size("inner")) == F.col("inner")
    runs = places.join(many, ["l0", "l1"]).where(run_of).select("conv_id", "turn", "hash")
    said = cut(said.select("conv_id", "turn", "hash").unionByName(runs).distinct(), "said")
    here = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("h_turn"))
    first = said.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("o"))
    j = passages.join(here, ["hash", "conv_id"], "left").join(first, "hash", "left")
    same = F.when(F.col("h_turn") < F.col("turn"), F.struct("conv_id", F.col("h_turn").alias("turn")))
    other = F.when(F.col("o") < F.struct("conv_id", "turn"), F.col("o"))
    j = j.withColumn("o", F.coalesce(same, other))
    linked = F.col("o").isNotNull() & (F.col("level") == 1)
    per = cut(j.groupBy("conv_id", "turn", "copy").agg(F.count("o").alias("n_linked"), F.min(F.when(linked, F.struct("at", "o"))).alias("r")).select("conv_id", "turn", "copy", "n_linked", "r.o"), "replies")
    tree = _threads(whole, per)
    out = m.join(per, ["conv_id", "turn", "copy"], "left").join(tree, ["conv_id", "turn"], "left")
    own = F.coalesce("o", "parent")
    return out.select(
        "conv_id", "turn", "role", "clean_text", F.size("hashes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        own["conv_id"].alias("reply_conv"), own["turn"].alias("reply_turn"), F.col("root.conv_id").alias("thread_conv"), F.col("root.turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def _threads(whole: DataFrame, per: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root and depth of each message: the parent by quotation, else the message before."""
    links = per.where("o is not null").groupBy("conv_id", "turn").agg(F.min("o").alias("o"))
    nodes = whole.select("conv_id", "turn").distinct().join(links, ["conv_id", "turn"], "left")
    nodes = cut(ranked(nodes, "conv_id", "turn", rank="i"), "nodes")  # a conversation's messages have consecutive numbers
    before = nodes.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), (F.col("i") + 1).alias("i"))
    nodes = nodes.join(before, "i", "left")
    same = F.col("_c") == F.col("conv_id")
    nodes = nodes.select("conv_id", "turn", "i", "o", F.when(same, F.struct(F.col("_c").alias("conv_id"), F.col("_t").alias("turn"))).alias("last"))
    anchor = F.when(F.col("o").isNotNull() | F.col("last").isNull(), F.col("i"))
    # The last anchor up to each message: within a range of numbers, else in the ranges before, of which there are few.
    nodes = cut(nodes.withColumn("anchor", anchor).withColumn("p", F.floor(F.col("i") / RANGE)), "nodes")
    ahead = Window.partitionBy("p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ranges = nodes.groupBy("p").agg(F.max("anchor").alias("a"))
    earlier = ranges.select("p", F.max("a").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    nodes = nodes.withColumn("near", F.max("anchor").over(ahead)).join(small(cut(earlier, "ranges")), "p")
    nodes = cut(nodes.select("conv_id", "turn", "i", F.coalesce("o", "last").alias("parent"), F.col("o").isNotNull().alias("quotes"), F.coalesce("near", "earlier").alias("anchor")), "nodes")
    # An anchor with a quotation goes on to the anchor of what it quotes, and is so much deeper than that.
    to = nodes.select(F.struct("conv_id", "turn").alias("parent"), F.col("anchor").alias("to"), (F.col("i") - F.col("anchor") + 1).alias("depth"))
    up = cut(nodes.where("quotes").select("i", "parent").join(to, "parent").select("i", "to", "depth"), "up")
    for _ in range(ROUNDS):
        # A reply points to an earlier message, so there are no cycles; each round doubles the steps behind a pointer.
        on = up.select(F.col("i").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_d"))
        nxt = cut(up.join(on, "to", "left").select("i", F.coalesce("_to", "to").alias("to"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_to").isNotNull().alias("moved")), "up")
        if nxt.where("moved").isEmpty():
            break
        up = nxt.drop("moved")
    roots = up.select(F.col("i").alias("anchor"), F.col("to").alias("_root"), F.col("depth").alias("_d"))
    nodes = nodes.join(roots, "anchor", "left").withColumn("r", F.coalesce("_root", "anchor"))
    names = nodes.where("i = anchor").select(F.col("i").alias("r"), F.struct("conv_id", "turn").alias("root"))
    return nodes.join(names, "r").select("conv_id", "turn", "parent", "root", (F.col("i") - F.col("anchor") + F.coalesce("_d", F.lit(0))).alias("depth"))


def conversations(linked: DataFrame) -> DataFrame:
    """Messages thread by thread, each after the one that it replies to, and those of a conversation in their turn.
    Range-partitioned, so a thread may span tasks."""
    keys = ["thread_conv", "thread_turn", "conv_id", "turn"]
    return linked.repartitionByRange(*keys).sortWithinPartitions(*keys)


def query(spark, sf_dir: str) -> DataFrame:
    return conversations(link(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
