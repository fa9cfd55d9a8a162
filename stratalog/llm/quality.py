"""Quality rules with cross-document line frequency.

Base rules of a text: its words, characters in words, symbols, repeated lines and words in repeated three-word windows.
It fails them with fewer than ``MIN_WORDS`` words, or if over half of its words are in repeated windows.

Line frequency: lines are normalised (trimmed, white space runs made one space, lower case) and hashed; for each host
(``source``) the different contents that hold a line are counted, so that exact copies of a document count once. Lines
of at least ``MIN_LINE_WORDS`` words in more than ``MAX_DOCS`` contents of a host are removed (``clean`` gives the texts
without them). A document is depleted, and rejected, if what remains is less than ``MIN_LEFT`` percent of its words.

Null texts have no words and fail. Null hosts are one host. Repeated rows are the same content and are each returned.
Texts are read whole. ``rate`` looks at doc_id, text and source only.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stratalog.llm.common import parts, slim, small
from stratalog.plans.scratch import cut

MIN_WORDS, MAX_REPEAT, MAX_DOCS, MIN_LINE_WORDS, MIN_LEFT = 50, 50, 50, 1, 30
#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
_SYMBOL, _SPACE = re.compile(f"[{re.escape(SYMBOLS)}]"), b" \t\n\x0b\x0c\r"


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words).decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")) - 2**63


def content_hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - 2**63


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; hashes of distinct normalised lines, and their words in all."""
    if not text:
        return 0, 0, 0, 0, 0, [], []
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blank = sum(map(raw.count, (bytes([c]) for c in _SPACE)))
    seen: set[bytes] = set()
    dup, lines = 0, Counter()
    for line in raw.split(b"\n"):
        w = line.split()
        if not w:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        if len(w) >= MIN_LINE_WORDS:
            lines[line_hash(w)] += len(w)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    many = Counter(windows)
    inside = np.zeros(len(words) + 2, bool)
    if len(many) < len(windows):
        at = np.fromiter((many[x] > 1 for x in windows), bool, len(windows))
        for k in range(3):
            inside[k : k + len(at)] |= at
    return len(words), len(text) - blank, len(_SYMBOL.findall(text)), dup, int(inside.sum()), list(lines), list(lines.values())


def _measured(docs: DataFrame) -> DataFrame:
    slim(docs.sparkSession)
    ints, lists = ["content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], ["lines", "line_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            texts = b.column("text").to_pylist()
            got = list(zip(*((content_hash(t), *measure(t)) for t in texts), strict=True))
            cols = [*(pa.array(c, pa.int64()) for c in got[:6]), *(pa.array(c, pa.list_(pa.int64())) for c in got[6:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *cols], ["doc_id", "host", *ints, *lists])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in ints) + ", lines array<long>, line_words array<long>")
    return cut(rows.withColumn("h", F.xxhash64("host", F.col("host").isNull())), "measures")


def _removed(rows: DataFrame, max_docs: int) -> DataFrame:
    """(h, content, line, w): the lines that are removed from each content."""
    # One row for each host, content and line, however often the content is copied.
    contents = rows.where("size(lines) > 0").groupBy("h", "content").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    lines = cut(contents.select("h", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("h", "content", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w")), "lines")
    common = cut(lines.groupBy("h", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs).select("h", "line"), "common")
    # Few lines are common: they are broadcast if they are small; else Spark splits a line that many contents share.
    return lines.join(small(common), ["h", "line"])


def rate(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text, source): the measures, base_failed, removed_words and kept."""
    rows = _measured(docs)
    removed = cut(_removed(rows, max_docs).groupBy("h", "content").agg(F.sum("w").alias("removed_words")), "removed")
    rows = rows.join(small(removed), ["h", "content"], "left")
    gone = F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - gone) < MIN_LEFT * F.col("n_words")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone.alias("removed_words"), (~failed & ~depleted).alias("kept"))


def clean(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of ``docs`` with their columns, ``text`` without the lines that are common to its host. Rows from which
    nothing is removed, null texts among them, stay as they are."""
    slim(docs.sparkSession)
    names = docs.columns
    removed = _removed(_measured(docs), max_docs).groupBy("h", "content").agg(F.collect_set("line").alias("_gone"))
    removed = cut(removed.select(F.col("h").alias("_h"), F.col("content").alias("_c"), "_gone"), "removed")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            yield b.append_column("_content", pa.array([content_hash(t) for t in b.column("text").to_pylist()], pa.int64()))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            out = []
            for t, gone in zip(b.column("text").to_pylist(), b.column("_gone").to_pylist(), strict=True):
                gone = set(gone or ())
                out.append("\n".join(x for x in t.split("\n") if not (w := x.encode("utf-8", "surrogatepass").split()) or line_hash(w) not in gone) if t and gone else t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    host = F.col("source").cast("string")
    d = docs.mapInArrow(hashed, kinds + ", _content long").withColumn("_host", F.xxhash64(host, host.isNull()))
    return d.join(small(removed), (F.col("_content") == F.col("_c")) & (F.col("_host") == F.col("_h")), "left").select(*names, "_gone").mapInArrow(without, kinds)


def query(spark, sf_dir: str) -> DataFrame:
    return rate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) x),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win) x WHERE c > 1),
repw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i AS p FROM rep UNION ALL SELECT r, i + 1 FROM rep UNION ALL SELECT r, i + 2 FROM rep) x GROUP BY r),
l AS (SELECT r, t, host, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, t, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
lines AS (SELECT r, t, host, line, len(ws) AS n, lower(array_to_string(ws, ' ')) AS norm FROM lw WHERE len(ws) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
common AS (SELECT host, norm FROM lines WHERE n >= {MIN_LINE_WORDS} GROUP BY host, norm HAVING count(DISTINCT t) > {MAX_DOCS}),
gone AS (SELECT r, sum(n) AS n FROM lines JOIN common USING (host, norm) WHERE n >= {MIN_LINE_WORDS} GROUP BY r),
m AS (SELECT doc_id, cast(len(ws) AS bigint) AS n_words, cast(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS bigint) AS word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols, cast(coalesce(dup.n, 0) AS bigint) AS n_dup_lines,
  cast(coalesce(repw.n, 0) AS bigint) AS n_repeat_words, cast(coalesce(gone.n, 0) AS bigint) AS removed_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN repw USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * (n_words - removed_words) >= {MIN_LEFT} * n_words AS kept FROM f
"""
