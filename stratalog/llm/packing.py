"""Best-fit packing by minimum bin slack.

Documents are cut into pieces of at most ``LENGTH`` tokens. The lengths of all pieces are counted (at most LENGTH
different ones); from the counts alone the bins are planned: with the longest piece left as a start, a bitset
subset-sum over the lengths still available finds the fullest feasible combination, which is then removed as often as
the counts allow. The n-th piece of a length takes the n-th place planned for that length: places are ranges of n, so
the plan stays small (some 60 lengths by a few thousand combinations at most) at any number of pieces.

Null and empty texts are one end token. Ties and repeated rows are told apart by a number that each piece gets when it
is written. Texts of any length are tokenized whole. ``doc_id`` may be null. Other columns are not looked at.
"""
from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import held, parts, slim
from stratalog.plans.scratch import cut

LENGTH, END, TOKENIZER = 2048, 0, "word_bpe_49k.json"
#: Chunks kept, bytes of the longest one kept, and bytes of text to a call.
_CACHE, _LONGEST, _BYTES, _MARKS, _END = 200_000, 64, 2 << 20, (b".", b","), np.uint32(END).astype("<u4").tobytes()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def by_words(tokenizer: dict) -> bool:
    """Whether a tokenizer, as in its file, lowers case, never joins over white space and marks the ends of words."""
    kinds = [x["type"] for x in (tokenizer.get("normalizer") or {}).get("normalizers", [])]
    cut_ = [x["type"] for x in (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    spaced = any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in tokenizer.get("added_tokens") or [])
    return kinds == ["NFC", "Replace", "Lowercase"] and cut_ == ["Split", "ByteLevel"] and tokenizer["model"].get("end_of_word_suffix") == "</w>" and not spaced


class Ids:
    """Token ids of a text. Where the tokenizer never joins over ASCII white space (``by_words``), what lies between is
    encoded once and kept; the texts of any other one are encoded as they are.

    Chunks are kept in Arrow and their ids in one array, some 30 bytes each where a dictionary takes 200. When the bound is
    met, the half that was met in the most calls stays. Such a tokenizer lowers case, and ends a word at punctuation:
    chunks are looked up in lower case, and unmet ones of ASCII without one last full stop or comma.
    """

    def __init__(self, path: str):
        # The tasks are the parallelism; threads within one only add to its CPU time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words = by_words(json.loads(self.tok.to_str()))
        self.last = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        # Chunks, their ids in turn, where each one's ids end, and in how many calls it was met.
        self.chunks, self.ids = pa.array([], pa.binary()), np.zeros(0, "<u4")
        self.ends, self.met = np.zeros(1, np.int64), np.zeros(0, np.float32)

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters only go many to a call: each is one word to the tokenizer and its last token says so."""
        out = {}
        texts = [p.decode("utf-8", "replace") for p in chunks]
        single = [i for i, t in enumerate(texts) if not t.isalpha()]
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        for some in (groups[at : at + 16] for at in range(0, len(groups), 16)):
            for g, e in zip(some, self.batch([" ".join([texts[i] for i in g]) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                stops = np.flatnonzero(self.last[ids]) + 1
                if len(stops) != len(g):  # letters that are normalised to something else
                    single += g
                    continue
                raw, at = ids.tobytes(), 0
                for i, to in zip(g, (stops * 4).tolist(), strict=True):
                    out[chunks[i]] = raw[at:to]
                    at = to
        for at in range(0, len(single), 1024):
            some = single[at : at + 1024]
            for i, e in zip(some, self.batch([texts[i] for i in some], add_special_tokens=False), strict=True):
                out[chunks[i]] = np.array(e.ids, "<u4").tobytes()
        return out

    def _unmet(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks that are not kept, as bytes."""
        # A word with one last mark has the ids of the word, then those of the mark.
        marked = {p for p in chunks if p[-1:] in _MARKS and p[-2:-1].isalnum() and p.isascii() and b"<|" not in p}
        todo = list({p for p in chunks if p not in marked} | {p[:-1] for p in marked} | {p[-1:] for p in marked})
        at = pc.index_in(pa.array(todo, pa.binary()), value_set=self.chunks).to_pylist()
        known = {p: self.ids[self.ends[i] : self.ends[i + 1]].tobytes() for p, i in zip(todo, at, strict=True) if i is not None}
        known |= self._encode([p for p, i in zip(todo, at, strict=True) if i is None])
        return [known[p[:-1]] + known[p[-1:]] if p in marked else known[p] for p in chunks]

    def _lookup(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each of some distinct chunks begin and end."""
        at = pc.index_in(chunks, value_set=self.chunks)
        new, at = chunks.filter(at.is_null()), pc.fill_null(at, -1).to_numpy().astype(np.int64)
        self.met[at[at >= 0]] += 1
        if not len(new):
            return self.ids, self.ends[at], self.ends[at + 1]
        raw = self._unmet(new.to_pylist())
        at[at < 0] = len(self.chunks) + np.arange(len(new))
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), "<u4")])
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4)])
        self._keep(new, ids, ends)
        return ids, ends[at], ends[at + 1]

    def _keep(self, new: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """Keeps the chunks that there are and new ones, which all have their ids in ``ids``, as far as the bounds allow."""
        short = np.concatenate([np.ones(len(self.chunks), bool), pc.binary_length(new).to_numpy() <= _LONGEST])
        chunks, met = pa.concat_arrays([self.chunks, new]), np.concatenate([self.met, np.ones(len(new), np.float32)])
        if short.sum() > _CACHE:
            most = np.argsort(np.where(short, -met, np.inf), kind="stable")[: _CACHE // 2]
            stay = np.zeros(len(short), bool)
            stay[most] = True
            short &= stay
            met /= 2
        if not short.all():
            n = np.diff(ends)
            chunks, met, ids, ends = chunks.filter(pa.array(short)), met[short], ids[np.repeat(short, n)], np.concatenate([[0], np.cumsum(n[short])])
        self.chunks, self.met, self.ids, self.ends = chunks, met, ids, ends

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's begin (with the end of the last). A null has none.

        Chunks are split and numbered by Arrow; Python sees each distinct one of the call once.
        """
        texts = pc.fill_null(texts, "")
        if not self.words:
            ids = [np.array(e.ids, "<u4") for e in self.batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else they may hold a special token, which has its case
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        bounds, words = parts.offsets.to_numpy(), parts.values.cast(pa.binary()).dictionary_encode()
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        ids, first, to = self._lookup(words.dictionary)
        at = words.indices.to_numpy()
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum((to - first)[at], out=ends[1:])
        where = np.repeat(first[at] - ends[:-1], np.diff(ends))
        where += np.arange(len(where))
        return ids[where], ends[bounds]


def ids_of(path: str) -> Ids:
    """One for a worker process, so that a task goes on with the words that the tasks before it have met."""
    return held(("ids", path), lambda: Ids(path))


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = path or vocabulary_path()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        for b in (p for whole in batches for p in parts(whole, size=_BYTES)):
            t, bounds = ids(b.column("text"))
            out = []
            for i, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                for p, at in enumerate(range(0, z - a + 1, LENGTH)):
                    n = min(LENGTH, z - a + 1 - at)
                    crc = zlib.crc32(t[a + at : min(z, a + at + n)])
                    out.append((i, p, at, n, crc if a + at + n <= z else zlib.crc32(_END, crc)))
            rows, piece, start, length, crc = map(list, zip(*out, strict=True))
            cols = [b.column("doc_id").take(pa.array(rows)).cast(pa.int64()), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tokenize, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths, each at most as often as it is there, with the largest sum up to ``room``."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[n], room // n), 1
        while left:
            take = min(take, left)
            steps.append((n, take, bits))
            bits |= (bits << (n * take)) & mask
            left -= take
            take *= 2
            if bits >> room & 1:
                break
        if bits >> room & 1:
            break
    at, out = bits.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            out[n] = out.get(n, 0) + take
    return out


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, and how many bins each fills. At each step a length runs out or gets fewer than the combination takes."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        combo = fullest({n: c for n, c in rest.items() if c}, length - top)
        combo[top] = combo.get(top, 0) + 1
        times = min(left[n] // k for n, k in combo.items())
        out.append((combo, times))
        for n, k in combo.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    slim(docs.sparkSession)
    # Numbered as they are written, so that equal rows can be told apart.
    rows = cut(pieces(docs, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    total = 0
    counts = {}
    for r in rows.groupBy("length").count().collect():  # at most LENGTH rows
        counts[r["length"]] = r["count"]
        total += r["count"]
    # places by length: first rank, first bin, pieces of this length in a bin, offset of the first
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used, bins = dict.fromkeys(counts, 0), 0
    for combo, times in plan(counts):
        at = 0
        for n in sorted(combo, reverse=True):
            places.setdefault(n, []).append((used[n], bins, combo[n], at))
            used[n] += combo[n] * times
            at += n * combo[n]
        bins += times
    tables = {n: np.array(p, np.int64) for n, p in places.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            for n in np.unique(length):
                at, t = np.flatnonzero(length == n), tables[int(n)]
                p = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                i = rank[at] - p[:, 0]
                seq[at], off[at] = p[:, 1] + i // p[:, 2], p[:, 3] + i % p[:, 2] * n
            yield b.drop(columns="rank").assign(sequence_id=seq, offset=off)

    # The rank of a piece among those of its length: its place in a hash bucket, plus the buckets before. No bucket
    # is large, whatever the length's share of all pieces.
    buckets = max(256, min(1_000_000, total // 2000))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    base = base.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("row")) - 1
    ranked = rows.withColumn("inside", inside).join(base, ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("inside"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes. Documents that the mix repeats are packed as often as they are there."""
    return pack(docs)
