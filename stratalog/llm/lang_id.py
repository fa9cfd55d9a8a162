"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram is the product of its letters' vectors, each rotated by its
place; a text is the sum of its n-grams. A language's prototype is the sum over its documents, a prediction the
prototype with the largest cosine.

Nulls and empty texts, or texts without a letter, are ``und`` with score 0. Rows with a null ``lang`` or ``doc_id``
are predicted but not learned from. Equal cosines go to the first language by code point. With nothing to learn
from, every text is ``und``. Repeated rows are each counted and each returned. Texts of any length are read whole, in pieces.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalog.llm.common import parts, release, slim
from stratalog.plans.scratch import cut, ranked

DIM, N, SEED = 512, 3, 20260
#: Languages (4 KB each) that a pass over the texts compares with; more of them take more passes.
LANGS = 2000
_PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct letter trigrams (runs of other characters are one space) as packed code points, and their counts."""
    if not text:
        return None
    keys, counts, tail = [], [], np.array([32], np.uint64)
    text = text.lower()
    seen = False
    for at in range(0, len(text), _PIECE):
        cp = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[cp]
        seen = seen or bool(is_letter.any())
        a = np.concatenate([tail, np.where(is_letter, cp, 32).astype(np.uint64)])
        a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
        if at + _PIECE >= len(text) and a[-1] != 32:
            a = np.append(a, np.uint64(32))
        if len(a) >= N:
            k, c = np.unique((a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:], return_counts=True)
            keys.append(k)
            counts.append(c)
        tail = a[-(N - 1) :]
    if not seen:
        return None
    return merge(keys, counts)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.zeros(len(k), np.int64)
    np.add.at(c, at, np.concatenate(counts))
    return k, c


@lru_cache(20_000)
def _letter(cp: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[SEED, cp])).integers(0, 2, DIM, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def vectors(keys: np.ndarray) -> np.ndarray:
    """The vectors of packed trigrams, a row each."""
    mask = np.uint64((1 << 21) - 1)
    out = np.ones((len(keys), DIM), np.int8)
    for place, shift in enumerate((0, 21, 42)):
        cp, at = np.unique((keys >> np.uint64(shift)) & mask, return_inverse=True)
        out *= np.roll(np.stack([_letter(int(c)) for c in cp]), place, axis=1)[at]
    return out


class Codebook:
    """Rows for the n-grams met so far: letters get small numbers, so that counting a text's n-grams takes no sorting.

    Bounded: with over ALPHABET letters or ROWS n-grams, the text at hand takes the plain way (ngrams, vectors).
    """

    ALPHABET, ROWS, FRONT = 127, 40_000, 8192

    def __init__(self):
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[np.flatnonzero(~_letters())] = 0
        self.points = np.zeros(128, np.uint64)
        self.points[0] = 32
        self.n_letters, self.n = 1, 0
        self.row = np.full(1 << 21, -1, np.int32)
        self.keys = np.zeros(self.ROWS, np.uint64)
        # Small numbers, and the same as floats for the rows that most texts have.
        self.matrix = np.zeros((0, DIM), np.int8)
        self.front = np.zeros((0, DIM), np.float32)

    def rows(self, text: str | None) -> np.ndarray | None:
        """The row of each n-gram of the text in turn; None without a letter, or if there is no room."""
        if not text or len(text) > _PIECE:
            return None
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        a = self.letter[cp]
        if a.min() < 0:
            new = np.unique(cp[a < 0])
            if self.n_letters + len(new) > self.ALPHABET:
                return None
            self.letter[new] = np.arange(self.n_letters, self.n_letters + len(new))
            self.points[self.n_letters : self.n_letters + len(new)] = new
            self.n_letters += len(new)
            a = self.letter[cp]
        if not a.any():
            return None
        padded = np.zeros(len(a) + 2, np.int32)
        padded[1:-1] = a
        a = padded[np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])]
        tri = (a[:-2] << 14) | (a[1:-1] << 7) | a[2:]
        r = self.row[tri]
        if r.min() < 0:
            new = np.unique(tri[r < 0])
            if self.n + len(new) > self.ROWS:
                return None
            self.row[new] = np.arange(self.n, self.n + len(new))
            self.keys[self.n : self.n + len(new)] = (self.points[new >> 14] << np.uint64(42)) | (self.points[(new >> 7) & 127] << np.uint64(21)) | self.points[new & 127]
            self.n += len(new)
            r = self.row[tri]
        return r

    def encode(self, rows: list[np.ndarray]) -> np.ndarray:
        """The vectors of texts given as rows. Sums of so few small numbers are whole in float32."""
        if (have := len(self.matrix)) < self.n:
            grown = np.empty((self.n, DIM), np.int8)
            grown[:have] = self.matrix
            for at in range(have, self.n, 4096):
                grown[at : at + 4096] = vectors(self.keys[at : min(self.n, at + 4096)])
            self.matrix = grown
            if len(self.front) < self.FRONT:
                self.front = grown[: self.FRONT].astype(np.float32)
        if self.n > self.FRONT:
            out = np.empty((len(rows), DIM), np.float32)
            for i, r in enumerate(rows):
                k, c = np.unique(r, return_counts=True)
                out[i] = c.astype(np.float32) @ self.matrix[k].astype(np.float32)
            return out
        return np.stack([np.bincount(r, minlength=self.n).astype(np.float32) for r in rows]) @ self.front[: self.n]


def exact(keys: np.ndarray, counts: np.ndarray, step: int = 4096) -> np.ndarray:
    """The vector in whole numbers, which add up to the same in any order."""
    out = np.zeros(DIM, np.int64)
    for at in range(0, len(keys), step):
        out += np.rint(counts[at : at + step].astype(np.float64) @ vectors(keys[at : at + step]).astype(np.float64)).astype(np.int64)
    return out


def learn(docs: DataFrame) -> DataFrame:
    """Prototypes, a row for each language (i, lang, v), numbered by code point, from columns text and lang. Each task
    sends one vector a language; Spark adds them up."""
    slim(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        book = Codebook()
        counts: dict[str, np.ndarray] = {}
        other: dict[str, np.ndarray] = {}
        for b in (p for whole in batches for p in parts(whole)):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if (r := book.rows(text)) is not None:
                    c = counts.setdefault(lang, np.zeros(0, np.int64))
                    if len(c) < book.n:
                        c = counts[lang] = np.concatenate([c, np.zeros(max(book.n - len(c), len(c)), np.int64)])
                    c[: book.n] += np.bincount(r, minlength=book.n)
                elif (g := ngrams(text)) is not None:
                    other[lang] = other.get(lang, 0) + exact(*g)
        for lang in counts.keys() | other.keys():
            c = counts.get(lang, np.zeros(0, np.int64))[: book.n]
            v = exact(book.keys[: len(c)], c) + other.get(lang, 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([v], pa.list_(pa.int64()))], ["lang", "v"])

    sums = (
        docs.select("text", "lang").where("lang is not null and text is not null")
        .mapInArrow(bundle, "lang string, v array<long>")
        .select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    )
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))  # DIM entries each
    return cut(ranked(rows.select("lang", F.col("v.x").alias("v")), "lang"), "prototypes")


def predict(docs: DataFrame, prototypes: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``. Only the text is looked at. LANGS prototypes go to the tasks
    at a time; where there are more, each pass improves on what the ones before have found."""
    slim(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    out = docs.select(*[text if c == "text" else F.col(c) for c in keep], *([] if "text" in keep else [text]))
    total = prototypes.count()
    for lo in range(0, max(1, total), LANGS):
        some = prototypes.where(F.col("i").between(lo, lo + LANGS - 1)).orderBy("i").collect()
        more = [] if lo + LANGS >= total and "text" not in keep else ["text"]
        out = _compare(out, [r["lang"] for r in some], np.array([r["v"] for r in some], np.float64).reshape(-1, DIM), [*dict.fromkeys([*keep, *more])], lo > 0)
        if lo + LANGS < total:
            out = cut(out, "languages")
    return out.select(*keep, "lang_pred", "score")


def _compare(docs: DataFrame, names: list[str], matrix: np.ndarray, keep: list[str], again: bool) -> DataFrame:
    norms = np.linalg.norm(matrix, axis=1)
    matrix = matrix / np.where(norms > 0, norms, 1)[:, None]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        book = Codebook()
        for whole in batches:
            for b in parts(whole):
                texts = b.column("text")
                pred, best = (b.column(c).to_pylist() for c in ("lang_pred", "score")) if again else (["und"] * len(b), [0.0] * len(b))
                for at in range(0, len(b), 64):
                    part = texts.slice(at, 64).to_pylist()
                    met = [(i, r) for i, t in enumerate(part, at) if names and (r := book.rows(t)) is not None]
                    vecs = [([i for i, _ in met], book.encode([r for _, r in met]))] if met else []
                    done = {i for i, _ in met}
                    vecs += [([i], exact(*g)[None]) for i, t in enumerate(part, at) if names and i not in done and (g := ngrams(t)) is not None]
                    for where, v in vecs:
                        v = v.astype(np.float64)  # whole numbers either way, so that the path makes no difference
                        n = np.linalg.norm(v, axis=1)
                        cos = np.round((v @ matrix.T) / np.where(n > 0, n, 1)[:, None], 9)
                        for i, t, c in zip(where, cos.argmax(1), cos, strict=True):
                            x = min(1.0, max(0.0, float(c[t])))
                            if pred[i] == "und" and not (again and best[i]) or x > best[i]:
                                pred[i], best[i] = names[t], x
                cols = [b.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(best, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(score, schema + ", lang_pred string, score double")


def held_out():
    """True for the fold that is never learned from; a null id is in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, *keep: str) -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict all of them."""
    return predict(docs, learn(docs.where(~held_out())), *keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Below this cosine no known language's profile describes the text.
MIN_SCORE = 0.2
#: With fewer letters the cosine says too little: so few trigrams of a language come near its profile by chance only.
MIN_LETTERS = 64


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which no language is recognised; the others, and short ones with a letter, stay as they are."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = docs.select(*cols)
    prototypes = learn(kept.where(~held_out()))
    scored = predict(kept, prototypes, *cols)
    short = F.regexp_count("text", F.lit(r"\p{L}")) < MIN_LETTERS
    return scored.where((F.col("lang_pred") != "und") & ((F.col("score") >= MIN_SCORE) | short)).select(*cols)
