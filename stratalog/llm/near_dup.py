"""Near-duplicates by b-bit MinHash.

1. Each text becomes its set of word shingles; texts with equal sets are one class from there on.
2. Minima of random functions over the set, in bands: classes that share a band's hash (a bucket) are candidates.
3. Packed low bits of the minima are compared by bit counts: the share of equal minima, corrected for chance
   collisions, estimates the similarity. Only pairs that may reach the threshold go on, and those sizes allow it.
4. Each class meets the least class of each of its buckets; such pairs are confirmed on the full sets, and components
   of confirmed links are known from there on: a group of copies of one text is one component now.
5. Buckets whose other members are still in several components are compared by bit counts, pairs of different
   components only; classes in a pair that may reach the threshold form families, whose pairs of different components
   are confirmed on the full sets. Members of the largest component of a bucket or family never meet one another.
   Both go to tasks in chunks of bounded size, whatever the size of a bucket, family or set.
6. Components over all confirmed links.

The number of bands follows from the threshold: a pair at it shares no bucket with a chance of at most ``MISS``, and
its estimate is under the floor with a chance of at most ``MISS``.

Null or empty texts, and texts without words, have an empty set and link to nothing. Rows with one ``doc_id`` are one
node. A null ``doc_id`` links to nothing: ``component_id`` is null and it is kept. Other columns are not looked at.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stratalog.llm.common import WordHashes, mix, parts, release, shingles, slim, small
from stratalog.llm.components import components
from stratalog.plans.scratch import cut

ROWS, MISS, BITS, SEED = 5, 1e-7, 2, 97
#: About so many signatures, and elements of sets, in each of the two chunks that meet in a task. A set weighs as
#: much as LEAST elements at least, so that no chunk has very many of them.
SIGNATURES, ITEMS, LEAST = 256, 1 << 19, 1 << 11
#: Of a 64-bit word of two-bit values, their lower bits; values in a word.
LOWER, WIDTH = 0x5555555555555555, 32


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS) / 4) * 4


def corrected(differ, n: int):
    """The similarity that ``differ`` of ``n`` packed values speak for, corrected for equal bits by chance."""
    return (1 - differ / n - 2.0**-BITS) / (1 - 2.0**-BITS)


def most_differing(n: int, percent: int) -> int:
    """So many of ``n`` packed values of a pair at the threshold differ at most, but for a chance of MISS."""
    p, left = (1 - percent / 100) * (1 - 2.0**-BITS), 1.0
    for d in range(n + 1):
        left -= math.comb(n, d) * p**d * (1 - p) ** (n - d)
        if left <= MISS:
            return d
    return n


class Sketch:
    """Sets, minima, band hashes and packed low bits."""

    def __init__(self, k: int, bands: int):
        self.k, self.bands, self.words = k, bands, WordHashes()
        rng = np.random.Generator(np.random.Philox(key=SEED))
        n = bands * ROWS
        self.a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)

    def set(self, text: bytes | None) -> np.ndarray:
        """The set of a text in UTF-8."""
        words = text.lower().split() if text else []  # bytes.lower() changes A-Z only
        return shingles(self.words.of(words), self.k)

    def sets(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
        for t in texts.cast(pa.binary()):
            yield self.set(t.as_py())

    def minima(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in range(0, len(s), 1024):
            x = s[None, at : at + 1024] ^ self.b[:, None]
            x *= self.a[:, None]
            np.minimum(out, x.min(1), out=out)
        return mix(out)

    def band_hashes(self, m: np.ndarray) -> np.ndarray:
        x = np.arange(self.bands, dtype=np.uint64)
        for c in m.reshape(self.bands, ROWS).T:
            x = mix(x ^ c) + np.uint64(1)
        return x.view(np.int64)

    def packed(self, m: np.ndarray) -> np.ndarray:
        """The low bits of the minima, WIDTH to a word; what is left of the last word is 0."""
        low = np.zeros(-(-len(m) // WIDTH) * WIDTH, np.uint64)
        low[: len(m)] = m & np.uint64(3)
        return np.bitwise_or.reduce(low.reshape(-1, WIDTH) << (np.arange(WIDTH, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many packed values differ: a's rows of words by b's."""
    out = np.zeros((len(a), len(b)), np.int32)
    for c in range(a.shape[1]):
        x = a[:, c, None].view(np.uint64) ^ b[None, :, c].view(np.uint64)
        out += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(LOWER))
    return out


def differ_of(a: Column, b: Column, words: int) -> Column:
    """``differing`` of two array columns."""
    total = F.lit(0)
    for w in range(words):
        x = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOWER)))
    return total


def overlaps(a: list[np.ndarray], b: list[np.ndarray], step: int = 8192, most: int = 1 << 20) -> np.ndarray:
    """Sizes of the intersections of sorted sets, a's by b's, as products of 0/1 matrices over ``step`` elements at a time.

    Elements are hashes: equal ranges of their values hold about ``most`` each, whatever the sets' sizes.
    """
    if len(a) == 1:
        return np.array([[_common(a[0], x) for x in b]], np.float64)
    if len(b) == 1:
        return np.array([[_common(b[0], x)] for x in a], np.float64)
    n = -(-(sum(map(len, a)) + sum(map(len, b))) // most)
    bounds = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    cuts = [[[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets] for sets in (a, b)]
    out = np.zeros((len(a), len(b)), np.float64)
    for r in range(n):
        la, lb = ([s[c[r] : c[r + 1]] for s, c in zip(sets, cs, strict=True)] for sets, cs in zip((a, b), cuts, strict=True))
        every, count = np.unique(np.concatenate(la + lb), return_counts=True)
        every = every[count > 1]
        for at in range(0, len(every), step):
            part = every[at : at + step]
            out += _holds(la, part) @ _holds(lb, part).T
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def _holds(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    """A row for each set: 1 for the elements of ``part`` that it has."""
    m = np.zeros((len(sets), len(part)), np.float32)
    for i, s in enumerate(sets):
        s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
        pos = np.searchsorted(part, s)
        m[i, pos[part[pos] == s]] = 1
    return m


def forest(left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> list[tuple[int, int]]:
    """For each id with a pair in ``ok`` (left's by right's), itself and the least id that it reaches by such pairs."""
    ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    l, r = at[: len(left)], at[len(left) :]
    rows, cols = np.nonzero(ok)
    a, b = l[rows], r[cols]
    least = np.arange(len(ids))
    while True:
        was = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == was).all():
            break
    return [(int(ids[i]), int(ids[least[i]])) for i in np.unique(np.concatenate([a, b]))]


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task, from batches sorted by the column task."""
    held, key = [], None
    for b in batches:
        k = b.column("task").to_numpy()
        ends = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(b)] if len(b) else [0]
        for lo, hi in zip(ends, ends[1:], strict=False):
            if held and k[lo] != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            key = k[lo]
    if held:
        yield pa.Table.from_batches(held)


def _meet(t: pa.Table, most: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows on the left, on the right, and which pairs of them may be linked: of different components, sizes and bits near enough."""
    comp, n = t.column("comp").to_numpy(), t.column("n").to_numpy()
    sig = t.column("sig").combine_chunks()
    sig = sig.flatten().to_numpy().reshape(len(t), -1)
    left, right = (np.flatnonzero(t.column(c).to_numpy()) for c in ("left", "right"))
    may = differing(sig[left], sig[right]) <= most
    may &= comp[left][:, None] != comp[right][None, :]
    a, b = n[left][:, None], n[right][None, :]
    may &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    return left, right, may


def _seats(m: DataFrame, limit: int) -> DataFrame:
    """Tasks for the members (grp, rep, comp, w) of groups: every pair of members of different components meets in one.

    The largest component of a group is dealt to chunks of about ``limit`` by weight, the other members to others; each
    chunk of the former meets each of the latter, and these meet one another.
    """
    per = m.groupBy("grp", "comp").agg(F.sum("w").alias("w"))
    per = per.groupBy("grp").agg(F.max(F.struct("w", "comp")).alias("top"), F.sum("w").alias("all"))
    count = lambda x: F.ceil(x / limit).cast("int")
    per = per.where(F.col("all") > F.col("top.w")).select("grp", F.col("top.comp").alias("_top"), count(F.col("top.w")).alias("_d"), count(F.col("all") - F.col("top.w")).alias("_r"))
    j = m.join(cut(per, "groups"), "grp")
    main = F.col("comp") == F.col("_top")
    at = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.when(main, F.col("_d")).otherwise(F.col("_r"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    seat = lambda kind, i, j, left, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    yes, no, here = F.lit(True), F.lit(False), F.col("_at")
    as_main = F.transform(upto("_r"), lambda o: seat(0, here, o, yes, no))
    as_rest = F.concat(F.transform(upto("_d"), lambda o: seat(0, o, here, no, yes)), F.transform(upto("_r"), lambda o: seat(1, F.least(here, o), F.greatest(here, o), here <= o, here >= o)))
    rest = [c for c in m.columns if c not in ("grp", "w")]
    j = j.withColumn("_at", at).select(*rest, "grp", F.explode(F.when(main, as_main).otherwise(as_rest)).alias("s"))
    return j.select(F.xxhash64("grp", "s.kind", "s.i", "s.j").alias("task"), *rest, "s.left", "s.right")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    slim(docs.sparkSession)
    bands = bands_for(percent)
    values = bands * ROWS
    words, most = -(-values // WIDTH), most_differing(values, percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        s = Sketch(k, bands)
        for b in (p for whole in batches for p in parts(whole)):
            n, one, two, bh, sig = [], [], [], [], []
            for x in s.sets(b.column("text")):
                raw = x.tobytes()
                n.append(len(x))
                one.append(xxhash.xxh3_64_intdigest(raw) - 2**63)
                two.append(xxhash.xxh3_64_intdigest(raw, seed=1) - 2**63)
                m = s.minima(x) if len(x) else None
                bh.append(None if m is None else s.band_hashes(m))
                sig.append(None if m is None else s.packed(m))
            cols = [*(pa.array(c, pa.int64()) for c in (n, one, two)), *(pa.array(c, pa.list_(pa.int64())) for c in (bh, sig))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n", "h1", "h2", "bands", "sig"])

    rows = cut(docs.mapInArrow(sketch, "doc_id long, n long, h1 long, h2 long, bands array<long>, sig array<long>"), "sketch")
    with_set = rows.where("n > 0 and doc_id is not null")
    classes = cut(with_set.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # A class's bands come from its representative's row.
    reps = with_set.join(classes.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi")
    reps = cut(reps.dropDuplicates(["h1", "h2", "doc_id"]).select(F.col("doc_id").alias("rep"), "n", "bands", "sig"), "reps")
    band = reps.select("rep", F.explode("bands").alias("band"))
    shared = cut(band.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size")).where("first < last"), "shared")
    inside = cut(band.join(shared.select("band", "first", "size"), "band").where("rep <> first"), "inside")
    near = _to_firsts(reps, inside, words, most, values, percent)
    edges = _confirmed(docs, near, k, bands, most, percent)
    known = components(edges)
    family = _families(reps, inside, known, most, percent)
    if family is not None:
        # Two texts of one doc_id are two rows with one rep: what a member weighs is the sum of both.
        edges = edges.unionByName(_confirmed(docs, _seats(family, ITEMS), k, bands, most, percent))
        known = components(edges)
    label = known.select(F.col("u").alias("rep"), F.col("v").alias("component_id"))
    named = classes.join(label, "rep", "left").select("h1", "h2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component_id"), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def _to_firsts(reps: DataFrame, inside: DataFrame, words: int, most: int, values: int, percent: int) -> DataFrame:
    """Tasks of the pairs of a class and the first of one of its buckets that may be linked."""
    s = reps.select("rep", "n", "sig")
    pairs = inside.select(F.col("rep").alias("u"), F.col("first").alias("v")).distinct()
    pairs = pairs.join(s.select(F.col("rep").alias("u"), F.col("n").alias("_n"), F.col("sig").alias("_sig")), "u")
    pairs = cut(pairs, "pairs").join(s.select(F.col("rep").alias("v"), F.col("n").alias("_m"), F.col("sig").alias("_tau")), "v")
    likely = corrected(differ_of(F.col("_sig"), F.col("_tau"), words), values) >= F.lit(corrected(most, values) - 1e-9)
    fits = 100 * F.least("_n", "_m") >= percent * F.greatest("_n", "_m")
    pairs = cut(pairs.where(likely & fits).select("u", "v", "_n", "_sig", "_m", "_tau"), "pairs")
    per = cut(pairs.groupBy("v").agg(F.ceil(F.sum(F.greatest("_n", F.lit(LEAST))) / ITEMS).cast("int").alias("_d")), "hubs")
    hub = pairs.select("v", "_m", "_tau").distinct().join(per, "v")
    hub = hub.select("v", F.col("v").alias("rep"), F.col("v").alias("comp"), F.col("_m").alias("n"), F.col("_tau").alias("sig"), F.lit(True).alias("left"), F.explode(F.sequence(F.lit(0), F.col("_d") - 1)).alias("_i"))
    rest = pairs.join(per.select("v", "_d"), "v").select("v", F.col("u").alias("rep"), F.col("u").alias("comp"), F.col("_n").alias("n"), F.col("_sig").alias("sig"), F.lit(False).alias("left"), F.pmod(F.xxhash64("u", F.lit(SEED)), F.col("_d")).cast("int").alias("_i"))
    return hub.unionByName(rest).select(F.xxhash64("v", "_i").alias("task"), "rep", "comp", "n", "sig", "left", (~F.col("left")).alias("right"))


def _families(reps: DataFrame, inside: DataFrame, known: DataFrame, most: int, percent: int) -> DataFrame | None:
    """Members (grp, rep, comp, w, n, sig) of families of classes that may be linked though they are in different
    components; None if there are none. ``inside`` has the classes of each bucket but its first, which has met them all."""
    label = known.select(F.col("u").alias("rep"), F.col("v").alias("_c"))
    m = inside.where("size > 2").select("band", "rep").join(label, "rep", "left").select("band", "rep", F.coalesce("_c", "rep").alias("comp"))
    m = cut(m, "inside")
    open_ = cut(m.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band"), "open")
    if open_.isEmpty():
        return None
    s = reps.select("rep", "n", "sig")
    m = m.join(open_, "band", "left_semi").select(F.col("band").alias("grp"), "rep", "comp", F.lit(1).cast("long").alias("w")).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for t in _by_task(batches):
            left, right, may = _meet(t, most, percent)
            if may.any():
                ids = t.column("rep").to_numpy()
                uv = np.array(forest(ids[left], ids[right], may), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], ["u", "v"])

    seats = cut(_seats(m, SIGNATURES), "seats").join(s, "rep")
    seats = seats.select("task", "rep", "comp", "n", "sig", "left", "right").repartition("task").sortWithinPartitions("task")
    star = cut(seats.mapInArrow(compare, "u long, v long").distinct(), "star")
    if star.isEmpty():
        return None
    family = components(star)
    member = family.select(F.col("u").alias("rep"), F.col("v").alias("grp")).unionByName(family.select(F.col("v").alias("rep"), F.col("v").alias("grp")).distinct())
    member = member.join(label, "rep", "left").join(s, "rep")
    return cut(member.select("grp", "rep", F.coalesce("_c", "rep").alias("comp"), F.greatest("n", F.lit(LEAST)).alias("w"), "n", "sig"), "family")


def _confirmed(docs: DataFrame, seats: DataFrame, k: int, bands: int, most: int, percent: int) -> DataFrame:
    """Confirmed links (u, v): for each task the pairs that meet in it, on the full sets, at most a link for each member."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        s = Sketch(k, bands)
        for t in _by_task(batches):
            left, right, may = _meet(t, most, percent)
            left, right, may = left[may.any(1)], right[may.any(0)], may[may.any(1)][:, may.any(0)]
            if not len(left):
                continue
            at = np.unique(np.concatenate([left, right]))
            sets = dict(zip(at.tolist(), s.sets(t.column("text").take(pa.array(at))), strict=True))
            a, b = ([sets[i] for i in side.tolist()] for side in (left, right))
            inter = overlaps(a, b)
            na, nb = (np.fromiter(map(len, x), np.float64, len(x)) for x in (a, b))
            ok = may & (100 * inter >= percent * (na[:, None] + nb[None, :] - inter))
            if ok.any():
                ids = t.column("rep").to_numpy()
                uv = np.array([x for x in forest(ids[left], ids[right], ok) if x[0] != x[1]], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], ["u", "v"])

    seats = cut(seats, "seats")
    full = docs.join(small(seats.select("rep").distinct()), F.col("doc_id") == F.col("rep"), "left_semi")
    full = seats.join(full, F.col("doc_id") == F.col("rep")).select("task", "rep", "comp", "n", "sig", "left", "right", "text")
    return cut(full.repartition("task").sortWithinPartitions("task").mapInArrow(confirm, "u long, v long").distinct(), "links")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    gone = cut(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.select("doc_id", "text", "lang", "source", "n_chars").join(small(gone), F.col("doc_id") == F.col("_gone"), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
o AS (SELECT w.doc_id, cast(coalesce(n, 0) AS bigint) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id)
SELECT *, doc_id = component_id AS kept FROM o
"""
