"""SimHash fingerprints. DataFrame functions only.

A text's terms are its five-word shingles (a shorter text's whole sequence is one), weighted by how often they occur.
Each occurrence votes on every bit of a 128-bit fingerprint by its hash; a bit is set where more than half of the
votes are for it. Votes are counted eight to a 64-bit sum over at most 127 terms, then two to a sum over those parts:
few sums, so that the code generated for them is small enough to be compiled. Likeness is the share of equal bits.

``near_pairs`` finds all pairs within a Hamming radius by permuted block tables: of eight blocks of 16 bits at least two
are equal in a pair within RADIUS bits, so a table for each two blocks, permuted to the front, has the pair side by side.
A pair counts in the first of its tables only. Where very many fingerprints share two blocks, the rest of their bits is
cut into seven groups, of which one is equal again, and they meet by two blocks and a group.

Null texts are empty; a text without words has the fingerprint of no votes, all zeros. Rows go in ascending doc_id,
null first, then by text hash; after the last comes the first. A single row is its own next one. Repeated rows are rows
of their own and one class. Other columns are not looked at.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import small
from stratalog.plans.scratch import cut

BITS, K = 128, 5
SEP = r"[\x20\x09-\x0D]+"
#: Eight counters of 8 bits, and two of 32 bits that take one of the former, in a 64-bit sum; terms in a
#: part (the top counter stays below the sign bit).
LANES8, LANES32, PART = 0x0101010101010101, 0x000000FF000000FF, 127
#: Rows of a bucket in the ordered pass, the most buckets there may be, and those of rows without an id.
PER_BUCKET, MAX_BUCKETS, NULL_BUCKETS = 200, 100_000, 256
#: Bits by which near fingerprints differ at most; fingerprints that share two blocks from which on these meet by groups.
RADIUS, HOT = 6, 2000


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, SEP, -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def term_hashes(h: Column, k: int = K) -> Column:
    """A 64-bit hash for each ``k``-word window of a column of word hashes."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - k + 1))
    return F.when(F.size(h) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, F.least(F.size(h), F.lit(k))))))


def _parts_sums() -> list[Column]:
    """Sums _a0 .. _b7: lane l of sum s counts bit 8 * l + s of its half of the hashes."""
    return [F.sum(F.shiftrightunsigned(half, s).bitwiseAND(F.lit(LANES8))).alias(f"_{half}{s}") for half in "ab" for s in range(8)]


def _all_sums() -> list[Column]:
    """Sums _a0_0 .. _b7_3: the lanes q and q + 4 of the sums of the parts."""
    return [F.sum(F.shiftrightunsigned(f"_{half}{s}", 8 * q).bitwiseAND(F.lit(LANES32))).alias(f"_{half}{s}_{q}") for half in "ab" for s in range(8) for q in range(4)]


def _fingerprint() -> Column:
    """32 hexadecimal digits from the vote counts."""

    def word(half: str) -> Column:
        bits = []
        for s in range(8):
            for q in range(4):
                c = F.col(f"_{half}{s}_{q}")
                for count, at in ((c.bitwiseAND(F.lit(0xFFFFFFFF)), 8 * q + s), (F.shiftrightunsigned(c, 32), 8 * (q + 4) + s)):
                    value = (1 << at) - (1 << 64) * (at == 63)
                    bits.append(F.when(count * 2 > F.col("_n"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    return F.concat(*[F.lpad(F.lower(F.hex(word(h))), 16, "0") for h in "ab"])


def vote(df: DataFrame, text: str, *keys: str, name: str = "fingerprint") -> DataFrame:
    """``keys`` with the fingerprint of ``text``; keys must tell the rows apart. If the input is already dealt by some of
    the keys, nothing is shuffled."""
    # The word hashes are a column of their own: within the windows' expression they would be made again for each.
    words = df.select(*keys, word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    terms = words.select(*keys, F.posexplode_outer(term_hashes(F.col("_w"))).alias("at", "a"))
    terms = terms.select(*keys, F.floor(F.col("at") / PART).alias("_part"), "a", F.when(F.col("a").isNotNull(), F.xxhash64(F.lit(2), "a")).alias("b"))
    parts = terms.groupBy(*keys, "_part").agg(F.count("a").alias("_n"), *_parts_sums())
    whole = parts.groupBy(*keys).agg(F.sum("_n").alias("_n"), *_all_sums())
    return whole.select(*keys, _fingerprint().alias(name))


def likeness(a: Column, b: Column) -> Column:
    differ = sum(F.bit_count(_signed(x).bitwiseXOR(_signed(y))) for x, y in zip(_parts(a), _parts(b), strict=True))
    return 1 - differ.cast("double") / BITS


def _parts(fp: Column) -> list[Column]:
    return [F.substring(fp, a, 8) for a in range(1, 33, 8)]


def _signed(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _halves(fp: Column) -> list[Column]:
    p = [_signed(x) for x in _parts(fp)]
    return [F.shiftleft(p[0], 32).bitwiseOR(p[1]), F.shiftleft(p[2], 32).bitwiseOR(p[3])]


def _blocks(a: Column, b: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, s).bitwiseAND(F.lit(0xFFFF)) for x in (a, b) for s in (48, 32, 16, 0)]


_TABLES = [(i, j) for i in range(8) for j in range(i + 1, 8)]


def near_pairs(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b, distance) of fingerprint classes within ``radius``, RADIUS at most; ``fps`` has id and fingerprint.

    Equal fingerprints are one class, named by its least id, and aren't paired: join on the fingerprint for members.
    """
    if radius > RADIUS:
        raise ValueError(f"the block tables find pairs within {RADIUS} bits")
    cls = fps.where("fingerprint is not null and id is not null").groupBy("fingerprint").agg(F.min("id").alias("id"))
    x, y = _halves(F.col("fingerprint"))
    cls = cut(cls.select("id", x.alias("x"), y.alias("y")), "classes")
    k = _blocks(F.col("x"), F.col("y"))
    keys = F.array(*[F.lit(t << 32).bitwiseOR(F.shiftleft(k[i], 16)).bitwiseOR(k[j]) for t, (i, j) in enumerate(_TABLES)])
    t = cls.select("id", "x", "y", F.explode(keys).alias("key"))
    shared = cut(t.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    t = cut(t.join(shared, "key"), "tables")
    plain = _meet(t.where(F.col("n") <= hot).withColumn("grp", F.lit(0)), radius, False)
    # The two equal blocks are left out of the groups; of the other 96 bits, five groups have 16 and two have 8.
    rest = F.expr("filter(transform(sequence(0, 7), i -> named_struct('i', i, 'v', shiftrightunsigned(if(i < 4, x, y), 48 - 16 * (i % 4)) & 65535L)), b -> b.i <> first and b.i <> second)")
    by = lambda at: F.element_at(F.array(*[F.lit(p[at]) for p in _TABLES]), (F.shiftrightunsigned("key", 32) + 1).cast("int"))
    many = t.where(F.col("n") > hot).withColumn("first", by(0)).withColumn("second", by(1)).withColumn("rest", F.transform(rest, lambda b: b["v"]))
    groups = F.array(*[F.col("rest")[i] for i in range(5)], F.shiftrightunsigned(F.col("rest")[5], 8), F.col("rest")[5].bitwiseAND(F.lit(255)))
    many = many.select("id", "x", "y", "key", F.posexplode(groups).alias("grp", "sub"))
    return plain.unionByName(_meet(many.withColumn("n", F.lit(0)), radius, True))


def _meet(t: DataFrame, radius: int, grouped: bool) -> DataFrame:
    a, b = t.alias("a"), t.alias("b")
    x, y = (F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in "xy")
    distance = F.bit_count(x) + F.bit_count(y)
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.grp") == F.col("b.grp"))
    if grouped:
        on &= F.col("a.sub") == F.col("b.sub")
    j = a.join(b, on & (F.col("a.id") < F.col("b.id")) & (distance <= radius))
    j = j.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.cast("int").alias("distance"), x.alias("x"), y.alias("y"), F.col("a.key").alias("key"), F.col("a.grp").alias("grp"))
    # Only in the first table, and group, in which the two are equal.
    same = F.array(*[k == 0 for k in _blocks(F.col("x"), F.col("y"))])
    first = F.array_position(same, True).cast("int")
    second = first + F.array_position(F.slice(same, first + 1, F.lit(8)), True).cast("int")
    table = F.element_at(F.array(*[F.lit(10 * (i + 1) + j + 1) for i, j in _TABLES]), (F.shiftrightunsigned("key", 32) + 1).cast("int"))
    j = j.where(table == 10 * first + second)
    if grouped:
        both = F.array(*_blocks(F.col("x"), F.col("y")))
        rest = F.filter(both, lambda v, i: (i != first - 1) & (i != second - 1))
        equal = F.array(*[rest[i] == 0 for i in range(5)], F.shiftrightunsigned(rest[5], 8) == 0, rest[5].bitwiseAND(F.lit(255)) == 0)
        j = j.where(F.array_position(equal, True).cast("int") == F.col("grp") + 1)
    return j.select("a", "b", "distance")


def neighbours(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint, class_id (its least id) and n_near: how many other fingerprints are within ``radius``."""
    cls = fps.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("id").alias("class_id"))
    links = near_pairs(fps, radius).select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_near"))
    return cls.join(links, "class_id", "left").select("fingerprint", "class_id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def _buckets(ids: DataFrame) -> tuple[Column, int]:
    """A bucket number that rises with doc_id, of about equal counts: quantiles, and even steps between them."""
    leaves = 32
    q, n = ids.agg(F.percentile_approx("doc_id", [i / leaves for i in range(leaves + 1)], 10000), F.count(F.lit(1))).first()
    if not q:
        return _null_bucket(), NULL_BUCKETS
    cuts = sorted(set(q))
    steps = max(1, min(MAX_BUCKETS, n // PER_BUCKET) // leaves)

    def leaf(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            a, b = cuts[lo], cuts[min(lo + 1, len(cuts) - 1)]
            inner = F.floor((F.col("doc_id") - F.lit(a)).cast("double") / float(max(1, b - a)) * steps)
            return F.lit(NULL_BUCKETS + lo * steps).cast("long") + F.greatest(F.lit(0), F.least(F.lit(steps - 1), inner))
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < F.lit(cuts[mid]), leaf(lo, mid)).otherwise(leaf(mid, hi))

    return F.when(F.col("doc_id").isNull(), _null_bucket()).otherwise(leaf(0, len(cuts))), len(cuts) * steps + NULL_BUCKETS


def _null_bucket() -> Column:
    """Rows without an id go by the hash of their text, and so do their buckets."""
    return F.shiftright(F.xxhash64("t"), 56) + F.lit(128).cast("long")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last quarter replaced by as much of the next one's start)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    bucket, _ = _buckets(docs.select("doc_id"))
    d = docs.withColumn("bucket", bucket)
    # The first row of each bucket also goes, marked, to the end of the bucket before: then every next row is at hand.
    # Of rows without an id the one with the least hash is the first of its bucket.
    d = d.withColumn("o", F.coalesce("doc_id", F.xxhash64("t")))
    firsts = d.groupBy("bucket").agg(F.min("o").alias("first"))  # one row for each bucket
    w = Window.orderBy("bucket")
    lap = F.coalesce(F.lag("bucket").over(w), F.max("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = cut(firsts.select(F.col("bucket").alias("_b"), "first", lap.alias("_before")), "firsts")
    j = d.join(small(firsts), (F.col("bucket") == F.col("_b")) & (F.col("o") == F.col("first")), "left").drop("o")
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_before").alias("bucket"), F.lit(1).alias("guest"))
    d = j.select("doc_id", "t", F.explode(F.when(F.col("_b").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("x"))
    d = d.select("doc_id", "t", "x.bucket", "x.guest")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", F.xxhash64("t"))
    n = F.length("t").cast("long")
    part = F.floor(n / 4).cast("int")
    d = d.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("t").over(order))
    d = d.withColumn("e", F.concat(F.substring(F.col("t"), F.lit(1), (n - part).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), part)))
    d = d.select("bucket", "rn", "guest", "doc_id", n.alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("t").alias("t")), F.struct(F.lit(1).alias("which"), F.col("e").alias("t")))).alias("v"))
    # Grouping by bucket and row needs no shuffle: the window has dealt the rows by bucket.
    keys = ["bucket", "rn", "guest", "doc_id", "n_chars", "edited_sha256", "which"]
    f = vote(d.select(*keys[:-1], "v.which", F.col("v.t").alias("t")), "t", *keys)
    side = lambda i: F.max(F.when(F.col("which") == i, F.col("fingerprint")))
    f = f.groupBy(*keys[:-1]).agg(side(0).alias("fingerprint"), side(1).alias("edited_fingerprint"))
    f = f.withColumn("_next", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("rn"))).where("guest = 0")
    return f.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    f = cut(edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "fingerprints")
    near = cut(neighbours(f.select(F.col("doc_id").alias("id"), "fingerprint")), "neighbours")
    return f.join(small(near), "fingerprint").select(*f.columns, "class_id", "n_near")
