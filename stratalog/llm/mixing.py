"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources weigh 1, 2, 3, 1, ... in order of code points, null last, and share 100 % of all words; no target is above
``CAP`` times its source's size, and what is above goes to the others by weight. Each source's documents fall into
``BLOCKS`` blocks by a hash of id and text, a random permutation. A source's quota is a whole number of passes over its
blocks, then further blocks in order, then parts of one last block (as many, by further digits of the hash), then
documents of one last part until its target is met as nearly as whole documents allow. A tree divides the quotas among
output shards: at each node a multivariate-hypergeometric draw says how many of the blocks of each source go left. Each
shard then takes its own stretch of each source's block sequence and shuffles locally.

Null texts have size 0; they, empty texts and sources without words are taken as often as their source's whole passes
say. A null source is a source. Rows with one ``doc_id``, or none, are told apart by their texts, and equal rows are
drawn one by one. There may be any number of sources: all that is kept of them is a table; the driver holds a row for
``GROUP`` of them. Extra columns stay as they are.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import WORD, slim, small
from stratalog.plans.scratch import cut, ranked

WEIGHTS, CAP, SHARDS, SEED, GROUP = (1, 2, 3), 3, 16, 5, 10_000
#: Hexadecimal digits of a row's hash that name its block, as many its part of the block, and all that order rows.
DIGITS, BLOCKS, KEY = 3, 16**3, 15
#: numpy draws from populations below this.
_LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from good and bad are good; exact for populations of any size."""
    if good + bad < _LARGE:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    if bad < min(good, n):
        return n - hypergeometric(rng, bad, good, n)
    if total - n < min(good, n):
        return good - hypergeometric(rng, good, bad, total - n)
    # As many as there are hits when the fewer of both are thrown on different places, of which the others hold the first.
    few, many, hits = min(good, n), max(good, n), 0
    while few:
        step = min(few, 1 << 20)
        at = np.unique(rng.integers(0, total, step))
        while len(at) < step:  # places that were hit twice are thrown again
            at = np.unique(np.concatenate([at, rng.integers(0, total, step - len(at))]))
        now = int(np.searchsorted(at, many))
        hits, many, total, few = hits + now, many - now, total - step, few - step
    return hits


def split(quotas: np.ndarray, shards: int, seed: int = SEED, leaves: np.ndarray | None = None) -> np.ndarray:
    """Exact quotas by shard (rows) and source: each node of the tree draws its left half without replacement.

    ``leaves``: how many units each shard gets in all; by default as equal as can be.
    """
    rng = np.random.Generator(np.random.Philox(key=seed))
    out = np.zeros((shards, len(quotas)), np.int64)

    def draw(counts: np.ndarray, n: int) -> np.ndarray:
        got, left = np.zeros_like(counts), int(counts.sum())
        for i, c in enumerate(counts.tolist()):
            left -= c
            got[i] = hypergeometric(rng, c, left, n) if n else 0
            n -= int(got[i])
        return got

    def node(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        n = int(counts.sum()) * (mid - lo) // (hi - lo) if leaves is None else int(leaves[lo:mid].sum())
        left = draw(counts, n)
        node(lo, mid, left)
        node(mid, hi, counts - left)

    node(0, shards, np.asarray(quotas, np.int64))
    return out


def sources(sizes: DataFrame) -> DataFrame:
    """From (s, n): s, n, i (its place by code point, null last), target, passes (whole ones) and rest (words beyond them)."""
    t = ranked(sizes.select("s", "n", F.col("s").isNull().alias("_null")), "_null", "s", rank="i")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("i") % len(WEIGHTS) + 1).cast("int"))
    t = cut(t.select("s", "n", "i", weight.alias("w")), "sources")
    total, unit, full = t.agg(F.sum("n")).first()[0] or 0, 0.0, -1
    while True:  # a round caps a source at least; the sums are of whole numbers
        over = F.col("w") * F.lit(unit) > CAP * F.col("n")
        now, capped, weights = t.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(over, CAP * F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0))).first()
        if now == full or not weights:
            break
        full, unit = now, (total - capped) / weights
    over = F.col("w") * F.lit(unit) > CAP * F.col("n")
    target = F.when(over, (CAP * F.col("n")).cast("double")).otherwise(F.col("w") * F.lit(unit))
    passes = F.when(F.col("n") > 0, F.least(F.lit(CAP), F.floor(F.col("target") / F.col("n")))).otherwise(1).cast("int")
    rest = F.when((F.col("n") > 0) & (F.col("passes") < CAP), F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("n"))).otherwise(0.0)
    return t.withColumn("target", target).withColumn("passes", passes).withColumn("rest", rest)


def _last(parts: DataFrame, need: str, at: str) -> DataFrame:
    """From the words of each part (s, ``at``, words, ``need``): the first at which their sum is over the need, and what is left to find there."""
    upto = Window.partitionBy("s").orderBy(at)
    p = parts.withColumn("cum", F.sum("words").over(upto)).where(F.col("cum") > F.col(need)).groupBy("s").agg(F.min(F.struct(at, "cum", "words", need)).alias("e"))
    return p.select("s", F.col(f"e.{at}").alias(at), (F.col(f"e.{need}") - (F.col("e.cum") - F.col("e.words"))).alias("left"))


def _same(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    return df.join(other.withColumnRenamed("s", "_o"), F.col("s").eqNullSafe(F.col("_o")), how).drop("_o")


def _shares(t: DataFrame, shards: int) -> DataFrame:
    """(s, cuts): where in a source's sequence of units each shard's stretch ends, the last one's left out."""
    t = t.select("s", "i", F.floor(F.col("i") / GROUP).alias("g"), "units")
    groups = t.groupBy("g").agg(F.sum("units").alias("n")).orderBy("g").collect()  # a row for GROUP sources
    leaves = dict(zip([r["g"] for r in groups], split(np.array([r["n"] for r in groups], np.int64), shards).T, strict=True))

    def divide(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        which = int(g["g"].iloc[0])
        cuts = np.cumsum(split(g["units"].to_numpy(), shards, [SEED, which], leaves[which]), axis=0)[:-1].T
        return pd.DataFrame({"s": g["s"], "cuts": list(cuts)})

    return t.groupBy("g").applyInPandas(divide, "s string, cuts array<long>")


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The columns of ``docs`` with _size, _source_size, _target and _draws: an array of (shard, copy, order key)."""
    slim(docs.sparkSession)
    mine = [F.col(c) for c in docs.columns]
    text = F.coalesce("text", F.lit(""))
    name = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text))
    number = lambda at: F.conv(F.substring("_key", at, DIGITS), 16, 10).cast("int")
    docs = docs.select(*mine, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), F.substring(F.md5(name), 1, KEY).alias("_key"))
    docs = docs.withColumn("_block", number(1))
    rows = cut(docs.select(F.col("source").cast("string").alias("s"), F.col("_block").alias("block"), number(1 + DIGITS).alias("part"), F.col("_key").alias("key"), F.col("_size").alias("size")), "sizes")
    blocks = cut(rows.groupBy("s", "block").agg(F.sum("size").alias("words")), "words")
    t = cut(sources(blocks.groupBy("s").agg(F.sum("words").alias("n"))), "targets")
    # Where the rest ends: windows over one source's blocks, and over the parts of its last one, BLOCKS rows at most each.
    last = cut(_last(_same(blocks, small(t.where("rest > 0").select("s", "rest"))), "rest", "block"), "last")
    inside = _same(rows, small(last.select("s", F.col("block").alias("_last"), "left"))).where("block = _last")
    parts = inside.groupBy("s", "part", "left").agg(F.sum("size").alias("words"))
    last_part = cut(_last(parts, "left", "part").withColumnRenamed("left", "need"), "last_part")
    edge = _same(inside, small(last_part.select("s", F.col("part").alias("_part"), "need"))).where("part = _part")
    # Rows of that part, equal ones as one row with their number, while they bring the sum nearer to what is needed.
    edge = edge.groupBy("s", "key", "size").agg(F.count(F.lit(1)).alias("many"), F.first("need").alias("need"))
    before = F.coalesce(F.sum(F.col("many") * F.col("size")).over(Window.partitionBy("s").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.when(F.col("size") > 0, F.least(F.col("many"), F.floor((F.col("need") - F.col("before")) / F.col("size") + 0.5))).otherwise(F.when(F.col("before") <= F.col("need"), F.col("many")).otherwise(0))
    edge = cut(edge.withColumn("before", before).withColumn("take", F.greatest(F.lit(0), take)).select("s", "key", "size", "many", "take"), "edge")
    ends = _same(last.select("s", F.col("block").alias("last")), last_part.select("s", F.col("part").alias("last_part")), "left")
    # A source whose blocks never exceed the rest has no last one: all of them are taken.
    t = _same(t, ends, "left").withColumn("last", F.when(F.col("rest") > 0, F.coalesce("last", F.lit(BLOCKS - 1))).otherwise(-1))
    t = cut(t.withColumn("units", F.col("passes") * F.lit(BLOCKS).cast("long") + F.col("last") + 1), "units")
    t = cut(_same(t, _shares(t, shards)).select(F.col("s").alias("_s"), F.col("n").alias("_source_size"), F.col("target").alias("_target"), "passes", "last", F.coalesce("last_part", F.lit(BLOCKS)).alias("last_part"), "cuts"), "table")
    j = docs.join(small(t), F.col("source").cast("string").eqNullSafe(F.col("_s")))
    ours = edge.where("take > 0").select(F.col("s").alias("_e"), F.col("key").alias("_k"), F.col("size").alias("_n"), "many", "take")
    j = j.join(small(cut(ours, "edge")), F.col("source").cast("string").eqNullSafe(F.col("_e")) & (F.col("_key") == F.col("_k")) & (F.col("_size") == F.col("_n")), "left")
    part, at_end = number(1 + DIGITS), F.col("_block") == F.col("last")
    whole = (F.col("_block") < F.col("last")) | (at_end & (part < F.col("last_part")))
    chosen = at_end & (part == F.col("last_part")) & F.col("take").isNotNull()
    j = j.withColumn("_extra", whole | (chosen & (F.col("take") == F.col("many"))))
    if not edge.where("take > 0 and take < many").isEmpty():
        # Of some equal rows only so many are taken: these rows are numbered, in tasks of their own.
        some = chosen & (F.col("take") < F.col("many"))
        few = ranked(j.where(some).withColumn("_row", F.monotonically_increasing_id()), "_s", "_key", "_row", rank="_i")
        firsts = few.groupBy(F.col("_key").alias("_fk"), F.col("_s").alias("_fs")).agg(F.min("_i").alias("_first"))
        few = few.join(small(cut(firsts, "firsts")), (F.col("_key") == F.col("_fk")) & F.col("_s").eqNullSafe(F.col("_fs")))
        few = few.withColumn("_extra", F.col("_i") - F.col("_first") < F.col("take")).select(*j.columns)
        j = j.where(~F.coalesce(some, F.lit(False))).unionByName(few)
    times = F.col("passes") + F.when(F.coalesce("_extra", F.lit(False)), 1).otherwise(0)
    unit = lambda c: c.cast("long") * BLOCKS + F.col("_block")
    shard = lambda c: F.size(F.filter("cuts", lambda x: x <= unit(c)))
    draw = lambda c: F.struct(shard(c).alias("shard"), c.alias("copy"), F.xxhash64(F.lit(SEED + 2), "_key", c).alias("key"))
    draws = F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), draw)).otherwise(F.expr("cast(array() as array<struct<shard:int,copy:int,key:bigint>>)"))
    return j.select(*mine, "_size", "_source_size", "_target", draws.alias("_draws"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m = mix(docs)
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.size("_draws") * F.col("_size")).cast("long").alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document is there as often as it is drawn, shard by shard, shuffled within each."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    drawn = mix(docs.select(*cols)).select(*cols, F.explode("_draws").alias("d"))
    # A shard may hold more than a task should: it is dealt to several, by the random key.
    return drawn.repartition(F.col("d.shard"), F.pmod(F.col("d.key"), F.lit(64))).sortWithinPartitions("d.shard", "d.key").select(*cols)


#: The same quotas as one order of rows for each source; the tree decides on shards, which the query does not return.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size,
  substr(md5('{SEED}:' || coalesce(cast(doc_id AS varchar), 'null') || ':' || md5(coalesce(text, ''))), 1, {KEY}) AS key FROM documents),
s AS (SELECT source, sum(size)::bigint AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, {CAP} * n / w AS ratio FROM s),
u AS (SELECT *, ((SELECT sum(n) FROM s) - coalesce(sum({CAP} * n) OVER before, 0))::double / (sum(w) OVER rest)::double AS unit FROM r
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT unit FROM u WHERE NOT w * unit > {CAP} * n ORDER BY ratio, source NULLS LAST LIMIT 1),
g AS (SELECT source, n, CASE WHEN w * coalesce((SELECT unit FROM f), 1e300) > {CAP} * n THEN cast({CAP} * n AS double) ELSE w * (SELECT unit FROM f) END AS target FROM s),
p AS (SELECT *, CASE WHEN n > 0 THEN least({CAP}, cast(floor(target / n) AS bigint)) ELSE 1 END AS passes FROM g),
q AS (SELECT *, CASE WHEN n > 0 AND passes < {CAP} THEN greatest(0.0::double, target - passes * n) ELSE 0.0::double END AS rest FROM p),
x AS (SELECT d.*, q.n, q.target, q.passes, q.rest, sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, n AS source_size, target, cast(size * (passes + CASE WHEN rest > 0 AND cum - size / 2.0::double <= rest THEN 1 ELSE 0 END) AS bigint) AS taken FROM x
"""
