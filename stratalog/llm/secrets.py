"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is what is assigned to a key word (of any length; in quotes, up to the closing one), a token with a known
prefix or a private key in PEM, or a run of at least 16 token characters with a digit in it. Features: its length and character mix, its
character transitions, how much of it dictionary words cover, what its path says, and the neighbouring words: those in
the BEFORE characters before it and the AFTER characters behind it, whatever lies between. The
forest is trained from labelled findings (columns candidate, before, after, path, label): the caller's, or those that
``labelled_findings`` generates from public secret and non-secret formats; at most ``MAX_FINDINGS`` are used.

Null and empty texts have no candidates. A null path counts as no path. Texts are read whole. Repeated rows give their
findings again. ``start`` counts code points from 0.
"""
from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import small
from stratalog.plans.scratch import cut

MAX_FINDINGS, TREES, DEPTH, SEED = 20_000, 20, 6, 11
#: Characters of the text before and after a candidate.
BEFORE, AFTER = 48, 24
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
#: Words of identifiers and prose that a random string doesn't hold.
DICTIONARY = "access account address admin application article build cache class client code commit config content count data date default dev document error event example field file format function group handler hash header image index info item key language level library line link list local login main message method model module name network node number object option order page path user password point policy private process production profile project public query release report request resource result role root sample schema search secret section server service session source stage start state status system table task temp test text time title token type update upload url value version video view window with work year your".split()
#: The commonest letter pairs of English text.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
KEYWORDS = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential)"
#: Values after a key word, the rest of its name, and = or :. The first test is for speed: most places fail it.
ASSIGNED = (
    r"(?<=[=:>][ \t]{0,4}[\"'`]?|[Rr] )(?<=" + KEYWORDS + r"[\w.\-]{0,32}[\"'`\]]{0,2}[ \t]{0,8}[=:!]{0,2}[=:]>?[ \t]{0,4}[\"'`]?|(?i:bearer) )"
    r"(?:(?<=\")[^\"\n]++(?=\")|(?<=')[^'\n]++(?=')|(?<=`)[^`\n]++(?=`)|[^\s\"'`<>,;=:][^\s\"'`<>]*(?<![,;.)\]}]))"
)
PREFIXED = r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w\-]{20,}|xox[abprs]-[\w\-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[\w\-]{35})"
PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|(?:\s+[A-Za-z0-9+/=]{20,})+)"
ANY = "|".join([PEM, ASSIGNED, CANDIDATE, r"(?<![A-Za-z0-9])" + PREFIXED])
BENIGN = r"(?i)(sha-?1|sha-?256|md5|checksum|digest|commit|revision|uuid|guid|etag|integrity|example|sample|build|card|phone|order|isbn|id)\W*$"
BENIGN_AFTER = r"(?i)\b(sha-?1|sha-?256|md5|checksum|digest|commit|revision|uuid|guid|etag|example|sample|build|order)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234567|abcdef)"
FEATURES = ["f_len", "f_digit", "f_upper", "f_lower", "f_switch", "f_pairs", "f_words", "f_hex", "f_digits_only", "f_placeholder", "f_path_test", "f_path_conf", "f_key", "f_benign", "f_assign", "f_quote", "f_key_after", "f_benign_after", "f_named", "f_assigned", "f_known", "f_special", "f_code"]


def _share(pattern: str, c: Column) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def features(f: DataFrame) -> DataFrame:
    """``f`` (candidate, before, after, path) with the FEATURES columns, all doubles."""
    c, before, after, path = F.col("candidate"), F.coalesce(F.col("before"), F.lit("")), F.coalesce(F.col("after"), F.lit("")), F.lower(F.coalesce(F.col("path"), F.lit("")))
    lone = F.lower(c)
    cols = {
        "f_len": F.least(F.length(c), F.lit(256)),
        "f_digit": _share("[0-9]", c),
        "f_upper": _share("[A-Z]", c),
        "f_lower": _share("[a-z]", c),
        # character transitions: changes of class, and pairs that are common in prose
        "f_switch": _share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])", c),
        "f_pairs": _share("(?=" + "|".join(PAIRS) + ")", lone),
        "f_words": 1 - F.length(F.regexp_replace(lone, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / F.length(c),
        "f_hex": c.rlike("^[0-9a-fA-F]+$"),
        "f_digits_only": c.rlike("^[0-9_+/-]+$"),
        "f_placeholder": c.rlike(PLACEHOLDER),
        "f_path_test": path.rlike("test|example|sample|doc|mock|fixture"),
        "f_path_conf": path.rlike(r"\.env|conf|secret|cred|\.pem|\.ya?ml|\.ini|deploy"),
        "f_key": before.rlike(KEYWORDS),
        "f_benign": before.rlike(BENIGN) | before.rlike(r"(?i)(sha-?1|sha-?256|md5|checksum|digest|commit|revision|uuid)"),
        "f_assign": before.rlike(r"[=:]\s*[\"']?$"),
        "f_quote": before.rlike("[\"']$"),
        "f_key_after": after.rlike(KEYWORDS),
        "f_benign_after": after.rlike(BENIGN_AFTER),
        "f_assigned": before.rlike(KEYWORDS + r"[\w.\-]*[\"'`\]]*\s*[=:!]*[=:]>?\s*[\"'`]?$|(?i:bearer) $"),
        "f_known": c.rlike("^(?:" + PREFIXED + "|" + PEM + ")"),
        "f_special": _share(r"[^A-Za-z0-9\s]", c),
        # calls, variables, prose, URLs and masks
        "f_code": c.rlike(r"[A-Za-z_]\(|^[$]?[{(\[%]|^[$][A-Za-z_]|://|^(.)\1*$|\w \w|(?i)^(true|false|null|none|nil|string|str|int|undefined)$"),
        # a name to which something is assigned
        "f_named": after.rlike(r"^[\"']?\s*:?=(?!=)|^[\"']?:\s"),
    }
    return f.withColumns({n: F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in cols.items()})


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Findings with labels, the same at every call: secrets in the ways that they leak, and what scanners mistake for
    them. ``template`` says which way it is, so that models can be tested on ways that they have not met."""
    i = F.col("id")
    hex40, hex64 = F.sha1(i.cast("string")), F.sha2(i.cast("string"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i), 256))), "=", "")
    letters = F.substring(F.translate(b64, "0123456789+/", "qzwxkvjfhgQZ"), 1, 28)
    up = F.upper(F.substring(F.translate(b64, "+/", "xy"), 1, 16))
    word = lambda salt: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    num = lambda k: F.lpad(F.pmod(F.xxhash64(i, F.lit(k)), F.lit(10**16)).cast("string"), 16, "0")
    uuid = F.concat_ws("-", *[F.substring(hex40, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    path = lambda *p: F.element_at(F.array(*map(F.lit, p)), (F.pmod(F.xxhash64(i, F.lit("p")), F.lit(len(p))) + 1).cast("int"))
    anywhere = path("src0", "src7", "app/config.yml", "src/main.py", ".env", "deploy/prod.ini", "docs/guide.md", "web")
    tests, plain = path("tests/test_auth.py", "examples/demo.py", "docs/sample.md"), F.concat(word("w"), F.lit(" "), word("z"), F.lit(" "))
    quote = F.when(i % 2 == 0, '"').otherwise("")
    key = lambda s: F.concat(word("k"), F.lit(f" {s}"), quote)
    kinds = [  # candidate, before, path, label, after if it isn't the quote
        (hex40, key("token = "), anywhere, 1), (hex40, key("TOKEN = "), anywhere, 1), (b64, key("secret: "), anywhere, 1),
        (F.concat(F.lit("AKIA"), up), key("access_key = "), anywhere, 1), (F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), key("auth: "), anywhere, 1),
        (F.substring(b64, 1, 24), key("password="), anywhere, 1), (hex64, key("api_key: "), anywhere, 1), (F.substring(hex40, 1, 32), key("apikey="), anywhere, 1),
        (num("card"), plain, anywhere, 0), (num("card2"), F.concat(plain, F.lit("card ")), anywhere, 0), (hex40, F.concat(plain, F.lit("commit ")), anywhere, 0),
        (hex64, key("sha256: "), anywhere, 0), (F.substring(hex40, 1, 32), key("md5 checksum = "), anywhere, 0), (uuid, F.concat(plain, F.lit("uuid=")), anywhere, 0),
        (F.concat(word("a"), F.lit("_"), word("b"), F.lit("_"), word("c"), i), plain, anywhere, 0), (F.concat(F.lit("/"), word("a"), F.lit("/"), word("b"), F.lit("/v2/"), word("c")), key("path = "), anywhere, 0),
        (F.concat(F.lit("your_token_example_"), i), key("token = "), tests, 0), (F.concat(F.lit("xxxxxxxx1234567"), i), key("password="), tests, 0),
        (F.concat(F.lit("2024-01-0"), i % 9, F.lit("T10-00-00Z")), plain, anywhere, 0), (hex40, plain, anywhere, 0),
        (hex40, plain, anywhere, 1, " is the api token"), (F.substring(b64, 1, 24), plain, anywhere, 1, " as password for it"), (hex40, plain, anywhere, 0, " is the commit"), (hex64, plain, anywhere, 0, " (sha256 checksum)"),
        (F.substring(b64, 1, 28), F.concat(key("token = "), F.substring(hex40, 1, 20), F.lit(".")), anywhere, 1), (b64, F.concat(F.lit("AWS_SECRET_ACCESS_KEY_"), i % 10, F.lit(" = "), quote), anywhere, 1),
        (F.concat(F.upper(word("a")), F.lit("_SECRET_ACCESS_KEY_"), i % 10), plain, anywhere, 0, ' = "'),
        (F.concat(F.substring(b64, 1, 6), F.lit("!"), F.substring(hex40, 1, 2)), key("password = "), anywhere, 1), (F.substring(b64, 1, 10), key("pwd="), anywhere, 1), (F.concat(word("a"), F.substring(num("n"), 1, 4), F.lit("$!")), key("password: "), anywhere, 1),
        (F.concat(F.substring(b64, 1, 5), F.lit("@"), F.substring(b64, 9, 4), F.lit("%."), F.substring(hex40, 1, 5)), key("passwd: "), anywhere, 1), (letters, key("token = "), anywhere, 1), (F.lower(F.substring(letters, 1, 12)), key("secret="), anywhere, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))), plain, anywhere, 1), (F.concat(F.lit("ghp_"), letters), plain, anywhere, 1), (F.concat(F.lit("AKIA"), up), plain, anywhere, 1), (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "x"), 1, 36)), key("see "), anywhere, 1),
        (F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(b64, "[+/]", "Q"), 1, 24)), key("stripe: "), anywhere, 1), (F.concat(F.lit("glpat-"), F.substring(letters, 1, 20)), plain, anywhere, 1), (F.concat(F.lit("xoxb-"), F.substring(num("x"), 1, 12), F.lit("-"), letters), key("slack = "), anywhere, 1),
        (F.concat(F.lit("AIza"), F.substring(F.concat(letters, hex40), 1, 35)), plain, anywhere, 1), (F.concat(F.lit("github_pat_"), letters), plain, anywhere, 1), (F.concat_ws(".", b64, F.substring(b64, 5, 30), hex40), key("token = "), anywhere, 1),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, F.lit("\n"), b64, F.lit("\n-----END RSA PRIVATE KEY-----")), plain, anywhere, 1),
        (word("a"), key("token: "), anywhere, 0), (F.concat(word("a"), F.lit("_"), word("b")), key("secret: "), anywhere, 0), (F.concat(word("a"), F.lit("_"), word("b"), F.lit("()")), key("token = "), anywhere, 0), (F.concat(F.lit("${"), F.upper(word("a")), F.lit("}")), key("password="), anywhere, 0),
        (F.concat_ws(" ", word("a"), word("b"), word("c")), key("password: "), anywhere, 0), (F.concat(F.lit("your_"), word("a")), key("password: "), anywhere, 0), (F.lit("********"), key("pwd="), anywhere, 0), (F.concat(F.lit("https://"), word("a"), F.lit(".com/"), word("b")), key("auth: "), anywhere, 0),
        (F.element_at(F.array(*map(F.lit, ("true", "null", "None", "string"))), (F.pmod(F.xxhash64(i), F.lit(4)) + 1).cast("int")), key("token: "), anywhere, 0), (F.concat(F.lit("self."), word("a"), F.lit("."), word("b")), key("token = "), anywhere, 0),
    ]
    kinds = [(*k, quote)[:5] for k in kinds]
    pick = lambda at: F.element_at(F.array(*[k[at] if isinstance(k[at], Column) else F.lit(k[at]) for k in kinds]), (i % len(kinds) + 1).cast("int"))
    return spark.range(0, n, 1, 4).select(pick(0).alias("candidate"), pick(1).alias("before"), pick(4).alias("after"), pick(2).alias("path"), pick(3).cast("double").alias("label"), (i % len(kinds)).cast("int").alias("template"))


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings, at most MAX_FINDINGS of them."""
    f = features(findings.select("candidate", "before", "after", "path", "label").limit(MAX_FINDINGS))
    v = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(f).select("v", "label")
    return RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(v)


def candidates(docs: DataFrame, text: str = "text", path: str = "source", pattern: str = CANDIDATE) -> DataFrame:
    """Every candidate with its place and neighbours; one pass, and a shuffle of their lengths only."""
    d = docs.select("doc_id", F.col(text).alias("t"), F.col(path).cast("string").alias("path")).where(F.col("t").rlike(pattern))
    d = d.withColumn("row", F.monotonically_increasing_id())
    d = d.select("doc_id", "path", "row", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("found"), F.split("t", pattern, -1).alias("gaps"))
    d = d.select("doc_id", "path", "row", F.posexplode(F.arrays_zip(F.concat("found", F.array(F.lit(""))).alias("c"), F.col("gaps").alias("g"))).alias("at", "x"))
    near, head = F.right(F.col("x.g"), F.lit(BEFORE)), F.substring(F.concat(F.substring("x.g", 1, AFTER), "x.c"), 1, AFTER)
    tail = F.right(F.concat(near, "x.c"), F.lit(BEFORE))
    d = d.select("doc_id", "path", "row", "at", F.col("x.c").alias("candidate"), F.length("x.g").cast("long").alias("gap"), near.alias("near"), head.alias("head"), tail.alias("tail"))
    w = Window.partitionBy("row").orderBy("at")
    past = F.sum(F.col("gap") + F.length("candidate")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("candidate")
    d = d.withColumn("start", past.cast("long"))
    # A candidate has a character at least, so that so many neighbours hold BEFORE and AFTER of them.
    d = d.withColumn("before", F.right(F.concat(F.array_join(F.collect_list("tail").over(w.rowsBetween(-BEFORE, -1)), ""), "near"), F.lit(BEFORE)))
    d = d.withColumn("after", F.substring(F.array_join(F.collect_list("head").over(w.rowsBetween(1, AFTER)), ""), 1, AFTER))
    return d.where("candidate <> ''").select("doc_id", "path", "start", F.length("candidate").cast("long").alias("length"), "candidate", "before", "after")


def scan(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", path: str = "source", threshold: float = 0.5) -> DataFrame:
    """Candidates with ``score`` and ``is_secret``."""
    v = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(features(candidates(docs, text, path, ANY)))
    s = model.setFeaturesCol("v").transform(v).withColumn("score", vector_to_array("probability")[1])
    return s.select("doc_id", "start", "length", "candidate", "path", "score", (F.col("score") >= threshold).alias("is_secret"))


def query(spark, sf_dir: str) -> DataFrame:
    """A row for each candidate; the candidate itself only as its digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan(docs, train(labelled_findings(spark)))
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are replaced by ``[SECRET]``, place by place, and ``n_chars`` follows."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    # Spans hold for one text only: rows that share a doc_id are told apart by it.
    keyed = docs.select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("doc_id"), "text", "source")
    found = scan(keyed, train(labelled_findings(spark)))
    # What is a secret in one place of a text is one wherever it is a candidate there.
    same = found.groupBy(F.col("doc_id").alias("_id"), "candidate").agg(F.max("is_secret").alias("is_secret"), F.collect_set(F.struct("start", "length")).alias("_at")).where("is_secret")
    bad = cut(same.groupBy("_id").agg(F.array_sort(F.flatten(F.collect_list("_at"))).alias("_at")), "secrets")
    j = docs.select(*cols).join(small(bad), F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).eqNullSafe(F.col("_id")), "left")
    t, mask = F.col("text"), F.lit("[SECRET]")

    def piece(s: Column, x: Column) -> Column:
        return F.struct(F.concat(s["out"], F.substring(t, (s["end"] + 1).cast("int"), (x["start"] - s["end"]).cast("int")), mask).alias("out"), (x["start"] + x["length"]).alias("end"))

    rest = lambda s: F.concat(s["out"], F.substring(t, (s["end"] + 1).cast("int"), F.length(t)))
    masked = F.aggregate("_at", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("end")), piece, rest)
    clean = F.when(F.col("_id").isNull(), t).otherwise(masked)
    j = j.withColumn("text", clean).withColumn("n_chars", F.when(F.col("_id").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return j.select(*cols)
