"""Secret scans: candidate strings by pattern, false positives removed by a random forest on labelled findings.

Everything on this path is DataFrame and SQL functions and Spark's own forest; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, crc_fold, written

ASSIGNED = r"""(?i:(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential)s?["']?\s{0,3}[:=]\s{0,3})"""
LONG = r"[A-Za-z0-9_+/=-]{20,}"
#: An assigned value: the whole string up to its closing quote on the same line, or the run up to white space, however short.
#: Signs that end a statement or a bracket behind a run without quotes are not part of it. Both are possessive: Java's
#: matcher calls itself for every turn of a loop that it may take back, and a long value would exhaust the stack.
QUOTED = r"""(?:"(?!")[^"\\\r\n]*+(?:\\.[^"\\\r\n]*+)*+(?=")|'(?!')[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+)*+(?='))"""
BARE = r"""["']?[^\s"'](?:[^\s"'),;\]}>]++|["'),;\]}>]++(?!\s|\z))*+"""
#: user:pass@ of a URL; the user goes to the text before.
LOGIN = r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s:/?#@\"']{0,128}:"
URL_PASS = r"[^\s/\"'@](?:[^\s/\"']*[^\s/\"'@])?(?=@)"
CANDIDATE = f"{ASSIGNED}(?:{QUOTED}|{BARE})|{LOGIN}{URL_PASS}|{LONG}"
#: Upper bound of the labelled findings that the forest is fitted on, drawn by a hash.
SAMPLE_ROWS = 20_000
#: Words of at least four letters that make up so large a share of all such words are the dictionary. By this there are at
#: most 200,000 of them, whatever the size of the corpus, which is why it may be broadcast.
DICTIONARY_SHARE = 5e-6
TREES, DEPTH, SEED = 24, 7, 11
THRESHOLD = 0.5
CONTEXT = 48

CREDENTIAL_WORDS = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential)s?\W*$"
DIGEST_WORDS = r"(?i)(sha\d*|md5|commit|checksum|hash|digest|uuid|etag|revision|build|id|ref)\W*$"
SAMPLE_VALUE = r"(?i)(example|sample|dummy|placeholder|fake|your|xxxx|changeme)"
SAMPLE_BEFORE = r"(?i)\b(example|sample|dummy|placeholder|fake|your)[\s_-]+[\w-]*\W*$"
LINKS = r"(?i)(https?://|www\.|[\w.]@|@|src=|href=)\S*$"
KNOWN_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.?.*|AIza[0-9A-Za-z_-]{35})$"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, path, start, value, rule, before, after) for every candidate of each whole text.

    ``start`` counts code points from 0. The rule is assigned (the value follows a credential word and a sign of
    assignment: a whole quoted string, or the run up to white space), url (the password of user:password@ in a URL) or
    long (20 characters or more). before and after hold up to CONTEXT characters.
    """
    found = docs.select(
        F.col(id_col).alias("doc_id"), (F.col(path_col) if path_col else F.lit(None).cast("string")).alias("path"), F.col(text_col).alias("text")
    ).where(F.col("text").rlike(CANDIDATE))
    found = found.select(
        "doc_id", "path", F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1)).alias("hits"), F.split("text", CANDIDATE, -1).alias("gaps")
    )
    # Places by a running sum over the pieces of one text.
    pieces = F.zip_with("gaps", "hits", lambda g, h: F.struct(F.char_length(g).alias("g"), F.coalesce(F.char_length(h), F.lit(0)).alias("h")))
    starts = F.aggregate(
        pieces,
        F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at")),
        lambda acc, p: F.struct(F.array_append(acc["starts"], acc["at"] + p["g"]).alias("starts"), (acc["at"] + p["g"] + p["h"]).alias("at")),
        lambda acc: acc["starts"],
    )
    rows = found.withColumn("starts", starts).select(
        "doc_id", "path", F.posexplode("hits").alias("i", "hit"), "gaps", "starts"
    ).select(
        "doc_id", "path", "hit", F.element_at("starts", F.col("i") + 1).alias("at"),
        F.substring(F.element_at("gaps", F.col("i") + 1), -CONTEXT, CONTEXT).alias("gap"), F.substring(F.element_at("gaps", F.col("i") + 2), 1, CONTEXT).alias("after"),
    )
    value = F.regexp_replace("hit", f"^(?:{ASSIGNED}[\"']?|{LOGIN})(?=.)", "")
    rows = rows.withColumn("value", value).withColumn("lead", F.expr("left(hit, char_length(hit) - char_length(value))"))
    rule = F.when(F.col("lead") == "", F.lit("long")).when(F.col("lead").rlike(f"^{LOGIN}$"), F.lit("url")).otherwise(F.lit("assigned"))
    return rows.select(
        "doc_id", "path", (F.col("at") + F.char_length("lead")).cast("long").alias("start"), "value", rule.alias("rule"), F.concat("gap", "lead").alias("before"), "after"
    )


def dictionary(docs: DataFrame, text_col: str = "text", share: float = DICTIONARY_SHARE) -> DataFrame:
    """(word) the common words of four letters or more over all texts, counted before the shuffle."""
    words = docs.select(F.explode(F.split(ascii_lower(F.col(text_col)), f"[{SPACE}]+")).alias("word"))
    words = words.where(F.col("word").rlike(r"^\p{L}{4,}[.,;:!?]?$")).select(F.regexp_replace("word", r"[.,;:!?]$", "").alias("word"))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= F.lit(total * share)).select("word")


_KINDS = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]"}
FEATURES = (
    ["chars", "coverage", "distinct", "run", "hex", "vowels", "path_sample", "path_depth", "assigned", "quoted", "credential_word", "digest_word", "sample_word", "link", "known"]
    + [f"share_{k}" for k in _KINDS]
    + [f"{a}_{b}" for a in _KINDS for b in _KINDS]
)


def _count(column: str, pattern: str) -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The findings with one double column per name in FEATURES and a row key.

    Dictionary coverage is the share of a value's characters that stand in letter runs which are dictionary words.
    """
    found = found.withColumn("key", F.xxhash64("doc_id", "start", "value", "before", "after"))
    # Equal rows share a key, whose words count once.
    runs = found.select("key", "value").dropDuplicates(["key"]).select("key", F.explode(F.regexp_extract_all(ascii_lower(F.col("value")), F.lit(r"([a-z]{4,})"), F.lit(1))).alias("word"))
    covered = (
        runs.join(F.broadcast(words), "word").groupBy("key").agg(F.sum(F.char_length("word")).alias("covered"))
    )
    length = F.char_length("value").cast("double")
    own = {
        "chars": length,
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / length,
        "run": F.array_max(F.transform(F.regexp_extract_all("value", F.lit(r"((.)\2*)"), F.lit(1)), F.char_length)) / length,
        "hex": F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "vowels": _count("value", "[aeiouAEIOU]") / length,
        "path_sample": F.coalesce(F.col("path").rlike(r"(?i)(test|example|sample|fixture|mock|doc)"), F.lit(False)),
        "path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)),
        "assigned": F.col("rule") != "long",
        "quoted": F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"),
        "credential_word": F.col("before").rlike(CREDENTIAL_WORDS),
        "digest_word": F.col("before").rlike(DIGEST_WORDS),
        "sample_word": F.col("value").rlike(SAMPLE_VALUE) | F.col("before").rlike(SAMPLE_BEFORE),
        "link": (F.col("rule") != "url") & F.col("before").rlike(LINKS),
        "known": F.col("value").rlike(KNOWN_FORMATS),
        **{f"share_{k}": _count("value", p) / length for k, p in _KINDS.items()},
        **{f"{a}_{b}": _count("value", f"(?<={p})(?={q})") / length for a, p in _KINDS.items() for b, q in _KINDS.items()},
    }
    rows = found.join(covered, "key", "left").withColumn("coverage", F.coalesce("covered", F.lit(0)) / length)
    return rows.withColumns({name: column.cast("double") for name, column in own.items()}).drop("covered")


def weak_labels(rows: DataFrame) -> DataFrame:
    """Labelled findings where no reviewed ones are at hand: 1 for known formats and for quoted, assigned values of mixed characters,
    0 for digests, links, samples and values made of words; the others stay without a label."""
    mixed = (F.col("share_digit") > 0.1) & (F.col("share_digit") < 1) & (F.col("coverage") < 0.5)
    yes = (F.col("known") == 1) | ((F.col("assigned") == 1) & (F.col("quoted") == 1) & mixed & (F.col("sample_word") == 0) & (F.col("distinct") > 0.15))
    no = (F.col("link") == 1) | ((F.col("assigned") == 0) & (F.col("digest_word") == 1)) | (F.col("sample_word") == 1) | (F.col("coverage") >= 0.5) | (F.col("distinct") <= 0.15)
    no = no | ((F.col("assigned") == 0) & (F.col("quoted") == 0) & (F.col("share_digit") < 0.1))
    return rows.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).where("label IS NOT NULL")


def fit(labelled: DataFrame, bound: int = SAMPLE_ROWS) -> RandomForestClassificationModel | float:
    """A forest on about `bound` labelled findings (all if fewer), or the smoothed share of label 1 where one label is missing."""
    counts = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("yes")).first()
    n, yes = counts["n"], counts["yes"] or 0.0
    if not 0 < yes < n:
        return (yes + 1) / (n + 2)
    cut = int(min(1.0, bound / n) * (1 << 30))
    sample = labelled.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) < cut)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    # A written sample in a fixed number of partitions and order gives the same forest on each run.
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("key", "features", "label")
    ready = written(ready.repartitionByRange(4, "key").sortWithinPartitions("key"), "findings-sample")
    if ready.agg(F.countDistinct("label").alias("n")).first()["n"] < 2:
        return (yes + 1) / (n + 2)
    return forest.fit(ready)


def judge(rows: DataFrame, model: RandomForestClassificationModel | float, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (share of the forest for a secret) and is_secret."""
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", folds: int = 5) -> DataFrame:
    """(doc_id, start, value, rule, held_out, score, is_secret) for every candidate of every text.

    labelled: findings with the columns of features(...) and label (0 or 1); without them weak_labels of the findings outside
    fold 0 (crc32 of the id) are used. Null and empty texts have no findings; a null path counts as no path. The same value
    twice in a text gives two rows, repeated documents give their findings each. Without both labels the score is the
    smoothed share of label 1. An empty table gives an empty table; other columns are not read.
    """
    rows = written(candidates(docs, id_col, text_col, path_col), "candidates")
    words = written(dictionary(docs, text_col), "dictionary")
    rows = written(features(rows, words).withColumn("held_out", crc_fold(F.col("doc_id"), folds) == 0), "findings")
    model = fit(labelled if labelled is not None else weak_labels(rows.where("NOT held_out")))
    return judge(rows, model).select("doc_id", "start", "value", "rule", "held_out", "score", "is_secret")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text", "source"))
