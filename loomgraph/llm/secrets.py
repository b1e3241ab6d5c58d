"""Secret scans: candidates by pattern, then a random forest that drops false positives.

Candidates are runs of at least 16 key characters, long words and names of files among them. Their features are column expressions: length,
transitions between character classes, shares of classes, different characters, how many letters dictionary
words cover, marks of the path, and the neighbouring words. The forest is trained on labelled findings with
Spark ML, on a sample bounded by ``fit_rows``; all candidates of all texts are scored.

No Python runs on executors, nothing is shuffled but the bounded training sample.

Defined results: a null or empty text has no candidates; each occurrence is one row, repeated rows included;
a null path has no marks; without findings of both labels every candidate keeps the score 0.5; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import words_of

LEAST = 16
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 40, 8, 11
KEY = r"[A-Za-z0-9+/_-]{16,}={0,2}"
# fixed values: words that name a secret, and words that stand in real text or in placeholders
SECRET_WORDS = ("access", "apikey", "api", "auth", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")
DICTIONARY = ("and", "change", "const", "data", "default", "dummy", "example", "file", "for", "from", "have", "http", "https", "image", "index", "insert", "name", "page",
              "placeholder", "sample", "self", "test", "that", "the", "this", "user", "value", "version", "with", "www", "xxxx", "your")
PATH_MARKS = ("test", "example", "sample", "fixture", "doc")
FEATURES = ("length", "transitions", "digits", "uppers", "others", "different", "hex", "covered", "letter_run", "named_in_word", "named_before", "assigned", "quoted", "next_secret",
            "path_depth", "path_marks")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", least: int = LEAST) -> DataFrame:
    """(doc_id, place, word, candidate, before, after, path): ``place`` is the number of the word in its text."""
    where = F.lit(None).cast("string") if path is None else F.col(f"`{path}`").cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), where.alias("path"), words_of(F.col(f"`{text}`")).alias("w"))
    looks = lambda x: (F.length(x) >= least) & x.rlike(KEY)
    places = F.filter(F.transform("w", lambda x, i: F.when(looks(x), i)), lambda i: i.isNotNull())
    found = rows.select("doc_id", "path", "w", F.explode(places).alias("place"))
    found = found.select("doc_id", "path", "place", F.get("w", F.col("place")).alias("word"), F.get("w", F.col("place") - 2).alias("before2"),
                         F.get("w", F.col("place") - 1).alias("before"), F.get("w", F.col("place") + 1).alias("after"))
    found = found.withColumn("candidate", F.explode(F.regexp_extract_all("word", F.lit(KEY), F.lit(0))))
    return found.withColumn("place", F.col("place").cast("bigint"))


def features(found: DataFrame) -> DataFrame:
    """``found`` with the columns FEATURES, all double."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    none = lambda x: F.lower(F.coalesce(F.col(x), F.lit("")))
    count = lambda pattern, x=c: F.regexp_count(x, F.lit(pattern)).cast("double")
    names = "|".join(SECRET_WORDS)
    rest = F.lower(F.regexp_replace(F.col("word"), F.lit(KEY), F.lit(" ")))
    flag = lambda x: x.cast("double")
    values = {
        "length": n,
        "transitions": count("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])") / n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "others": count("[^A-Za-z0-9]") / n,
        "different": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "hex": flag(c.rlike("^[0-9a-f]+$")),
        "covered": (n - F.length(F.regexp_replace(F.lower(c), F.lit("|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))), F.lit("")))) / n,
        "letter_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)).cast("double") / n,
        "named_in_word": flag(rest.rlike(names)),
        "named_before": flag(none("before").rlike(names) | none("before2").rlike(names)),
        "assigned": flag(F.col("word").rlike("[=:].*" + KEY) | none("before").rlike("[=:]$")),
        "quoted": flag(F.col("word").rlike("[\"'`]")),
        "next_secret": flag(none("after").rlike(names)),
        "path_depth": F.regexp_count(none("path"), F.lit("/")).cast("double"),
        "path_marks": flag(none("path").rlike("|".join(PATH_MARKS))),
    }
    return found.select("*", *[F.coalesce(values[k], F.lit(0.0)).alias(k) for k in FEATURES])


def train(findings: DataFrame, label: str = "label", fit_rows: int = FIT_ROWS):
    """A forest fitted on at most ``fit_rows`` labelled findings; None if the table lacks one of the labels.

    The sample holds those of least hash of every label, a rare label up to its equal part of ``fit_rows``; weights give
    each label its share of the whole table."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = features(findings).select(*FEATURES, F.col(f"`{label}`").cast("double").alias("label"), F.xxhash64("candidate", "doc_id", "place").alias("h"))
    rows = materialise(rows.where("label IS NOT NULL"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy("count", "label").collect()}
    if not {0.0, 1.0} <= set(counts):
        return None
    parts, left = [], fit_rows
    for k, (value, count) in enumerate(counts.items()):
        take = min(count, max(1, left // (len(counts) - k)))
        left -= take
        parts.append(rows.where(F.col("label") == value).orderBy("h", *FEATURES).limit(take).withColumn("weight", F.lit(count / take)))
    sample = reduce(DataFrame.unionByName, parts).coalesce(1).persist()
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    model = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(rows)
    sample.unpersist()
    return model


def scan(docs: DataFrame, model, **columns) -> DataFrame:
    """(doc_id, place, candidate, score, secret) for every candidate; ``score`` is the forest's vote share."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = features(candidates(docs, **columns))
    if model is None:
        return found.select("doc_id", "place", "candidate", F.lit(0.5).alias("score"), F.lit(True).alias("secret"))
    voted = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    voted = voted.withColumn("score", vector_to_array("probability")[1])
    return voted.select("doc_id", "place", "candidate", "score", (F.col("score") >= 0.5).alias("secret"))


def weak_findings(found: DataFrame) -> DataFrame:
    """Findings with labels where no reviewed ones are given: 1 for the forms that issuers publish and for
    values that a secret's name is assigned to, 0 for runs with dictionary words or long stretches of letters
    that no name stands near; null (not used) for the others."""
    c = F.col("candidate")
    near = F.lower(F.concat_ws(" ", "before2", "before", F.regexp_replace(F.col("word"), F.lit(KEY), F.lit(" "))))
    named = near.rlike("|".join(SECRET_WORDS)) & (F.col("word").rlike("[=:]") | F.coalesce(F.col("before").rlike("[=:]$"), F.lit(False)))
    issued: Column = c.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-|^sk-[A-Za-z0-9]{20,}$")
    worded = c.rlike("[A-Za-z]{14,}") | F.lower(c).rlike("example|placeholder|sample|xxxx|http")
    return found.withColumn("label", F.when(issued, 1).when(worded, 0).when(named, 1).when(~named & c.rlike("[-_/]"), 0))
