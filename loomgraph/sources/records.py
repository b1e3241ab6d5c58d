"""QA record files: record scan, description resolution, splits, prompt fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import question_field, strip
from ..operators.ranking import numbered
from .store import path_exists

# Record file names in order of preference.
RECORD_FILES = ("records.jsonl", "manifest.jsonl", "dataset.jsonl")
RECORD_SCHEMA = "id string, _id string, question string, answer string, label string, desc string, retrieved_passages array<string>"


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of the first record file found, numbered ``idx`` from 0 in file order."""
    for name in RECORD_FILES:
        path = f"{root.rstrip('/')}/{name}"
        if path_exists(spark, path):
            rows = spark.read.schema(RECORD_SCHEMA).json(path).withColumn("_line", F.monotonically_increasing_id())
            return numbered(rows, [], [F.col("_line")], F.floor(F.col("_line") / F.lit(65_536)), "idx").drop("_line")
    raise FileNotFoundError(f"no record file under {root}: expected one of {', '.join(RECORD_FILES)}")


def answer_text(answer: Column) -> Column:
    """A JSON list of answers becomes a '|'-joined string; other text stays."""
    listed = F.from_json(answer, "array<string>")
    return F.when(answer.startswith("["), F.coalesce(F.array_join(listed, "|"), answer)).otherwise(answer)


def resolve_description(records: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """desc: cached text, else the record's own, else its passages, else ''."""
    base = records if cached is None else records.join(cached.select("id", F.col("desc").alias("cached_desc")), "id", "left")
    own = F.when(strip(F.coalesce("desc", F.lit(""))) != "", strip(F.col("desc")))
    from_passages = F.when(F.size(F.coalesce("retrieved_passages", F.array().cast("array<string>"))) > 0,
                           F.concat(F.lit("\n\nRetrieved passages:\n"), F.array_join("retrieved_passages", "\n")))
    options = ([F.col("cached_desc")] if cached is not None else []) + [own, from_passages, F.lit("")]
    return base.withColumn("desc", F.coalesce(*options)).drop("cached_desc")


def read_cached_descriptions(spark: SparkSession, root: str) -> DataFrame:
    """(id, desc) from ``cached_desc/<id>.txt``."""
    path = f"{root.rstrip('/')}/cached_desc"
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id string, desc string")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("desc"))
    return files.select(F.url_decode(F.regexp_extract("f", r"([^/]+)\.txt$", 1)).alias("id"), "desc")


def dataset_rows(records: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """idx, id, question (prompt form), label (lower-cased), desc, retrieved_passages."""
    named = records.withColumn("id", F.coalesce("id", "_id", F.col("idx").cast("string")))
    return resolve_description(named, cached).select(
        "idx", "id", question_field(F.col("question")).alias("question"),
        F.lower(answer_text(F.coalesce("answer", "label", F.lit("")))).alias("label"), "desc",
        F.coalesce("retrieved_passages", F.array().cast("array<string>")).alias("retrieved_passages"))


def positional_split(rows: DataFrame, idx: str = "idx") -> DataFrame:
    """train / val / test by position: floor(0.8 n) and floor(0.9 n)."""
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    train = F.floor(F.lit(0.8) * F.col("_n"))
    val = F.floor(F.lit(0.9) * F.col("_n"))
    return rows.join(F.broadcast(total)).withColumn(
        "split", F.when(F.col(idx) < train, "train").when(F.col(idx) < val, "val").otherwise("test")).drop("_n")


def file_split(spark: SparkSession, root: str, rows: DataFrame, idx: str = "idx") -> DataFrame:
    """Split by index files when all three exist, by position otherwise."""
    names = {s: f"{root.rstrip('/')}/split/{s}_indices.txt" for s in ("train", "val", "test")}
    if not all(path_exists(spark, p) for p in names.values()):
        return positional_split(rows, idx)
    listed = None
    for split, path in names.items():
        part = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("bigint").alias(idx), F.lit(split).alias("split"))
        listed = part if listed is None else listed.unionByName(part)
    return rows.join(listed, idx)
