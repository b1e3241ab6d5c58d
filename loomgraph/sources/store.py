"""Vector store, mention store and build-once artefacts on shared storage."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import node_key

STORE_SCHEMA = "hash_id string, text string, embedding array<float>"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of one namespace; empty when nothing was stored yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.parquet(path).select("hash_id", "text", "embedding")


def missing_texts(texts: DataFrame, store: DataFrame, namespace: str, text: str = "text") -> DataFrame:
    """(hash_id, text) not in the store yet; equal texts once."""
    keyed = texts.select(node_key(namespace + "-", F.col(text)).alias("hash_id"), F.col(text).alias("text")).distinct()
    return keyed.join(store.select("hash_id"), "hash_id", "left_anti")


def upsert_texts(spark: SparkSession, path: str, texts: DataFrame, namespace: str, encoder, text: str = "text",
                 batch: str | None = None) -> None:
    """Encode and append only the new texts.

    With ``batch`` the new rows replace the folder of that batch, so a replayed batch is not doubled."""
    if batch is None:
        new = missing_texts(texts, read_store(spark, path), namespace, text)
        new.select("hash_id", "text", encoder(F.col("text")).alias("embedding")).write.mode("append").parquet(path)
        return
    existing = read_store_partitions(spark, path).where(F.col("batch") != batch)
    new = missing_texts(texts, existing, namespace, text)
    new.select("hash_id", "text", encoder(F.col("text")).alias("embedding")).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_store_partitions(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORE_SCHEMA + ", batch string")
    return spark.read.schema(STORE_SCHEMA + ", batch string").option("basePath", path).parquet(path)


def vectors_in_order(store: DataFrame, requests: DataFrame, ids: str = "hash_ids") -> DataFrame:
    """Explode request rows (request_id, hash_ids) to their vectors with the requested position."""
    asked = requests.select("request_id", F.posexplode(ids).alias("place", "hash_id"))
    return asked.join(store.select("hash_id", "embedding"), "hash_id")


def read_mentions_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Mention cache file {passage id: [entities]}, {sentence: [entities]} as two long tables."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json(
        "value", "passage_hash_id_to_entities map<string,array<string>>, sentence_to_entities map<string,array<string>>").alias("r"))
    passages = whole.select(F.explode("r.passage_hash_id_to_entities").alias("passage_id", "e")).select("passage_id", F.explode("e").alias("entity"))
    sentences = whole.select(F.explode("r.sentence_to_entities").alias("sentence", "e")).select("sentence", F.explode("e").alias("entity"))
    return passages.distinct(), sentences.distinct()


def unread_passages(passages: DataFrame, mentions: DataFrame) -> DataFrame:
    """Passages whose mentions are not stored yet."""
    return passages.join(mentions.select("client_id", "passage_id").distinct(), ["client_id", "passage_id"], "left_anti")


def merge_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored mentions with the passages and sentences of ``new`` replaced by the newer rows."""
    kept = old.join(new.select("client_id", "passage_id").distinct(), ["client_id", "passage_id"], "left_anti")
    return kept.unionByName(new).distinct()


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False,
               partition_by: list[str] | None = None) -> DataFrame:
    """Read a finished artefact, or build and write it. A folder without its success mark is rebuilt."""
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        writer = build().write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)


def append_metrics(spark: SparkSession, path: str, metrics: dict) -> None:
    """Append one metrics record as a JSON line part."""
    spark.createDataFrame([(json.dumps(metrics),)], "value string").write.mode("append").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, question string, label string, pred string, desc string").json(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML body as text parts: node elements (id, text) and weighted edge elements.

    The parts sort as header, nodes, edges, footer; concatenating them gives one document."""
    def esc(c):
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    spark = nodes.sparkSession
    head = ('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
            '<key id="content" for="node" attr.name="content" attr.type="string"/>\n'
            '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n<graph id="G" edgedefault="undirected">')
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0_header")
    nodes.select(F.concat(F.lit('<node id="'), F.col("hash_id"), F.lit('"><data key="content">'), esc(F.col("text")), F.lit("</data></node>")).alias("value")
                 ).write.mode("overwrite").text(f"{path}/1_nodes")
    edges.where("src < dst").select(F.concat(F.lit('<edge source="'), F.col("src"), F.lit('" target="'), F.col("dst"), F.lit('"><data key="weight">'),
                 F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value")).write.mode("overwrite").text(f"{path}/2_edges")
    spark.createDataFrame([("</graph>\n</graphml>",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/3_footer")


def write_weights(weights: DataFrame, path: str, trainable: list[str] | None = None) -> None:
    """Checkpoint of (module, param, idx, value) rows, optionally only the trainable parameters."""
    kept = weights if trainable is None else weights.where(F.col("param").isin(*trainable))
    kept.write.mode("overwrite").partitionBy("module").parquet(path)
