"""Incremental ingest: a stream of passages keeps the vector and mention stores up to date.

Each micro-batch encodes and reads only texts that no earlier batch has stored. A replayed batch
rewrites its own folder, so a restart does not duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import Encoder
from ..operators.recognise import Recogniser, distinct_passages, passage_mentions
from ..session import keep
from ..sources.store import path_exists, upsert_texts

MENTION_SCHEMA = "client_id int, passage_id string, sentence string, entity string, batch string"


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], MENTION_SCHEMA)
    return spark.read.schema(MENTION_SCHEMA).option("basePath", path).parquet(path)


def ingest_batch(batch: DataFrame, batch_id: int, root: str, encoder: Encoder, recogniser: Recogniser | None = None) -> None:
    """Store new passages' mentions, then the vectors of new passages, sentences and entities."""
    spark = batch.sparkSession
    name = f"{batch_id:012d}"
    passages = keep(distinct_passages(batch))
    known = read_mentions(spark, f"{root}/mentions").where(F.col("batch") != name).select("client_id", "passage_id").distinct()
    unread = passages.join(known, ["client_id", "passage_id"], "left_anti")
    passage_mentions(unread, recogniser).write.mode("overwrite").parquet(f"{root}/mentions/batch={name}")
    new = read_mentions(spark, f"{root}/mentions").where(F.col("batch") == name)
    upsert_texts(spark, f"{root}/passage", passages, "passage", encoder, batch=name)
    upsert_texts(spark, f"{root}/sentence", new.select(F.col("sentence").alias("text")), "sentence", encoder, batch=name)
    upsert_texts(spark, f"{root}/entity", new.select(F.col("entity").alias("text")), "entity", encoder, batch=name)
    passages.unpersist()


def ingest_stream(passages: DataFrame, root: str, checkpoint: str, encoder: Encoder, recogniser: Recogniser | None = None,
                  available_now: bool = False) -> StreamingQuery:
    """Start the ingest of a streaming DataFrame with client_id and text."""
    writer = passages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: ingest_batch(batch, batch_id, root, encoder, recogniser))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
