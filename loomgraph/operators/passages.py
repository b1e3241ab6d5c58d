"""Question batches, entity occurrences in passages and the transitions that ranking walks along."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ATTRIBUTE_KEYWORDS, is_attribute_query
from ..functions.vectors import union_all
from ..session import materialise
from .matching import automaton, occurrences

MAX_QUESTIONS = 4096
BLOCK = 16
NEEDLE_BYTES = 32 * 1024 * 1024


@dataclass
class QuestionBatch:
    """A bounded batch of questions: ids, vectors and keyword masks on the driver, slots as a table."""

    ids: list
    vectors: np.ndarray
    masks: np.ndarray
    slots: DataFrame
    id_type: str

    @property
    def width(self) -> int:
        return max(1, min(BLOCK, len(self.ids)))

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // self.width)


def question_batch(questions: DataFrame, keywords=ATTRIBUTE_KEYWORDS) -> QuestionBatch:
    """Collect a batch of at most MAX_QUESTIONS questions (qid, question, x); more is an error, see
    ``plans.retrieval.retrieve_all`` for batching."""
    low = F.lower("question")
    mask = sum((F.when(F.contains(low, F.lit(k)), F.lit(1 << n)).otherwise(F.lit(0)) for n, k in enumerate(keywords)), F.lit(0))
    rows = questions.select(
        "qid", F.col("x").cast("array<double>").alias("x"),
        F.when(is_attribute_query(F.col("question"), keywords), mask).otherwise(F.lit(0)).alias("mask"),
    ).limit(MAX_QUESTIONS + 1).collect()
    if len(rows) > MAX_QUESTIONS:
        raise ValueError(f"a question batch holds at most {MAX_QUESTIONS} questions")
    rows.sort(key=lambda r: r["qid"])
    width = max(1, min(BLOCK, len(rows)))
    id_type = questions.schema["qid"].dataType.simpleString()
    slots = questions.sparkSession.createDataFrame(
        [(r["qid"], n // width, n % width) for n, r in enumerate(rows)], f"qid {id_type}, block int, slot int")
    return QuestionBatch(
        [r["qid"] for r in rows], np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), -1),
        np.array([r["mask"] for r in rows], dtype=np.int64), slots, id_type)


def keyword_mask(text, keywords=ATTRIBUTE_KEYWORDS):
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(k)), F.lit(1 << n)).otherwise(F.lit(0)) for n, k in enumerate(keywords)), F.lit(0))


def entity_occurrences(passages: DataFrame, needles: DataFrame, needle_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """(client_id, passage_id, needle, n): non-overlapping occurrences of each needle in each passage.

    Both texts must already be lower-cased. One multi-pattern automaton per client finds all needles
    in a single pass over a passage, so passages and needles are never paired up. A needle set
    beyond ``needle_bytes`` is split and searched part by part.
    """
    needles = needles.where("needle <> ''").distinct()
    size = needles.agg(F.coalesce(F.sum(F.octet_length("needle") + 64), F.lit(0)).alias("b")).head()["b"]
    parts = max(1, -(-int(size) // needle_bytes))
    client = passages.schema["client_id"].dataType.simpleString()
    frames = []
    for part in range(parts):
        chunk = needles if parts == 1 else needles.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == part)
        by_client: dict[int, list[str]] = {}
        for row in chunk.collect():
            by_client.setdefault(row["client_id"], []).append(row["needle"])
        frames.append(_search(passages, by_client, client))
    return union_all(frames)


def _search(passages: DataFrame, by_client: dict[int, list[str]], client: str) -> DataFrame:
    shared = passages.sparkSession.sparkContext.broadcast(by_client)

    def search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machines = {c: automaton(words) for c, words in shared.value.items()}
        for batch in rows:
            out = []
            for c, pid, text in zip(batch["client_id"], batch["passage_id"], batch["text"]):
                machine = machines.get(c)
                if machine is not None:
                    out.extend((c, pid, w, n) for w, n in occurrences(machine, text).items())
            yield pd.DataFrame(out, columns=["client_id", "passage_id", "needle", "n"])

    return passages.select("client_id", "passage_id", "text").mapInPandas(
        search, f"client_id {client}, passage_id string, needle string, n bigint")


def entity_bonus(activated: DataFrame, entity_texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(client_id, qid, node, bonus): sum over activated entities of score * ln(1+occurrences) / max(tier, 1).

    activated: client_id, qid, entity_id, score, tier. entity_texts: client_id, hash_id, text.
    """
    named = activated.join(
        entity_texts.select("client_id", F.col("hash_id").alias("entity_id"), F.lower("text").alias("needle")), ["client_id", "entity_id"])
    named = materialise(named)
    low = passages.select("client_id", "passage_id", F.lower("text").alias("text"))
    found = entity_occurrences(low, named.select("client_id", "needle"))
    gain = F.col("score") * F.log(F.lit(1.0) + F.col("n")) / F.greatest(F.col("tier"), F.lit(1))
    return found.join(named, ["client_id", "needle"]).groupBy("client_id", "qid", F.col("passage_id").alias("node")).agg(
        F.sum(gain).alias("bonus"))


def transition(edges: DataFrame) -> DataFrame:
    """(client_id, src, dst, p): edge weight over the total weight leaving src; edges hold both directions.

    Totals come from an aggregate joined back, so a hub is never sorted as one window group."""
    merged = edges.groupBy("client_id", "src", "dst").agg(F.sum("weight").alias("weight"))
    total = merged.groupBy("client_id", "src").agg(F.sum("weight").alias("total")).where("total > 0")
    return merged.join(total, ["client_id", "src"]).select("client_id", "src", "dst", (F.col("weight") / F.col("total")).alias("p"))
