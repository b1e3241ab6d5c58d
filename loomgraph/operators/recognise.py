"""Entity mentions. A recogniser is any callable Column(sentence) -> Column array<struct<entity,label>>."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import passage_key
from ..functions.text import sentences

Recogniser = Callable[[Column], Column]

# Labels that never become entities.
DROPPED_LABELS = ("ORDINAL", "CARDINAL")

# The default recogniser's mention pattern (capitalised runs, ordinals, numbers).
MENTION_PATTERN = r"(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*|\d+(?:st|nd|rd|th)|\d+)"

# Sentence-initial function words that are not names.
STOP_MENTIONS = (
    "The", "This", "That", "These", "Those", "There", "It", "He", "She", "They", "We", "You",
    "In", "On", "At", "By", "For", "From", "With", "And", "But", "Or", "If", "As", "An", "To",
)


def pattern_recogniser(pattern: str = MENTION_PATTERN, stop=STOP_MENTIONS) -> Recogniser:
    """Deterministic default that needs no model and runs in the JVM."""

    def recognise(sentence: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(sentence, F.lit(pattern), 1))
        if stop:
            found = F.filter(found, lambda m: ~m.isin(*stop))
        return F.transform(
            found,
            lambda m: F.struct(
                m.alias("entity"),
                F.when(m.rlike(r"^\d+$"), "CARDINAL")
                .when(m.rlike(r"^\d+(st|nd|rd|th)$"), "ORDINAL")
                .otherwise("NAME")
                .alias("label"),
            ),
        )

    return recognise


def model_recogniser(load: Callable[[], Callable[[str], list[tuple[str, str]]]]) -> Recogniser:
    """Wrap a named-entity model: ``load`` runs once per worker and returns text -> [(entity, label)].

    The loader is tried once here so that a missing model fails at construction."""
    load()

    @F.pandas_udf("array<struct<entity:string,label:string>>")
    def recognise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = load()
        for texts in batches:
            yield pd.Series([[{"entity": e, "label": l} for e, l in find(t or "")] for t in texts])

    return recognise


def distinct_passages(passages: DataFrame, text: str = "text") -> DataFrame:
    """(client_id, passage_id, text): equal texts of a client are one passage."""
    return passages.select("client_id", passage_key(F.col(text)).alias("passage_id"), F.col(text).alias("text")).distinct()


def passage_sentences(passages: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """(client_id, passage_id, sentence, entities): the sentences of a passage that hold kept entities, each once.

    Input needs client_id, passage_id and text, one row per passage. Nothing is shuffled, and a sentence is written
    once instead of once per entity.
    """
    recogniser = recogniser or pattern_recogniser()
    split = passages.select("client_id", "passage_id", F.explode(sentences(F.col("text"))).alias("sentence"))
    kept = F.filter(recogniser(F.col("sentence")), lambda m: m["entity"].isNotNull() & ~m["label"].isin(*DROPPED_LABELS))
    entities = F.array_distinct(F.transform(kept, lambda m: m["entity"]))
    # exploded as an array of one or none: a filter on the size would be pushed down and read the sentence twice
    some = F.explode(F.filter(F.array(F.struct(entities.alias("entities"))), lambda f: F.size(f["entities"]) > 0)).alias("_f")
    return split.select("client_id", "passage_id", "sentence", some).select("client_id", "passage_id", "sentence", "_f.entities")


def mentions_of(found: DataFrame) -> DataFrame:
    """(client_id, passage_id, sentence, entity) of ``passage_sentences`` rows."""
    return found.select("client_id", "passage_id", "sentence", F.explode("entities").alias("entity"))


def passage_mentions(passages: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """(client_id, passage_id, sentence, entity), one row per distinct mention of a kept label.

    Input needs client_id, passage_id and text. Passages are split and read where they lie; only the
    short mention rows are shuffled, and duplicates collapse on the map side.
    """
    return mentions_of(passage_sentences(passages, recogniser)).distinct()


def question_mentions(questions: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """(qid, entity) with lower-cased entities; input needs qid and question."""
    recogniser = recogniser or pattern_recogniser()
    split = questions.select("qid", F.explode(sentences(F.col("question"))).alias("sentence"))
    found = split.select("qid", F.explode(recogniser(F.col("sentence"))).alias("m"))
    return (
        found.where(~F.col("m.label").isin(*DROPPED_LABELS))
        .select("qid", F.lower("m.entity").alias("entity"))
        .distinct()
    )
