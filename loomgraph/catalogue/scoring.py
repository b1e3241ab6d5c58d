"""Answer scoring and class-weight queries."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import normalise_answer
from ..operators import evaluate as ev
from ..operators import federate as fed
from . import base
from .base import rounded, sql_squeeze, sql_strip, table


def _turn_pairs(spark, sf):
    """Every conversation turn as a prediction and the turn after it as the label."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.col("text").alias("pred"), F.lead("text").over(w).alias("label")).where("label is not null")


def normalised_answers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(normalise_answer(F.col("text"))).alias("answer_md5"))


def answer_scores(spark, sf):
    s = ev.score_predictions(_turn_pairs(spark, sf))
    return s.select("conv_id", "turn", F.col("hit").cast("bigint").alias("hit"), F.col("em").cast("bigint").alias("em"), *rounded("f1"))


def shard_metrics(spark, sf):
    """hit, em and f1 in percent per evaluation shard (row number modulo 3)."""
    from ..operators.ranking import numbered

    rows = numbered(_turn_pairs(spark, sf), [], [F.col("conv_id"), F.col("turn")], F.floor(F.col("conv_id") / 1024), "i")
    m = ev.split_metrics(rows.withColumn("shard", F.pmod("i", F.lit(3))), ["shard"])
    return m.select("shard", "n", *rounded("hit", "em", "f1"))


def list_answer_metrics(spark, sf):
    """Multi-answer scores: the label's words joined by '|', the prediction split at full stops."""
    p = _turn_pairs(spark, sf).select(F.replace("pred", F.lit(". "), F.lit("|")).alias("pred"), F.replace("label", F.lit(" "), F.lit("|")).alias("label"))
    return ev.list_metrics(p).select(*rounded("accuracy", "hit", "precision", "recall", "f1"))


def contain_accuracy(spark, sf):
    p = _turn_pairs(spark, sf)
    return ev.contain_accuracy(p, "pred", "label").select(*rounded("contain_accuracy"))


def inverse_class_weights(spark, sf):
    return fed.inverse_frequency(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))).select(
        "doc_id", "label", "class_size", *rounded("sample_weight"))


def class_accuracy(spark, sf):
    """Accuracy of 'toxic' as a guess of 'quality', per quality class."""
    p = table(spark, sf, "labels").select(F.col("toxic").alias("predicted"), F.col("quality").alias("label"))
    return ev.type_accuracy(p, ["label"]).select("label", *rounded("accuracy"))


def round_loss(spark, sf):
    """Average client loss per round from the event log (round = hour, client = user modulo 5)."""
    e = table(spark, sf, "events").select(F.hour("ts").cast("bigint").alias("round"), F.col("value").alias("loss"))
    return ev.round_losses(e).select("round", *rounded("avg_loss"))


def learning_rate_schedule(spark, sf):
    """Scheduled rate at every event's position in a ten-epoch run."""
    e = table(spark, sf, "events").select("event_id", ((F.col("event_id") % 1000) / F.lit(100.0)).alias("epoch"))
    return e.select("event_id", F.round(fed.learning_rate(F.col("epoch"), 1e-2, 1.0, 10.0), 9).alias("rate"))


QUERIES = {f.__name__: f for f in (
    normalised_answers, answer_scores, shard_metrics, list_answer_metrics, contain_accuracy, inverse_class_weights, class_accuracy,
    round_loss, learning_rate_schedule)}

_PUNCT = string.punctuation.replace("'", "''")


def _norm(expr: str) -> str:
    """Articles are dropped as whole tokens after the punctuation is gone."""
    words = f"string_split({sql_squeeze(f'translate(lower({expr}), {chr(39)}{_PUNCT}{chr(39)}, {chr(39)}{chr(39)})')}, ' ')"
    return f"array_to_string([w FOR w IN {words} IF w NOT IN ('a', 'an', 'the', '')], ' ')"


_PAIRS = """turns AS (SELECT conv_id, turn, text AS pred, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations),
pairs AS (SELECT * FROM turns WHERE label IS NOT NULL)"""

_SCORES = f"""{_PAIRS},
normed AS (SELECT conv_id, turn, coalesce({_norm('pred')}, '') AS p, coalesce({_norm('label')}, '') AS a FROM pairs),
bags AS (SELECT *, [w FOR w IN string_split(p, ' ') IF w <> ''] AS pt, [w FOR w IN string_split(a, ' ') IF w <> ''] AS gt FROM normed),
pw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(pt) AS w FROM bags) GROUP BY ALL),
aw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(gt) AS w FROM bags) GROUP BY ALL),
common AS (SELECT pw.conv_id, pw.turn, sum(least(pw.n, aw.n)) AS s FROM pw JOIN aw USING (conv_id, turn, w) GROUP BY ALL),
scored AS (SELECT b.conv_id, b.turn, CAST(contains(p, a) AS BIGINT) AS hit, CAST(p = a AS BIGINT) AS em,
  CASE WHEN len(pt) = 0 OR len(gt) = 0 THEN CAST(len(pt) = 0 AND len(gt) = 0 AS DOUBLE)
       WHEN coalesce(s, 0) = 0 THEN 0.0
       ELSE 2.0 * (s / len(pt)::DOUBLE) * (s / len(gt)::DOUBLE) / (s / len(pt)::DOUBLE + s / len(gt)::DOUBLE) END AS f1
  FROM bags b LEFT JOIN common c ON b.conv_id = c.conv_id AND b.turn = c.turn)"""

SQL = {
    "normalised_answers": f"SELECT doc_id, md5({_norm('text')}) AS answer_md5 FROM documents",
    "answer_scores": f"WITH {_SCORES} SELECT conv_id, turn, hit, em, round(f1, 6) AS f1 FROM scored",
    "shard_metrics": f"""WITH {_SCORES}, r AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) % 3 AS shard FROM scored)
        SELECT shard, count(*) AS n, round(avg(hit) * 100, 6) AS hit, round(avg(em) * 100, 6) AS em, round(avg(f1) * 100, 6) AS f1 FROM r GROUP BY shard""",
    "list_answer_metrics": f"""WITH {_PAIRS},
        cut AS (SELECT string_split(replace(replace(pred, '. ', '|'), '|', chr(10)), chr(10)) AS lines, string_split(replace(label, ' ', '|'), '|') AS opts FROM pairs),
        j AS (SELECT lines, opts, {_norm("array_to_string(lines, ' ')")} AS joined FROM cut),
        m AS (SELECT len(lines) AS nl, len(opts) AS no, len([o FOR o IN opts IF contains(joined, coalesce({_norm('o')}, ''))])::DOUBLE AS k FROM j)
        SELECT round(avg(k / no) * 100, 6) AS accuracy, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS hit,
        round(avg(k / nl) * 100, 6) AS precision, round(avg(k / no) * 100, 6) AS recall,
        round(avg(CASE WHEN k = 0 THEN 0 ELSE 2 * (k / nl) * (k / no) / (k / nl + k / no) END) * 100, 6) AS f1 FROM m""",
    "contain_accuracy": f"""WITH {_SCORES}
        SELECT round(avg(CASE WHEN {sql_strip('q.pred')} = '' OR {sql_strip('q.label')} = '' THEN 0 ELSE s.hit END), 6) AS contain_accuracy
        FROM scored s JOIN pairs q ON q.conv_id = s.conv_id AND q.turn = s.turn""",
    "inverse_class_weights": """SELECT doc_id, quality AS label, count(*) OVER (PARTITION BY quality) AS class_size,
        round(1.0::DOUBLE / count(*) OVER (PARTITION BY quality), 6) AS sample_weight FROM labels""",
    "class_accuracy": """SELECT quality AS label, round(avg(CASE WHEN toxic = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels GROUP BY quality""",
    "round_loss": "SELECT CAST(hour(ts) AS BIGINT) AS round, round(avg(value), 6) AS avg_loss FROM events GROUP BY 1",
    "learning_rate_schedule": """WITH e AS (SELECT event_id, (event_id % 1000) / 100.0::DOUBLE AS ep FROM events)
        SELECT event_id, round(CASE WHEN ep < 1 THEN 0.01::DOUBLE * ep ELSE 5e-6 + (0.01::DOUBLE - 5e-6) * 0.5 * (1 + cos(pi() * (ep - 1) / 9)) END, 9) AS rate FROM e""",
}
