"""Metric tables over predictions, answers and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import answer_options, contains_non_blank, list_scores, prediction_lines, token_f1
from ..functions.text import normalise_answer, tokens


def score_predictions(predictions: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Per-row hit, em and token F1. Both texts are normalised once."""
    staged = predictions.withColumn("_p", normalise_answer(F.col(pred))).withColumn("_a", normalise_answer(F.col(label)))
    tokenised = staged.withColumn("_pt", tokens(F.col("_p"))).withColumn("_at", tokens(F.col("_a")))
    return (
        tokenised.withColumn("hit", F.contains("_p", "_a").cast("int")).withColumn("em", (F.col("_p") == F.col("_a")).cast("int"))
        .withColumn("f1", token_f1(F.col("_pt"), F.col("_at"))).drop("_p", "_a", "_pt", "_at"))


def split_metrics(predictions: DataFrame, keys: list[str], pred: str = "pred", label: str = "label") -> DataFrame:
    """hit, em and f1 in percent per key."""
    return score_predictions(predictions, pred, label).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg("hit") * 100.0).alias("hit"), (F.avg("em") * 100.0).alias("em"), (F.avg("f1") * 100.0).alias("f1"))


def list_metrics(predictions: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """accuracy, hit, precision, recall and f1 in percent over multi-answer predictions."""
    lines = prediction_lines(F.col(pred))
    staged = predictions.select(
        normalise_answer(F.array_join(lines, " ")).alias("joined"), F.size(lines).alias("lines"),
        F.transform(answer_options(F.col(label)), lambda a: normalise_answer(a)).alias("options"))
    scores = list_scores(F.col("joined"), F.col("lines"), F.col("options"))
    rows = staged.select(*[c.alias(n) for n, c in scores.items()])
    return rows.agg(*[(F.avg(n) * 100.0).alias(n) for n in scores])


def contain_accuracy(predictions: DataFrame, pred: str = "pred_answer", label: str = "gold_answer") -> DataFrame:
    return predictions.agg(F.avg(contains_non_blank(F.col(pred), F.col(label))).alias("contain_accuracy"))


def judged_accuracy(predictions: DataFrame, judge, pred: str = "pred_answer", label: str = "gold_answer") -> DataFrame:
    """Accuracy by an external judge: ``judge`` maps a prompt column to its reply column."""
    prompt = F.concat(
        F.lit("Compare a candidate answer with the accepted one. Accepted: "), F.col(label), F.lit("\nCandidate: "), F.col(pred),
        F.lit("\nReply with the single word correct or incorrect."))
    verdict = (F.lower(F.trim(judge(prompt))) == "correct").cast("double")
    return predictions.agg(F.avg(verdict).alias("judged_accuracy"))


def round_losses(losses: DataFrame) -> DataFrame:
    """(round, avg_loss) over the clients that trained."""
    return losses.groupBy("round").agg(F.avg("loss").alias("avg_loss"))


def type_accuracy(predicted: DataFrame, keys: list[str]) -> DataFrame:
    return predicted.groupBy(*keys).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))
