"""Answer scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise_answer, strip


def contains_answer(prediction: Column, answer: Column) -> Column:
    """1 when the normalised answer is a substring of the normalised prediction ('' always is)."""
    return F.contains(normalise_answer(prediction), normalise_answer(answer)).cast("int")


def exact_match(prediction: Column, answer: Column) -> Column:
    return (normalise_answer(prediction) == normalise_answer(answer)).cast("int")


def contains_non_blank(prediction: Column, answer: Column) -> Column:
    """Like contains_answer, but a blank or missing side scores 0."""
    blank = (strip(F.coalesce(prediction, F.lit(""))) == "") | (strip(F.coalesce(answer, F.lit(""))) == "")
    return F.when(blank, 0).otherwise(contains_answer(prediction, answer))


def _count_of(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda t: t == item))


def token_f1(predicted: Column, accepted: Column) -> Column:
    """Bag-of-tokens F1 of two staged token columns; both empty scores 1, one empty scores 0."""
    shared = F.aggregate(
        F.array_distinct(F.array_intersect(predicted, accepted)), F.lit(0),
        lambda s, t: s + F.least(_count_of(predicted, t), _count_of(accepted, t)))
    np_, na = F.size(predicted), F.size(accepted)
    return F.when((np_ == 0) | (na == 0), ((np_ == 0) & (na == 0)).cast("double")).otherwise(F.lit(2.0) * shared / (np_ + na))


def prediction_lines(prediction: Column) -> Column:
    """Prediction split on '|' and newlines."""
    return F.split(F.translate(prediction, "|", "\n"), "\n")


def answer_options(answer: Column) -> Column:
    return F.split(answer, r"\|")


def list_scores(joined: Column, lines: Column, options: Column) -> dict[str, Column]:
    """accuracy, hit, precision, recall and f1 from staged columns: the normalised joined prediction,
    the number of prediction lines, and the normalised answer options."""
    matched = F.size(F.filter(options, lambda a: F.contains(joined, a)))
    precision = matched / lines
    recall = matched / F.size(options)
    f1 = F.when(matched == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / (precision + recall))
    return {"accuracy": recall, "hit": (matched > 0).cast("double"), "precision": precision, "recall": recall, "f1": f1}
