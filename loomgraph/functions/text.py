"""Text expressions that stay inside whole-stage codegen."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"

# Words that mark a question about an attribute.
ATTRIBUTE_KEYWORDS = (
    "born", "birth", "where", "when", "located", "location", "founded", "founder",
    "died", "death", "nationality", "capital", "date", "year",
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def sentences(text: Column) -> Column:
    """Distinct non-empty sentences; a sentence ends at . ! or ? followed by whitespace, or a line end."""
    broken = F.regexp_replace(text, r"([.!?])\s+", "$1\n")
    parts = F.transform(F.split(broken, r"[\r\n]+"), lambda s: strip(s))
    return F.array_distinct(F.filter(parts, lambda s: s != F.lit("")))


def window_tokens(text: Column) -> Column:
    """Whitespace tokens; blank text gives one empty token. Stage this as a column before windowing."""
    return F.split(squeeze(text), " ")


def chunk_windows(tokens: Column, max_tokens: int = 64) -> Column:
    """Windows of ``max_tokens`` tokens of a staged token column; blank text gives one empty window."""
    last = F.greatest(F.ceil(F.size(tokens) / F.lit(max_tokens)).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice(tokens, i * F.lit(max_tokens) + 1, F.lit(max_tokens)), " "),
    )


def parse_chunk_index(text: Column) -> Column:
    has_index = text.rlike(r"(?s)^\d+:")
    return F.when(has_index, F.regexp_extract(text, r"(?s)^(\d+):", 1).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))


def parse_chunk_body(text: Column) -> Column:
    has_index = text.rlike(r"(?s)^\d+:")
    return strip(F.when(has_index, F.regexp_replace(text, r"(?s)^\d+:", "")).otherwise(text))


def title_of(text: Column) -> Column:
    """Lower-cased head of ``index:title: body`` text."""
    bare = strip(F.regexp_replace(text, r"^\d+:", ""))
    return F.lower(strip(F.substring_index(bare, ":", 1)))


def titled_passage(title: Column, sentence_list: Column) -> Column:
    kept = F.filter(F.transform(sentence_list, lambda s: strip(s)), lambda s: s != F.lit(""))
    return F.concat(F.lit("Title: "), title, F.lit("\n"), F.array_join(kept, "\n"))


def evidence_text(title: Column, sentence_list: Column, first: int = 3) -> Column:
    head = F.transform(F.slice(sentence_list, 1, first), lambda s: strip(s))
    return F.concat(title, F.lit(": "), F.array_join(head, " "))


def normalise_answer(text: Column) -> Column:
    """Lower-case, drop ASCII punctuation and English articles, squeeze whitespace; NULL becomes ''."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), string.punctuation, "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def tokens(text: Column) -> Column:
    """Whitespace tokens of already squeezed text; '' gives no token."""
    return F.filter(F.split(text, " "), lambda t: t != F.lit(""))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("bigint")


def is_attribute_query(question: Column, keywords=ATTRIBUTE_KEYWORDS) -> Column:
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)(\w+)"), 1)
    return F.arrays_overlap(words, F.array(*[F.lit(k) for k in keywords]))


def keyword_overlap(question: Column, passage: Column, keywords=ATTRIBUTE_KEYWORDS) -> Column:
    """Keywords found as substrings of both texts."""
    q, p = F.lower(question), F.lower(passage)
    hits = [F.when(F.contains(q, F.lit(k)) & F.contains(p, F.lit(k)), 1).otherwise(0) for k in keywords]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def reading_prompt(passages: Column, question: Column) -> Column:
    """User part of the reading prompt: one passage per line, then the question."""
    lines = F.array_join(F.transform(passages, lambda p: F.concat(p, F.lit("\n"))), "")
    return F.concat(lines, F.lit("Question: "), question, F.lit("\n Thought: "))


def answer_of(reply: Column) -> Column:
    """Text after the first 'Answer:' (up to a second one), or the whole reply."""
    parts = F.split(reply, "Answer:")
    return F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(1)))).otherwise(reply)


def question_field(question: Column) -> Column:
    return F.concat(F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\nAnswer: "))
