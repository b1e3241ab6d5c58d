"""Quality rules: a threshold table compiled into column expressions, evaluated without user functions.

Every metric is a whole number taken from the whole text. A rule compares ``100 * metric`` with
``percent * base``, so verdicts are exact integer comparisons. The plan is a chain of projections over
the scan: no shuffle, no Python, and memory bounded by one row.

Defined results: a null text counts as an empty one; a text without words has zero for every metric and
fails; repeated rows are judged one by one; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, words_of

# fixed values: frequent function words of the four languages of the corpus
STOP_WORDS = (
    "a", "and", "are", "as", "be", "by", "for", "from", "have", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
    "au", "avec", "ce", "dans", "des", "du", "elle", "est", "et", "il", "la", "le", "les", "ne", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "ist", "mit", "nicht", "und", "von", "zu",
    "como", "con", "de", "del", "el", "en", "es", "las", "lo", "los", "no", "para", "por", "se", "una", "y",
)
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``side`` "min": fails when 100 * metric < percent * base. "max": fails when it is greater."""

    name: str
    metric: str
    base: str
    side: str
    percent: int

    def fails(self, metric: dict[str, Column]) -> Column:
        value, bound = 100 * metric[self.metric], self.percent * metric[self.base]
        return value < bound if self.side == "min" else value > bound


#: The base rules of the contract: at least 50 words, at most half of them in repeated three-word windows.
BASE_RULES = (
    Rule("too_few_words", "n_words", "one", "min", 5000),
    Rule("repeated_windows", "n_repeat_words", "n_words", "max", 50),
)
RULES = (
    Rule("short_words", "word_chars", "n_words", "min", 250),
    Rule("long_words", "word_chars", "n_words", "max", 1100),
    Rule("symbols", "n_symbols", "n_words", "max", 10),
    Rule("few_stop_words", "n_stop_words", "n_words", "min", 4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", "max", 40),
    Rule("cut_lines", "n_cut_lines", "n_lines", "max", 40),
    Rule("list_lines", "n_list_lines", "n_lines", "max", 90),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_cut_lines", "n_list_lines", "n_repeat_words")


def quality(docs: DataFrame, text: str = "text", out: str = "quality", rules=RULES, base_rules=BASE_RULES, stop_words=STOP_WORDS) -> DataFrame:
    """``docs`` with one more column ``out``: struct of the metrics, ``base_failed``, ``failed`` (names of
    the rules that a text breaks) and ``kept``. A column of that name is replaced."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = docs.select(F.struct("*").alias("row"), whole.alias("t"), words_of(whole).alias("w"))
    windows = F.transform("w", lambda x, i: F.struct(F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)).alias("k"), i.alias("i")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    row = row.select("*", F.sort_array(F.slice(windows, 1, F.greatest(F.size("w") - 2, F.lit(0)))).alias("s"), lines.alias("l"))
    twice = F.filter("s", lambda x, j: F.coalesce(F.get("s", j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get("s", j + 1)["k"] == x["k"], F.lit(False)))
    row = row.select("row", "t", "w", "l", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    steps = F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3))))
    values = {
        "n_words": F.size("w"),
        "word_chars": F.length("t") - F.regexp_count("t", F.lit(BLANK)),
        "n_symbols": F.regexp_count("t", F.lit(SYMBOLS)),
        "n_stop_words": F.size(F.filter("w", lambda x: x.isin(*sorted(set(stop_words))))),
        "n_lines": F.size("l"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_cut_lines": F.size(F.filter("l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        "n_list_lines": F.size(F.filter("l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]"))),
        "n_repeat_words": F.aggregate(steps, F.lit(0), lambda a, x: a + x),
    }
    row = row.select("row", *[v.cast("bigint").alias(k) for k, v in values.items()])
    metric = {k: F.col(k) for k in METRICS} | {"one": F.lit(1)}
    base_failed = reduce(Column.__or__, [r.fails(metric) for r in base_rules], F.lit(False))
    failed = F.array_compact(F.array(*[F.when(r.fails(metric), F.lit(r.name)) for r in (*base_rules, *rules)]))
    row = row.select("row", *METRICS, base_failed.alias("base_failed"), failed.alias("failed"))
    verdict = F.struct(*METRICS, "base_failed", "failed", (F.size("failed") == 0).alias("kept"))
    return row.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != out], verdict.alias(out))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that break no rule, with the same columns."""
    mark = "quality verdict"
    judged = quality(docs, out=mark, **options)
    # a filter on the verdict itself would be pushed below the projections, and the metrics be computed anew
    # inside their own lambdas; a condition that is not deterministic stays where it is
    kept = F.col(f"`{mark}`")["kept"] & (F.spark_partition_id() >= 0)
    return judged.select("*", kept.alias(f"{mark} kept")).where(F.col(f"`{mark} kept`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    q = quality(docs.select("doc_id", "text"), out="q")
    return q.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def digest_sql() -> str:
    """The contract's columns in SQL, with the rule table written out by name."""
    blank, stop = r"[\x20\x09-\x0D]", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    bad = " OR ".join(f"100 * {r.metric} {'<' if r.side == 'min' else '>'} {r.percent} * {1 if r.base == 'one' else r.base}" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i, w FROM d),
k AS (SELECT doc_id, i, a, CASE WHEN i + 2 <= len(w) THEN a || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g FROM x),
c AS (SELECT doc_id, i, a, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS dup FROM k),
r AS (SELECT doc_id, a, dup OR coalesce(lag(dup, 1) OVER q, false) OR coalesce(lag(dup, 2) OVER q, false) AS hit FROM c WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words, count(*) FILTER (a IN ({stop})) AS n_stop_words FROM r GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
             count(*) FILTER (regexp_matches(line, '(\.\.\.|…){blank}*$')) AS n_cut_lines,
             count(*) FILTER (regexp_matches(line, '^{blank}*[-*•]{blank}')) AS n_list_lines
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_cut_lines, 0) AS n_cut_lines, coalesce(n_list_lines, 0) AS n_list_lines
      FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT (base_failed OR {bad}) AS kept FROM b"""
