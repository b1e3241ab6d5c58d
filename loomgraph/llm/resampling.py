"""Target-distribution importance resampling with hashed n-grams and Gumbel top-k.

1. Scan. A text becomes bytes with A-Z lowered and every run of separators collapsed to one space; one compiled
   pattern per length, bounded by look-arounds and matched with overlaps, then gives the spans of all n-grams,
   and the CRC-32 of a span picks its bucket. Each document keeps its sparse bucket counts, so texts are read once.
2. Gains. Bucket totals of the raw and the target texts are summed per task, then per bucket: ``buckets`` rows
   whatever the input. gain = floor(1000 * ln((t + 1)(S + B) / ((s + 1)(T + B)))).
3. Draw. score = weight + floor(-1000 ln(-ln(u))) with u from SHA-256 of the id, so reruns draw the same rows; the
   ``share`` percent of highest scores among documents of ``least_words`` words is a draw without replacement in
   proportion to exp(weight / 1000). Ranks come from range partitions shifted by the counts of earlier ranges.

Defined results: a null or empty text has no feature, weight 0 and is never drawn (least_words > 0); a null id is
hashed as an empty string and comes last among ties, then fewer features first; repeated rows are separate
documents; an empty table gives no rows; empty target texts make every t zero; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import shuffle_parts

BUCKETS = 10_000
SEED = "2024"
SHARE = 10
LEAST_WORDS = 20
# fixed value: what may stand in a word after lower-casing: 0-9, a-z and everything outside ASCII
IN_WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
FOLD = bytes(b if b in IN_WORD else 0x20 for b in (c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)))
COUNTS = "doc_id string, n_words bigint, n_features bigint, buckets binary, counts binary"


def collapsed(text: str | None) -> bytes:
    """The words of a text, lower-cased in A-Z only, with single spaces between."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(FOLD).split())


def span_pattern(n: int):
    """Pattern of n consecutive words of a collapsed text, to be matched with overlaps."""
    import regex

    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def scanner(longest: int, buckets: int):
    """text -> (number of words, bucket of every n-gram of 1 to ``longest`` words)."""
    patterns = [span_pattern(n) for n in range(1, longest + 1)]

    def scan(text: str | None) -> tuple[int, np.ndarray]:
        data = collapsed(text)
        found = [np.fromiter((zlib.crc32(m[0]) for m in p.finditer(data, overlapped=True)), np.uint32) for p in patterns]
        return len(found[0]), np.concatenate(found) % np.uint32(buckets)

    return scan


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Rows of COUNTS for rows (doc_id, text): ``buckets`` and ``counts`` are parallel arrays of 32-bit numbers.

    Ids travel as text, since pandas would turn large ids with a null among them into doubles."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = scanner(longest, buckets)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words, found = scan(text)
                which, count = np.unique(found, return_counts=True)
                rows.append((doc_id, words, len(found), which.astype("<u4").tobytes(), count.astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_features", "buckets", "counts"])

    return texts.mapInPandas(work, COUNTS)


def bucket_totals(counted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of ``counted``; a task hands on at most one row per bucket."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for which, count in zip(batch["buckets"], batch["counts"], strict=True):
                total[np.frombuffer(which, "<u4")] += np.frombuffer(count, "<u4")
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    return counted.select("buckets", "counts").mapInPandas(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket from the totals (bucket, n) of both sides."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    every = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"))
    held = every.unionByName(both).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = held.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda c: c.cast("double")
    ratio = real(F.col("t") + 1) * real(F.col("all_s") + buckets) / (real(F.col("s") + 1) * real(F.col("all_t") + buckets))
    return held.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight), ids as text; ``gain`` has one number per bucket."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weight = [int((gain[np.frombuffer(b, "<u4")] * np.frombuffer(c, "<u4").astype(np.int64)).sum()) for b, c in zip(batch["buckets"], batch["counts"], strict=True)]
            yield batch[["doc_id", "n_words", "n_features"]].assign(weight=np.array(weight, np.int64))

    return counted.mapInPandas(work, "doc_id string, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id, seed: str):
    """floor(-1000 ln(-ln(u))), u from the first 8 hexadecimal digits of SHA-256 of ``seed:doc_id``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... by falling score, then doc_id (null last), then n_features."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    spark = rows.sparkSession
    dealt = materialise(rows.repartitionByRange(shuffle_parts(spark), *order).withColumn("range", F.spark_partition_id()))
    counts = sorted(dealt.groupBy("range").count().collect())  # one row per shuffle partition at most
    starts, at = [], 0
    for r, n in counts:
        starts.append((r, at))
        at += n
    base = spark.createDataFrame(starts, "range int, base bigint")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("place", inside).join(F.broadcast(base), "range").withColumn("rank", F.col("base") + F.col("place")).drop("range", "place", "base")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: str = SEED,
              share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document of ``docs``, rank null where it is not drawn.

    ``target`` holds texts of the wanted distribution; ``longest`` is the length of the longest n-gram."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    counted = materialise(bucket_counts(docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text")), longest, buckets))
    wanted = bucket_counts(target.select(F.lit(None).cast("string").alias("doc_id"), F.col(f"`{target_text}`").alias("text")), longest, buckets)
    gain = np.zeros(buckets, np.int64)
    for bucket, value in gains(bucket_totals(counted, buckets), bucket_totals(wanted, buckets), buckets).collect():  # ``buckets`` rows
        gain[bucket] = value
    scored = weighed(counted, gain).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialise(scored)
    eligible = F.col("n_words") >= least_words
    drawn = share * scored.where(eligible).count() // 100
    order = ranked(scored.where(eligible)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint"))
    rest = scored.where(~eligible).withColumn("rank", F.lit(None).cast("bigint"))
    return order.select("doc_id", "n_words", "n_features", "weight", "score", "rank").unionByName(rest)


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of every different word: bytes from hexadecimal, folded over a table of 256 remainders
DIGEST_SQL = r"""
WITH t AS (SELECT list(r ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda x: 0::UBIGINT)),
             lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END) AS r FROM range(256) s(i))),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
c AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(words) AS w FROM d) GROUP BY ALL),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM c UNION SELECT w FROM g)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::UBIGINT)),
             lambda a, y: xor(a // 256, crc[1 + (xor(a % 256, y))::INT])), 4294967295::UBIGINT)::BIGINT % 10000 AS bucket FROM v, t),
s AS (SELECT bucket, sum(n) AS s FROM c JOIN b USING (w) GROUP BY bucket),
u AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (w) GROUP BY bucket),
e AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM u), 0) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM s FULL JOIN u USING (bucket)),
w AS (SELECT k, sum(n * gain)::BIGINT AS weight FROM c JOIN b USING (w) JOIN e USING (bucket) GROUP BY k),
r AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (k)),
o AS (SELECT doc_id, n_features, weight, score, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank FROM o
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM r WHERE n_features < 20"""
