"""Mixing of sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1. Targets: sources share the size of the whole corpus by weight; no target exceeds ``most`` times its
   source, the excess goes to the others by weight (water filling over one row per source).
2. Schedule: slot i has the golden-ratio point frac(i * phi) as a 32-bit integer. The points are mapped
   through the cumulative targets to sources and every slot gets its rank among those of its source
   (counts per stretch of slots are summed first, so no source is numbered in one task).
3. Stream: the documents of a source are shuffled by a hash and laid end to end; repeats of the stream
   follow each other. It is cut into blocks of equally many words; slot rank k takes block k. The last
   block ends where the target is reached, and blocks the schedule fell short of close the schedule.
4. Slots and document pieces are joined on (source, block). Keys are spread evenly however large a
   source is.

Block length grows with the corpus up to ``longest_block``, and is the same for all sources.

Defined results: a null text has no words; a text without words is never taken; a null source is a source
of its own, ordered last; repeated rows are separate documents; null ids are allowed; an empty table gives
an empty mix. The shuffle depends on ids and texts only, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import BLANK, count_words, shuffle_parts

WEIGHTS = (5, 2, 1)
MOST = 3
LONGEST_BLOCK = 4096
SLOTS = 1 << 18  # slots that a corpus gets at least, blocks of one word apart
GOLDEN = 2654435769  # fixed value: 2**32 divided by the golden ratio
STRETCH = 1 << 14
GRID_BITS = 10


@dataclass
class Mix:
    """``sources``: one row per source with its target. ``places``: one row per document with its place
    in its source's stream. ``pieces``: (slot, block, epoch, place, from_word, to_word), the mix itself."""

    sources: DataFrame
    places: DataFrame
    pieces: DataFrame


PLACE = ("skey", "bucket", "n")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, skey, source_size, target, low, high) from (source, skey, source_size), one row per source.

    ``low`` and ``high`` bound the source's part of the 32-bit points."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("*", (F.row_number().over(order) - 1).alias("rank"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.select("*", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.select("*", level.alias("level"))
    target = F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))
    ranked = ranked.select("*", target.alias("target"))
    edge = lambda w: F.floor(F.coalesce(F.sum("target").over(w), F.lit(0.0)) / F.sum("target").over(everything) * F.lit(float(1 << 32)))
    by_rank = Window.orderBy("rank")
    return ranked.select("source", "skey", "rank", "source_size", "target", F.floor(F.col("target") + 0.5).alias("words"),
                         edge(by_rank.rowsBetween(Window.unboundedPreceding, -1)).alias("low"),
                         F.when(F.lead("rank").over(by_rank).isNull(), F.lit(1 << 32)).otherwise(edge(by_rank)).alias("high"))


def point(slot: Column) -> Column:
    """Low 32 bits of slot * GOLDEN, in two halves so that no product overflows."""
    low, high = slot.bitwiseAND(F.lit(0xFFFF)), F.shiftright(slot, 16).bitwiseAND(F.lit(0xFFFF))
    return (low * GOLDEN + F.shiftleft((high * GOLDEN).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def schedule(spark, sources: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, skey, block): which block of which source each slot takes; ``block`` counts through repeats."""
    n = -(-total // block)
    slots = spark.range(0, n, 1, max(shuffle_parts(spark), n >> 20)).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"))
    slots = slots.withColumn("cell", F.shiftright("x", 32 - GRID_BITS))
    used = sources.where("high > low").select("skey", "low", "high")
    cells = used.select("*", F.explode(F.sequence(F.shiftright("low", 32 - GRID_BITS), F.shiftright(F.col("high") - 1, 32 - GRID_BITS))).alias("cell"))
    dealt = slots.join(cells, "cell").where("x >= low AND x < high").select("slot", "skey", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    counts = dealt.groupBy("skey", "stretch").agg(F.count("*").alias("c"))
    so_far = Window.partitionBy("skey").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("skey", "stretch", F.coalesce(F.sum("c").over(so_far), F.lit(0)).alias("base"))
    inner = dealt.withColumn("r", F.row_number().over(Window.partitionBy("skey", "stretch").orderBy("slot")) - 1)
    ranked = inner.join(base, ["skey", "stretch"]).select("slot", "skey", (F.col("base") + F.col("r")).alias("block"))
    last = sources.select("skey", F.ceil(F.col("words") / block).alias("blocks"))
    ranked = ranked.join(last, "skey").where("block < blocks").select("slot", "skey", "block")
    given = counts.groupBy("skey").agg(F.sum("c").alias("given"))
    short = last.join(given, "skey", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < blocks")
    closing = short.select(F.lit(n).cast("bigint").alias("slot"), "skey", F.explode(F.sequence("given", F.col("blocks") - 1)).alias("block"))
    return ranked.unionByName(closing)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = MOST,
        longest_block: int = LONGEST_BLOCK) -> Mix:
    spark = docs.sparkSession
    i, t, s = F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.col(f"`{source}`")
    narrow = materialise(docs.select(i.alias("doc_id"), s.alias("source"), source_key(s).alias("skey"), count_words(t).alias("size"),
                                     shuffle_key(i).alias("h"), F.xxhash64(t).alias("th")))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    block = max(1, min(longest_block, total // SLOTS))
    sources = materialise(targets(narrow.groupBy("source", "skey").agg(F.sum("size").alias("source_size")), weights, most))

    bucketed = narrow.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "th")
    local = bucketed.select("*", F.row_number().over(inside).alias("n"),
                            (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("inner_start"))
    sums = bucketed.groupBy("skey", "bucket").agg(F.sum("size").alias("c"))
    along = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("skey", "bucket", F.coalesce(F.sum("c").over(along), F.lit(0)).alias("base"))
    placed = local.join(base, ["skey", "bucket"]).join(sources.select("skey", "source_size", "target", "words"), "skey")
    places = materialise(placed.select("doc_id", "source", *PLACE, "h", "th", "size", "source_size", "target", "words",
                                       (F.col("base") + F.col("inner_start")).alias("start")))

    turns = places.where("size > 0 AND words > 0").select(*PLACE, "doc_id", "source", "h", "th", "size", "start", "words", F.explode(
        F.sequence(F.lit(0), F.ceil(F.col("words") / F.col("source_size")).cast("int") - 1)).alias("epoch"), "source_size")
    spans = turns.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words"))).where("a < b")
    spans = spans.select("*", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("block"))
    taken = spans.join(schedule(spark, sources, total, block), ["skey", "block"])
    pieces = taken.select("slot", "block", "epoch", *PLACE, "doc_id", "source", "h", "th", "size",
                          (F.greatest("a", F.col("block") * block) - F.col("a")).alias("from_word"),
                          (F.least("b", (F.col("block") + 1) * block) - F.col("a")).alias("to_word"))
    return Mix(sources, places, pieces)


def digest(docs: DataFrame) -> DataFrame:
    m = mix(docs)
    per = m.pieces.groupBy(*PLACE).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return m.places.join(per, list(PLACE), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: one row for each repeat of a document that the mix takes, with the columns of
    ``docs``; where a target ends inside a document, the row holds the words taken (``n_chars`` follows)."""
    i, t, s = F.col("doc_id"), F.col("text"), F.col("source")
    per = mix(docs, **options).pieces.groupBy(*PLACE, "h", "th", "size", "epoch").agg(F.min("from_word").alias("a"), F.max("to_word").alias("b"))
    per = per.groupBy(*PLACE, "h", "th", "size").agg(F.sort_array(F.collect_list(F.struct("epoch", "a", "b"))).alias("takes"))
    same = Window.partitionBy("skey", "h", "th")
    per = per.select("skey", "h", "th", "size", "takes", F.row_number().over(same.orderBy("bucket", "n")).alias("copy"))
    rows = docs.select(F.struct("*").alias("row"), source_key(s).alias("skey"), shuffle_key(i).alias("h"), F.xxhash64(t).alias("th"))
    rows = rows.select("*", F.row_number().over(same.orderBy(F.lit(0))).alias("row_copy"))
    # the difference keeps the copy out of the join keys, so the rows are not shuffled a second time
    taken = rows.join(per, ["skey", "h", "th"]).where("row_copy - copy = 0").select("row", "size", F.explode("takes").alias("take"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(f"{BLANK}*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(words, F.col("take.a").cast("int") + 1, (F.col("take.b") - F.col("take.a")).cast("int")), "")
    new = F.when((F.col("take.a") == 0) & (F.col("take.b") == F.col("size")), F.col("row.text")).otherwise(part)
    taken = taken.select("row", new.alias("new"))
    swap = {"text": F.col("new"), "n_chars": F.length("new").cast("bigint")}
    return taken.select(*[swap.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


DIGEST_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
      FROM r WINDOW f AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS words,
             (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, words) - start) + greatest(0, least(source_size + start + size, words) - source_size - start)
        + greatest(0, least(2 * source_size + start + size, words) - 2 * source_size - start))::BIGINT AS taken FROM p"""
