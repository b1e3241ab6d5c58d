"""Chat formatting with rotated perspectives.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant and
the others as users with their names; the mask covers what the speaker says and its end mark. Turns are
ordered by (turn, speaker, text). A rendering is cut into parts of ``part_turns`` turns, one row each, with
the offset of the part in the rendering, so a conversation of any length never meets in one row or task:
turns get their places by counts per stretch of turns first, and offsets by sums per part.

Defined results: a null speaker is a participant without a name ("user"); a null text is empty; a null turn
comes last; a null conv_id is a conversation of its own; repeated rows are separate turns; every conversation
has at least one participant; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts

# fixed values: marks of the rendered form
ASSISTANT, USER, BODY, END = "<|assistant|>", "<|user", "|>\n", "<|end|>\n"
PART_TURNS = 256


def header(speaker: Column, view: Column) -> Column:
    name = F.when(speaker.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), speaker))
    return F.when(speaker.eqNullSafe(view), F.lit(ASSISTANT + "\n")).otherwise(F.concat(F.lit(USER), name, F.lit(BODY)))


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with ``place``, their number from 0 within the conversation.

    Rows are dealt out by ranges of (conversation, order), numbered per (range, conversation), and shifted by
    the counts of the conversation's earlier ranges; a long conversation spans many ranges."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_first(), "text"]
    rows = turns.repartitionByRange(shuffle_parts(turns.sparkSession), *order).withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("range", "conv_id").orderBy(*order[1:])
    rows = rows.withColumn("n", F.row_number().over(inside) - 1)
    counts = rows.groupBy("conv_id", "range").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("conv_id").alias("c_id"), F.col("range").alias("c_range"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"))
    shifted = rows.join(base, (F.col("range") == F.col("c_range")) & F.col("conv_id").eqNullSafe(F.col("c_id")))
    return shifted.select("conv_id", "turn", "speaker", "text", (F.col("base") + F.col("n")).alias("place"))


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, view, part, start, text, masks, n_turns): ``start`` is the place of the part's first character
    in the rendering for ``view``; ``masks`` are [begin, end) places within the part that train the model."""
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{speaker}`").cast("string").alias("speaker"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    placed = numbered(rows).withColumn("part", F.floor(F.col("place") / part_turns))
    views = rows.select(F.col("conv_id").alias("v_id"), F.col("speaker").alias("view")).distinct()
    seen = placed.join(views, F.col("conv_id").eqNullSafe(F.col("v_id"))).drop("v_id")
    head = header(F.col("speaker"), F.col("view"))
    said = seen.select("conv_id", "view", "part", F.struct("place", F.length(head).alias("skip"), F.concat(head, "text", F.lit(END)).alias("said"),
                                                           F.col("speaker").eqNullSafe(F.col("view")).alias("own")).alias("s"))
    parts = said.groupBy("conv_id", "view", "part").agg(F.sort_array(F.collect_list("s")).alias("s"))
    # (rendered length so far, masks so far), over the turns of one part
    step = lambda a, x: F.struct((a["at"] + F.length(x["said"])).alias("at"), F.when(x["own"], F.concat(a["masks"], F.array(F.struct(
        (a["at"] + x["skip"]).alias("begin"), (a["at"] + F.length(x["said"])).alias("end"))))).otherwise(a["masks"]).alias("masks"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("masks"))
    parts = parts.select("conv_id", "view", "part", F.array_join(F.transform("s", lambda x: x["said"]), "").alias("text"), F.aggregate("s", none, step)["masks"].alias("masks"),
                         F.size("s").alias("n_turns"))
    before = Window.partitionBy("conv_id", "view").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("bigint"))


def digest(turns: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["begin"], m["end"])), ",")
    return perspectives(turns).select("conv_id", "view", F.col("part").cast("bigint").alias("part"), "start", "text", spans.alias("mask_spans"), F.col("n_turns").cast("bigint").alias("n_turns"))


DIGEST_SQL = r"""
WITH t AS (SELECT conv_id, role AS speaker, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, coalesce(text, '')) - 1 AS place FROM conversations),
v AS (SELECT DISTINCT conv_id, role AS view FROM conversations),
h AS (SELECT t.conv_id, view, place, place // 256 AS part, speaker IS NOT DISTINCT FROM view AS own, text,
             CASE WHEN speaker IS NOT DISTINCT FROM view THEN '<|assistant|>' || chr(10) ELSE '<|user' || CASE WHEN speaker IS NULL THEN '' ELSE ':' || speaker END || '|>' || chr(10) END AS head
      FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS said FROM h),
e AS (SELECT *, sum(length(said)) OVER (PARTITION BY conv_id, view, part ORDER BY place) AS stop FROM s),
p AS (SELECT conv_id, view, part, string_agg(said, '' ORDER BY place) AS text, count(*) AS n_turns,
             coalesce(string_agg((stop - length(said) + length(head)) || '-' || stop, ',' ORDER BY place) FILTER (own), '') AS mask_spans FROM e GROUP BY ALL)
SELECT conv_id, view, part::BIGINT AS part, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, view ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       text, mask_spans, n_turns::BIGINT AS n_turns FROM p"""
