"""Ranking helpers that never sort an unbounded group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank",
          first: int = 1) -> DataFrame:
    """Best ``k`` rows per key in a total order.

    The rank filter becomes a window group limit, so every task forwards at most ``k`` rows per key
    and a hot key reaches the final task as (tasks x k) rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= F.lit(k))
    return ranked if first == 1 else ranked.withColumn(rank, F.col(rank) + F.lit(first - 1))


def top_k_salted(df: DataFrame, keys: list[str], order: list[Column], k: int, salt_on: str, salts: int = 64, rank: str = "rank") -> DataFrame:
    """``top_k`` for limits too large for a window group limit: rows are first ranked inside salted
    parts of a key, so the last task of a hot key sorts at most (salts x k) rows."""
    part = F.pmod(F.xxhash64(F.col(salt_on), F.lit(7)), F.lit(salts))
    salted = df.withColumn("_salt", part)
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= k)
    last = first.drop("_salt", "_r").withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return last.where(F.col(rank) <= k)


def numbered(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Contiguous 0-based numbers per key, in the order (bucket, order).

    ``bucket`` must follow the order (hash prefix, position range). Rows are numbered inside a
    bucket and shifted by the sizes of the earlier buckets, so the sort work of a hot key spreads
    over its buckets and only one count per bucket is ordered as a whole.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        if keys else Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.withColumn("_pos", F.row_number().over(within))
        .join(shift, [*keys, "_bucket"])
        .withColumn(name, (F.col("_shift") + F.col("_pos") - 1).cast("bigint"))
        .drop("_bucket", "_pos", "_shift")
    )


def hash_bucket(hash_id: Column, digits: int = 3) -> Column:
    """Leading hex digits of a prefixed md5 id; follows the id's own order within one prefix."""
    return F.substring(F.substring_index(hash_id, "-", -1), 1, digits)


def next_in_order(df: DataFrame, keys: list[str], position: str, value: str, width: int = 100_000,
                  name: str = "next_value") -> DataFrame:
    """``value`` of the following row by (position, value) per key; NULL for the last.

    Positions are cut into ranges of ``width``; the last row of a range takes the first row of the
    next non-empty range, so no task sorts a whole key.
    """
    order = [F.col(position), F.col(value)]
    tagged = df.withColumn("_range", F.floor(F.col(position) / F.lit(width)))
    heads = tagged.groupBy(*keys, "_range").agg(F.min(F.struct(position, value)).alias("_head"))
    following = heads.select(
        *keys, "_range", F.lead(F.col("_head")[value]).over(Window.partitionBy(*keys).orderBy("_range")).alias("_following")
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        tagged.withColumn("_lead", F.lead(value).over(within))
        .join(following, [*keys, "_range"])
        .withColumn(name, F.coalesce("_lead", "_following"))
        .drop("_range", "_lead", "_following")
    )


def min_max(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Min-max scaling per key by a two-phase aggregate joined back; a constant group scales to 1."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(
        (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    )
    return df.join(span, keys).withColumn(name, scaled).drop("_lo", "_hi")


def topk_softmax(df: DataFrame, keys: list[str], score: str, k: int, ties: list[Column],
                 name: str = "weight", digits: int = 9) -> DataFrame:
    """Softmax over the ``k`` best scores per key; other rows are gone (weight 0)."""
    kept = top_k(df, keys, [F.round(score, digits).desc(), *ties], k, "_rank")
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return kept.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e").withColumnRenamed("_rank", "rank")
