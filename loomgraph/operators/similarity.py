"""Exact top-k by inner product without materialising the pairs.

Both axes are tiled: a task holds at most about ``query_rows`` queries of one group and streams a part of the group's
vectors past them, ``BLOCK_ROWS`` at a time, so its memory does not depend on either table. Rows of a part are sorted so
that a block holds vectors of one direction; a block has a centre and a radius, and queries whose bound
q . centre + |q| * radius lies below their k-th best score so far are not multiplied with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalise
from .ranking import top_k

QUERY_ROWS = 8_192
PART_ROWS = 65_536
BLOCK_ROWS = 1_024
GRAM_ROWS = 32_768
DIGITS = 9


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


class Best:
    """Running k best (score, key) per query row. Scores are compared to 9 digits, so summation order
    cannot reorder near-equal rows; ties go to the smaller key. The unrounded score is kept."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, 0), -np.inf)
        self.keys = np.empty((rows, 0), dtype=object)

    def floor(self) -> np.ndarray:
        """What a score must reach to matter, per query."""
        if self.scores.shape[1] < self.k:
            return np.full(len(self.scores), -np.inf)
        return np.round(self.scores.min(axis=1), DIGITS)

    def add(self, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """``scores`` of the query ``rows`` against vectors ``keys``; keys rise, so among equal scores the first wins."""
        level = np.round(scores, DIGITS) + 0.0
        if self.scores.shape[1] < self.k:  # widen until k places exist; empty places are minus infinity
            more = min(self.k - self.scores.shape[1], len(keys))
            self.scores = np.concatenate([self.scores, np.full((len(self.scores), more), -np.inf)], axis=1)
            self.keys = np.concatenate([self.keys, np.full((len(self.keys), more), None, dtype=object)], axis=1)
        width = self.scores.shape[1]
        held = np.round(self.scores[rows], DIGITS) + 0.0
        floor = held.min(axis=1)
        # a score equal to the worst held one matters only if its key is smaller than the largest key held with it
        useful = level > floor[:, None]
        for r in np.flatnonzero((level == floor[:, None]).any(axis=1)):
            last = max((k for k, h in zip(self.keys[rows[r]], held[r], strict=True) if h == floor[r] and k is not None), default=None)
            stop = len(keys) if last is None else np.searchsorted(keys, last)
            useful[r, :stop] |= level[r, :stop] == floor[r]
        hit = np.flatnonzero(useful.any(axis=1))
        if not len(hit):
            return
        fresh = np.where(useful[hit], level[hit], -np.inf)
        if width == 1:  # argmax takes the first of equal scores
            at = fresh.argmax(axis=1)
            self.scores[rows[hit], 0], self.keys[rows[hit], 0] = scores[hit, at], keys[at]
            return
        for r, own in zip(hit, rows[hit], strict=True):
            place = np.flatnonzero(useful[r])
            if len(place) > self.k:  # the k best, the first of equal ones
                cut = np.partition(level[r, place], len(place) - self.k)[len(place) - self.k]
                place = np.concatenate([place[level[r, place] > cut], place[level[r, place] == cut]])[:self.k]
            real = np.flatnonzero(np.isfinite(self.scores[own]))
            merged = np.concatenate([self.scores[own, real], scores[r, place]])
            names = np.concatenate([self.keys[own, real], keys[place]])
            compared = np.round(merged, DIGITS) + 0.0
            order = sorted(range(len(merged)), key=lambda c: (-compared[c], names[c]))[:width]
            self.scores[own, :len(order)], self.keys[own, :len(order)] = merged[order], names[order]


class Tile:
    """Queries of one task and the vectors that stream past them."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, k: int):
        self.keys, self.x, self.best = keys, x, Best(len(keys), k)
        self.norms = np.sqrt((x * x).sum(axis=1))
        self.products = 0

    def add(self, keys: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, x = keys[order], x[order]
        centre = x.mean(axis=0)
        radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
        bound = self.x @ centre + self.norms * radius
        rows = np.flatnonzero(bound + 1e-8 * np.maximum(1.0, np.abs(bound)) >= self.best.floor())
        if len(rows):
            self.products += len(rows) * len(keys)
            self.best.add(rows, (self.x if len(rows) == len(self.x) else self.x[rows]) @ x.T, keys)

    def rows(self, group: int, skip_self: bool) -> pd.DataFrame:
        n, width = self.best.scores.shape
        frame = pd.DataFrame({"grp": np.full(n * width, group), "query_key": np.repeat(self.keys, width), "vector_key": self.best.keys.reshape(-1), "score": self.best.scores.reshape(-1)})
        frame = frame[np.isfinite(frame.score)]
        return frame[frame.query_key != frame.vector_key] if skip_self else frame


def top_k_dot(queries: DataFrame, vectors: DataFrame, k: int, *, group: str = "client_id",
              query_key: str = "query_key", vector_key: str = "vector_key", vector: str = "x",
              normalise: bool = False, skip_self: bool = False,
              query_rows: int = QUERY_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """The ``k`` vectors with the largest inner product for every query of the same group.

    Returns (group, query_key, vector_key, score, rank). Scores are compared to 9 digits, ties go to
    the smaller key. Each query travels once per part of its group's vectors, each vector once per
    tile of its group's queries; a task hands on k rows per query.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    inner_k = k + 1 if skip_self else k
    key_type = queries.schema[query_key].dataType
    vkey_type = vectors.schema[vector_key].dataType
    unit = l2_normalise(F.col(vector)) if normalise else F.col(vector).cast("array<double>")
    q = queries.select(F.col(group).cast("bigint").alias("grp"), F.col(query_key).alias("qk"), unit.alias("v"))
    v = vectors.select(F.col(group).cast("bigint").alias("grp"), F.col(vector_key).alias("vk"), unit.alias("v"))
    schema = T.StructType([
        T.StructField("grp", T.LongType()),
        T.StructField("query_key", key_type),
        T.StructField("vector_key", vkey_type),
        T.StructField("score", T.DoubleType()),
    ])
    # tiles of each group's queries and parts of its vectors; small tables get parts enough for all cores
    spark = queries.sparkSession
    asked = q.groupBy("grp").agg(F.count(F.lit(1)).alias("nq"))
    held = v.groupBy("grp").agg(F.count(F.lit(1)).alias("nv"))
    cores = spark.sparkContext.defaultParallelism
    cut = asked.join(held, "grp").select(F.col("grp").alias("g"), F.ceil(F.col("nq") / query_rows).cast("int").alias("tiles"), F.greatest(F.ceil(F.col("nv") / part_rows), F.least(F.lit(cores), F.ceil(F.col("nv") / BLOCK_ROWS))).cast("int").alias("parts"))
    cut = F.broadcast(cut) if cut.limit(100_001).count() <= 100_000 else cut
    none_q, none_v = F.lit(None).cast(key_type), F.lit(None).cast(vkey_type)
    own = F.pmod(F.xxhash64("qk"), F.col("tiles")).cast("int")
    left = q.join(cut, F.col("grp") == F.col("g")).select("grp", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit(0).alias("cell"), "qk", none_v.alias("vk"), "v")
    # the component of largest size tells roughly which way a vector points
    size = F.transform("v", lambda x: F.abs(x))
    way = F.array_position(size, F.array_max(size)).cast("int")
    dealt = F.pmod(F.xxhash64("vk"), F.col("parts")).cast("int")
    right = v.join(cut, F.col("grp") == F.col("g")).select("grp", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), dealt.alias("part"), F.lit(1).alias("side"),
                                                           F.when(F.element_at("v", F.greatest(way, F.lit(1))) < 0, -way).otherwise(way).alias("cell"), none_q.alias("qk"), "vk", "v")
    stream = left.unionByName(right).repartition("grp", "tile", "part").sortWithinPartitions("grp", "tile", "part", "side", "cell")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, tile, asked_keys, asked_rows, keys, rows = None, None, [], [], [], []

        def flush():
            nonlocal keys, rows
            if rows:
                tile.add(np.array(keys, dtype=object), _matrix(rows))
                keys, rows = [], []

        for batch in batches:
            for grp, t, part, side, qk, vk, x in zip(*(batch[c] for c in ("grp", "tile", "part", "side", "qk", "vk", "v")), strict=True):
                if (grp, t, part) != place:
                    if tile is not None:
                        flush()
                        yield tile.rows(place[0], skip_self)
                    place, tile, asked_keys, asked_rows = (grp, t, part), None, [], []
                if side == 0:
                    asked_keys.append(qk)
                    asked_rows.append(x)
                    continue
                if tile is None:
                    if not asked_rows:
                        continue  # no query of the group was dealt to this tile
                    tile = Tile(np.array(asked_keys, dtype=object), _matrix(asked_rows), inner_k)
                keys.append(vk)
                rows.append(x)
                if len(rows) >= BLOCK_ROWS:
                    flush()
        if tile is not None:
            flush()
            yield tile.rows(place[0], skip_self)

    # keys are cast to text only where pandas would turn a nullable whole number into a fraction
    whole = {c: kind for c, kind in (("qk", key_type), ("vk", vkey_type)) if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))}
    filled = stream.select("grp", "tile", "part", "side", *[F.coalesce(c, F.lit(0).cast(whole[c])).alias(c) if c in whole else F.col(c) for c in ("qk", "vk")], "v")
    partial = filled.mapInPandas(scan, schema)
    best = top_k(partial, ["grp", "query_key"], [F.round("score", DIGITS).desc(), F.col("vector_key")], k)
    return best.select(
        F.col("grp").cast(queries.schema[group].dataType).alias(group),
        F.col("query_key").alias(query_key if query_key != vector_key else "query_key"),
        F.col("vector_key").alias(vector_key if query_key != vector_key else "vector_key"),
        "score", "rank",
    )


class Extremes:
    """Smallest and largest product between the rows of two parts, or within one part; nothing is kept per row."""

    def __init__(self, x: np.ndarray, same: bool):
        self.x, self.same, self.seen = x, same, 0
        self.lo, self.hi = np.inf, -np.inf

    def add(self, x: np.ndarray) -> None:
        """The next rows of the other part; within one part these are the same rows in the same order."""
        for at in range(0, len(self.x), BLOCK_ROWS):
            mine = self.x[at:at + BLOCK_ROWS]
            if self.same and at + len(mine) <= self.seen:
                continue  # these rows met the block when they were streamed themselves
            level = mine @ x.T
            if self.same and at < self.seen + len(x):  # a row with itself or an earlier row says nothing new
                level = level[np.arange(at, at + len(mine))[:, None] > np.arange(self.seen, self.seen + len(x))[None, :]]
            if level.size:
                self.lo, self.hi = min(self.lo, level.min()), max(self.hi, level.max())
        self.seen += len(x)


def gram_range(vectors: DataFrame, *, group: str = "client_id", key: str = "node_id", vector: str = "x",
               part_rows: int = GRAM_ROWS) -> DataFrame:
    """(group, lo, hi): smallest and largest cosine over all pairs of a group with a zero diagonal.

    Rows are dealt into parts of about ``part_rows``; a task multiplies two parts, each pair of parts once, and hands on
    two numbers. So a pair of rows is multiplied once for both extremes, and a row travels once per part.
    """
    # float vectors travel as they are and become unit vectors in the task
    held = vectors.select(F.col(group).cast("bigint").alias("grp"), F.xxhash64(key).alias("h"), F.col(vector).alias("v"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # at least as many pairs of parts as cores while a part has a block of rows
    least = int(np.ceil(np.sqrt(2 * cores)))
    parts = held.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).select(F.col("grp").alias("g"), F.greatest(
        F.ceil(F.col("n") / part_rows), F.least(F.lit(least), F.ceil(F.col("n") / BLOCK_ROWS))).cast("int").alias("parts"))
    parts = F.broadcast(parts) if parts.limit(100_001).count() <= 100_000 else parts
    dealt = held.join(parts, F.col("grp") == F.col("g")).withColumn("own", F.pmod("h", F.col("parts")).cast("int"))
    # part ``own`` meets every part ``other``: the smaller of the two is held, the larger streams past it
    met = dealt.select("grp", "own", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    stream = met.select("grp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "v")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, mine, tile, rows = None, [], None, []

        def flush():
            nonlocal rows
            if rows:
                tile.add(_unit(rows))
                rows = []

        def finish():
            nonlocal tile
            if place is not None and place[1] == place[2]:
                tile = Extremes(_unit(mine), True)
                for at in range(0, len(mine), BLOCK_ROWS):
                    tile.add(tile.x[at:at + BLOCK_ROWS])
            elif tile is not None:
                flush()
            if tile is not None and np.isfinite([tile.lo, tile.hi]).all():
                yield pd.DataFrame({"grp": [place[0]], "lo": [tile.lo], "hi": [tile.hi]})

        for batch in batches:
            for grp, a, b, side, x in zip(*(batch[c] for c in ("grp", "a", "b", "side", "v")), strict=True):
                if (grp, a, b) != place:
                    yield from finish()
                    place, mine, tile, rows = (grp, a, b), [], None, []
                if side == 0:
                    mine.append(x)
                    continue
                if tile is None:
                    if not mine:
                        continue
                    tile = Extremes(_unit(mine), False)
                rows.append(x)
                if len(rows) >= BLOCK_ROWS:
                    flush()
        yield from finish()

    pairs = stream.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b", "side").mapInPandas(scan, "grp bigint, lo double, hi double")
    found = pairs.groupBy("grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    groups = vectors.select(group).distinct()
    return groups.join(found, F.col(group).cast("bigint") == F.col("grp"), "left").select(
        group, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0)).alias("lo"), F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0)).alias("hi"))


def _unit(rows: list) -> np.ndarray:
    x = _matrix(rows)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
