"""Topology of condensed graphs: similarity top-k, self-expression, degree-capped matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise, union_all
from ..session import client_hint, materialise
from .graph import ENTITY
from .ranking import top_k
from .similarity import gram_range, top_k_dot

PRIOR_EPS = 1e-8


def allowed_pair(type_i: Column, type_j: Column, i: Column, j: Column, entity_entity: bool = False) -> Column:
    """Exactly one end is an entity (optionally both); never a node with itself."""
    one = (type_i == ENTITY) != (type_j == ENTITY)
    if entity_entity:
        one = one | ((type_i == ENTITY) & (type_j == ENTITY))
    return one & (i != j)


def _best_partners(vectors: DataFrame, k: int, preserve_types: bool) -> DataFrame:
    """(client_id, i, j, dot) best ``k`` partners per node; with types, only across the entity boundary."""
    q = vectors.select("client_id", F.col("node_id").alias("i"), "node_type", "x")
    v = vectors.select("client_id", F.col("node_id").alias("j"), "node_type", "x")
    options = dict(query_key="i", vector_key="j")
    if not preserve_types:
        return top_k_dot(q, v, k, skip_self=True, **options).withColumnRenamed("score", "dot")
    is_entity = F.col("node_type") == ENTITY
    return union_all([
        top_k_dot(q.where(is_entity), v.where(~is_entity), k, **options),
        top_k_dot(q.where(~is_entity), v.where(is_entity), k, **options),
    ]).withColumnRenamed("score", "dot")


def knn_rows(nodes: DataFrame, k: int = 8, text_vectors: DataFrame | None = None, prior_weight: float = 0.0,
             preserve_types: bool = True) -> DataFrame:
    """(client_id, i, j, weight): best ``k`` positive (cos+1)/2 + prior_weight * prior per row.

    Input nodes: client_id, node_id, node_type, x. The prior is an affine function of the text
    cosine, so both terms become one inner product of concatenated vectors plus a constant and the
    top-k stays exact without scoring pairs twice.
    """
    unit = nodes.select("client_id", "node_id", "node_type", l2_normalise(F.col("x")).alias("x"))
    if text_vectors is None or prior_weight <= 0:
        best = _best_partners(unit, k, preserve_types)
        weighted = best.withColumn("weight", (F.col("dot") + 1.0) / 2.0)
    else:
        span = gram_range(text_vectors)
        hint = client_hint(span)
        scale = F.sqrt(F.lit(float(prior_weight)) / (F.col("hi") - F.col("lo") + F.lit(PRIOR_EPS)))
        text = text_vectors.select("client_id", "node_id", l2_normalise(F.col("x")).alias("t")).join(hint(span), "client_id").select(
            "client_id", "node_id", F.transform("t", lambda v: v * scale).alias("t"))
        both = unit.join(text, ["client_id", "node_id"]).select(
            "client_id", "node_id", "node_type",
            F.concat(F.transform("x", lambda v: v * F.lit(0.5**0.5)), F.col("t")).alias("x"))
        offset = F.lit(0.5) - F.lit(float(prior_weight)) * F.col("lo") / (F.col("hi") - F.col("lo") + F.lit(PRIOR_EPS))
        weighted = _best_partners(both, k, preserve_types).join(hint(span), "client_id").withColumn("weight", F.col("dot") + offset)
    return weighted.where(F.col("weight") > 0).select("client_id", "i", "j", "weight", "rank")


def evidence_prior(pairs: DataFrame, text_vectors: DataFrame) -> DataFrame:
    """Add ``prior``: the pair's text cosine scaled by the client's smallest and largest cosine.

    ``pairs`` has client_id, i, j; a node paired with itself has cosine 0."""
    span = gram_range(text_vectors)
    unit = text_vectors.select("client_id", "node_id", l2_normalise(F.col("x")).alias("t"))
    left = unit.select("client_id", F.col("node_id").alias("i"), F.col("t").alias("ti"))
    right = unit.select("client_id", F.col("node_id").alias("j"), F.col("t").alias("tj"))
    from ..functions.vectors import dot

    cos = F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(dot(F.col("ti"), F.col("tj")))
    return (
        pairs.join(left, ["client_id", "i"]).join(right, ["client_id", "j"]).join(client_hint(span)(span), "client_id")
        .withColumn("prior", (cos - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(PRIOR_EPS)))
        .drop("ti", "tj", "lo", "hi")
    )


def symmetric_pairs(rows: DataFrame) -> DataFrame:
    """(client_id, i, j, weight) with i < j: the larger weight of the two directions."""
    return rows.where("i <> j").groupBy(
        "client_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    ).agg(F.max("weight").alias("weight")).where("weight > 0")


def degree_capped(pairs: DataFrame, k: int) -> DataFrame:
    """Greedy b-matching: pairs in falling weight are kept while both ends have degree below ``k``.

    Ties fall to the smaller (i, j). A pair that is among the best ``room`` open pairs of both its ends is kept by the
    greedy scan whatever comes before it, so a round takes all such pairs, lowers the room of their ends and drops the
    pairs of full nodes. Every round takes at least the best open pair. No client meets in one task.
    Input and output: client_id, i, j, weight with i < j.
    """
    keys = ["client_id", "i", "j"]
    open_pairs = materialise(pairs.select(*keys, "weight", F.round("weight", 9).alias("_w"), F.lit(k).alias("room_i"), F.lit(k).alias("room_j")))
    taken: list[DataFrame] = []
    while not open_pairs.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("room_i").alias("room")), F.struct(F.col("j").alias("node"), F.col("room_j").alias("room")))).alias("_end")
        sides = open_pairs.select(*keys, "_w", ends).select(*keys, "_w", "_end.node", "_end.room")
        near = top_k(sides, ["client_id", "node"], [F.col("_w").desc(), F.col("i"), F.col("j")], k, "_place").where(F.col("_place") <= F.col("room"))
        both = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select(*keys, F.lit(True).alias("_won"))
        marked = materialise(open_pairs.join(both, keys, "left"))
        won = marked.where("_won")
        taken.append(won.select(*keys, "weight"))
        used = won.select("client_id", F.explode(F.array("i", "j")).alias("node")).groupBy("client_id", "node").agg(F.count(F.lit(1)).alias("used"))
        rest = marked.where("_won IS NULL").drop("_won")
        for end, room in (("i", "room_i"), ("j", "room_j")):
            rest = rest.join(used.withColumnRenamed("node", end), ["client_id", end], "left").withColumn(room, F.col(room) - F.coalesce("used", F.lit(0))).where(F.col(room) > 0).drop("used")
        open_pairs = materialise(rest)
    return union_all(taken) if taken else pairs.select(*keys, "weight").limit(0)


def edge_list(pairs: DataFrame) -> DataFrame:
    """(client_id, src, dst, weight) with both directions of every positive pair."""
    from .graph import both_directions

    return both_directions(pairs.where("weight > 0").select("client_id", F.col("i").alias("src"), F.col("j").alias("dst"), "weight")).select(
        "client_id", "src", "dst", "weight")


def knn_topology(nodes: DataFrame, k: int = 8, text_vectors: DataFrame | None = None, prior_weight: float = 0.0,
                 preserve_types: bool = True) -> DataFrame:
    rows = knn_rows(nodes, k, text_vectors, prior_weight, preserve_types)
    return edge_list(degree_capped(symmetric_pairs(rows), k))


def expression_support(nodes: DataFrame, text_vectors: DataFrame, candidates: int = 16, preserve_types: bool = True) -> DataFrame:
    """(client_id, i, j): best candidates per row by raw inner product, and by text prior."""
    raw = nodes.select("client_id", "node_id", "node_type", F.col("x").cast("array<double>").alias("x"))
    types = nodes.select("client_id", "node_id", "node_type")
    text = text_vectors.select("client_id", "node_id", l2_normalise(F.col("x")).alias("x")).join(types, ["client_id", "node_id"])
    return _best_partners(raw, candidates, preserve_types).select("client_id", "i", "j").unionByName(
        _best_partners(text, candidates, preserve_types).select("client_id", "i", "j")).distinct()


def self_expressive_rows(nodes: DataFrame, text_vectors: DataFrame, *, candidates: int = 16, iterations: int = 50,
                         step_size: float = 1e-2, alpha: float = 8.0, beta: float = 5.0, preserve_types: bool = True) -> DataFrame:
    """(client_id, i, j, z): sparse coefficients rebuilding every row from its support by iterative
    shrinkage.

    A row's coefficients depend only on its own vector and its at most 2 * candidates support rows,
    so rows are solved independently in Arrow batches instead of as one dense matrix.
    """
    support = expression_support(nodes, text_vectors, candidates, preserve_types)
    with_prior = evidence_prior(support, text_vectors)
    partner = nodes.select("client_id", F.col("node_id").alias("j"), F.col("x").cast("array<double>").alias("xj"))
    mine = nodes.select("client_id", F.col("node_id").alias("i"), F.col("x").cast("array<double>").alias("xi"))
    grouped = (
        with_prior.join(partner, ["client_id", "j"]).groupBy("client_id", "i")
        .agg(F.sort_array(F.collect_list(F.struct("j", "prior", "xj"))).alias("s"))
        .join(mine, ["client_id", "i"])
        .select("client_id", "i", "xi", F.col("s.j").alias("j"), F.col("s.prior").alias("prior"), F.flatten("s.xj").alias("xs"))
    )
    l1, l3 = beta / alpha, 1.0 / alpha

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            sizes = batch["j"].map(len).to_numpy()
            width = int(sizes.max())
            x = np.stack([np.asarray(v) for v in batch["xi"]])
            xs = np.zeros((len(batch), width, x.shape[1]))
            prior = np.zeros((len(batch), width))
            live = np.arange(width)[None, :] < sizes[:, None]
            for r, (flat, p) in enumerate(zip(batch["xs"], batch["prior"])):
                xs[r, : sizes[r]] = np.asarray(flat).reshape(sizes[r], -1)
                prior[r, : sizes[r]] = p
            z = np.zeros((len(batch), width))
            tau = step_size * (l1 + l3 * (1.0 - prior))
            for _ in range(iterations):
                gap = np.einsum("bs,bsd->bd", z, xs) - x
                z = z - step_size * np.einsum("bsd,bd->bs", xs, gap)
                z = np.sign(z) * np.maximum(np.abs(z) - tau, 0.0) * live
            yield pd.DataFrame({
                "client_id": np.repeat(batch["client_id"].to_numpy(), sizes),
                "i": np.repeat(batch["i"].to_numpy(), sizes),
                "j": np.concatenate([np.asarray(v) for v in batch["j"]]),
                "z": z[live],
            })

    client = nodes.schema["client_id"].dataType.simpleString()
    return grouped.mapInPandas(solve, f"client_id {client}, i bigint, j bigint, z double")


def self_expressive_topology(nodes: DataFrame, text_vectors: DataFrame, *, final_k: int = 8, **options) -> DataFrame:
    """Edge list from abs(Z) + abs(Z) transposed, row top-k, then the degree-capped matching."""
    z = materialise(self_expressive_rows(nodes, text_vectors, **options).where("z <> 0"))
    weights = z.select("client_id", "i", "j", F.abs("z").alias("w")).unionByName(
        z.select("client_id", F.col("j").alias("i"), F.col("i").alias("j"), F.abs("z").alias("w")))
    rows = weights.groupBy("client_id", "i", "j").agg(F.sum("w").alias("weight"))
    best = top_k(rows, ["client_id", "i"], [F.round("weight", 9).desc(), F.col("j")], final_k)
    return edge_list(degree_capped(symmetric_pairs(best), final_k))
