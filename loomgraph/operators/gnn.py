"""Graph encoders at inference time: convolution, attention and transformer layers as joins.

A layer's weights are small matrices given by the caller; node vectors stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, layer_norm, sum_vectors
from ..session import materialise
from .surrogate import KEYS, _affine, normalised_adjacency, spread


@dataclass
class Layer:
    """weight [out, in] and bias of a convolution layer. Attention layers hold ``heads`` heads one after the other along
    the rows of weight, query, key and skip and along attend_src and attend_dst; see ``attention_layer`` and
    ``transformer_layer``."""

    weight: np.ndarray
    bias: np.ndarray | None = None
    attend_src: np.ndarray | None = None
    attend_dst: np.ndarray | None = None
    query: np.ndarray | None = None
    key: np.ndarray | None = None
    skip: np.ndarray | None = None
    heads: int = 1


def _activate(table: DataFrame, norm: bool) -> DataFrame:
    if not norm:
        return table
    return table.withColumn("x", F.transform(layer_norm(F.col("x")), lambda v: F.greatest(v, F.lit(0.0))))


def convolution(nodes: DataFrame, edges: DataFrame, layers: list[Layer]) -> DataFrame:
    """(client_id, node_id, x): stacked D^-1/2 (A+I) D^-1/2 X W + b with layer norm and ReLU between."""
    adjacency = materialise(normalised_adjacency(nodes, edges))
    table = nodes.select(*KEYS, "x")
    for n, layer in enumerate(layers):
        table = table.withColumn("x", _affine(layer.weight, None, False)(F.col("x").cast("array<double>")))
        summed = spread(table, adjacency, "x", layer.weight.shape[0], "x")
        if layer.bias is not None:
            summed = summed.withColumn("x", F.zip_with("x", F.lit(layer.bias.tolist()), lambda a, b: a + b))
        table = materialise(_activate(summed, n < len(layers) - 1))
    return table


def _heads(vector, heads: int, dim: int) -> list:
    return [F.slice(vector, h * dim + 1, dim) for h in range(heads)]


def _softmax_sum(scored: DataFrame, heads: int, dim: int) -> DataFrame:
    """Attention sums per target: edge rows (client_id, dst, e0, e1, ..., v) to the softmax(e)-weighted parts of v, one after the other.

    The maxima come from an aggregate joined back, so a hub's edges never form one window."""
    names = [f"e{h}" for h in range(heads)]
    top = scored.groupBy("client_id", "dst").agg(*[F.max(n).alias(f"top{n}") for n in names])
    weighted = scored.join(top, ["client_id", "dst"]).select("client_id", "dst", "v", *[F.exp(F.col(n) - F.col(f"top{n}")).alias(n) for n in names])
    parts = [F.zip_with(part, F.array_repeat(n, dim), lambda v, w: v * w) for n, part in zip(names, _heads(F.col("v"), heads, dim), strict=True)]
    weighted = weighted.select("client_id", "dst", F.concat(*parts).alias("v"), *names)
    total = sum_vectors(weighted, ["client_id", "dst"], "v", heads * dim, name="s", extra=[F.sum(n).alias(n) for n in names])
    shares = [F.zip_with(part, F.array_repeat(n, dim), lambda v, z: v / z) for n, part in zip(names, _heads(F.col("s"), heads, dim), strict=True)]
    return total.select("client_id", F.col("dst").alias("node_id"), F.concat(*shares).alias("x"))


def _with_self(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = nodes.select("client_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    return edges.where("src <> dst").select("client_id", "src", "dst").unionByName(own).distinct()


def attention_layer(table: DataFrame, edges: DataFrame, layer: Layer, slope: float = 0.2) -> DataFrame:
    """Graph attention: per head a softmax over incoming edges (self loop added) of leaky(a_src.h_src + a_dst.h_dst);
    the heads' sums are averaged."""
    heads, dim = layer.heads, layer.weight.shape[0] // layer.heads
    h = materialise(table.select(*KEYS, _affine(layer.weight, None, False)(F.col("x").cast("array<double>")).alias("h")))
    each = lambda a, name: [dot(part, F.lit(own.tolist())).alias(f"{name}{n}") for n, (part, own) in enumerate(zip(_heads(F.col("h"), heads, dim), np.split(a, heads), strict=True))]
    s = h.select("client_id", F.col("node_id").alias("src"), F.col("h").alias("v"), *each(layer.attend_src, "s"))
    d = h.select("client_id", F.col("node_id").alias("dst"), *each(layer.attend_dst, "d"))
    leaky = [F.when(raw >= 0, raw).otherwise(raw * F.lit(slope)).alias(f"e{n}") for n in range(heads) for raw in [F.col(f"s{n}") + F.col(f"d{n}")]]
    scored = _with_self(table, edges).join(s, ["client_id", "src"]).join(d, ["client_id", "dst"]).select("client_id", "dst", "v", *leaky)
    mean = F.transform(_heads(F.col("x"), heads, dim)[0], lambda v: v / heads)
    for part in _heads(F.col("x"), heads, dim)[1:]:
        mean = F.zip_with(mean, part, lambda a, v: a + v / heads)
    out = _softmax_sum(scored, heads, dim).withColumn("x", mean)
    return out if layer.bias is None else out.withColumn("x", F.zip_with("x", F.lit(layer.bias.tolist()), lambda a, b: a + b))


def transformer_layer(table: DataFrame, edges: DataFrame, layer: Layer) -> DataFrame:
    """Transformer convolution: per head a softmax over incoming edges of q.k/sqrt(d); the heads' sums one after the
    other, plus the skip projection."""
    heads, dim = layer.heads, layer.weight.shape[0] // layer.heads
    x = F.col("x").cast("array<double>")
    base = materialise(table.select(*KEYS, _affine(layer.query, None, False)(x).alias("q"), _affine(layer.key, None, False)(x).alias("k"),
                                    _affine(layer.weight, layer.bias, False)(x).alias("v"), _affine(layer.skip, None, False)(x).alias("skip")))
    s = base.select("client_id", F.col("node_id").alias("src"), "k", "v")
    d = base.select("client_id", F.col("node_id").alias("dst"), "q")
    scores = [(dot(q, k) / F.lit(float(dim) ** 0.5)).alias(f"e{n}") for n, (q, k) in enumerate(zip(_heads(F.col("q"), heads, dim), _heads(F.col("k"), heads, dim), strict=True))]
    scored = edges.select("client_id", "src", "dst").distinct().join(s, ["client_id", "src"]).join(d, ["client_id", "dst"]).select("client_id", "dst", "v", *scores)
    message = _softmax_sum(scored, heads, dim).withColumnRenamed("x", "m")
    return base.join(message, KEYS, "left").select(
        *KEYS, F.when(F.col("m").isNull(), F.col("skip")).otherwise(F.zip_with("skip", "m", lambda a, b: a + b)).alias("x"))


def encode(nodes: DataFrame, edges: DataFrame, layers: list[Layer], kind: str = "gcn") -> DataFrame:
    """Node vectors of a 'gcn', 'gat' or 'gt' stack."""
    if kind == "gcn":
        return convolution(nodes, edges, layers)
    step = {"gat": attention_layer, "gt": transformer_layer}.get(kind)
    if step is None:
        raise ValueError(f"unknown graph encoder: {kind}")
    table = nodes.select(*KEYS, "x")
    for n, layer in enumerate(layers):
        table = materialise(_activate(step(table, edges, layer), n < len(layers) - 1))
    return table


def graph_mean(vectors: DataFrame, members: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Mean node vector per graph of a batch; ``members`` maps graph keys to (client_id, node_id)."""
    return sum_vectors(members.join(vectors, KEYS), keys, "x", dim, mean=True)
