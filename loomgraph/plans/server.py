"""Server side of a round: averaging, global graph initialisation, edge estimation, feature matching."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import federate as fed
from ..operators.topology import degree_capped, edge_list
from ..session import materialise

CELL_ROWS = 1024


@dataclass(frozen=True)
class ServerConfig:
    """Fixed default values."""

    global_nodes: int = 1024
    edge_hidden: int = 256
    edge_topk: int = 8
    type_dim: int = 16
    preserve_types: bool = True
    surrogate_hidden: int = 64
    surrogate_layers: int = 2
    type_weight: float = 1.0
    link_weight: float = 0.5
    seed: int = 42


@dataclass
class EdgeEstimator:
    """Pair scorer: two hidden ReLU layers over (|a-b|, a*b, type vectors), sigmoid on top."""

    types: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def create(cls, dim: int, cfg: ServerConfig) -> "EdgeEstimator":
        rng = np.random.default_rng(cfg.seed)
        widths = [2 * dim + 2 * cfg.type_dim, cfg.edge_hidden, cfg.edge_hidden, 1]
        layers = []
        for a, b in zip(widths[:-1], widths[1:]):
            bound = 1.0 / np.sqrt(a)
            layers.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
        return cls(rng.standard_normal((3, cfg.type_dim)), layers)

    def score(self, xa, ta, xb, tb) -> np.ndarray:
        h = np.concatenate([np.abs(xa - xb), xa * xb, self.types[ta], self.types[tb]], axis=-1)
        for n, (w, b) in enumerate(self.layers):
            h = h @ w + b
            if n < len(self.layers) - 1:
                h = np.maximum(h, 0.0)
        return 1.0 / (1.0 + np.exp(-h[..., 0]))


def estimated_pairs(nodes: DataFrame, estimator: EdgeEstimator, preserve_types: bool = True, threshold: float = 0.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(client_id, i, j, weight) with i < j: mean score of both directions of every allowed pair.

    Nodes are dealt into cells of about ``cell_rows``; each pair of cells is scored in one task."""
    type_vectors, layers = estimator.types, estimator.layers
    cells = max(1, -(-nodes.count() // cell_rows))
    dealt = nodes.select("node_id", "node_type", "x", F.pmod(F.xxhash64("node_id"), F.lit(cells)).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("other"))
    dealt = dealt.select("node_id", "node_type", "x", "cell", F.least("cell", "other").alias("one"), F.greatest("cell", "other").alias("two"))

    def score(part: pd.DataFrame) -> pd.DataFrame:
        est = EdgeEstimator(type_vectors, layers)
        ids, types, cell = part["node_id"].to_numpy(), part["node_type"].to_numpy(dtype=int), part["cell"].to_numpy()
        x, one_cell, out = np.array(part["x"].tolist(), dtype=np.float64), (part["one"] == part["two"]).iloc[0], []
        for k in range(len(ids)):
            other = ids > ids[k]
            if not one_cell:
                other &= cell != cell[k]
            if preserve_types:
                other &= (types == 0) != (types[k] == 0)
            if other.any():
                xa, ta = np.broadcast_to(x[k], x[other].shape), np.full(other.sum(), types[k])
                w = (est.score(xa, ta, x[other], types[other]) + est.score(x[other], types[other], xa, ta)) / 2.0
                out.append(pd.DataFrame({"client_id": 0, "i": ids[k], "j": ids[other], "weight": w}))
        return pd.concat(out) if out else pd.DataFrame({"client_id": [], "i": [], "j": [], "weight": []})

    return dealt.groupBy("one", "two").applyInPandas(score, "client_id int, i bigint, j bigint, weight double").where(F.col("weight") > threshold)


class Server:
    """Keeps the global graph and the averaged weights between rounds."""

    def __init__(self, cfg: ServerConfig = ServerConfig()):
        self.cfg = cfg
        self.nodes: DataFrame | None = None
        self.estimator: EdgeEstimator | None = None
        self.weights: DataFrame | None = None

    def start(self, anchors: DataFrame, dim: int) -> DataFrame:
        """Draw the synthetic nodes from the anchors of their type (anchors: client_id, core_id, node_type, x)."""
        self.nodes = materialise(fed.initial_global_nodes(anchors, self.cfg.global_nodes, dim, self.cfg.seed))
        self.estimator = EdgeEstimator.create(dim, self.cfg)
        return self.nodes

    def average(self, weights: DataFrame, clients: DataFrame) -> DataFrame:
        self.weights = materialise(fed.federated_average(weights, clients))
        return self.weights

    def export(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the global graph with the degree-capped estimated topology."""
        if self.nodes is None or self.estimator is None:
            raise RuntimeError("the global graph is not initialised")
        pairs = estimated_pairs(self.nodes, self.estimator, self.cfg.preserve_types)
        edges = edge_list(degree_capped(pairs, self.cfg.edge_topk)).drop("client_id")
        return self.nodes, edges
