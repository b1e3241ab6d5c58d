"""The federated round loop over upload tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import federate as fed
from ..operators.condense import assert_numeric_only
from ..operators.evaluate import round_losses, split_metrics
from ..sources.store import append_metrics
from .server import Server

# A learner trains the sampled clients of one round: (round, client ids, averaged weights or None,
# global nodes, global edges) -> (weights rows, client rows with num_samples and loss).
Learner = Callable[[int, list[int], DataFrame | None, DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class Rounds:
    spark: SparkSession
    server: Server
    num_clients: int
    client_fraction: float = 1.0
    seed: int = 0
    metrics_path: str | None = None
    history: list[dict] = field(default_factory=list)

    def run(self, anchors: DataFrame, dim: int, num_rounds: int, learner: Learner | None = None,
            evaluate: Callable[[int], DataFrame] | None = None, eval_every: int = 1) -> list[dict]:
        """Round 0 only condenses; later rounds train (with a learner), average, and evaluate.

        ``evaluate`` returns predictions (split, pred, label) of a round."""
        assert_numeric_only(anchors)
        for n in range(num_rounds):
            begin = time.time()
            chosen = fed.sample_clients(self.num_clients, self.client_fraction, self.seed, n)
            if self.server.nodes is None:
                self.server.start(anchors.where(F.col("client_id").isin(chosen)), dim)
            nodes, edges = self.server.export()
            record = {"round": n, "clients": chosen, "avg_loss": None}
            if learner is not None and n > 0:
                weights, clients = learner(n, chosen, self.server.weights, nodes, edges)
                self.server.average(weights, clients.withColumn("sampled", F.col("client_id").isin(chosen)))
                loss = round_losses(clients.withColumn("round", F.lit(n))).head()
                record["avg_loss"] = None if loss is None else loss["avg_loss"]
            if evaluate is not None and n % eval_every == 0:
                for row in split_metrics(evaluate(n), ["split"]).collect():
                    record.update({f"{row['split']}_{m}": row[m] for m in ("hit", "em", "f1")})
            record["round_time"] = time.time() - begin
            self.history.append(record)
            if self.metrics_path:
                append_metrics(self.spark, self.metrics_path, record)
        return self.history


def summary(history: list[dict]) -> str:
    """Plain table of a run."""
    lines = ["round | avg loss | train | val | test"]
    for r in history:
        def cell(key: str) -> str:
            value = r.get(key)
            return "-" if value is None else f"{value:.4f}" if key == "avg_loss" else f"{value:.1f}%"
        lines.append(f"{r['round']:>5} | " + " | ".join(cell(k) for k in ("avg_loss", "train_hit", "val_hit", "test_hit")))
    return "\n".join(lines)
