"""Federated averaging, anchor statistics and round bookkeeping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered

# Modules whose weights are averaged.
MODULES = ("graph_encoder", "projector", "condensed_encoder", "projector_c")


def federated_average(weights: DataFrame, clients: DataFrame, modules=MODULES) -> DataFrame:
    """(module, param, idx, value): sample-weighted mean over the uploading clients.

    weights: client_id, module, param, idx, value. clients: client_id, num_samples, sampled.
    The divisor is the sample total of all uploading clients, also for a module only some of them
    sent. Clients that were not sampled, have no samples or sent nothing do not count.
    """
    eligible = clients.where(F.col("sampled") & (F.col("num_samples") > 0)).select("client_id", "num_samples")
    uploading = eligible.join(weights.select("client_id").distinct(), "client_id", "left_semi")
    total = uploading.agg(F.sum("num_samples").alias("total"))
    return (
        weights.where(F.col("module").isin(*modules)).join(uploading, "client_id")
        .groupBy("module", "param", "idx").agg(F.sum(F.col("value") * F.col("num_samples")).alias("weighted"))
        .join(F.broadcast(total))
        .select("module", "param", "idx", (F.col("weighted") / F.col("total")).alias("value"))
    )


def weighted_gradients(gradients: DataFrame, sizes: DataFrame) -> DataFrame:
    """(param, idx, value): sum of n_c / sum(n) * g_c; a client without nodes counts 1 in the divisor."""
    total = sizes.agg(F.sum(F.greatest("n", F.lit(1))).alias("total"))
    return (
        gradients.join(sizes, "client_id").groupBy("param", "idx").agg(F.sum(F.col("value") * F.col("n")).alias("weighted"))
        .join(F.broadcast(total)).select("param", "idx", (F.col("weighted") / F.col("total")).alias("value"))
    )


def gradient_match(left: DataFrame, right: DataFrame, norm_weight: float = 0.0) -> DataFrame:
    """One row: 1 - cosine of two (param, idx, value) tables (+ norm_weight * mean squared difference)."""
    joined = left.select("param", "idx", F.col("value").alias("a")).join(
        right.select("param", "idx", F.col("value").alias("b")), ["param", "idx"], "full").fillna(0.0, ["a", "b"])
    s = joined.agg(
        F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"),
        F.sum(F.col("b") * F.col("b")).alias("bb"), F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"))
    cos = F.col("ab") / (F.greatest(F.sqrt("aa"), F.lit(1e-8)) * F.greatest(F.sqrt("bb"), F.lit(1e-8)))
    return s.select((F.lit(1.0) - cos + F.lit(float(norm_weight)) * F.col("mse")).alias("loss"))


def sample_clients(num_clients: int, fraction: float, seed: int, round_no: int) -> list[int]:
    """max(1, int(n * fraction)) clients of a round, ascending."""
    count = max(1, int(num_clients * fraction))
    return sorted(np.random.default_rng([seed, round_no]).choice(num_clients, size=count, replace=False).tolist())


def sample_pool(samples: DataFrame, per_client: int, seed: int, round_no: int, key: str = "idx") -> DataFrame:
    """Up to ``per_client`` rows of every client's training pool, redrawn per round (0 = all)."""
    if per_client <= 0:
        return samples
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(round_no)), F.col(key).cast("string")))
    w = Window.partitionBy("client_id").orderBy(order, F.col(key))
    return samples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_client).drop("_r")


def average_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: directed edges per node over all anchor graphs, 8.0 without nodes."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    e = edges.agg(F.count(F.lit(1)).alias("e"))
    return n.join(F.broadcast(e)).select(F.when(F.col("n") == 0, F.lit(8.0)).otherwise(F.col("e") / F.col("n")).alias("target_degree"))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def apportion(counts: list[int], total: int) -> list[int]:
    """Split ``total`` by the type ratios with the largest remainders; equal ones in order of type."""
    weights = np.asarray(counts, dtype=np.float64)
    exact = total * (weights / weights.sum() if weights.any() else np.full(len(weights), 1 / len(weights)))
    whole = np.floor(exact).astype(int)
    ranked = np.argsort(whole - exact, kind="stable")
    whole[ranked[:total - int(whole.sum())]] += 1
    return whole.tolist()


def initial_global_nodes(anchors: DataFrame, total: int, dim: int, seed: int = 0) -> DataFrame:
    """(node_id, node_type, x): ``total`` synthetic nodes drawn with replacement from the anchors of
    their type plus 0.01 noise; a type without anchors starts at 0.02 noise.

    Row numbers and noise are hashes of (node, component, seed), so no draw passes through the driver; only the three
    type counts do."""
    spark = anchors.sparkSession
    counts = {r["node_type"]: r["n"] for r in type_counts(anchors).collect()}
    sizes = [int(counts.get(t, 0)) for t in range(3)]
    shares = apportion(sizes, total)
    kind = F.when(F.col("node_id") < shares[0], 0).when(F.col("node_id") < shares[0] + shares[1], 1).otherwise(2)
    size = F.get(F.array(*[F.lit(n).cast("bigint") for n in sizes]), F.col("node_type"))
    word = lambda at: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("node_id").cast("string"), at, F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    even = lambda at: (word(at) + 0.5) / F.lit(4294967296.0)
    normal = lambda i: F.sqrt(-2 * F.log(even(F.concat(F.lit("r"), i.cast("string"))))) * F.cos(F.lit(2 * np.pi) * even(F.concat(F.lit("a"), i.cast("string"))))
    drawn = spark.range(total).select(F.col("id").alias("node_id")).withColumn("node_type", kind).select(
        "node_id", "node_type", F.when(size > 0, F.pmod(word(F.lit("row")), size)).otherwise(-1).alias("row"),
        F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: normal(i) * F.when(size > 0, 0.01).otherwise(0.02)).alias("noise"))
    bucket = F.concat_ws("/", F.lpad(F.col("client_id").cast("string"), 10, "0"), F.lpad(F.floor(F.col("core_id") / 1024).cast("string"), 12, "0"))
    rows = numbered(anchors.select("client_id", "core_id", F.col("node_type").cast("int").alias("node_type"), "x"), ["node_type"],
                    [F.col("client_id"), F.col("core_id")], bucket, "row").select("node_type", "row", "x")
    base = F.coalesce(F.col("x").cast("array<double>"), F.transform("noise", lambda v: F.lit(0.0)))
    return drawn.join(rows, ["node_type", "row"], "left").select("node_id", "node_type", F.zip_with(base, "noise", lambda a, b: a + b).alias("x"))


def inverse_frequency(labels: DataFrame, label: str = "label") -> DataFrame:
    """Class size and sampling weight 1/size next to every row."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("class_size"))
    return labels.join(sizes, label).withColumn("sample_weight", F.lit(1.0) / F.col("class_size"))


def learning_rate(epoch: Column, base: float, warmup: float, epochs: float, floor: float = 5e-6) -> Column:
    """Linear warm-up, then half-cycle cosine decay to ``floor``."""
    cosine = F.lit(floor) + F.lit(base - floor) * F.lit(0.5) * (
        F.lit(1.0) + F.cos(F.lit(float(np.pi)) * (epoch - F.lit(float(warmup))) / F.lit(float(epochs - warmup))))
    return F.when(epoch < F.lit(float(warmup)), F.lit(float(base)) * epoch / F.lit(float(warmup or 1.0))).otherwise(cosine)


# fixed values: names of the ablation modes, each with (evidence is shown, what stands for the condensed graph)
PROMPT_MODES = {
    "both": (True, "own"), "dual": (True, "own"), "shared": (True, "own"), "no_synthetic": (True, "own"),
    "evidence_only": (True, "zero"), "ze_only": (True, "zero"), "z_e_only": (True, "zero"),
    "condensed_only": (False, "own"), "zc_only": (False, "own"), "z_c_only": (False, "own"),
    "random_condensed": (True, "noise"), "random_zc": (True, "noise"), "random_z_c": (True, "noise"),
    "none": (False, "zero"), "text_only": (False, "zero"),
}


def masked_prompt(evidence: Column, condensed: Column, mode: str, seed: int = 0) -> tuple[Column, Column]:
    """The two graph prompt vectors under an ablation mode; ValueError for a name that is not one."""
    if (name := mode.lower()) not in PROMPT_MODES:
        raise ValueError(f"no such prompt mode: {mode}; known are {sorted(PROMPT_MODES)}")
    shown, source = PROMPT_MODES[name]
    form = {"own": lambda v: v, "zero": lambda v: F.transform(v, lambda c: F.lit(0.0)), "noise": lambda v: _noise_like(v, seed)}
    return form["own" if shown else "zero"](evidence), form[source](condensed)


def _noise_like(vector: Column, seed: int) -> Column:
    """Standard normal values by position and content hash (Box-Muller), reproducible across retries."""
    def uniform(i: Column, salt: int) -> Column:
        return (F.pmod(F.xxhash64(F.to_json(F.struct(vector.alias("v"))), i, F.lit(seed), F.lit(salt)), F.lit(2**31)) + F.lit(0.5)) / F.lit(float(2**31))

    return F.transform(vector, lambda _, i: F.sqrt(F.lit(-2.0) * F.log(uniform(i, 1))) * F.cos(F.lit(2 * float(np.pi)) * uniform(i, 2)))
