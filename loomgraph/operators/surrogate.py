"""Surrogate graph convolution over all anchor graphs at once: forward, loss and parameter gradients.

Node rows stay distributed. Neighbour sums are joins with hash aggregation; the small weight matrices
travel to the rows; gradients are summed inside each partition before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, sum_vectors, union_all
from ..session import materialise
from .graph import both_directions
from .ranking import numbered

Layers = list[tuple[np.ndarray, np.ndarray]]
KEYS = ["client_id", "node_id"]


def init_layers(input_dim: int, hidden: int, output: int = 3, num_layers: int = 2, seed: int = 0) -> Layers:
    """Uniform weights and biases within 1/sqrt(fan-in)."""
    if num_layers < 1:
        raise ValueError("num_layers must be at least 1")
    dims = [input_dim, *[hidden] * (num_layers - 1), output]
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(dims[:-1], dims[1:]):
        bound = 1.0 / np.sqrt(a)
        out.append((rng.uniform(-bound, bound, (b, a)), rng.uniform(-bound, bound, b)))
    return out


def symmetric_adjacency(edges: DataFrame) -> DataFrame:
    """(client_id, src, dst, weight): larger of the two directions, no self loops."""
    return both_directions(edges.where("src <> dst").select("client_id", "src", "dst", "weight")).groupBy(
        "client_id", "src", "dst").agg(F.max("weight").alias("weight")).where("weight > 0")


def normalised_adjacency(nodes: DataFrame, edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """(client_id, src, dst, a) = D^-1/2 (A + I) D^-1/2 with one row per non-zero entry."""
    adjacency = symmetric_adjacency(edges)
    if self_loops:
        adjacency = adjacency.unionByName(nodes.select(
            "client_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0).alias("weight")))
    degree = adjacency.groupBy("client_id", "src").agg(F.greatest(F.sum("weight"), F.lit(1e-12)).alias("degree"))
    ds = degree.withColumnRenamed("degree", "ds")
    dd = degree.select("client_id", F.col("src").alias("dst"), F.col("degree").alias("dd"))
    return adjacency.join(ds, ["client_id", "src"]).join(dd, ["client_id", "dst"]).select(
        "client_id", "src", "dst", (F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("a"))


def spread(rows: DataFrame, adjacency: DataFrame, vector: str, dim: int, name: str) -> DataFrame:
    """(client_id, node_id, name): neighbour sum of ``vector`` weighted by the adjacency."""
    sent = adjacency.select("client_id", F.col("src").alias("node_id"), "dst", "a").join(rows.select(*KEYS, vector), KEYS)
    return sum_vectors(sent, ["client_id", "dst"], vector, dim, weight=F.col("a"), name=name).withColumnRenamed("dst", "node_id")


def _affine(weight: np.ndarray, bias: np.ndarray | None, relu: bool):
    w, b = np.ascontiguousarray(weight.T), bias

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        out = np.stack([np.asarray(v, dtype=np.float64) for v in x]) @ w
        if b is not None:
            out = out + b
        return pd.Series(list(np.maximum(out, 0.0) if relu else out))

    return apply


def forward(nodes: DataFrame, adjacency: DataFrame, layers: Layers) -> DataFrame:
    """nodes plus p0, h1, p1, ... and ``logits``; h<L-1> is the embedding (x itself for one layer)."""
    table = nodes
    current = "x"
    for n, (w, b) in enumerate(layers):
        table = table.join(spread(table, adjacency, current, w.shape[1], f"p{n}"), KEYS)
        last = n == len(layers) - 1
        current = "logits" if last else f"h{n + 1}"
        table = materialise(table.withColumn(current, _affine(w, b, not last)(F.col(f"p{n}"))))
    return table


def drawn(salt: int, seed: int, *columns: str):
    """A whole number of 32 bits from the columns; the same on every retry and in SQL."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)), F.lit(str(salt)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def negative_edges(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """(client_id, src, dst): one random non-adjacent pair per edge. Needs node ids 0..n-1.

    Rank and skip: a hash of the edge draws a node among those that are not linked to all others, and a number below
    the count of its non-neighbours; the node of that rank follows from the sorted neighbour list without trying. So
    every edge has its pair, unless its client is a complete graph, and nothing is drawn twice."""
    sizes = nodes.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    linked = both_directions(edges.where("src <> dst").select("client_id", "src", "dst")).distinct()
    taken = nodes.select("client_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst")).unionByName(linked)
    lists = taken.groupBy("client_id", F.col("src").alias("a")).agg(F.sort_array(F.collect_list("dst")).alias("skip"))
    from ..session import client_hint

    hint = client_hint(sizes)
    lists = lists.join(hint(sizes), "client_id").withColumn("free", F.col("n") - F.size("skip")).where("free > 0")
    # places of the nodes that have a non-neighbour: ranges of ids are counted first, so no client is numbered in one task
    places = materialise(numbered(lists, ["client_id"], [F.col("a")], F.floor(F.col("a") / 4096), "place"))
    able = places.groupBy("client_id").agg(F.count(F.lit(1)).alias("able"))
    asked = edges.select("client_id", "src", "dst").join(hint(able), "client_id").select(
        "client_id", F.pmod(drawn(1, seed, "client_id", "src", "dst"), F.col("able")).alias("place"), drawn(2, seed, "client_id", "src", "dst").alias("draw"))
    held = asked.join(places.select("client_id", "place", "a", "skip", "free"), ["client_id", "place"])
    ranked = F.aggregate("skip", F.pmod("draw", F.col("free")), lambda v, x: F.when(x <= v, v + 1).otherwise(v))
    return held.select("client_id", F.col("a").alias("src"), ranked.alias("dst"))


def link_terms(table: DataFrame, edges: DataFrame, negatives: DataFrame, embedding: str) -> DataFrame:
    """(client_id, src, dst, label, logit, slope, loss) of the balanced link loss; slope = sigmoid - label."""
    pairs = edges.select("client_id", "src", "dst", F.lit(1.0).alias("label")).unionByName(
        negatives.select("client_id", "src", "dst", F.lit(0.0).alias("label")))
    left = table.select("client_id", F.col("node_id").alias("src"), F.col(embedding).alias("u"))
    right = table.select("client_id", F.col("node_id").alias("dst"), F.col(embedding).alias("v"))
    z = F.col("logit")
    return (
        pairs.join(left, ["client_id", "src"]).join(right, ["client_id", "dst"])
        .select("client_id", "src", "dst", "label", dot(F.col("u"), F.col("v")).alias("logit"))
        .withColumn("slope", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col("label"))
        .withColumn("loss", F.greatest(z, F.lit(0.0)) - z * F.col("label") + F.log1p(F.exp(-F.abs(z))))
    )


def type_loss(table: DataFrame) -> DataFrame:
    """(client_id, n, type_loss, type_accuracy) of the node-type classifier."""
    z = F.col("logits")
    top = F.array_max(z)
    lse = top + F.log(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    hit = (F.array_position(z, top) - 1 == F.col("node_type")).cast("double")
    return table.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(lse - F.get(z, F.col("node_type").cast("int"))).alias("type_loss"), F.avg(hit).alias("type_accuracy"))


def _gradient_rows(table: DataFrame, layer: int, slope: str, inputs: str) -> DataFrame:
    """Per-partition sums of slope x input and slope as (param, idx, value) rows."""
    def partial(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = b = None
        for part in rows:
            if part.empty:
                continue
            d = np.stack([np.asarray(v) for v in part[slope]])
            p = np.stack([np.asarray(v) for v in part[inputs]])
            gw, gb = d.T @ p, d.sum(axis=0)
            w, b = (gw, gb) if w is None else (w + gw, b + gb)
        if w is not None:
            for name, values in ((f"layers.{layer}.weight", w.reshape(-1)), (f"layers.{layer}.bias", b)):
                yield pd.DataFrame({"param": name, "idx": np.arange(len(values)), "value": values})

    return table.select(slope, inputs).mapInPandas(partial, "param string, idx bigint, value double")


def anchor_gradients(nodes: DataFrame, edges: DataFrame, layers: Layers, *, type_weight: float = 1.0,
                     link_weight: float = 0.5, seed: int = 0, negatives: DataFrame | None = None) -> DataFrame:
    """(param, idx, value): gradient of the node-count weighted mean of the clients' surrogate losses.

    nodes: client_id, node_id (0..n-1 per client), node_type, x. edges: client_id, src, dst, weight,
    both directions. All clients are processed in one pass; a client's share n_c / sum(n) is folded
    into the slopes, so the final gradient is a plain sum.
    """
    adjacency = materialise(normalised_adjacency(nodes, edges))
    table = forward(nodes, adjacency, layers)
    total = table.count()
    embedding = f"h{len(layers) - 1}" if len(layers) > 1 else "x"
    last = len(layers) - 1
    z = F.col("logits")
    top = F.array_max(z)
    norm = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    scale = F.lit(type_weight / max(total, 1))
    slopes = F.transform(z, lambda v, i: scale * (F.exp(v - top) / norm - (i == F.col("node_type").cast("int")).cast("double")))
    table = table.withColumn(f"d{last}", slopes)
    grads = [_gradient_rows(table, last, f"d{last}", f"p{last}")]
    for n in range(last, 0, -1):
        w = layers[n][0]
        hidden = w.shape[1]
        table = table.withColumn("back", _affine(w.T, None, False)(F.col(f"d{n}")))
        incoming = spread(table, adjacency, "back", hidden, "g")
        if n == last and link_weight:
            negatives = negative_edges(nodes, edges, seed) if negatives is None else negatives
            terms = materialise(link_terms(table, edges, negatives, embedding))
            counts = terms.groupBy("client_id").agg(F.count(F.lit(1)).alias("m"))
            sizes = table.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
            from ..session import client_hint

            share = counts.join(sizes, "client_id").select("client_id", (F.lit(link_weight / max(total, 1)) * F.col("n") / F.col("m")).alias("share"))
            pulls = both_directions(terms.select("client_id", "src", "dst", "slope")).join(client_hint(share)(share), "client_id").select(
                "client_id", "src", "dst", (F.col("slope") * F.col("share")).alias("a"))
            link = spread(table, pulls, embedding, hidden, "g")
            incoming = sum_vectors(union_all([incoming.select(*KEYS, "g"), link.select(*KEYS, "g")]), KEYS, "g", hidden, name="g")
        table = table.drop("back").join(incoming, KEYS, "left")
        flow = F.zip_with(F.col("g"), F.col(f"h{n}"), lambda g, h: F.when(h > 0, g).otherwise(F.lit(0.0)))
        table = materialise(table.withColumn(f"d{n - 1}", flow).drop("g"))
        grads.append(_gradient_rows(table, n - 1, f"d{n - 1}", f"p{n - 1}"))
    return union_all(grads).groupBy("param", "idx").agg(F.sum("value").alias("value"))


def surrogate_loss(nodes: DataFrame, edges: DataFrame, layers: Layers, *, type_weight: float = 1.0,
                   link_weight: float = 0.5, seed: int = 0, negatives: DataFrame | None = None) -> DataFrame:
    """(client_id, n, loss, type_loss, link_loss, type_accuracy)."""
    table = forward(nodes, materialise(normalised_adjacency(nodes, edges)), layers)
    embedding = f"h{len(layers) - 1}" if len(layers) > 1 else "x"
    negatives = negative_edges(nodes, edges, seed) if negatives is None else negatives
    links = link_terms(table, edges, negatives, embedding).groupBy("client_id").agg(F.avg("loss").alias("link_loss"))
    return type_loss(table).join(links, "client_id", "left").fillna(0.0, ["link_loss"]).select(
        "client_id", "n", (F.lit(type_weight) * F.col("type_loss") + F.lit(link_weight) * F.col("link_loss")).alias("loss"),
        "type_loss", "link_loss", "type_accuracy")


def alignment_loss(anchor_rows: DataFrame, global_rows: DataFrame, vector: str = "h", cell_rows: int = 4096) -> DataFrame:
    """One row ``loss``: mean over anchor rows of |h - softmax(h G^T / sqrt(H)) G|^2, G the global rows.

    Both sides are dealt into cells of about ``cell_rows``. A pair of cells gives every anchor row the largest score, the
    sum of exponentials below it and their weighted sum of global rows; these are merged per anchor row by the larger
    maximum. So neither side has to fit a task, and no score is written."""
    counts = [max(1, -(-t.count() // cell_rows)) for t in (anchor_rows, global_rows)]
    x = F.col(vector).cast("array<double>").alias("h")
    anchors = materialise(anchor_rows.select(F.monotonically_increasing_id().alias("at"), x))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(F.pmod(F.xxhash64("at"), F.lit(counts[0])).cast("int").alias("one"), others(counts[1]).alias("two"), "at", "h")
    right = global_rows.select(others(counts[0]).alias("one"), F.pmod(F.xxhash64("node_id"), F.lit(counts[1])).cast("int").alias("two"), F.lit(None).cast("bigint").alias("at"), x)

    def partial(cell: pd.DataFrame) -> pd.DataFrame:
        own = cell["at"].notna().to_numpy()
        if own.all() or not own.any():
            return pd.DataFrame({"at": [], "top": [], "mass": [], "v": []})
        h, g = (np.stack([np.asarray(v) for v in cell["h"][side]]) for side in (own, ~own))
        z = h @ g.T / np.sqrt(g.shape[1])
        top = z.max(axis=1)
        a = np.exp(z - top[:, None])
        return pd.DataFrame({"at": cell["at"][own].astype("int64"), "top": top, "mass": a.sum(axis=1), "v": list(a @ g)})

    parts = left.unionByName(right).groupBy("one", "two").applyInPandas(partial, "at bigint, top double, mass double, v array<double>")
    most = parts.groupBy("at").agg(F.max("top").alias("most"))
    scaled = parts.join(most, "at").withColumn("scale", F.exp(F.col("top") - F.col("most")))
    width = F.size(F.first("v"))
    sums = scaled.groupBy("at").agg(F.sum(F.col("mass") * F.col("scale")).alias("mass"), F.collect_list("v").alias("_v"), F.collect_list("scale").alias("_s"), width.alias("w"))
    added = F.aggregate(F.arrays_zip("_v", "_s"), F.array_repeat(F.lit(0.0), F.col("w")), lambda a, p: F.zip_with(a, p["_v"], lambda x, y: x + y * p["_s"]))
    gap = F.zip_with(F.col("h"), F.zip_with(F.col("sum"), F.array_repeat(F.col("mass"), F.size("sum")), lambda v, m: v / m), lambda x, y: x - y)
    rows = sums.select("at", "mass", added.alias("sum")).join(anchors, "at")
    return rows.agg(F.coalesce(F.avg(F.aggregate(gap, F.lit(0.0), lambda a, d: a + d * d)), F.lit(0.0)).alias("loss"))


def degree_penalty(nodes: DataFrame, edges: DataFrame, target: float) -> DataFrame:
    """One row ``loss``: mean squared difference of weighted node degrees to ``target``."""
    degree = edges.groupBy("client_id", F.col("src").alias("node_id")).agg(F.sum("weight").alias("degree"))
    gap = F.coalesce("degree", F.lit(0.0)) - F.lit(float(target))
    return nodes.select(*KEYS).join(degree, KEYS, "left").agg(F.avg(gap * gap).alias("loss"))


def diversity_penalty(rows: DataFrame, vector: str = "x", group: str = "client_id", cell_rows: int = 4096) -> DataFrame:
    """(group, loss): mean absolute cosine between different rows of a group.

    The rows of a group are dealt into cells of about ``cell_rows``; each pair of cells is multiplied once
    and gives one partial sum."""
    from ..functions.vectors import l2_normalise

    unit = materialise(rows.select(F.col(group).alias("grp"), F.monotonically_increasing_id().alias("at"), l2_normalise(F.col(vector)).alias("v")))
    sizes = unit.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("cells", F.ceil(F.col("n") / cell_rows))
    cell, other = F.pmod(F.xxhash64("at"), F.col("cells")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1))
    dealt = unit.join(sizes, "grp").withColumn("cell", cell).select("grp", "v", "cell", other.alias("other"))
    dealt = dealt.select("grp", "v", "cell", F.least("cell", "other").alias("one"), F.greatest("cell", "other").alias("two"))

    def partial(part: pd.DataFrame) -> pd.DataFrame:
        x, first = np.stack([np.asarray(v) for v in part["v"]]), (part["cell"] == part["one"]).to_numpy()
        if part["one"].iloc[0] == part["two"].iloc[0]:
            total = np.abs(x @ x.T).sum() - (x * x).sum()
        else:
            total = 2.0 * np.abs(x[first] @ x[~first].T).sum()
        return pd.DataFrame({"grp": part["grp"].iloc[:1], "s": [float(total)]})

    key = rows.schema[group].dataType.simpleString()
    sums = dealt.groupBy("grp", "one", "two").applyInPandas(partial, f"grp {key}, s double").groupBy("grp").agg(F.sum("s").alias("s"))
    return sizes.join(sums, "grp").select(F.col("grp").alias(group), F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("s") / (F.col("n") * (F.col("n") - 1))).alias("loss"))
