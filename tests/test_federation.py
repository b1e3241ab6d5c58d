import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import federate as fed
from loomgraph.operators import gnn
from loomgraph.operators import surrogate as su
from loomgraph.plans.rounds import Rounds, summary
from loomgraph.plans.server import EdgeEstimator, Server, ServerConfig, estimated_pairs


def anchor_case(spark, seed=0, sizes=(5, 7), dim=4):
    rng = np.random.default_rng(seed)
    nodes, edges, dense = [], [], {}
    for c, n in enumerate(sizes):
        x, types = rng.standard_normal((n, dim)), rng.integers(0, 3, n)
        w = np.zeros((n, n))
        for _ in range(2 * n):
            a, b = rng.integers(0, n, 2)
            if a != b:
                w[a, b] = w[b, a] = rng.random() + 0.1
        nodes += [(c, i, int(types[i]), x[i].tolist()) for i in range(n)]
        edges += [(c, int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w))]
        dense[c] = (x, types, w)
    return (spark.createDataFrame(nodes, "client_id int, node_id bigint, node_type int, x array<double>"),
            spark.createDataFrame(edges, "client_id int, src bigint, dst bigint, weight double"), dense)


def normalised(w):
    a = w + np.eye(len(w))
    d = a.sum(axis=1) ** -0.5
    return d[:, None] * a * d[None, :]


def dense_loss(layers, dense, negatives, link_weight=0.5):
    total, loss = sum(len(x) for x, _, _ in dense.values()), 0.0
    for c, (x, types, w) in dense.items():
        a, h, emb = normalised(w), x, x
        for n, (k, b) in enumerate(layers):
            h = (a @ h) @ k.T + b
            if n < len(layers) - 1:
                h = emb = np.maximum(h, 0)
        z = h - h.max(axis=1, keepdims=True)
        ce = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(x)), types]))
        pairs = [(s, d, 1.0) for s, d in zip(*np.nonzero(w))] + [(s, d, 0.0) for g, s, d in negatives if g == c]
        logits = np.array([emb[s] @ emb[d] for s, d, _ in pairs])
        labels = np.array([t for _, _, t in pairs])
        bce = float(np.mean(np.maximum(logits, 0) - logits * labels + np.log1p(np.exp(-np.abs(logits)))))
        loss += len(x) / total * (ce + link_weight * bce)
    return loss


def test_gradients_match_finite_differences(spark):
    nodes, edges, dense = anchor_case(spark)
    layers = su.init_layers(4, 3, 3, 2, seed=4)
    negatives = su.negative_edges(nodes, edges, 1).cache()
    rows = [(r.client_id, r.src, r.dst) for r in negatives.collect()]
    assert all(s != d and dense[c][2][s, d] == 0 for c, s, d in rows)
    got = {(r.param, r.idx): r.value for r in su.anchor_gradients(nodes, edges, layers, negatives=negatives).collect()}
    for n, (w, b) in enumerate(layers):
        for name, values in (("weight", w), ("bias", b)):
            flat = values.reshape(-1)
            for i in range(len(flat)):
                keep, eps = flat[i], 1e-6
                flat[i] = keep + eps
                up = dense_loss(layers, dense, rows)
                flat[i] = keep - eps
                down = dense_loss(layers, dense, rows)
                flat[i] = keep
                assert got[f"layers.{n}.{name}", i] == pytest.approx((up - down) / (2 * eps), abs=1e-7)
    losses = su.surrogate_loss(nodes, edges, layers, negatives=negatives).collect()
    total = sum(r.n for r in losses)
    assert sum(r.n / total * r.loss for r in losses) == pytest.approx(dense_loss(layers, dense, rows))


@pytest.mark.parametrize("heads", [1, 4])
def test_graph_encoders_match_dense(spark, heads):
    nodes, edges, dense = anchor_case(spark, seed=3)
    rng = np.random.default_rng(0)
    m = lambda a, b: rng.standard_normal((a, b))
    for kind in ("gat", "gt"):
        bias = rng.standard_normal(3 if kind == "gat" else 3 * heads)
        layer = gnn.Layer(m(3 * heads, 4), bias, rng.standard_normal(3 * heads), rng.standard_normal(3 * heads), m(3 * heads, 4), m(3 * heads, 4), m(3 * heads, 4), heads)
        got = {(r.client_id, r.node_id): r.x for r in gnn.encode(nodes, edges, [layer], kind).collect()}
        for c, (x, _, w) in dense.items():
            for i in range(len(x)):
                near, parts = np.flatnonzero(w[:, i]), []
                near = np.union1d(near, [i]) if kind == "gat" else near
                for t in range(heads):
                    own = slice(3 * t, 3 * t + 3)
                    if kind == "gat":
                        h = x @ layer.weight[own].T
                        e = h[near] @ layer.attend_src[own] + h[i] @ layer.attend_dst[own]
                        e, v = np.where(e >= 0, e, 0.2 * e), h[near]
                    else:
                        e = (x[near] @ layer.key[own].T) @ (layer.query[own] @ x[i]) / np.sqrt(3)
                        v = x[near] @ layer.weight[own].T + layer.bias[own]
                    a = np.exp(e - e.max()) if len(e) else e
                    parts.append((a / a.sum()) @ v if len(e) else np.zeros(3))
                want = np.mean(parts, axis=0) + layer.bias if kind == "gat" else np.concatenate(parts) + layer.skip @ x[i]
                assert got[c, i] == pytest.approx(want.tolist())


def test_negatives_are_never_linked_and_never_lost(spark):
    """A star and a clique with one pair missing: the few free pairs are found, and a complete client has none."""
    star = [(0, 0, i) for i in range(1, 30)]
    clique = [(1, a, b) for a in range(8) for b in range(a) if (a, b) != (5, 2)]
    full = [(2, a, b) for a in range(4) for b in range(a)]
    edges = spark.createDataFrame(star + clique + full, "client_id int, src bigint, dst bigint")
    nodes = spark.createDataFrame([(c, i) for c, n in ((0, 30), (1, 8), (2, 4), (3, 2)) for i in range(n)], "client_id int, node_id bigint")
    rows = [tuple(r) for r in su.negative_edges(nodes, edges, 3).collect()]
    assert len(rows) == len(star) + len(clique)
    assert {r[1:] for r in rows if r[0] == 1} <= {(5, 2), (2, 5)}
    assert all(a != b and 0 not in (a, b) and max(a, b) < 30 for c, a, b in rows if c == 0) and len({r for r in rows if r[0] == 0}) > 20


@pytest.mark.parametrize("cell_rows", [4096, 6])
def test_alignment_in_cells(spark, cell_rows):
    rng = np.random.default_rng(9)
    h, g = rng.standard_normal((20, 5)) * 30, rng.standard_normal((17, 5)) * 30  # exponents far beyond a double
    hd = spark.createDataFrame([(v.tolist(),) for v in h], "h array<double>")
    gd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g)], "node_id bigint, h array<double>")
    z = h @ g.T / np.sqrt(5)
    a = np.exp(z - z.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    assert su.alignment_loss(hd, gd, cell_rows=cell_rows).head().loss == pytest.approx(((a @ g - h) ** 2).sum() / 20)
    assert su.alignment_loss(hd.limit(0), gd).head().loss == 0.0


def test_federated_average_divides_by_all_uploading_clients(spark):
    w = spark.createDataFrame([(0, "projector", "w", 0, 1.0), (1, "projector", "w", 0, 4.0), (2, "projector", "w", 0, 100.0), (0, "graph_encoder", "w", 0, 3.0), (0, "other", "w", 0, 3.0)],
                              "client_id int, module string, param string, idx bigint, value double")
    c = spark.createDataFrame([(0, 1, True), (1, 2, True), (2, 5, False), (3, 9, True), (1, 0, True)][:4], "client_id int, num_samples bigint, sampled boolean")
    got = {(r.module, r.idx): r.value for r in fed.federated_average(w, c).collect()}
    assert got == {("projector", 0): pytest.approx(3.0), ("graph_encoder", 0): pytest.approx(1.0)}


def test_apportion_and_sampling():
    assert fed.apportion([0, 0, 0], 9) == [3, 3, 3]
    assert sum(fed.apportion([5, 3, 1], 128)) == 128 and fed.apportion([1, 1, 2], 4) == [1, 1, 2]
    assert len(fed.sample_clients(5, 0.1, 0, 3)) == 1 and fed.sample_clients(5, 1.0, 0, 0) == [0, 1, 2, 3, 4]


def test_learning_rate(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (10.0,)], "e double").select(fed.learning_rate(F.col("e"), 1e-2, 1.0, 10.0).alias("r"))
    assert [r.r for r in df.collect()] == pytest.approx([0.0, 5e-3, 1e-2, 5e-6])


def test_prompt_modes(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "e array<double>, c array<double>")
    want = {"both": ([1, 2], [3, 4]), "evidence_only": ([1, 2], [0, 0]), "condensed_only": ([0, 0], [3, 4]), "text_only": ([0, 0], [0, 0]), "shared": ([1, 2], [3, 4])}
    for mode, (e, c) in want.items():
        assert tuple(df.select(*fed.masked_prompt(F.col("e"), F.col("c"), mode)).head()) == (e, c)
    e, c = df.select(*fed.masked_prompt(F.col("e"), F.col("c"), "random_condensed")).head()
    assert e == [1, 2] and len(c) == 2 and c != [3, 4] and all(np.isfinite(c))
    with pytest.raises(ValueError):
        fed.masked_prompt(F.col("e"), F.col("c"), "other")


def test_alignment_and_penalties(spark):
    rng = np.random.default_rng(1)
    h, g = rng.standard_normal((20, 4)), rng.standard_normal((5, 4))
    hd = spark.createDataFrame([(v.tolist(),) for v in h], "h array<double>")
    gd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g)], "node_id int, h array<double>")
    z = h @ g.T / 2
    a = np.exp(z - z.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    assert su.alignment_loss(hd, gd).head().loss == pytest.approx(((a @ g - h) ** 2).sum() / 20)
    u = g / np.linalg.norm(g, axis=1, keepdims=True)
    gram = np.abs(u @ u.T)
    got = su.diversity_penalty(gd.select(F.lit(0).alias("client_id"), F.col("h").alias("x"))).head().loss
    assert got == pytest.approx((gram.sum() - np.trace(gram)) / 20)


def test_pairs_of_cells(spark):
    """Cells give the sums and scores of the whole matrix at any number of rows."""
    rng = np.random.default_rng(4)
    x, types = rng.standard_normal((45, 4)), rng.integers(0, 3, 45)
    x[30:] = x[30]
    nodes = spark.createDataFrame([(0, i, int(t), v.tolist()) for i, (t, v) in enumerate(zip(types, x))], "client_id int, node_id bigint, node_type int, x array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    gram = np.abs(u @ u.T)
    assert su.diversity_penalty(nodes, cell_rows=7).head().loss == pytest.approx((gram.sum() - np.trace(gram)) / (45 * 44))
    est = EdgeEstimator.create(4, ServerConfig(edge_hidden=8, type_dim=3))
    got = {(r.i, r.j): r.weight for r in estimated_pairs(nodes, est, cell_rows=7).collect()}
    t, allowed = [types[i:i + 1] for i in range(45)], [(i, j) for i in range(45) for j in range(i + 1, 45) if (types[i] == 0) != (types[j] == 0)]
    want = {(i, j): (est.score(x[i:i + 1], t[i], x[j:j + 1], t[j])[0] + est.score(x[j:j + 1], t[j], x[i:i + 1], t[i])[0]) / 2 for i, j in allowed}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_round_loop(spark, tmp_path):
    nodes, _, _ = anchor_case(spark, sizes=(20, 30))
    anchors = nodes.withColumnRenamed("node_id", "core_id")
    server = Server(ServerConfig(global_nodes=12, edge_hidden=8, edge_topk=2, type_dim=3))
    with pytest.raises(RuntimeError):
        server.export()

    def learner(n, chosen, weights, global_nodes, global_edges):
        rows = [(c, "projector", "w", 0, float(c + n)) for c in chosen]
        return (spark.createDataFrame(rows, "client_id int, module string, param string, idx bigint, value double"),
                spark.createDataFrame([(c, 10 * (c + 1), 0.5) for c in chosen], "client_id int, num_samples bigint, loss double"))

    def evaluate(n):
        return spark.createDataFrame([("val", "paris", "paris"), ("val", "x", "y"), ("test", "a b", "b")], "split string, pred string, label string")

    rounds = Rounds(spark, server, 2, metrics_path=str(tmp_path / "metrics"))
    history = rounds.run(anchors, 4, 2, learner, evaluate)
    assert history[0]["avg_loss"] is None and history[1]["avg_loss"] == 0.5 and history[1]["val_hit"] == 50.0
    assert server.weights.head().value == pytest.approx((1 * 10 + 2 * 20) / 30)
    assert spark.read.text(str(tmp_path / "metrics")).count() == 2 and "50.0%" in summary(history)
    types = {r.node_id: r.node_type for r in server.nodes.collect()}
    edges = {(r.src, r.dst) for r in server.export()[1].collect()}
    assert len(types) == 12 and set(types.values()) == {0, 1, 2}
    assert edges and all((d, s) in edges and (types[s] == 0) != (types[d] == 0) for s, d in edges)
    assert max(np.bincount([s for s, _ in edges])) <= 2
