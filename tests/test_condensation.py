import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import anchors as an
from loomgraph.operators import condense as co
from loomgraph.operators import graph
from loomgraph.operators import topology as to
from loomgraph.plans.condensation import condense
from loomgraph.plans.index import GraphIndex


def random_graph(spark, seed=0, entities=30, others=40, dim=8):
    """Random two-sided graph with one entity touching almost everything."""
    rng = np.random.default_rng(seed)
    n = entities + others
    types = [0] * entities + [int(t) for t in rng.integers(1, 3, others)]
    pairs = {(int(rng.integers(entities)), int(rng.integers(entities, n))) for _ in range(90)} | {(0, o) for o in range(entities, n - 3)}
    nodes = spark.createDataFrame([(0, i, t, f"text {i}") for i, t in enumerate(types)], "client_id int, node_id bigint, node_type int, text string")
    edges = spark.createDataFrame([(0, a, b, 0) for a, b in pairs] + [(0, b, a, 0) for a, b in pairs], "client_id int, src bigint, dst bigint, edge_type int")
    x = rng.standard_normal((n, dim))
    vectors = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "client_id int, node_id bigint, x array<double>")
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return nodes, edges, vectors, x, types, near


def direct_pagerank(near, entities, iterations=20, d=0.85):
    out = {e: [x for h in near[e] for x in near[h] if x != e] for e in entities}
    n = len(entities)
    r = {e: 1 / n for e in entities}
    for _ in range(iterations):
        lost = sum(d * r[e] for e in entities if not out[e])
        nxt = {e: (1 - d) / n + lost / n for e in entities}
        for e in entities:
            for x in out[e]:
                nxt[x] += d * r[e] / len(out[e])
        r = nxt
    return r


def test_toy_scores(spark, toy):
    nodes, edges = toy
    nb = graph.undirected_neighbours(edges)
    pool = an.entity_pool(nodes, nb, 0)
    pr = an.projection_pagerank(pool, nb, nodes)
    plain = {r.node_id: r.score for r in an.entity_scores(pool, nodes, nb, None).collect()}
    full = {r.node_id: r.score for r in an.entity_scores(pool, nodes, nb, pr).collect()}
    # two passages: ln(1 + dS) + ln(1 + dP) + ln(2 / (1 + dP))
    want = {0: np.log(2) + np.log(2), 1: np.log(3) + np.log(2), 2: np.log(2) + np.log(2)}
    assert plain == pytest.approx(want, abs=1e-6)
    # 0 and 1 share a sentence and a passage, 1 and 2 a sentence
    share = np.array([[0, 2 / 3, 0], [1, 0, 1], [0, 1 / 3, 0]])
    rank = np.full(3, 1 / 3)
    for _ in range(20):
        rank = 0.15 / 3 + 0.85 * share @ rank
    assert full == pytest.approx({k: v + 0.5 * rank[k] for k, v in want.items()}, abs=1e-6)


@pytest.mark.parametrize("seed", [0, 1])
def test_pagerank_equals_explicit_projection(spark, seed):
    nodes, edges, _, _, types, near = random_graph(spark, seed)
    nb = graph.undirected_neighbours(edges)
    pool = an.entity_pool(nodes, nb, 0)
    got = {r.node_id: r.pagerank for r in an.projection_pagerank(pool, nb, nodes).collect()}
    want = direct_pagerank(near, [i for i, t in enumerate(types) if t == 0])
    assert got == pytest.approx(want, abs=1e-12) and sum(got.values()) == pytest.approx(1.0)


def test_pool_limit(spark):
    nodes, edges, _, _, types, near = random_graph(spark)
    nb = graph.undirected_neighbours(edges)
    ids = [r.node_id for r in an.entity_pool(nodes, nb, 10).collect()]
    assert len(ids) == len(set(ids)) == 10
    best = sorted((i for i, t in enumerate(types) if t == 0), key=lambda i: (-len(near[i]), i))[:5]
    assert set(best) <= set(ids)


@pytest.mark.parametrize("pool_rows", [1_024, 9, 2])
def test_diverse_selection_matches_direct_loop(spark, pool_rows):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 6))
    s = rng.standard_normal(60)
    scores = spark.createDataFrame([(int(i % 2), i, float(v)) for i, v in enumerate(s)], "client_id int, node_id bigint, score double")
    vectors = spark.createDataFrame([(int(i % 2), i, v.tolist()) for i, v in enumerate(x)], "client_id int, node_id bigint, x array<double>")
    cfg = an.AnchorConfig(entity_ratio=0.2)
    got = {(r.client_id, r.pick): r.node_id for r in an.diverse_entities(scores, vectors, cfg, pool_rows).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for c in (0, 1):
        ids = [i for i in range(60) if i % 2 == c]
        chosen, nearest = [], {i: 0.0 for i in ids}
        for _ in range(math.ceil(0.2 * len(ids))):
            best = min((i for i in ids if i not in chosen), key=lambda i: (-(s[i] - 0.3 * nearest[i]), i))
            chosen.append(best)
            nearest = {i: max(nearest[i], float(u[i] @ u[best])) for i in ids}
        assert [got[c, k] for k in range(len(chosen))] == chosen


def test_sparse_two_hop_is_exact_around_a_hub(spark):
    nodes, edges, _, _, _, near = random_graph(spark)
    nb = co.mark_sides(graph.undirected_neighbours(edges), nodes)
    core = nodes.select("client_id", "node_id")
    got = {}
    for r in co.sparse_two_hop(core, nb, 8).collect():
        got.setdefault(r.core, set()).add(r.node_id)
    for v in near:
        two = {w for m in near[v] for w in near[m]} - {v} - near[v]
        assert got.get(v, set()) == set(sorted(two, key=lambda w: (len(near[w]), w))[:8])
    plain = nb.select("client_id", "node_id", "neighbour")
    other = {(r.core, r.node_id) for r in co.sparse_two_hop(core, plain, 8).collect()}
    assert other == {(v, w) for v, ws in got.items() for w in ws}


def test_gating_and_chunks_match_direct(spark):
    nodes, edges, vectors, x, _, near = random_graph(spark, dim=6)
    rng = np.random.default_rng(5)
    chunks = {i: rng.standard_normal((int(rng.integers(1, 5)), 6)) for i in near}
    text = {i: c.mean(axis=0) for i, c in chunks.items()}
    cd = spark.createDataFrame([(0, i, n, row.tolist()) for i, c in chunks.items() for n, row in enumerate(c)], "client_id int, node_id bigint, chunk_id int, x array<double>")
    td = spark.createDataFrame([(0, i, t.tolist()) for i, t in text.items()], "client_id int, node_id bigint, x array<double>")
    core = nodes.where("node_id < 12").select("client_id", "node_id")
    nb = co.mark_sides(graph.undirected_neighbours(edges), nodes)
    selection = co.gate_neighbours(co.hop_candidates(core, nb), vectors, td).cache()
    tilde, trace = co.select_chunks(selection, cd, vectors, 6)
    ctx = {r.node_id: r.x for r in co.gated_context(selection, td, 6).collect()}
    tilde = {r.node_id: r.x for r in tilde.collect()}
    chosen = {}
    for r in selection.collect():
        chosen.setdefault((r.core, r.hop), {})[r.node_id] = r.weight

    def cos(a, b):
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    def softmax(v):
        e = np.exp(np.array(v) - max(v))
        return e / e.sum()

    for v in range(12):
        two = sorted(({w for m in near[v] for w in near[m]} - {v} - near[v]), key=lambda w: (len(near[w]), w))[:8]
        context, picked = np.zeros(6), []
        for hop, (cands, budget, gamma) in enumerate([([v], 1, 0.4), (sorted(near[v]), 3, 0.4), (two, 2, 0.2)]):
            best = sorted(cands, key=lambda w: (-round(cos(x[v], text[w]), 9), w))[:budget]
            if not best:
                assert (v, hop) not in chosen
                continue
            w = softmax([cos(x[v], text[b]) for b in best])
            assert chosen[v, hop] == pytest.approx(dict(zip(best, w)))
            context += gamma * sum(wi * text[b] for wi, b in zip(w, best))
            picked += best
        flat = sorted(((round(float(c @ x[v]) / math.sqrt(6), 9), -p, -n, c) for p in picked for n, c in enumerate(chunks[p])), key=lambda t: t[:3], reverse=True)[:8]
        w = softmax([f[0] for f in flat])
        assert ctx[v] == pytest.approx(context.tolist(), abs=1e-8)
        assert tilde[v] == pytest.approx(sum(wi * f[3] for wi, f in zip(w, flat)).tolist(), abs=1e-6)


def random_pairs(seed, n=25, groups=2):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for i in range(n):
            for j in range(i + 1, n):
                if rng.random() < 0.5:
                    rows.append((g, i, j, float(rng.integers(1, 9)) / 8))
    return rows


def direct_matching(rows, k):
    out, room = set(), {}
    for g, i, j, w in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if room.get((g, i), 0) < k and room.get((g, j), 0) < k:
            out.add((g, i, j))
            room[g, i] = room.get((g, i), 0) + 1
            room[g, j] = room.get((g, j), 0) + 1
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_degree_capped_matching(spark, k):
    rows = random_pairs(k)
    df = spark.createDataFrame(rows, "client_id int, i bigint, j bigint, weight double")
    got = {(r.client_id, r.i, r.j) for r in to.degree_capped(df, k).collect()}
    assert got == direct_matching(rows, k)


def condensed_nodes(spark, n=40, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    x, t = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    types = rng.integers(0, 3, n)
    nodes = spark.createDataFrame([(0, i, int(types[i]), x[i].tolist()) for i in range(n)], "client_id int, node_id bigint, node_type int, x array<double>")
    text = spark.createDataFrame([(0, i, t[i].tolist()) for i in range(n)], "client_id int, node_id bigint, x array<double>")
    return nodes, text, x, t, types


def dense_prior(t):
    u = t / np.linalg.norm(t, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, 0)
    return (s - s.min()) / (s.max() - s.min() + 1e-8)


@pytest.mark.parametrize("prior", [0.0, 0.4])
@pytest.mark.parametrize("typed", [True, False])
def test_knn_rows_match_dense(spark, prior, typed):
    nodes, text, x, t, types = condensed_nodes(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = (u @ u.T + 1) / 2 + (prior * dense_prior(t) if prior else 0)
    np.fill_diagonal(w, -1)
    if typed:
        w[(types[:, None] == 0) == (types[None, :] == 0)] = -1
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-w[i])[:4] if w[i, j] > 0}
    rows = to.knn_rows(nodes, 4, text, prior, typed).collect()
    assert {(r.i, r.j) for r in rows} == want
    assert all(r.weight == pytest.approx(w[r.i, r.j]) for r in rows)


def test_knn_topology_invariants(spark):
    nodes, _, _, _, types = condensed_nodes(spark)
    edges = {(r.src, r.dst): r.weight for r in to.knn_topology(nodes, 3).collect()}
    assert edges and all(edges[d, s] == w and s != d for (s, d), w in edges.items())
    for s, d in edges:
        assert (types[s] == 0) != (types[d] == 0)
    degree = np.bincount([s for s, _ in edges])
    assert degree.max() <= 3


def test_self_expression_matches_dense_iteration(spark):
    nodes, text, x, t, types = condensed_nodes(spark, n=24)
    got = {(r.i, r.j): r.z for r in to.self_expressive_rows(nodes, text, candidates=4, alpha=8.0, beta=0.4, step_size=0.02).collect()}
    prior = dense_prior(t)
    allowed = (types[:, None] == 0) != (types[None, :] == 0)
    support = np.zeros_like(prior, dtype=bool)
    for i in range(len(x)):
        for score in (x @ x[i], prior[i]):
            s = np.where(allowed[i], score, -np.inf)
            for j in np.argsort(-s)[:4]:
                support[i, j] |= bool(np.isfinite(s[j]))
    z = np.zeros_like(prior)
    for _ in range(50):
        z = z - 0.02 * ((z @ x - x) @ x.T) * support
        tau = 0.02 * (0.4 / 8 + (1 - prior) / 8)
        z = np.sign(z) * np.maximum(np.abs(z) - tau, 0) * support
    assert set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(support))}
    assert all(v == pytest.approx(z[k], abs=1e-9) for k, v in got.items())


def test_upload_guard(spark):
    with pytest.raises(ValueError):
        co.assert_numeric_only(spark.createDataFrame([(1, ["x"])], "a int, b array<string>"))
    with pytest.raises(ValueError):
        co.fuse(None, None, gate=2.0)


@pytest.mark.parametrize("method", ["knn", "self_expr"])
def test_condense_end_to_end(spark, method):
    texts = [(i % 2, f"{i}:Person{chr(65 + i % 7)} Alpha met Thing{chr(65 + i % 5)} in City{chr(65 + i % 3)}. Later Person{chr(65 + (i + 1) % 7)} Alpha left City{chr(65 + i % 3)}.") for i in range(24)]
    index = GraphIndex.build(spark.createDataFrame(texts, "client_id int, text string"), dim=16)
    cfg = co.CondenseConfig(anchors=an.AnchorConfig(entity_ratio=0.3), topology_method=method, knn_k=3, beta=0.1, step_size=0.05)
    out = condense(index, cfg)
    core = {(r.client_id, r.core_id): r for r in out.nodes.collect()}
    for c in (0, 1):
        ids = sorted(i for k, i in core if k == c)
        assert ids == list(range(len(ids))) and len(ids) > 0
    edges = {(r.client_id, r.src, r.dst) for r in out.edges.collect()}
    assert edges and all((c, d, s) in edges for c, s, d in edges)
    assert all((core[c, s].node_type == 0) != (core[c, d].node_type == 0) for c, s, d in edges)
    selected = {(r.client_id, r.anchor_id) for r in out.motifs.collect()}
    near = {(r.client_id, r.node_id, r.neighbour) for r in index.neighbours.collect()}
    for r in out.core.where("node_type > 0").collect():
        assert any((r.client_id, r.node_id, e) in near for c, e in selected if c == r.client_id)
    with pytest.raises(ValueError):
        condense(index, replace(cfg, topology_method="other"))


def shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_pagerank_steps_do_not_shuffle_the_incidence(spark):
    """Forty entities around five hundred sentences: a step hands on sums, not the 10,000 links."""
    links = [(0, 1000 + h, (h * 7 + n) % 40) for h in range(500) for n in range(20)]
    nodes = spark.createDataFrame([(0, n, 0) for n in range(40)] + [(0, 1000 + h, 1) for h in range(500)], "client_id int, node_id bigint, node_type int")
    near = graph.neighbours_of(spark.createDataFrame([(*x, 0) for x in links], "client_id int, other bigint, entity bigint, edge_type int"))
    pool = nodes.where("node_type = 0").select("client_id", "node_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cost = []
        for steps in (1, 4):
            at = shuffled_rows(spark)
            ranks = {r.node_id: r.pagerank for r in an.projection_pagerank(pool, near, nodes, steps).collect()}
            cost.append(shuffled_rows(spark) - at)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(ranks.values()) == pytest.approx(1.0)
    assert (cost[1] - cost[0]) / 3 < 10_000


def test_diverse_selection_needs_few_rounds(spark, monkeypatch):
    """Four thousand rows of nearly equal score: the default pool picks two hundred in a round or two, not one round per few picks."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 8))
    s = np.round(rng.uniform(0, 0.05, 4000), 9)
    scores = spark.createDataFrame([(0, i, float(s[i])) for i in range(4000)], "client_id int, node_id bigint, score double")
    vectors = spark.createDataFrame([(0, i, x[i].tolist()) for i in range(4000)], "client_id int, node_id bigint, x array<double>")
    made, real = [], an.materialise
    monkeypatch.setattr(an, "materialise", lambda df: made.append(1) or real(df))
    got = {r.pick: r.node_id for r in an.diverse_entities(scores, vectors).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    value, nearest, chosen = s.copy(), np.zeros(4000), []
    for _ in range(200):
        value = np.where(np.isin(np.arange(4000), chosen), -np.inf, np.round(s - 0.3 * nearest, 9))
        chosen.append(int(value.argmax()))
        nearest = np.maximum(nearest, u @ u[chosen[-1]])
    assert [got[k] for k in range(200)] == chosen
    assert len(made) <= 13


@pytest.mark.parametrize("whole_links", [an.WHOLE_LINKS, 0])
def test_pagerank_of_a_whole_client_needs_no_table_per_step(spark, monkeypatch, whole_links):
    """Two clients and one whose entities share nothing: both ways give the rank of the explicit projection."""
    nodes, edges, _, _, types, near = random_graph(spark, 2)
    lone = spark.createDataFrame([(7, 0, 0), (7, 1, 0), (7, 2, 1)], "client_id int, node_id bigint, node_type int")
    columns = ["client_id", "node_id", "node_type"]
    three = nodes.select(*columns).unionByName(nodes.select(*columns).withColumn("client_id", F.col("client_id") + 1)).unionByName(lone)
    nb = graph.undirected_neighbours(edges)
    nb = nb.unionByName(nb.withColumn("client_id", F.col("client_id") + 1))
    pool = an.entity_pool(three, nb, 0)
    made, real = [], an.materialise
    monkeypatch.setattr(an, "materialise", lambda df: made.append(1) or real(df))
    got = {(r.client_id, r.node_id): r.pagerank for r in an.projection_pagerank(pool, nb, three, whole_links=whole_links).collect()}
    first = nodes.head().client_id
    want = direct_pagerank(near, [i for i, t in enumerate(types) if t == 0])
    assert got == pytest.approx({(c, i): v for c in (first, first + 1) for i, v in want.items()} | {(7, 0): 0.5, (7, 1): 0.5}, abs=1e-12)
    assert whole_links == 0 or len(made) <= 3
