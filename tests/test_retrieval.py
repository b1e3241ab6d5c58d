import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import blockrank as br
from loomgraph.operators import evidence as ev
from loomgraph.operators import passages as ps
from loomgraph.operators import propagate as pr
from loomgraph.operators.encode import hash_encoder
from loomgraph.plans.retrieval import RetrievalConfig, Retriever, merge_clients


def spread_case(spark, seed=0, entities=14, sentences=30, questions=5):
    rng = np.random.default_rng(seed)
    links = {(f"e{int(rng.integers(entities)):02d}", f"s{s:02d}") for s in range(sentences) for _ in range(3)}
    links |= {("e00", f"s{s:02d}") for s in range(0, sentences, 2)}
    sim = {(q, f"s{s:02d}"): float(np.round(rng.uniform(0.55, 1.0), 9)) for q in range(questions) for s in range(sentences)}
    seeds = [(0, q, f"m{n}", f"e{int(rng.integers(entities)):02d}", float(np.round(rng.uniform(0.4, 1.0), 9))) for q in range(questions) for n in range(3)]
    # sentence s has the unit vector of its own axis, so a question vector lists its similarities
    sv = spark.createDataFrame([(0, f"s{s:02d}", np.eye(sentences)[s].tolist()) for s in range(sentences)], "client_id int, hash_id string, x array<double>")
    qv = spark.createDataFrame([(q, [sim[q, f"s{s:02d}"] for s in range(sentences)]) for q in range(questions)], "qid int, x array<double>")
    ld = spark.createDataFrame([(0, e, s) for e, s in sorted(links)], "client_id int, entity_id string, sentence_id string")
    sd = spark.createDataFrame(seeds, "client_id int, qid int, mention string, entity_id string, score double")
    return links, sim, seeds, ld, sd, qv, sv


def direct_ordered(links, sim, seeds, q, k, tau=0.5, rounds=3):
    of_entity, of_sentence = {}, {}
    for e, s in links:
        of_entity.setdefault(e, []).append(s)
        of_sentence.setdefault(s, []).append(e)
    weights, active = {}, {}
    for _, _, m, e, score in sorted((r for r in seeds if r[1] == q), key=lambda r: r[2]):
        active[e] = (score, 1)
        weights[e] = score
    used, current = set(), {e: v[0] for e, v in active.items()}
    for step in range(1, rounds):
        new = {}
        for e, score in current.items():
            if score < tau:
                continue
            free = sorted((s for s in of_entity.get(e, []) if s not in used), key=lambda s: (-sim[q, s], s))[:k]
            for s in free:
                used.add(s)
                for other in sorted(of_sentence[s]):
                    nxt = score * sim[q, s]
                    if nxt >= tau:
                        weights[other] = weights.get(other, 0) + nxt
                        new[other] = nxt
        active.update({e: (v, step + 1) for e, v in new.items()})
        current = new
    return weights, active


def direct_parallel(links, sim, seeds, q, k, tau=0.5, rounds=3):
    total, score = {}, {}
    for _, _, m, e, s in sorted((r for r in seeds if r[1] == q), key=lambda r: r[2]):
        total[e] = total.get(e, 0) + s
        score[e] = s
    weights, active, used, current = dict(score), {e: (s, 0) for e, s in score.items()}, set(), total
    for step in range(1, rounds):
        act = {e: v for e, v in current.items() if v >= tau}
        picked = set()
        for e in act:
            picked |= set(sorted((s for x, s in links if x == e and s not in used), key=lambda s: (-sim[q, s], s))[:k])
        nxt = {}
        for s in picked:
            carried = sum(act[e] for e, x in links if x == s and e in act) * sim[q, s]
            for e, x in links:
                if x == s:
                    nxt[e] = nxt.get(e, 0) + carried
        used |= picked
        for e, v in nxt.items():
            weights[e] = weights.get(e, 0) + v
            if v >= tau:
                active[e] = (v, step)
        current = nxt
    return weights, active


@pytest.mark.parametrize("mode,direct", [(pr.spread_ordered, direct_ordered), (pr.spread_parallel, direct_parallel)])
@pytest.mark.parametrize("seed,k", [(0, 1), (1, 2)])
def test_spreading_matches_direct_loop(spark, mode, direct, seed, k):
    links, sim, seeds, ld, sd, qv, sv = spread_case(spark, seed)
    weights, active = mode(sd, ld, qv, sv, top_sentences=k)
    got_w, got_a = {}, {}
    for r in weights.collect():
        got_w.setdefault(r.qid, {})[r.entity_id] = r.weight
    for r in active.collect():
        got_a.setdefault(r.qid, {})[r.entity_id] = (r.score, r.tier)
    for q in range(5):
        w, a = direct(links, sim, seeds, q, k)
        assert got_w[q] == pytest.approx(w)
        assert {e: t for e, (_, t) in got_a[q].items()} == {e: t for e, (_, t) in a.items()}
        assert {e: s for e, (s, _) in got_a[q].items()} == pytest.approx({e: s for e, (s, _) in a.items()})


@pytest.mark.parametrize("needle_bytes", [1 << 20, 70])
def test_occurrences_match_count(spark, needle_bytes):
    texts = ["ana anana banana", "no match", "paris, paris and comparison", "aaaa"]
    words = ["ana", "paris", "a", "aa", "anana", "x"]
    p = spark.createDataFrame([(0, f"p{i}", t) for i, t in enumerate(texts)], "client_id int, passage_id string, text string")
    n = spark.createDataFrame([(0, w) for w in words] + [(1, "ana")], "client_id int, needle string")
    got = {(r.passage_id, r.needle): r.n for r in ps.entity_occurrences(p, n, needle_bytes).collect()}
    assert got == {(f"p{i}", w): t.count(w) for i, t in enumerate(texts) for w in words if w in t}


def block_case(spark, block_nodes, directed=False, questions=70):
    """A graph of 9 passages and 14 entities with a part of its own, its blocks, and a batch of questions."""
    rng = np.random.default_rng(4)
    names = [f"passage-{i}" for i in range(9)] + [f"entity-{i:02d}" for i in range(14)]
    w = np.zeros((23, 23))
    for _ in range(45):
        a, b = rng.integers(0, 8), rng.integers(9, 20)
        w[a, b] = w[b, a] = rng.random() + 0.1
    for a in range(5):
        w[a, a + 1] = w[a + 1, a] = 1.0
    if directed:
        w = np.where(rng.random(w.shape) < 0.4, 0.0, w)
    x, q = rng.standard_normal((9, 4)), rng.standard_normal((questions, 4))
    edges = spark.createDataFrame([(0, names[a], names[b], float(w[a, b])) for a in range(23) for b in range(23) if w[a, b]], "client_id int, src string, dst string, weight double")
    vectors = spark.createDataFrame([(0, names[i], x[i].tolist(), "when and where" if i % 2 else "where") for i in range(9)], "client_id int, node string, x array<double>, text string")
    nodes = spark.createDataFrame([(0, n) for n in names], "client_id int, node string")
    blocks = br.rank_blocks(nodes, ps.transition(edges), vectors, block_nodes)
    batch = ps.question_batch(spark.createDataFrame([(i, "when?", v.tolist()) for i, v in enumerate(q)], "qid int, question string, x array<double>"))
    deg = w.sum(axis=1, keepdims=True)
    return names, np.divide(w, deg, out=np.zeros_like(w), where=deg > 0), x, q, blocks, batch


@pytest.mark.parametrize("block_nodes, directed", [(1000, False), (6, False), (6, True)])
def test_block_ranks_match_dense_solve(spark, block_nodes, directed):
    rng = np.random.default_rng(1)
    names, p, x, q, blocks, batch = block_case(spark, block_nodes, directed)
    bonus = [(0, int(rng.integers(70)), names[int(rng.integers(9))], float(rng.uniform(-3, 5))) for _ in range(60)]
    weights = [(0, int(rng.integers(70)), names[int(rng.integers(9, 23))], float(v)) for v in [*rng.uniform(-1, 1, 80), np.nan]]
    reset = np.zeros((23, 70))
    for i in range(70):
        s = np.round(x @ q[i], 9)
        extra = np.zeros(9)
        for _, qid, node, v in bonus:
            extra[names.index(node)] += v if qid == i else 0.0
        with np.errstate(invalid="ignore"):
            total = 0.05 * (1.5 * (s - s.min()) / (s.max() - s.min()) + np.log(1 + extra))
        reset[:9, i] = np.where(np.isfinite(total) & (total > 0), total, 0.0)
    for _, qid, node, v in weights:
        reset[names.index(node), qid] += v
    entity = np.where(np.isfinite(reset[9:]) & (reset[9:] > 0), reset[9:], 0.0)
    reset[9:] = entity
    y = np.linalg.solve(np.eye(23) - 0.5 * p.T, reset)
    chunks = br.score_chunks(blocks.passages, batch)
    got = br.ranked_blocks(blocks, batch, chunks, spark.createDataFrame(bonus, "client_id int, qid int, node string, bonus double"),
                           spark.createDataFrame(weights, "client_id int, qid int, entity_id string, weight double"), 4)
    rows = {(r.qid, r["rank"]): (r.passage_id, r.score) for r in got.collect()}
    assert len(rows) == 280
    for i in range(70):
        level = [(-round(math.log(y[k, i]), 9) if y[k, i] > 0 else 1e9, names[k], k) for k in range(9)]
        for n, (_, name, k) in enumerate(sorted(level)[:4]):
            assert rows[i, n + 1][0] == name and rows[i, n + 1][1] == pytest.approx(y[k, i] / y[:, i].sum(), abs=1e-13)


def test_whole_graph_is_solved_in_one_round_by_few_questions_at_a_time(spark, monkeypatch):
    """A graph beyond the block size is one block up to ``whole_nodes``; no start matrix is written and the columns are solved in parts."""
    names, p, x, q, cut, batch = block_case(spark, 6)
    nodes = spark.createDataFrame([(0, n) for n in names], "client_id int, node string")
    moves = spark.createDataFrame([(0, names[a], names[b], float(p[a, b])) for a in range(23) for b in range(23) if p[a, b]], "client_id int, src string, dst string, p double")
    vectors = spark.createDataFrame([(0, names[i], x[i].tolist(), "where") for i in range(9)], "client_id int, node string, x array<double>, text string")
    blocks = br.rank_blocks(nodes, moves, vectors, 6, whole_nodes=23)
    assert blocks.edges.where("block <> to").isEmpty() and not cut.edges.where("block <> to").isEmpty()
    monkeypatch.setattr(br, "CELLS", 23 * 5)
    written = []
    monkeypatch.setattr(br, "materialise", lambda df: written.append(df) or df)
    none = spark.createDataFrame([], "client_id int, qid int, node string, bonus double"), spark.createDataFrame([], "client_id int, qid int, entity_id string, weight double")
    got = {(r.qid, r["rank"]): (r.passage_id, r.score) for r in br.ranked_blocks(blocks, batch, br.score_chunks(blocks.passages, batch), *none, 4).collect()}
    assert len(written) == 1 and written[0].where(written[0].kind == br.RESET).isEmpty()
    for i in range(70):
        s = np.round(x @ q[i], 9)
        y = np.linalg.solve(np.eye(23) - 0.5 * p.T, np.concatenate([0.075 * (s - s.min()) / (s.max() - s.min()), np.zeros(14)]))
        order = sorted((-round(math.log(y[k]), 9) if y[k] > 0 else 1e9, names[k], k) for k in range(9))
        for n, (_, name, k) in enumerate(order[:4]):
            assert got[i, n + 1][0] == name and got[i, n + 1][1] == pytest.approx(y[k] / y.sum(), abs=1e-13)


def test_local_limit_of_a_directed_cycle():
    """Eigenvalues of a cycle are not real; plain steps take over and reach the limit."""
    n = 9
    edges = [(np.roll(np.arange(n), 1).astype(np.int32), np.arange(n, dtype=np.int32), np.ones(n))]
    start = np.random.default_rng(0).random((n, 3))
    p = np.roll(np.eye(n), 1, axis=1)
    assert br.local_limit(start, edges, 0.9) == pytest.approx(np.linalg.solve(np.eye(n) - 0.9 * p.T, start), abs=1e-12)


def test_dense_ranking_in_blocks(spark):
    """More questions than one block holds, passages in several blocks."""
    names, _, x, q, blocks, batch = block_case(spark, 6)
    got = {(r.qid, r["rank"]): (r.passage_id, r.score) for r in br.dense_best(blocks, batch, br.score_chunks(blocks.passages, batch), 2).collect()}
    assert len(got) == 140
    for i in range(70):
        s = sorted((-float(x[k] @ q[i]), names[k]) for k in range(9))[:2]
        assert [got[i, n + 1][0] for n in range(2)] == [k for _, k in s]
        assert got[i, 1][1] == pytest.approx(-s[0][0], abs=1e-8)


@pytest.fixture(scope="module")
def retriever(spark):
    names = ["Ada Lovelace", "Charles Babbage", "Mary Somerville", "George Boole"]
    texts = [(i % 2, f"{i}:{names[i % 4]} wrote to {names[(i + 1) % 4]} about engines. {names[(i + 2) % 4]} lived in Town{chr(65 + i)}.") for i in range(16)]
    r = Retriever(hash_encoder(32), 32, 2, RetrievalConfig(mode="parallel"))
    with pytest.raises(RuntimeError):
        r.graph
    r.index(spark.createDataFrame(texts, "client_id int, text string"))
    return r


def test_retrieve(spark, retriever, tmp_path):
    q = spark.createDataFrame([(1, "Where did Ada Lovelace live?"), (2, "who has no name here"), (3, "Is George Boole known?")], "qid int, question string")
    ranked, activated = retriever.retrieve(q)
    rows = ranked.collect()
    per = {}
    for r in rows:
        per.setdefault((r.client_id, r.qid), []).append((r["rank"], r.score))
    assert set(per) == {(c, i) for c in (0, 1) for i in (1, 2, 3)}
    assert all([x for x, _ in sorted(v)] == [1, 2, 3, 4, 5] and [s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in per.values())
    assert not activated.where("qid = 2").head(1)
    nodes, edges = retriever.evidence(ranked, activated)
    n = {(r.client_id, r.qid, r.local_id): r.node_type for r in nodes.collect()}
    e = {(r.client_id, r.qid, r.src, r.dst) for r in edges.collect()}
    assert e and all((c, i, d, s) in e and {n[c, i, s], n[c, i, d]} in ({0, 1}, {0, 2}) for c, i, s, d in e)
    assert sum(1 for k, t in n.items() if t == 2 and k[1] == 2) == 10
    again = retriever.retrieve_all(q, str(tmp_path / "ranked"), batch_questions=2)
    assert {(r.client_id, r.qid, r["rank"], r.passage_id) for r in again.collect()} == {(r.client_id, r.qid, r["rank"], r.passage_id) for r in rows}
    assert merge_clients(ranked, 3).count() == 9
    slots = retriever.anchor_map(ranked).collect()
    assert len(slots) == 30 and all(s.node_id >= 0 for s in slots)
    generator = lambda prompt: F.concat(F.lit("Thought: none. Answer: "), F.length(prompt).cast("string"))
    answers = retriever.answer(ranked, q, generator).collect()
    assert len(answers) == 6 and all(a.pred_answer.isdigit() for a in answers)


def test_modes_are_checked():
    with pytest.raises(ValueError):
        Retriever(hash_encoder(8), 8, 1, RetrievalConfig(mode="other"))


def test_global_subgraph(spark):
    """Hub 0 joined to all others: a hit on it keeps the whole star, the cap keeps the best."""
    rng = np.random.default_rng(42)
    x = rng.standard_normal((9, 8))
    nodes = spark.createDataFrame([(0, i, 0, v.tolist()) for i, v in enumerate(x)], "graph_id int, node_id bigint, node_type int, x array<double>")
    edges = spark.createDataFrame([(0, 0, i, 1.0) for i in range(1, 9)], "graph_id int, src bigint, dst bigint, weight double")
    queries = spark.createDataFrame([(0, 7, x[0].tolist())], "graph_id int, qid int, x array<double>")
    seeds, kept, sub = ev.global_subgraph(queries, nodes, edges, top_r=1)
    assert [r.node_id for r in seeds.collect()] == [0] and kept.count() == 9 and sub.count() == 8
    _, kept, sub = ev.global_subgraph(queries, nodes, edges, top_r=2, max_nodes=4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {r.node_id for r in kept.collect()} == set(np.argsort(-(u @ u[0]))[:4].tolist())
    assert all(0 <= r.src < 4 and 0 <= r.dst < 4 for r in sub.collect())
    seeds, kept, _ = ev.global_subgraph(queries, nodes, edges.limit(0), top_r=50)
    scores = [r.score for r in sorted(seeds.collect(), key=lambda r: r["rank"])]
    assert len(scores) == 9 and scores == sorted(scores, reverse=True) and kept.count() == 9


def test_anchored_evidence(spark, toy):
    nodes, edges = toy
    anchors = spark.createDataFrame([(0, 1, 5), (0, 1, -1), (0, 2, 6)], "client_id int, qid int, node_id bigint")
    kept = ev.anchored_nodes(anchors, edges)
    assert {(r.qid, r.node_id) for r in kept.collect()} == {(1, 5), (1, 0), (1, 1), (2, 6), (2, 2)}
    _, out = ev.evidence_graph(kept, nodes, edges)
    assert {(r.qid, r.src, r.dst) for r in out.collect()} == {(1, 0, 2), (1, 2, 0), (1, 1, 2), (1, 2, 1), (2, 0, 1), (2, 1, 0)}
    vectors = nodes.select("client_id", "node_id", F.array(F.col("node_id").cast("double")).alias("x"))
    assert {r.qid: r.x for r in ev.mean_query(kept, vectors, 1).collect()} == {1: [2.0], 2: [4.0]}


def test_spreading_encodes_reached_sentences_only(spark, monkeypatch):
    """Sentences no question reaches are not encoded, in either mode."""
    from loomgraph.operators.graph import SENTENCE
    from loomgraph.plans.index import GraphIndex

    whole, asked = GraphIndex.of_type, []

    def of_type(self, node_type):
        assert node_type != SENTENCE
        return whole(self, node_type)

    texts = [(0, "0:Ada Lovelace met Charles Babbage. Charles Babbage was in London."), (0, "1:Paris is far. Rome is near. Oslo is cold.")]
    monkeypatch.setattr(GraphIndex, "of_type", of_type)
    for mode in ("parallel", "ordered"):
        r = Retriever(hash_encoder(16), 16, 1, RetrievalConfig(mode=mode))
        index = r.index(spark.createDataFrame(texts, "client_id int, text string"))
        given = index.sentence_vectors
        index.sentence_vectors = lambda keys: asked.append(given(keys)) or asked[-1]
        q = spark.createDataFrame([(1, "Did Ada Lovelace visit?")], "qid int, question string")
        seeds = r.seeds(q)
        weights, _ = r.spread(seeds, q.select("qid", hash_encoder(16)(F.col("question")).alias("x")))
        assert weights.count() >= 1
    assert asked and all(v.count() <= 2 for v in asked)
