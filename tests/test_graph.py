import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.operators.ranking import next_in_order, numbered, topk_softmax
from loomgraph.operators.recognise import passage_mentions, distinct_passages, question_mentions
from loomgraph.plans.index import GraphIndex


@pytest.fixture(scope="module")
def index(spark):
    texts = [(0, "0:Ada Lovelace met Charles Babbage. Babbage built engines! nothing here."), (0, "1:Charles Babbage was in London. It rained 3 times on the 2nd day."),
             (0, "2:no names at all"), (1, "3:Ada Lovelace met Charles Babbage. Paris is far."), (1, "3:Ada Lovelace met Charles Babbage. Paris is far.")]
    return GraphIndex.build(spark.createDataFrame(texts, "client_id int, text string"), dim=16)


def test_mentions(index, spark):
    got = {(r.client_id, r.sentence, r.entity) for r in index.mentions.collect()}
    assert (0, "0:Ada Lovelace met Charles Babbage.", "Ada Lovelace") in got
    assert (0, "Babbage built engines!", "Babbage") in got
    assert not any(e in ("3", "2nd", "It") for _, _, e in got)
    q = spark.createDataFrame([(1, "Did Ada Lovelace visit Paris in 1840?")], "qid int, question string")
    assert {r.entity for r in question_mentions(q).collect()} == {"did ada lovelace", "paris"}


def test_equal_passages_are_one(index):
    assert index.passages.where("client_id = 1").count() == 1


def test_graph_invariants(index):
    nodes = {(r.client_id, r.node_id): r for r in index.nodes.collect()}
    for c in (0, 1):
        ids = sorted(i for k, i in nodes if k == c)
        assert ids == list(range(len(ids)))
        types = [nodes[c, i].node_type for i in ids]
        assert types == sorted(types)
    edges = {(r.client_id, r.src, r.dst, r.edge_type) for r in index.edges.collect()}
    assert edges and all((c, d, s, t) in edges for c, s, d, t in edges)
    for c, s, d, t in edges:
        kinds = {nodes[c, s].node_type, nodes[c, d].node_type}
        assert kinds == ({0, 1} if t == 0 else {0, 2})
    assert len(edges) == index.edges.count()
    # sentences without an entity are no nodes
    assert not any(n.text == "nothing here." for n in nodes.values())


def test_weights_sum_to_one(index):
    sums = index.entity_passage_weights.groupBy("client_id", "passage_id").agg(F.sum("weight").alias("w")).collect()
    assert sums and all(r.w == pytest.approx(1.0) for r in sums)


def test_adjacent_passages(index):
    a = graph.adjacent_passages(index.passages).collect()
    text = {r.passage_id: r.text for r in index.passages.collect()}
    assert {(text[r.src][:2], text[r.dst][:2]) for r in a} == {("0:", "1:"), ("1:", "2:")}


def test_empty_input(spark):
    empty = GraphIndex.build(spark.createDataFrame([], "client_id int, text string"), dim=8)
    assert empty.edges.count() == 0 and empty.nodes.count() == 0 and empty.transitions.count() == 0


def test_partitioning(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(-1, 20)], "idx int, title string")
    got = {r.idx: r.client_id for r in graph.partition_by_index(df, 4).collect()}
    assert got == {i: max(i, 0) % 4 for i in range(-1, 20)}
    stats = graph.partition_stats(graph.partition_by_title(df, 50), 50, "title").collect()
    assert sum(r["size"] for r in stats) == 21 and len(stats) == 50 and all(r.no_overlap for r in stats)


def test_numbered_and_next(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(p)) for k, p in zip(rng.choice([0, 0, 0, 1], 300), rng.permutation(300))]
    df = spark.createDataFrame(rows, "k int, p bigint").withColumn("v", F.concat(F.lit("x"), F.col("p").cast("string")))
    got = {(r.k, r.p): r.n for r in numbered(df, ["k"], [F.col("p")], F.floor(F.col("p") / 7), "n").collect()}
    following = {(r.k, r.p): r.nxt for r in next_in_order(df, ["k"], "p", "v", width=9, name="nxt").collect()}
    for k in (0, 1):
        ordered = sorted(p for kk, p in rows if kk == k)
        assert [got[k, p] for p in ordered] == list(range(len(ordered)))
        assert [following[k, p] for p in ordered] == [f"x{p}" for p in ordered[1:]] + [None]


def test_topk_softmax_weights(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "g int, i int, s double")
    got = {r.i: round(r.weight, 6) for r in topk_softmax(df, ["g"], "s", 3, [F.col("i")]).collect()}
    assert got == {9: 0.665241, 8: 0.244728, 7: 0.090031}


def test_two_hop_and_induced(spark, toy):
    nodes, edges = toy
    nb = graph.undirected_neighbours(edges)
    two = {(r.start, r.node_id) for r in graph.exact_two_hop(nb, nodes.where("node_type = 0")).collect()}
    assert two == {(0, 1), (1, 0), (1, 2), (2, 1)}
    kept = nodes.where("node_id in (0, 1, 3, 6)").select("client_id", "node_id")
    inside = graph.induced_edges(edges, kept, ["client_id"])
    local, out = graph.relabelled(kept, inside, ["client_id"])
    assert {r.node_id: r.local_id for r in local.collect()} == {0: 0, 1: 1, 3: 2, 6: 3}
    assert {(r.src, r.dst) for r in out.collect()} == {(0, 2), (2, 0), (1, 2), (2, 1)}


def _shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_induced_edges_around_a_hub(spark):
    """A hub kept by every query costs rows in proportion to the edges, not their square."""
    n = 600
    pairs = [(p, 0) for p in range(1, n + 1)] + [(p, n + 1 + p % 7) for p in range(1, n + 1)]
    edges = spark.createDataFrame([(0, a, b) for a, b in pairs] + [(0, b, a) for a, b in pairs], "client_id int, src bigint, dst bigint")
    rows = [(0, f"q{p}", x) for p in range(1, n + 1) for x in (p, 0)] + [(0, "q3", 4), (0, "q3", n + 1 + 4)]
    kept = spark.createDataFrame(rows, "client_id int, qid string, node_id bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = _shuffled_rows(spark)
        got = sorted((r.qid, r.src, r.dst) for r in graph.induced_edges(edges, kept, ["client_id", "qid"]).collect())
        cost = _shuffled_rows(spark) - at
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    held = {}
    for _, q, x in rows:
        held.setdefault(q, set()).add(x)
    assert got == sorted((q, *e) for q, xs in held.items() for a, b in pairs if a in xs and b in xs for e in ((a, b), (b, a)))
    assert cost < 40 * n


def test_first_title_and_map(spark):
    from loomgraph.operators.evidence import passage_node_map

    nodes = spark.createDataFrame([(1, 0, 2, "4:Alpha: x"), (0, 5, 2, "9:alpha: y"), (0, 3, 2, "1:Alpha : z"), (0, 9, 0, "alpha")], "client_id int, node_id bigint, node_type int, text string")
    first = graph.first_node_by_title(nodes).collect()
    assert [(r.title, r.client_id, r.node_id) for r in first] == [("alpha", 0, 3)]
    slots = spark.createDataFrame([(1, 0, "ALPHA: q"), (1, 1, "beta: q")], "qid int, slot int, text string")
    got = {(r.qid, r.slot): (r.client_id, r.node_id) for r in passage_node_map(slots, nodes).collect()}
    assert got == {(1, 0): (0, 3), (1, 1): (-1, -1)}


def shuffled_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(spark._jvm.java.util.ArrayList(), False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_links_shuffle_no_texts(spark):
    """A long sentence with many entities is neither repeated per entity nor shuffled for ids and links."""
    rng = np.random.default_rng(3)
    names = [f"N{chr(97 + a)}{chr(97 + b)}x" for a in range(6) for b in range(6)]
    words = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(600))
    texts = [(0, f"{i}:{words()} {' a '.join(names)}.") for i in range(120)]
    index = GraphIndex.build(spark.createDataFrame(texts, "client_id int, text string"), dim=16)
    index.passages
    before = shuffled_bytes(spark)
    assert index.edges.count() == 2 * 2 * 120 * len(names) and index.ids.count() == 240 + len(names)
    assert shuffled_bytes(spark) - before < sum(len(t) for _, t in texts) / 4


def test_transitions_shuffle_packed_ids(spark):
    from loomgraph.operators.passages import transition

    names = [f"N{chr(97 + a)}{chr(97 + b)}x" for a in range(10) for b in range(10)]
    texts = [(i % 2, f"{i}:{' a '.join(names[i % 7:])}.") for i in range(200)]
    index = GraphIndex.build(spark.createDataFrame(texts, "client_id int, text string"), dim=16)
    weights, adjacent = index.entity_passage_weights, graph.adjacent_passages(index.passages)
    start = shuffled_bytes(spark)
    plain = {(r.client_id, r.src, r.dst): r.p for r in transition(graph.retrieval_edges(weights, adjacent)).collect()}
    middle = shuffled_bytes(spark)
    got = {(r.client_id, r.src, r.dst): r.p for r in index.transitions.collect()}
    assert got == pytest.approx(plain) and len(got) > 30_000
    assert shuffled_bytes(spark) - middle < 0.8 * (middle - start)
