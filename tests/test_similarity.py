import numpy as np
import pytest

from loomgraph.operators import similarity
from loomgraph.operators.similarity import gram_range, top_k_dot


def tables(spark, nq=37, nv=150, dim=6, groups=2, seed=0):
    rng = np.random.default_rng(seed)
    q = [(int(i % groups), int(i), rng.integers(-2, 3, dim).astype(float).tolist()) for i in range(nq)]
    v = [(int(i % groups), int(i), rng.integers(-2, 3, dim).astype(float).tolist()) for i in range(nv)]
    schema = "client_id int, {k} bigint, x array<double>"
    return q, v, spark.createDataFrame(q, schema.format(k="query_key")).repartition(3), spark.createDataFrame(v, schema.format(k="vector_key")).repartition(5)


def brute(q, v, k, skip_self=False):
    out = set()
    for g, qi, qx in q:
        scored = sorted((-float(np.dot(qx, vx)), vi) for h, vi, vx in v if h == g and not (skip_self and vi == qi))
        out |= {(g, qi, vi, -s, r + 1) for r, (s, vi) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("options", [{}, {"query_rows": 5, "part_rows": 11}])
@pytest.mark.parametrize("skip_self", [False, True])
def test_top_k_is_exact_on_ties(spark, options, skip_self):
    """Integer vectors give many equal scores; every tiling must settle them by key."""
    q, v, qd, vd = tables(spark)
    got = top_k_dot(qd, vd, 4, skip_self=skip_self, **options).collect()
    assert {(r.client_id, r.query_key, r.vector_key, r.score, r["rank"]) for r in got} == brute(q, v, 4, skip_self)


def test_one_group_with_most_rows(spark):
    q, v, _, _ = tables(spark, nq=20, nv=400, groups=1)
    v = [(0 if i % 3 else 1, i, x) for _, i, x in v]
    qd = spark.createDataFrame(q, "client_id int, query_key bigint, x array<double>")
    vd = spark.createDataFrame(v, "client_id int, vector_key bigint, x array<double>")
    got = top_k_dot(qd, vd, 7).collect()
    assert {(r.client_id, r.query_key, r.vector_key, r.score, r["rank"]) for r in got} == brute(q, v, 7)


def test_k_beyond_group_size(spark):
    q, v, qd, vd = tables(spark, nv=5)
    got = top_k_dot(qd, vd, 50).collect()
    assert {(r.client_id, r.query_key, r.vector_key, r.score, r["rank"]) for r in got} == brute(q, v, 50)


def test_text_keys_and_groups_of_one_side_only(spark):
    q = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0]), (None, "c", [0.0, 1.0])], "client_id int, query_key string, x array<double>")
    v = spark.createDataFrame([(0, "y", [2.0, 1.0]), (0, "x", [2.0, 9.0]), (2, "z", [1.0, 1.0])], "client_id int, vector_key string, x array<double>")
    got = [tuple(r) for r in top_k_dot(q, v, 2).orderBy("rank").collect()]
    assert got == [(0, "a", "x", 2.0, 1), (0, "a", "y", 2.0, 2)]
    assert top_k_dot(q.limit(0), v, 2).count() == 0 and top_k_dot(q, v.limit(0), 2).count() == 0


def test_blocks_below_the_bound_are_not_multiplied():
    """Directions of one axis each: after the own axis, blocks of other axes cannot reach the k-th score."""
    rng = np.random.default_rng(2)
    axes = np.eye(16)
    queries = np.repeat(axes, 4, axis=0) + rng.normal(size=(64, 16)) * 0.01
    tile = similarity.Tile(np.arange(64).astype(object), queries, 3)
    held = [axes[a] + rng.normal(size=(200, 16)) * 0.01 for a in range(16)]
    for a, x in enumerate(held):
        tile.add(np.arange(a * 200, a * 200 + 200).astype(object), x)
    every = queries @ np.concatenate(held).T
    got = tile.rows(0, False)
    for i in range(64):
        assert set(got[got.query_key == i].vector_key) == set(np.argsort(-every[i])[:3].tolist())
    assert tile.products < 0.7 * every.size


def test_memory_of_a_full_tile():
    """8,192 queries and 65,536 vectors of 384 numbers pass through a worker that holds the queries and one block."""
    import tracemalloc

    rng = np.random.default_rng(0)
    queries = rng.normal(size=(similarity.QUERY_ROWS, 384))
    tracemalloc.start()
    tile = similarity.Tile(np.arange(len(queries)).astype(object), queries, 10)
    for block in range(4):
        tile.add(np.arange(1024 * block, 1024 * block + 1024).astype(object), rng.normal(size=(1024, 384)))
    assert tracemalloc.get_traced_memory()[1] < 400 * 2**20
    tracemalloc.stop()


def test_gram_range(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 2), int(i), rng.standard_normal(5).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "client_id int, node_id bigint, x array<double>")
    got = {r.client_id: (r.lo, r.hi) for r in gram_range(df).collect()}
    for g in (0, 1):
        x = np.array([r[2] for r in rows if r[0] == g])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        np.fill_diagonal(s, 0)
        assert got[g] == pytest.approx((s.min(), s.max()))


def test_gram_range_multiplies_a_pair_once(spark, monkeypatch):
    """Parts of several blocks, each pair of rows multiplied once for both extremes, each row sent once per part."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 4)).astype(np.float32)
    x[::7] = 0
    df = spark.createDataFrame([(i, i % 3 // 2, v.tolist()) for i, v in enumerate(x)], "node_id bigint, client_id int, x array<float>").repartition(4)
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-12)
    want = {}
    for c in (0, 1):
        own = u[[i for i in range(150) if i % 3 // 2 == c]]
        s = own @ own.T
        np.fill_diagonal(s, 0)
        want[c] = pytest.approx((s.min(), s.max()))
    for rows in (9, 40, 1000):
        assert {r.client_id: (r.lo, r.hi) for r in gram_range(df, part_rows=rows).collect()} == want
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    whole = similarity.Extremes(u, True)
    for at in range(0, 150, 16):
        whole.add(u[at:at + 16])
    s = u @ u.T
    assert (whole.lo, whole.hi) == pytest.approx((s[np.triu_indices(150, 1)].min(), s[np.triu_indices(150, 1)].max()))
    monkeypatch.setattr(similarity, "top_k_dot", lambda *a, **k: pytest.fail("two searches over all pairs"))
    assert gram_range(df).count() == 2
    one = spark.createDataFrame([(1, 0, [1.0, 0.0])], "node_id bigint, client_id int, x array<float>")
    assert [(r.lo, r.hi) for r in gram_range(one).collect()] == [(0.0, 0.0)]


def test_ties_in_every_block_are_not_sorted_per_query():
    """Many equal vectors: the smallest keys win, without ordering all keys anew for every query."""
    from loomgraph.operators.similarity import Tile

    compared = 0

    class Key(str):
        def __lt__(self, other):
            nonlocal compared
            compared += 1
            return str.__lt__(self, other)

    rng = np.random.default_rng(5)
    names = [Key(f"{n:06d}") for n in rng.permutation(20 * 512)]
    for k in (1, 3):
        compared, tile = 0, Tile(np.arange(60), np.tile([1.0, 0.0], (60, 1)), k)
        for at in range(0, len(names), 512):
            tile.add(np.array(names[at:at + 512], dtype=object), np.tile([1.0, 0.0], (512, 1)))
        out = tile.rows(0, False)
        assert sorted(set(out.vector_key)) == [f"{n:06d}" for n in range(k)] and len(out) == 60 * k
        assert compared < 500_000
