import numpy as np
import pytest

from loomgraph.llm import vector_links as vl

SCHEMA = "vec_id bigint, embedding array<double>, label int, node string, a string, cell string, key string"


def brute(rows, cosine):
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, linked = len(rows), [set() for _ in rows]
    good = [k for k in range(n) if fine(rows[k][1])]
    for i in good:
        x = np.array(rows[i][1], float)
        for j in good:
            if j > i and len(rows[j][1]) == len(x):
                y = np.array(rows[j][1], float)
                a, b = x / np.abs(x).max(), y / np.abs(y).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    linked[i].add(j)
                    linked[j].add(i)
    out = []
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[k][0], len(linked[k]), least, rows[k][0] == least))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("tile, cosine", [(1024, 0.95), (7, 0.95), (16, 0.7)])
def test_links_equal_brute_force(spark, tile, cosine):
    rng = np.random.default_rng(tile)
    vectors = [v for _ in range(12) for c in [rng.normal(size=24)] for v in c + rng.normal(size=(12, 24)) * rng.choice([0.05, 0.2, 0.33])]
    vectors += list(rng.normal(size=(60, 24)))
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000 + k, vectors[k].tolist()) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found(vl.links(df, cosine=cosine, tile=tile)) == brute(rows, cosine)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.01, -0.0]), (2, [2.0, 0.01, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [1.0, nan, 0.0]), (7, [inf, 0.0, 0.0]), (8, []),
            (9, [1.0, 0.0]), (10, [5.0, 0.1]), (11, [3.0]), (12, [-3.0]), (13, [0.5]), (None, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.1]), (14, [1e300, 1e299, 0.0]), (15, [1e-300, 1e-301, 0.0]), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x", "x", "x", "x") for r in rows], SCHEMA)
    assert found(vl.links(df)) == brute(rows, 0.95)
    assert vl.links(df.limit(0)).count() == 0 and vl.links(df.where("vec_id IN (3, 4)")).count() == 2
    assert vl.digest(df).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_copies_cost_nothing_and_forests_are_small():
    rng = np.random.default_rng(3)
    raw = rng.normal(size=8) + rng.normal(size=(40, 8)) * 0.05
    ids = np.arange(40)
    one = vl.Tile(ids.astype("<i8").tobytes(), np.ones(40, "<i8").tobytes(), raw.tobytes(), 8, {})
    links = vl.linked(one, one, 0.95)
    assert links.all()
    np.fill_diagonal(links, False)
    a, b = vl.forest(links, ids, ids)
    assert len(a) <= 80


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(vl.links(df, cosine=0.4)) == brute(rows, 0.4)


def shuffled_bytes(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))


def test_a_tile_travels_once_per_group(spark):
    """Vectors that all lie near each other: tiles go to groups of tiles, not to each other tile one by one."""
    rng = np.random.default_rng(6)
    raw = (rng.normal(size=(1, 32)) + rng.normal(size=(2400, 32)) * 0.6).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(raw)], "vec_id bigint, embedding array<float>")
    at = shuffled_bytes(spark)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vl.links(df, cosine=0.8, tile=16).collect()}
    sent = shuffled_bytes(spark) - at
    unit = raw.astype(np.float64) / np.linalg.norm(raw.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.8
    assert [got[k][0] for k in range(2400)] == (near.sum(axis=1) - 1).tolist()
    assert sent < 48 * raw.nbytes
