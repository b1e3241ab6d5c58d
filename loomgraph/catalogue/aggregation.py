"""Federated aggregation and global graph queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import sum_vectors
from ..operators import federate as fed
from ..operators import gnn
from ..operators import surrogate as su
from ..session import spread as spread_out
from .base import rounded, table
from .graphs import _nation_graph


def _client_weights(spark, sf):
    """Mean embedding per label as client weights: a projector for all clients, an encoder for half of them."""
    m = sum_vectors(table(spark, sf, "embeddings"), ["label"], "embedding", 64, name="x", mean=True, extra=[F.count(F.lit(1)).alias("n")])
    rows = m.select(F.col("label").alias("client_id"), "n", F.posexplode("x").alias("idx", "value"))
    projector = rows.select("client_id", F.lit("projector").alias("module"), F.lit("weight").alias("param"), F.col("idx").cast("bigint").alias("idx"), "value")
    encoder = projector.where("client_id < 5").withColumn("module", F.lit("graph_encoder")).withColumn("value", F.col("value") * 2.0)
    clients = m.select(F.col("label").alias("client_id"), F.col("n").alias("num_samples"), (F.pmod("label", F.lit(3)) != 0).alias("sampled"))
    return projector.unionByName(encoder), clients


def federated_average(spark, sf):
    w, c = _client_weights(spark, sf)
    return fed.federated_average(w, c).select("module", "param", "idx", *rounded("value"))


def weighted_gradient_mean(spark, sf):
    w, c = _client_weights(spark, sf)
    g = w.where("module = 'projector'").select("client_id", "param", "idx", "value")
    return fed.weighted_gradients(g, c.select("client_id", F.col("num_samples").alias("n"))).select("param", "idx", *rounded("value"))


def gradient_match(spark, sf):
    """Match loss between the mean vectors of the even and the odd labels."""
    e = table(spark, sf, "embeddings").select(F.pmod("label", F.lit(2)).alias("side"), "embedding")
    m = sum_vectors(e, ["side"], "embedding", 64, name="x", mean=True).select("side", F.posexplode("x").alias("idx", "value")).withColumn("param", F.lit("w"))
    left, right = m.where("side = 0").drop("side"), m.where("side = 1").drop("side")
    return fed.gradient_match(left, right, 0.5).select(*rounded("loss", digits=9))


def _vector_graph(spark, sf):
    """Embeddings of two clients as anchor graphs; neighbours in id order are linked both ways."""
    e = table(spark, sf, "embeddings").select(
        F.pmod("vec_id", F.lit(2)).cast("int").alias("client_id"), F.floor(F.col("vec_id") / 2).cast("bigint").alias("node_id"),
        F.pmod("label", F.lit(3)).cast("int").alias("node_type"), F.col("embedding").cast("array<double>").alias("x"))
    ids = e.select("client_id", "node_id")
    one = ids.select("client_id", F.col("node_id").alias("src"), F.explode(F.array(F.lit(1), F.lit(3))).alias("step")).withColumn(
        "dst", F.col("src") + F.col("step")).join(ids.select("client_id", F.col("node_id").alias("dst")), ["client_id", "dst"], "left_semi")
    one = one.select("client_id", "src", "dst", (F.lit(1.0) / F.col("step")).alias("weight"))
    from ..operators.graph import both_directions

    return spread_out(e), both_directions(one).select("client_id", "src", "dst", "weight")


def neighbour_spread(spark, sf):
    """One normalised-adjacency product over the anchor graphs."""
    n, e = _vector_graph(spark, sf)
    s = su.spread(n, su.normalised_adjacency(n, e), "x", 64, "y")
    return s.select("client_id", "node_id", F.posexplode("y").alias("i", "value")).select("client_id", "node_id", F.col("i").cast("bigint").alias("i"), *rounded("value"))


def _layers():
    """Two layers with fixed cosine weights and sine biases."""
    wave = np.arange(16 * 64, dtype=np.float64)
    return [(np.cos(wave).reshape(16, 64) / 8.0, np.sin(wave[:16]) / 10.0), (np.cos(wave[:48]).reshape(3, 16) / 2.0, np.sin(wave[:3]) / 10.0)]


def anchor_gradients(spark, sf):
    """Surrogate gradients over all clients, with one drawn non-neighbour pair per edge."""
    n, e = _vector_graph(spark, sf)
    return su.anchor_gradients(n, e, _layers()).select("param", "idx", *rounded("value"))


def surrogate_losses(spark, sf):
    n, e = _vector_graph(spark, sf)
    return su.surrogate_loss(n, e, _layers()).select("client_id", "n", *rounded("loss", "type_loss", "link_loss", "type_accuracy"))


def negative_pairs(spark, sf):
    """One drawn pair of unlinked nodes per edge of the anchor graphs."""
    n, e = _vector_graph(spark, sf)
    return su.negative_edges(n, e).groupBy("client_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def graph_convolution(spark, sf):
    """Two-layer convolution with fixed cosine weights."""
    n, e = _vector_graph(spark, sf)
    w1 = np.cos(np.arange(8 * 64, dtype=np.float64)).reshape(8, 64) / 8.0
    w2 = np.cos(np.arange(4 * 8, dtype=np.float64)).reshape(4, 8) / 2.0
    out = gnn.encode(n, e, [gnn.Layer(w1), gnn.Layer(w2)], "gcn")
    return out.select("client_id", "node_id", F.posexplode("x").alias("i", "value")).select("client_id", "node_id", F.col("i").cast("bigint").alias("i"), *rounded("value"))


def _wave(n_out: int, n_in: int):
    """Fixed matrices of an attention layer: four heads of ``n_out`` rows over ``n_in`` columns."""
    k = np.arange(4 * n_out * n_in, dtype=np.float64).reshape(4 * n_out, n_in)
    return [f(k / step) / 8.0 for f, step in ((np.cos, 1), (np.sin, 1), (np.cos, 2), (np.sin, 3))]


def _component_rows(out):
    return out.select("client_id", "node_id", F.posexplode("x").alias("i", "value")).select("client_id", "node_id", F.col("i").cast("bigint").alias("i"), *rounded("value"))


def graph_attention(spark, sf):
    """Two attention layers of four heads with fixed weights; heads are averaged."""
    n, e = _vector_graph(spark, sf)
    layers = []
    for n_out, n_in in ((8, 64), (4, 8)):
        k = np.arange(4 * n_out, dtype=np.float64)
        layers.append(gnn.Layer(_wave(n_out, n_in)[0], np.sin(k[:n_out]) / 10.0, np.sin(k), np.cos(k), heads=4))
    return _component_rows(gnn.encode(n, e, layers, "gat"))


def graph_transformer(spark, sf):
    """Two transformer layers of four heads with fixed weights; heads stand one after the other."""
    n, e = _vector_graph(spark, sf)
    layers = []
    for n_out, n_in in ((4, 64), (2, 16)):
        weight, query, key, skip = _wave(n_out, n_in)
        layers.append(gnn.Layer(weight, np.sin(np.arange(4 * n_out)) / 10.0, query=query, key=key, skip=skip, heads=4))
    return _component_rows(gnn.encode(n, e, layers, "gt"))


def alignment_loss(spark, sf):
    """Reconstruction of every embedding from the label means."""
    e = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("h"))
    g = sum_vectors(table(spark, sf, "embeddings"), ["label"], "embedding", 64, name="h", mean=True).withColumnRenamed("label", "node_id")
    return su.alignment_loss(e, g).select(*rounded("loss"))


def diversity_penalty(spark, sf):
    """Mean absolute cosine between the label means, even and odd labels apart."""
    g = sum_vectors(table(spark, sf, "embeddings"), ["label"], "embedding", 64, name="x", mean=True)
    return su.diversity_penalty(g.select(F.pmod("label", F.lit(2)).cast("int").alias("client_id"), "x")).select("client_id", *rounded("loss"))


def degree_penalty(spark, sf):
    n, e = _vector_graph(spark, sf)
    return su.degree_penalty(n, e, 2.5).select(*rounded("loss"))


def average_degree(spark, sf):
    n, e = _nation_graph(spark, sf)
    return fed.average_degree(n, e.where("src <> dst")).select(*rounded("target_degree"))


def node_type_counts(spark, sf):
    n, _ = _vector_graph(spark, sf)
    return fed.type_counts(n).select("node_type", "n")


def initial_global_graph(spark, sf):
    """Synthetic start nodes per type (seeded draws)."""
    n, _ = _vector_graph(spark, sf)
    g = fed.initial_global_nodes(n.withColumnRenamed("node_id", "core_id"), 32, 64, seed=3)
    return g.select("node_id", "node_type", *[(F.round(F.element_at("x", 1), 6) + F.lit(0.0)).alias("first")])


def round_pool(spark, sf):
    """Training pool of one round: up to 20 documents per client."""
    d = table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(3)).cast("int").alias("client_id"), F.col("doc_id").alias("idx"))
    return fed.sample_pool(d, 20, seed=5, round_no=2)


def masked_prompts(spark, sf):
    """Norms of both prompt vectors in every mode that draws no noise."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    norm = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6)
    rows = [F.struct(F.lit(mode).alias("mode"), norm(ze).alias("evidence_norm"), norm(zc).alias("condensed_norm"))
            for mode in ("both", "evidence_only", "condensed_only", "none") for ze, zc in [fed.masked_prompt(F.col("z"), F.slice("z", 1, 32), mode)]]
    return e.select("vec_id", F.explode(F.array(*rows)).alias("r")).select("vec_id", "r.*")


QUERIES = {f.__name__: f for f in (
    federated_average, weighted_gradient_mean, gradient_match, neighbour_spread, negative_pairs, anchor_gradients, surrogate_losses, graph_convolution, graph_attention, graph_transformer,
    alignment_loss, diversity_penalty, degree_penalty, average_degree, node_type_counts, initial_global_graph, round_pool, masked_prompts)}

_MEANS = "cell AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL)"
_MEAN_LISTS = f"{_MEANS}, means AS (SELECT label, list(v ORDER BY i) AS v FROM cell GROUP BY label)"
_VG = """vn AS (SELECT CAST(vec_id % 2 AS INTEGER) AS client_id, vec_id // 2 AS node_id, CAST(label % 3 AS INTEGER) AS node_type, embedding::DOUBLE[] AS x FROM embeddings),
one AS (SELECT a.client_id, a.node_id AS src, b.node_id AS dst, 1.0::DOUBLE / (b.node_id - a.node_id) AS weight FROM vn a JOIN vn b
  ON b.client_id = a.client_id AND (b.node_id = a.node_id + 1 OR b.node_id = a.node_id + 3)),
ve AS (SELECT * FROM one UNION ALL SELECT client_id, dst, src, weight FROM one),
adj AS (SELECT * FROM ve UNION ALL SELECT client_id, node_id, node_id, 1.0 FROM vn),
dg AS (SELECT client_id, src, sum(weight) AS d FROM adj GROUP BY ALL),
na AS (SELECT a.client_id, a.src, a.dst, a.weight / sqrt(s.d * t.d) AS a FROM adj a JOIN dg s ON s.client_id = a.client_id AND s.src = a.src
  JOIN dg t ON t.client_id = a.client_id AND t.src = a.dst)"""

_NEGATIVE = f"""{_VG},
nn AS (SELECT client_id, count(*) AS n FROM vn GROUP BY client_id),
sk AS (SELECT client_id, a, list(b ORDER BY b) AS skip FROM (SELECT client_id, src AS a, dst AS b FROM ve UNION SELECT client_id, node_id, node_id FROM vn) GROUP BY ALL),
pl AS (SELECT k.client_id, a, skip, n.n - len(skip) AS free, row_number() OVER (PARTITION BY k.client_id ORDER BY a) - 1 AS place, count(*) OVER (PARTITION BY k.client_id) AS able
  FROM sk k JOIN nn n ON n.client_id = k.client_id WHERE n.n > len(skip)),
dr AS (SELECT client_id, ('0x' || substr(md5(client_id || ':' || src || ':' || dst || ':0:1'), 1, 8))::BIGINT AS d1, ('0x' || substr(md5(client_id || ':' || src || ':' || dst || ':0:2'), 1, 8))::BIGINT AS d2 FROM ve),
ng AS MATERIALIZED (SELECT d.client_id, p.a AS src, list_reduce(list_prepend(d2 % free, skip), lambda v, x: CASE WHEN x <= v THEN v + 1 ELSE v END) AS dst
  FROM dr d JOIN (SELECT DISTINCT client_id, able FROM pl) b ON b.client_id = d.client_id JOIN pl p ON p.client_id = d.client_id AND p.place = d1 % b.able)"""

_SURROGATE = f"""{_NEGATIVE},
w1 AS (SELECT o, i, cos(CAST(o * 64 + i AS DOUBLE)) / 8.0 AS w FROM (SELECT unnest(range(16)) AS o), (SELECT unnest(range(64)) AS i)),
w2 AS (SELECT o, i, cos(CAST(o * 16 + i AS DOUBLE)) / 2.0 AS w FROM (SELECT unnest(range(3)) AS o), (SELECT unnest(range(16)) AS i)),
xs AS (SELECT client_id, node_id, unnest(range(64)) AS i, unnest(x) AS v FROM vn),
p0 AS MATERIALIZED (SELECT n.client_id, n.dst AS node_id, i, sum(a * v) AS v FROM na n JOIN xs ON xs.client_id = n.client_id AND xs.node_id = n.src GROUP BY ALL),
h1 AS MATERIALIZED (SELECT client_id, node_id, o, greatest(sum(v * w) + sin(CAST(o AS DOUBLE)) / 10.0, 0) AS v FROM p0 JOIN w1 USING (i) GROUP BY client_id, node_id, o),
p1 AS MATERIALIZED (SELECT n.client_id, n.dst AS node_id, o AS i, sum(a * v) AS v FROM na n JOIN h1 h ON h.client_id = n.client_id AND h.node_id = n.src GROUP BY ALL),
lg AS (SELECT client_id, node_id, o, sum(v * w) + sin(CAST(o AS DOUBLE)) / 10.0 AS z FROM p1 JOIN w2 USING (i) GROUP BY client_id, node_id, o),
sm AS MATERIALIZED (SELECT l.client_id, l.node_id, o, z, t.node_type, exp(z) / sum(exp(z)) OVER w AS p, ln(sum(exp(z)) OVER w) AS lse, max(z) OVER w AS top
  FROM lg l JOIN vn t ON t.client_id = l.client_id AND t.node_id = l.node_id WINDOW w AS (PARTITION BY l.client_id, l.node_id)),
hv AS (SELECT client_id, node_id, list(v ORDER BY o) AS h FROM h1 GROUP BY ALL),
tm AS MATERIALIZED (SELECT q.client_id, q.src, q.dst, label, list_dot_product(u.h, v.h) AS z FROM (SELECT client_id, src, dst, 1.0::DOUBLE AS label FROM ve UNION ALL SELECT client_id, src, dst, 0.0 FROM ng) q
  JOIN hv u ON u.client_id = q.client_id AND u.node_id = q.src JOIN hv v ON v.client_id = q.client_id AND v.node_id = q.dst)"""

_PAIRS = f"""{_VG},
near AS (SELECT DISTINCT client_id, src, dst FROM ve WHERE src <> dst),
loops AS (SELECT * FROM near UNION SELECT client_id, node_id, node_id FROM vn),
x0 AS (SELECT client_id, node_id, unnest(range(64)) AS i, unnest(x) AS v FROM vn)"""


def _normed(source: str, name: str) -> str:
    return f"{name} AS (SELECT client_id, node_id, i, greatest((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 0) AS v FROM {source} WINDOW w AS (PARTITION BY client_id, node_id))"


def _product(source: str, name: str, wave: str, n_out: int, n_in: int, bias: str = "") -> str:
    """CTE ``name`` (client_id, node_id, k, v): ``source`` times the matrix of ``wave`` over four heads."""
    return f"""{name} AS MATERIALIZED (SELECT client_id, node_id, k, sum(v * w){bias} AS v FROM {source}
  JOIN (SELECT k, i, {wave.format('CAST(k * ' + str(n_in) + ' + i AS DOUBLE)')} / 8.0 AS w FROM (SELECT unnest(range({4 * n_out})) AS k), (SELECT unnest(range({n_in})) AS i)) USING (i) GROUP BY client_id, node_id, k)"""


def _attention(n: int, n_out: int, n_in: int) -> str:
    return f"""{_product(f'x{n}', f't{n}', 'cos({})', n_out, n_in)},
s{n} AS MATERIALIZED (SELECT client_id, node_id, k // {n_out} AS h, sum(v * sin(CAST(k AS DOUBLE))) AS s, sum(v * cos(CAST(k AS DOUBLE))) AS d FROM t{n} GROUP BY ALL),
e{n} AS (SELECT l.client_id, l.src, l.dst, a.h, CASE WHEN a.s + b.d >= 0 THEN a.s + b.d ELSE 0.2::DOUBLE * (a.s + b.d) END AS e FROM loops l
  JOIN s{n} a ON a.client_id = l.client_id AND a.node_id = l.src JOIN s{n} b ON b.client_id = l.client_id AND b.node_id = l.dst AND b.h = a.h),
a{n} AS MATERIALIZED (SELECT client_id, src, dst, h, exp(e) / sum(exp(e)) OVER (PARTITION BY client_id, dst, h) AS a FROM e{n}),
y{n} AS (SELECT a.client_id, a.dst AS node_id, t.k % {n_out} AS i, sum(a.a * t.v) / 4 + sin(CAST(t.k % {n_out} AS DOUBLE)) / 10.0 AS v FROM a{n} a
  JOIN t{n} t ON t.client_id = a.client_id AND t.node_id = a.src AND t.k // {n_out} = a.h GROUP BY a.client_id, a.dst, t.k % {n_out})"""


def _transformer(n: int, n_out: int, n_in: int) -> str:
    return f"""{_product(f'x{n}', f'v{n}', 'cos({})', n_out, n_in, ' + sin(CAST(k AS DOUBLE)) / 10.0')},
{_product(f'x{n}', f'q{n}', 'sin({})', n_out, n_in)},
{_product(f'x{n}', f'k{n}', 'cos({} / 2)', n_out, n_in)},
{_product(f'x{n}', f'r{n}', 'sin({} / 3)', n_out, n_in)},
e{n} AS (SELECT l.client_id, l.src, l.dst, k.k // {n_out} AS h, sum(q.v * k.v) / sqrt({n_out}.0::DOUBLE) AS e FROM near l JOIN k{n} k ON k.client_id = l.client_id AND k.node_id = l.src
  JOIN q{n} q ON q.client_id = l.client_id AND q.node_id = l.dst AND q.k = k.k GROUP BY ALL),
a{n} AS MATERIALIZED (SELECT client_id, src, dst, h, exp(e) / sum(exp(e)) OVER (PARTITION BY client_id, dst, h) AS a FROM e{n}),
m{n} AS (SELECT a.client_id, a.dst AS node_id, v.k, sum(a.a * v.v) AS v FROM a{n} a JOIN v{n} v ON v.client_id = a.client_id AND v.node_id = a.src AND v.k // {n_out} = a.h GROUP BY ALL),
y{n} AS (SELECT r.client_id, r.node_id, r.k AS i, r.v + coalesce(m.v, 0) AS v FROM r{n} r LEFT JOIN m{n} m ON m.client_id = r.client_id AND m.node_id = r.node_id AND m.k = r.k)"""


_GAUSS = "sqrt(-2 * ln((('0x' || substr(md5(node_id || ':r0:3'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * (('0x' || substr(md5(node_id || ':a0:3'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)"

SQL = {
    "round_pool": """SELECT CAST(doc_id % 3 AS INTEGER) AS client_id, doc_id AS idx FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 3 ORDER BY md5('5:2:' || doc_id), doc_id) <= 20""",
    "initial_global_graph": f"""WITH {_VG}, c AS (SELECT t, (SELECT count(*) FROM vn WHERE node_type = t) AS n FROM (SELECT unnest(range(3)) AS t)),
        f AS (SELECT t, n, 32 * n::DOUBLE / sum(n) OVER () AS exact FROM c),
        s AS (SELECT t, n, floor(exact) + (row_number() OVER (ORDER BY floor(exact) - exact, t) <= 32 - sum(floor(exact)) OVER ())::INT AS share FROM f),
        g AS (SELECT node_id, (SELECT count(*) FROM (SELECT sum(share) OVER (ORDER BY t) AS upto FROM s) WHERE upto <= node_id) AS node_type FROM (SELECT unnest(range(32)) AS node_id)),
        r AS (SELECT node_type, x[1] AS x, row_number() OVER (PARTITION BY node_type ORDER BY client_id, node_id) - 1 AS row FROM vn)
        SELECT g.node_id, CAST(g.node_type AS INTEGER) AS node_type, round(coalesce(r.x, 0) + CASE WHEN s.n > 0 THEN 0.01::DOUBLE ELSE 0.02::DOUBLE END * {_GAUSS.replace('node_id', 'g.node_id')}, 6) + 0.0 AS first
        FROM g JOIN s ON s.t = g.node_type LEFT JOIN r ON r.node_type = g.node_type AND s.n > 0 AND r.row = ('0x' || substr(md5(g.node_id || ':row:3'), 1, 8))::BIGINT % s.n""",
    "graph_attention": f"WITH {_PAIRS}, {_attention(0, 8, 64)}, {_normed('y0', 'x1')}, {_attention(1, 4, 8)} SELECT client_id, node_id, i, round(v, 6) + 0.0 AS value FROM y1",
    "graph_transformer": f"WITH {_PAIRS}, {_transformer(0, 4, 64)}, {_normed('y0', 'x1')}, {_transformer(1, 2, 16)} SELECT client_id, node_id, i, round(v, 6) + 0.0 AS value FROM y1",
    "negative_pairs": f"WITH {_NEGATIVE} SELECT client_id, src, dst, count(*) AS n FROM ng GROUP BY ALL",
    "surrogate_losses": f"""WITH {_SURROGATE},
        ty AS (SELECT client_id, count(*) AS n, avg(lse - z) AS type_loss, avg((z = top)::INT) AS type_accuracy FROM sm WHERE o = node_type GROUP BY client_id),
        li AS (SELECT client_id, avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))) AS link_loss FROM tm GROUP BY client_id)
        SELECT ty.client_id, n, round(type_loss + 0.5::DOUBLE * link_loss, 6) AS loss, round(type_loss, 6) AS type_loss, round(link_loss, 6) AS link_loss, round(type_accuracy, 6) AS type_accuracy
        FROM ty JOIN li ON li.client_id = ty.client_id""",
    "anchor_gradients": f"""WITH {_SURROGATE}, al AS (SELECT count(*) AS t FROM vn),
        d1 AS MATERIALIZED (SELECT client_id, node_id, o, (p - (o = node_type)::INT) / t AS v FROM sm, al),
        sh AS (SELECT m.client_id, 0.5::DOUBLE / t * n.n / m.m AS share FROM (SELECT client_id, count(*) AS m FROM tm GROUP BY client_id) m JOIN nn n ON n.client_id = m.client_id, al),
        bk AS (SELECT client_id, node_id, i, sum(v * w) AS v FROM d1 JOIN w2 USING (o) GROUP BY ALL),
        pu AS (SELECT t.client_id, src, dst, (1 / (1 + exp(-z)) - label) * share AS a FROM tm t JOIN sh ON sh.client_id = t.client_id),
        g AS (SELECT n.client_id, n.dst AS node_id, i AS o, a * v AS v FROM na n JOIN bk b ON b.client_id = n.client_id AND b.node_id = n.src
          UNION ALL SELECT p.client_id, p.dst, o, a * v FROM (SELECT * FROM pu UNION ALL SELECT client_id, dst, src, a FROM pu) p JOIN h1 h ON h.client_id = p.client_id AND h.node_id = p.src),
        d0 AS MATERIALIZED (SELECT h.client_id, h.node_id, h.o, CASE WHEN h.v > 0 THEN s.v ELSE 0 END AS v FROM h1 h JOIN (SELECT client_id, node_id, o, sum(v) AS v FROM g GROUP BY ALL) s
          ON s.client_id = h.client_id AND s.node_id = h.node_id AND s.o = h.o)
        SELECT param, idx, round(value, 6) + 0.0 AS value FROM (
          SELECT 'layers.1.weight' AS param, o * 16 + i AS idx, sum(d.v * p.v) AS value FROM d1 d JOIN p1 p ON p.client_id = d.client_id AND p.node_id = d.node_id GROUP BY ALL
          UNION ALL SELECT 'layers.1.bias', o, sum(v) FROM d1 GROUP BY ALL
          UNION ALL SELECT 'layers.0.weight', o * 64 + i, sum(d.v * p.v) FROM d0 d JOIN p0 p ON p.client_id = d.client_id AND p.node_id = d.node_id GROUP BY ALL
          UNION ALL SELECT 'layers.0.bias', o, sum(v) FROM d0 GROUP BY ALL)""",
    "federated_average": f"""WITH {_MEANS}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
        w AS (SELECT label, 'projector' AS module, i, v FROM cell UNION ALL SELECT label, 'graph_encoder', i, v * 2 FROM cell WHERE label < 5),
        t AS (SELECT sum(n) AS t FROM n WHERE label % 3 <> 0)
        SELECT module, 'weight' AS param, i - 1 AS idx, round(sum(v * n.n) / max(t.t), 6) + 0.0 AS value FROM w JOIN n ON n.label = w.label AND n.label % 3 <> 0, t GROUP BY module, i""",
    "weighted_gradient_mean": """SELECT 'weight' AS param, i - 1 AS idx, round(avg(CAST(embedding[i] AS DOUBLE)), 6) + 0.0 AS value
        FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i""",
    "gradient_match": """WITH c AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) FILTER (label % 2 = 0) AS a, avg(CAST(embedding[i] AS DOUBLE)) FILTER (label % 2 = 1) AS b
          FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i)
        SELECT round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) + 0.5 * avg((a - b) * (a - b)), 9) AS loss FROM c""",
    "neighbour_spread": f"""WITH {_VG} SELECT client_id, node_id, i - 1 AS i, round(sum(a * x[i]), 6) + 0.0 AS value FROM (
        SELECT n.client_id, n.dst AS node_id, n.a, v.x, unnest(range(1, 65)) AS i FROM na n JOIN vn v ON v.client_id = n.client_id AND v.node_id = n.src) GROUP BY ALL""",
    "graph_convolution": f"""WITH {_VG},
        w1 AS (SELECT o, i, cos(CAST(o * 64 + i AS DOUBLE)) / 8.0 AS w FROM (SELECT unnest(range(8)) AS o), (SELECT unnest(range(64)) AS i)),
        w2 AS (SELECT o, i, cos(CAST(o * 8 + i AS DOUBLE)) / 2.0 AS w FROM (SELECT unnest(range(4)) AS o), (SELECT unnest(range(8)) AS i)),
        xs AS (SELECT client_id, node_id, unnest(range(64)) AS i, unnest(x) AS v FROM vn),
        t1 AS (SELECT client_id, node_id, o, sum(v * w) AS v FROM xs JOIN w1 USING (i) GROUP BY ALL),
        h1 AS (SELECT n.client_id, n.dst AS node_id, o, sum(a * v) AS v FROM na n JOIN t1 t ON t.client_id = n.client_id AND t.node_id = n.src GROUP BY ALL),
        l1 AS (SELECT client_id, node_id, o AS i, greatest((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 0) AS v FROM h1 WINDOW w AS (PARTITION BY client_id, node_id)),
        t2 AS (SELECT client_id, node_id, o, sum(v * w) AS v FROM l1 JOIN w2 USING (i) GROUP BY ALL)
        SELECT n.client_id, n.dst AS node_id, o AS i, round(sum(a * v), 6) + 0.0 AS value FROM na n JOIN t2 t ON t.client_id = n.client_id AND t.node_id = n.src GROUP BY ALL""",
    "alignment_loss": f"""WITH {_MEAN_LISTS}, z AS (SELECT e.vec_id, m.label, m.v, e.embedding::DOUBLE[] AS h, exp(list_dot_product(e.embedding::DOUBLE[], m.v) / 8.0) AS x FROM embeddings e, means m),
        a AS (SELECT vec_id, h, v, x / sum(x) OVER (PARTITION BY vec_id) AS a FROM z),
        r AS (SELECT vec_id, i, sum(a * v[i]) - any_value(h[i]) AS d FROM (SELECT *, unnest(range(1, 65)) AS i FROM a) GROUP BY vec_id, i)
        SELECT round(sum(d * d) / count(DISTINCT vec_id), 6) AS loss FROM r""",
    "diversity_penalty": f"""WITH {_MEAN_LISTS} SELECT CAST(a.label % 2 AS INTEGER) AS client_id,
        round(avg(abs(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)))), 6) AS loss
        FROM means a JOIN means b ON a.label % 2 = b.label % 2 AND a.label <> b.label GROUP BY 1""",
    "degree_penalty": f"""WITH {_VG}, g AS (SELECT v.client_id, v.node_id, coalesce(sum(e.weight), 0) AS d FROM vn v LEFT JOIN ve e ON e.client_id = v.client_id AND e.src = v.node_id GROUP BY ALL)
        SELECT round(avg((d - 2.5) * (d - 2.5)), 6) AS loss FROM g""",
    "average_degree": """WITH f AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
        SELECT round(count(*) FILTER (a <> b)::DOUBLE / (SELECT count(*) FROM nation), 6) AS target_degree FROM f""",
    "node_type_counts": "SELECT CAST(label % 3 AS INTEGER) AS node_type, count(*) AS n FROM embeddings GROUP BY 1",
    "masked_prompts": """SELECT vec_id, mode,
            CASE WHEN mode IN ('both', 'evidence_only') THEN round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) ELSE 0.0 END AS evidence_norm,
            CASE WHEN mode IN ('both', 'condensed_only') THEN round(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]), 6) ELSE 0.0 END AS condensed_norm
        FROM embeddings, (SELECT unnest(['both', 'evidence_only', 'condensed_only', 'none']) AS mode)""",
}
