"""Condensation queries: anchors, gating, chunks, fusion, topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import sum_vectors
from ..operators import anchors as an
from ..operators import condense as co
from ..operators import topology as to
from ..operators.ranking import topk_softmax
from ..plans.condensation import condense, select_core
from ..session import materialise
from . import base
from .base import DIM, LINKS, rounded, sql_dot, sql_encode, table
from .graphs import DEGREES, PAGERANK

CONFIG = an.AnchorConfig()


def _core(spark, sf):
    g = base.index(spark, sf)
    return g, *select_core(g, CONFIG)


def motif_neighbours(spark, sf):
    _, _, rows, _ = _core(spark, sf)
    return rows.select("client_id", "anchor_id", "node_type", F.col("rank").cast("int").alias("rank"), "node_id", *rounded("score"))


def core_nodes(spark, sf):
    _, _, _, core = _core(spark, sf)
    return core.select("client_id", "node_id", "node_type", "core_id")


def core_edges(spark, sf):
    g, _, _, core = _core(spark, sf)
    return an.core_edges(core, g.edges)


def _gated(spark, sf):
    g, _, _, core = _core(spark, sf)
    return g, core, materialise(co.gate_neighbours(co.hop_candidates(core, g.neighbours), g.vectors, g.text_vectors))


def gated_neighbours(spark, sf):
    _, _, selection = _gated(spark, sf)
    return selection.select("client_id", "core", "hop", "node_id", F.col("rank").cast("int").alias("rank"), *rounded("score", "weight"))


def gated_context(spark, sf):
    g, _, selection = _gated(spark, sf)
    c = co.gated_context(selection, g.text_vectors, DIM)
    return c.select("client_id", "node_id", F.posexplode("x").alias("i", "value")).select("client_id", "node_id", F.col("i").cast("bigint").alias("i"), *rounded("value"))


def selected_chunks(spark, sf):
    g, _, selection = _gated(spark, sf)
    _, trace = co.select_chunks(selection, g.chunks, g.vectors, DIM)
    return trace.select("client_id", "core", "node_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("rank").cast("int").alias("rank"), *rounded("weight"))


def fused_vectors(spark, sf):
    """Anchor upload: audit ids and layer-normalised fused vectors of the core nodes."""
    g, core, selection = _gated(spark, sf)
    text, _ = co.select_chunks(selection, g.chunks, g.vectors, DIM)
    vectors = g.vectors.select("client_id", "node_id", "x").join(core.select("client_id", "node_id"), ["client_id", "node_id"], "left_semi")
    up = co.assert_numeric_only(co.anchor_upload(core, co.fuse(vectors, text)))
    return up.select("client_id", "core_id", "node_type", "hashed_local_id", F.posexplode("x").alias("i", "value")).select(
        "client_id", "core_id", "node_type", "hashed_local_id", F.col("i").cast("bigint").alias("i"), *rounded("value"))


def pooled_text_vectors(spark, sf):
    """Mean of the window vectors of every passage."""
    from ..operators.encode import chunk_vectors, pooled_vectors

    p = base.corpus(spark, sf).select("client_id", F.col("idx").cast("bigint").alias("node_id"), "text")
    v = pooled_vectors(chunk_vectors(p, base.encoder()), DIM)
    return v.select("node_id", F.posexplode("x").alias("i", "value")).select("node_id", F.col("i").cast("bigint").alias("i"), *rounded("value"))


def mean_vectors(spark, sf):
    """Mean embedding per label."""
    m = sum_vectors(table(spark, sf, "embeddings"), ["label"], "embedding", 64, name="x", mean=True)
    return m.select("label", F.posexplode("x").alias("i", "value")).select("label", F.col("i").cast("bigint").alias("i"), *rounded("value"))


def _vector_nodes(spark, sf):
    """Embeddings as condensed nodes: five labels per client, type by label."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("label") / 5).cast("int").alias("client_id"), F.col("vec_id").alias("node_id"),
        F.pmod("label", F.lit(3)).cast("int").alias("node_type"), F.col("embedding").alias("x"))


def _text_side(nodes):
    """A second vector per node: its vector in reverse order."""
    return nodes.select("client_id", "node_id", F.reverse("x").alias("x"))


def diverse_picks(spark, sf):
    """Greedy diversity selection over the embeddings, scored by their first component."""
    n = _vector_nodes(spark, sf)
    scores = n.select("client_id", "node_id", F.element_at("x", 1).cast("double").alias("score"))
    return an.diverse_entities(scores, n).select("client_id", "node_id", "pick")


def knn_rows(spark, sf):
    return to.knn_rows(_vector_nodes(spark, sf), 8).select("client_id", "i", "j", F.col("rank").cast("int").alias("rank"), *rounded("weight"))


def knn_rows_with_prior(spark, sf):
    n = _vector_nodes(spark, sf)
    return to.knn_rows(n, 8, _text_side(n), 0.3).select("client_id", "i", "j", *rounded("weight"))


def knn_rows_untyped(spark, sf):
    return to.knn_rows(_vector_nodes(spark, sf), 5, preserve_types=False).select("client_id", "i", "j", *rounded("weight"))


def evidence_prior(spark, sf):
    """Scaled text cosine of every kNN pair."""
    n = _vector_nodes(spark, sf)
    pairs = to.knn_rows(n, 8).select("client_id", "i", "j")
    return to.evidence_prior(pairs, _text_side(n)).select("client_id", "i", "j", *rounded("prior"))


def knn_topology(spark, sf):
    """Degree-capped matching over the kNN rows."""
    return to.knn_topology(_vector_nodes(spark, sf), 8).select("client_id", "src", "dst", *rounded("weight"))


def self_expressive_coefficients(spark, sf):
    """Sparse self-expression by iterative shrinkage."""
    n = _vector_nodes(spark, sf)
    z = to.self_expressive_rows(n, _text_side(n), alpha=8.0, beta=0.5, step_size=0.05)
    return z.select("client_id", "i", "j", *rounded("z"))


def topk_event_softmax(spark, sf):
    """Softmax over each user's three largest event values."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return topk_softmax(e, ["user_id"], "value", 3, [F.col("event_id")]).select("user_id", "event_id", F.col("rank").cast("int").alias("rank"), *rounded("weight"))


def condensed_graph_edges(spark, sf):
    """Whole condensation of the document graph to anchor edges."""
    return condense(base.index(spark, sf)).edges.select("client_id", "src", "dst", *rounded("weight"))


QUERIES = {f.__name__: f for f in (
    motif_neighbours, core_nodes, core_edges, gated_neighbours, gated_context, selected_chunks, fused_vectors, pooled_text_vectors, mean_vectors,
    diverse_picks, knn_rows, knn_rows_with_prior, knn_rows_untyped, evidence_prior, knn_topology, self_expressive_coefficients,
    topk_event_softmax, condensed_graph_edges)}

_UNIT = "[x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12) FOR x IN {v}]"


def _cos(a: str, b: str) -> str:
    return f"({sql_dot(a, b)} / (greatest(sqrt({sql_dot(a, a)}), 1e-12) * greatest(sqrt({sql_dot(b, b)}), 1e-12)))"


def _weighted(value: str, weight: str, keys: str, source: str, name: str) -> str:
    """CTE ``name`` (keys, v): per-component weighted sum of list column ``value``."""
    return f"""{name}_c AS (SELECT {keys}, i, sum({weight} * {value}[i]) AS s FROM (SELECT *, unnest(range(1, {DIM} + 1)) AS i FROM {source}) GROUP BY {keys}, i),
{name} AS (SELECT {keys}, list(s ORDER BY i) AS v FROM {name}_c GROUP BY {keys})"""


# one row per client and step of the greedy loop: the best value is picked, the rest move closer to the picks
_CORE = f"""{LINKS.replace('nodes AS (', 'nodes AS MATERIALIZED (').replace('edges AS (', 'edges AS MATERIALIZED (')}, {DEGREES}, {PAGERANK},
nb AS (SELECT DISTINCT client_id, src AS node_id, dst AS neighbour FROM edges),
deg AS (SELECT client_id, node_id, count(*) AS d FROM nb GROUP BY ALL),
{sql_encode('nv', 'nodes', 'text', 'client_id, node_id')},
cv0 AS MATERIALIZED (SELECT b.client_id, b.node_id, round(b.score + 0.5::DOUBLE * r.r, 9) AS score, [x / greatest(sqrt({sql_dot('v.v', 'v.v')}), 1e-12) FOR x IN v.v] AS v,
  greatest(1, ceil(0.05 * count(*) OVER (PARTITION BY b.client_id))) AS k FROM base_score b JOIN r20 r ON r.client_id = b.client_id AND r.ent = b.node_id
  JOIN nv v ON v.client_id = b.client_id AND v.node_id = b.node_id),
arrays AS MATERIALIZED (SELECT client_id, any_value(k) AS k, list(node_id ORDER BY node_id) AS ids, list(score ORDER BY node_id) AS scores, list(v ORDER BY node_id) AS vs FROM cv0 GROUP BY client_id),
loop AS (
  SELECT client_id, 0 AS step, list_position(scores, list_max(scores)) AS best, [0.0::DOUBLE FOR x IN scores] AS nearest FROM arrays
  UNION ALL
  SELECT client_id, step, list_position(vals, list_max(vals)), nearest FROM (
    SELECT client_id, step, nearest, list_transform(list_zip(scores, nearest), lambda x: round(x[1] - 0.3::DOUBLE * x[2], 9)) AS vals FROM (
      SELECT a.client_id, l.step + 1 AS step, a.scores, list_transform(list_zip(l.nearest, a.vs), lambda x, i: CASE WHEN i = l.best THEN 1e18::DOUBLE ELSE greatest(x[1], list_dot_product(x[2], a.vs[l.best])) END) AS nearest
      FROM loop l JOIN arrays a ON a.client_id = l.client_id WHERE l.step + 1 < a.k))),
selected AS MATERIALIZED (SELECT l.client_id, a.ids[l.best] AS node_id, l.step AS pick FROM loop l JOIN arrays a ON a.client_id = l.client_id),
near AS (SELECT n.client_id, n.node_id, v.v FROM nb n JOIN selected s ON s.client_id = n.client_id AND s.node_id = n.neighbour
  JOIN nv v ON v.client_id = n.client_id AND v.node_id = n.neighbour),
mentions_n AS (SELECT client_id, node_id, count(*) AS m FROM near GROUP BY ALL),
{_weighted('v', '1', 'client_id, node_id', 'near', 'centre')},
nscore AS (SELECT m.client_id, m.node_id, t.node_type, m.m + 0.1::DOUBLE * d.d + {_cos('x.v', 'c.v')} AS score
  FROM mentions_n m JOIN centre c ON c.client_id = m.client_id AND c.node_id = m.node_id JOIN nv x ON x.client_id = m.client_id AND x.node_id = m.node_id
  JOIN deg d ON d.client_id = m.client_id AND d.node_id = m.node_id JOIN nodes t ON t.client_id = m.client_id AND t.node_id = m.node_id AND t.node_type > 0),
motifs AS (SELECT * FROM (SELECT b.client_id, b.node_id AS anchor_id, s.pick, n.node_type, n.node_id, n.score,
    row_number() OVER (PARTITION BY b.client_id, b.node_id, n.node_type ORDER BY round(n.score, 9) DESC, n.node_id) AS rank
  FROM nb b JOIN selected s ON s.client_id = b.client_id AND s.node_id = b.node_id
  JOIN nscore n ON n.client_id = b.client_id AND n.node_id = b.neighbour) WHERE rank <= 3),
places AS (SELECT client_id, node_id, pick, 0 AS part, 0 AS rank FROM selected UNION ALL SELECT client_id, node_id, pick, node_type, rank FROM motifs),
core AS (SELECT client_id, node_id, row_number() OVER (PARTITION BY client_id ORDER BY pick, part, rank) - 1 AS core_id FROM (
  SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY client_id, node_id ORDER BY pick, part, rank) = 1))"""

_GATED = f"""{_CORE},
chunk_src AS (SELECT client_id, node_id, chunk_id, array_to_string(w[chunk_id * 64 + 1 : chunk_id * 64 + 64], ' ') AS text FROM (
  SELECT client_id, node_id, w, unnest(range(greatest(CAST(ceil(len(w) / 64.0) AS BIGINT), 1))) AS chunk_id FROM (
    SELECT client_id, node_id, string_split({base.sql_squeeze('text')}, ' ') AS w FROM nodes))),
{sql_encode('cv', 'chunk_src', 'text', 'client_id, node_id, chunk_id')},
chunk_n AS (SELECT client_id, node_id, count(*) AS n FROM cv GROUP BY ALL),
tv_src AS (SELECT c.client_id, c.node_id, c.v, n.n FROM cv c JOIN chunk_n n ON n.client_id = c.client_id AND n.node_id = c.node_id),
{_weighted('v', '(1.0::DOUBLE / n)', 'client_id, node_id', 'tv_src', 'tv')},
two AS (SELECT DISTINCT c.client_id, c.node_id AS core, b.neighbour AS node_id FROM core c JOIN nb a ON a.client_id = c.client_id AND a.node_id = c.node_id
  JOIN nb b ON b.client_id = c.client_id AND b.node_id = a.neighbour WHERE b.neighbour <> c.node_id),
cand AS (
  SELECT client_id, node_id AS core, 0 AS hop, node_id FROM core
  UNION ALL SELECT c.client_id, c.node_id, 1, n.neighbour FROM core c JOIN nb n ON n.client_id = c.client_id AND n.node_id = c.node_id
  UNION ALL SELECT client_id, core, 2, node_id FROM (
    SELECT t.*, row_number() OVER (PARTITION BY t.client_id, t.core ORDER BY d.d, t.node_id) AS rn FROM two t JOIN deg d ON d.client_id = t.client_id AND d.node_id = t.node_id) WHERE rn <= 8),
cand_g AS MATERIALIZED (SELECT c.*, g.v AS gv FROM cand c JOIN nv g ON g.client_id = c.client_id AND g.node_id = c.core),
scored AS MATERIALIZED (SELECT c.client_id, c.core, c.hop, c.node_id, {_cos('c.gv', 't.v')} AS score FROM cand_g c
  JOIN tv t ON t.client_id = c.client_id AND t.node_id = c.node_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, core, hop ORDER BY round(score, 9) DESC, node_id) AS rank FROM scored) WHERE rank <= [1, 3, 2][hop + 1]),
gate AS MATERIALIZED (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY client_id, core, hop) AS weight FROM kept)"""

_CHUNKS = f"""{_GATED},
gate_g AS MATERIALIZED (SELECT g.client_id, g.core, g.node_id, x.v AS gv FROM gate g JOIN nv x ON x.client_id = g.client_id AND x.node_id = g.core),
cs AS MATERIALIZED (SELECT g.client_id, g.core, g.node_id, c.chunk_id, c.v, {sql_dot('c.v', 'g.gv')} / sqrt({DIM}.0::DOUBLE) AS score
  FROM gate_g g JOIN cv c ON c.client_id = g.client_id AND c.node_id = g.node_id),
ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, core ORDER BY round(score, 9) DESC, node_id, chunk_id) AS rank FROM cs) WHERE rank <= 8),
chosen AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY client_id, core) AS weight FROM ck)"""

_VN = """vn AS (SELECT CAST(label // 5 AS INTEGER) AS client_id, vec_id AS node_id, label % 3 AS node_type, embedding::DOUBLE[] AS e FROM embeddings),
un AS (SELECT client_id, node_id, node_type, [x / greatest(sqrt(list_dot_product(e, e)), 1e-12) FOR x IN e] AS v FROM vn),
pair AS (SELECT a.client_id, a.node_id AS i, b.node_id AS j, a.node_type AS ti, b.node_type AS tj, list_dot_product(a.v, b.v) AS c,
  list_dot_product(list_reverse(a.v), list_reverse(b.v)) AS tc FROM un a JOIN un b ON b.client_id = a.client_id),
span AS (SELECT client_id, min(CASE WHEN i = j THEN 0 ELSE tc END) AS lo, max(CASE WHEN i = j THEN 0 ELSE tc END) AS hi FROM pair GROUP BY ALL)"""


def _knn(weight: str, k: int, mask: str) -> str:
    order = "c" if weight == "(c + 1) / 2" else "weight"
    return f"""{_VN}, w AS (SELECT p.client_id, i, j, c, {weight} AS weight FROM pair p JOIN span s ON s.client_id = p.client_id WHERE i <> j AND {mask}),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, i ORDER BY round({order}, 9) DESC, j) AS rank FROM w) WHERE rank <= {k} AND weight > 0)"""


_TYPED = "(ti = 0) <> (tj = 0)"


def _matching(source: str, k: int) -> str:
    """CTE ``matched`` (client_id, i, j, weight): one scan per client over the pairs of ``source`` (client_id, i, j, weight) in falling weight."""
    return f"""sym AS (SELECT client_id, least(i, j) AS i, greatest(i, j) AS j, max(weight) AS weight FROM {source} WHERE i <> j GROUP BY ALL HAVING max(weight) > 0),
place AS (SELECT client_id, node, row_number() OVER (PARTITION BY client_id ORDER BY node) AS p FROM (SELECT client_id, i AS node FROM sym UNION SELECT client_id, j FROM sym)),
rows_in AS (SELECT s.client_id, s.i, s.j, s.weight, a.p AS a, b.p AS b, row_number() OVER (PARTITION BY s.client_id ORDER BY round(s.weight, 9) DESC, s.i, s.j) AS n
  FROM sym s JOIN place a ON a.client_id = s.client_id AND a.node = s.i JOIN place b ON b.client_id = s.client_id AND b.node = s.j),
lists AS MATERIALIZED (SELECT r.client_id, list(a ORDER BY n) AS la, list(b ORDER BY n) AS lb, count(*) AS m, (SELECT max(p) FROM place q WHERE q.client_id = r.client_id) AS nodes FROM rows_in r GROUP BY r.client_id),
scan(client_id, n, room, good) USING KEY (client_id) AS (
  SELECT client_id, 0::BIGINT, [{k} FOR x IN range(nodes)], [0::BIGINT] FROM lists
  UNION
  SELECT s.client_id, s.n + 1, CASE WHEN s.room[l.la[s.n + 1]] > 0 AND s.room[l.lb[s.n + 1]] > 0
      THEN list_transform(s.room, lambda x, p: CASE WHEN p = l.la[s.n + 1] OR p = l.lb[s.n + 1] THEN x - 1 ELSE x END) ELSE s.room END,
    CASE WHEN s.room[l.la[s.n + 1]] > 0 AND s.room[l.lb[s.n + 1]] > 0 THEN list_append(s.good, s.n + 1) ELSE s.good END
  FROM scan s JOIN lists l ON l.client_id = s.client_id WHERE s.n < l.m),
matched AS (SELECT r.client_id, r.i, r.j, r.weight FROM (SELECT client_id, unnest(good) AS n FROM scan) g JOIN rows_in r ON r.client_id = g.client_id AND r.n = g.n)"""


_EDGES = "SELECT client_id, i AS src, j AS dst, round(weight, 6) + 0.0 AS weight FROM matched UNION ALL SELECT client_id, j, i, round(weight, 6) + 0.0 FROM matched"


def _greedy(steps: int) -> str:
    ctes = ["p0 AS (SELECT client_id, node_id, round(e[1], 9) AS score, v, 0.0::DOUBLE AS nearest, CAST(NULL AS BIGINT) AS pick, greatest(1, ceil(0.05 * count(*) OVER (PARTITION BY client_id))) AS k "
            "FROM (SELECT vn.client_id, vn.node_id, e, v FROM vn JOIN un ON un.client_id = vn.client_id AND un.node_id = vn.node_id))"]
    for n in range(steps):
        ctes.append(f"""b{n} AS (SELECT * FROM p{n} WHERE pick IS NULL AND {n} < k QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY round(score - 0.3::DOUBLE * nearest, 9) DESC, node_id) = 1),
p{n + 1} AS MATERIALIZED (SELECT p.client_id, p.node_id, p.score, p.v, CASE WHEN b.v IS NULL THEN p.nearest ELSE greatest(p.nearest, list_dot_product(p.v, b.v)) END AS nearest,
  CASE WHEN b.node_id = p.node_id THEN {n} ELSE p.pick END AS pick, p.k FROM p{n} p LEFT JOIN b{n} b ON b.client_id = p.client_id)""")
    return ",\n".join(ctes)


_FUSED = f"""{_CHUNKS}, {_weighted('v', 'weight', 'client_id, core', 'chosen', 'tt')},
core_n AS MATERIALIZED (SELECT c.*, n.node_type FROM core c JOIN nodes n ON n.client_id = c.client_id AND n.node_id = c.node_id),
core_g AS MATERIALIZED (SELECT c.*, g.v AS gv FROM core_n c JOIN nv g ON g.client_id = c.client_id AND g.node_id = c.node_id),
mixed AS (SELECT c.client_id, c.core_id, c.node_type, (c.node_id * 1103515245 + 12345) % 2147483647 AS hashed_local_id,
  [c.gv[k] + 0.5::DOUBLE * t.v[k] FOR k IN range(1, {DIM} + 1)] AS m FROM core_g c JOIN tt t ON t.client_id = c.client_id AND t.core = c.node_id),
cent AS (SELECT client_id, core_id, node_type, hashed_local_id, [x - list_avg(m) FOR x IN m] AS d FROM mixed),
fused AS MATERIALIZED (SELECT client_id, core_id, node_type, hashed_local_id, [x / sqrt(list_dot_product(d, d) / {DIM} + 1e-5) FOR x IN d] AS v FROM cent)"""

SQL = {
    "motif_neighbours": f"WITH RECURSIVE {_CORE} SELECT client_id, anchor_id, node_type, CAST(rank AS INTEGER) AS rank, node_id, round(score, 6) + 0.0 AS score FROM motifs",
    "core_nodes": f"WITH RECURSIVE {_CORE} SELECT c.client_id, c.node_id, n.node_type, c.core_id FROM core c JOIN nodes n ON n.client_id = c.client_id AND n.node_id = c.node_id",
    "core_edges": f"""WITH RECURSIVE {_CORE} SELECT DISTINCT e.client_id, a.core_id AS src, b.core_id AS dst FROM edges e
        JOIN core a ON a.client_id = e.client_id AND a.node_id = e.src JOIN core b ON b.client_id = e.client_id AND b.node_id = e.dst""",
    "gated_neighbours": f"WITH RECURSIVE {_GATED} SELECT client_id, core, hop, node_id, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score, round(weight, 6) AS weight FROM gate",
    "gated_context": f"""WITH RECURSIVE {_GATED}, gsrc AS (SELECT g.client_id, g.core AS node_id, t.v, g.weight * [0.4, 0.4, 0.2][g.hop + 1]::DOUBLE AS w FROM gate g
          JOIN tv t ON t.client_id = g.client_id AND t.node_id = g.node_id), {_weighted('v', 'w', 'client_id, node_id', 'gsrc', 'ctx')}
        SELECT client_id, node_id, unnest(range({DIM})) AS i, round(unnest(v), 6) + 0.0 AS value FROM ctx""",
    "selected_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT client_id, core, node_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(weight, 6) AS weight FROM chosen",
    "fused_vectors": f"""WITH RECURSIVE {_FUSED}
        SELECT client_id, core_id, node_type, hashed_local_id, unnest(range({DIM})) AS i, round(unnest(v), 6) + 0.0 AS value FROM fused""",
    "condensed_graph_edges": f"""WITH RECURSIVE {_FUSED},
        fu AS MATERIALIZED (SELECT client_id, core_id, node_type, [x / greatest(sqrt(list_dot_product(v, v)), 1e-12) FOR x IN v] AS v FROM fused),
        pw AS (SELECT a.client_id, a.core_id AS i, b.core_id AS j, list_dot_product(a.v, b.v) AS c FROM fu a JOIN fu b ON b.client_id = a.client_id AND (a.node_type = 0) <> (b.node_type = 0)),
        knn AS (SELECT client_id, i, j, (c + 1) / 2 AS weight FROM pw WHERE c > -1 QUALIFY row_number() OVER (PARTITION BY client_id, i ORDER BY round(c, 9) DESC, j) <= 8),
        {_matching('knn', 8)} {_EDGES}""",
    "pooled_text_vectors": f"""WITH {base.PASSAGES}, chunk_src AS (SELECT idx AS node_id, chunk_id, array_to_string(w[chunk_id * 64 + 1 : chunk_id * 64 + 64], ' ') AS text FROM (
          SELECT idx, w, unnest(range(greatest(CAST(ceil(len(w) / 64.0) AS BIGINT), 1))) AS chunk_id FROM (SELECT idx, string_split({base.sql_squeeze('text')}, ' ') AS w FROM passages)) t),
        {sql_encode('cv', 'chunk_src', 'text', 'node_id, chunk_id')}
        SELECT node_id, i - 1 AS i, round(avg(v[i]), 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, {DIM} + 1)) AS i FROM cv) GROUP BY node_id, i""",
    "mean_vectors": "SELECT label, i - 1 AS i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i",
    "diverse_picks": f"WITH {_VN.split('pair AS')[0].rstrip().rstrip(',')}, {_greedy(16)} SELECT client_id, node_id, pick FROM p16 WHERE pick IS NOT NULL",
    "knn_rows": f"WITH {_knn('(c + 1) / 2', 8, _TYPED)} SELECT client_id, i, j, CAST(rank AS INTEGER) AS rank, round(weight, 6) + 0.0 AS weight FROM knn",
    "knn_rows_with_prior": f"WITH {_knn('(c + 1) / 2 + 0.3::DOUBLE * (tc - lo) / (hi - lo + 1e-8)', 8, _TYPED)} SELECT client_id, i, j, round(weight, 6) + 0.0 AS weight FROM knn",
    "knn_rows_untyped": f"WITH {_knn('(c + 1) / 2', 5, 'TRUE')} SELECT client_id, i, j, round(weight, 6) + 0.0 AS weight FROM knn",
    "evidence_prior": f"""WITH {_knn('(c + 1) / 2', 8, _TYPED)} SELECT k.client_id, k.i, k.j, round((p.tc - s.lo) / (s.hi - s.lo + 1e-8), 6) + 0.0 AS prior
        FROM knn k JOIN pair p ON p.client_id = k.client_id AND p.i = k.i AND p.j = k.j JOIN span s ON s.client_id = k.client_id""",
    "knn_topology": f"WITH RECURSIVE {_knn('(c + 1) / 2', 8, _TYPED)}, {_matching('knn', 8)} {_EDGES}",
    "self_expressive_coefficients": f"""WITH RECURSIVE {_VN},
        typed AS (SELECT p.client_id, i, j, tc, list_dot_product(a.e, b.e) AS d FROM pair p JOIN vn a ON a.client_id = p.client_id AND a.node_id = i JOIN vn b ON b.client_id = p.client_id AND b.node_id = j WHERE {_TYPED}),
        sup AS MATERIALIZED (SELECT t.client_id, i, j, d, 0.05::DOUBLE * (0.0625::DOUBLE + 0.125::DOUBLE * (1 - (tc - lo) / (hi - lo + 1e-8))) AS tau FROM (
          SELECT *, row_number() OVER (PARTITION BY client_id, i ORDER BY round(d, 9) DESC, j) AS a, row_number() OVER (PARTITION BY client_id, i ORDER BY round(tc, 9) DESC, j) AS b FROM typed) t
          JOIN span s ON s.client_id = t.client_id WHERE a <= 16 OR b <= 16),
        gram AS (SELECT a.client_id, a.i, a.j, list(list_dot_product(x.e, y.e) ORDER BY b.j) AS g FROM sup a JOIN sup b ON b.client_id = a.client_id AND b.i = a.i
          JOIN vn x ON x.client_id = a.client_id AND x.node_id = a.j JOIN vn y ON y.client_id = b.client_id AND y.node_id = b.j GROUP BY ALL),
        held AS MATERIALIZED (SELECT s.client_id, s.i, list(s.j ORDER BY s.j) AS js, list(s.d ORDER BY s.j) AS ds, list(s.tau ORDER BY s.j) AS taus, list(g.g ORDER BY s.j) AS gs FROM sup s
          JOIN gram g ON g.client_id = s.client_id AND g.i = s.i AND g.j = s.j GROUP BY ALL),
        walk(client_id, i, step, z) USING KEY (client_id, i) AS (
          SELECT client_id, i, 0, [0.0::DOUBLE FOR x IN js] FROM held
          UNION
          SELECT client_id, i, step + 1, list_transform(list_zip(u, taus), lambda x: sign(x[1]) * greatest(abs(x[1]) - x[2], 0)) FROM (
            SELECT w.client_id, w.i, w.step, h.taus, list_transform(list_zip(w.z, h.gs, h.ds), lambda x: x[1] - 0.05::DOUBLE * (list_dot_product(x[2], w.z) - x[3])) AS u
            FROM walk w JOIN held h ON h.client_id = w.client_id AND h.i = w.i WHERE w.step < 50))
        SELECT client_id, i, j, round(z, 6) + 0.0 AS z FROM (SELECT w.client_id, w.i, unnest(h.js) AS j, unnest(w.z) AS z FROM walk w JOIN held h ON h.client_id = w.client_id AND h.i = w.i)""",
    "topk_event_softmax": """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id) AS rank FROM events),
        t AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM r WHERE rank <= 3)
        SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank, round(exp(value - m) / sum(exp(value - m)) OVER (PARTITION BY user_id), 6) AS weight FROM t""",
}
