"""Question retrieval queries: benchmark texts as questions over the document graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import sum_vectors
from ..operators import evidence as ev
from ..operators import passages as ps
from ..operators import propagate as pr
from ..operators.recognise import question_mentions
from ..operators.similarity import top_k_dot
from ..plans.retrieval import RetrievalConfig, Retriever, merge_clients
from ..session import materialise
from . import base
from .base import CLIENTS, DIM, NODES, rounded, sql_dot, sql_encode, sql_sentences, sql_strip, table
from .graphs import TRANSITIONS

SQL_STEPS = 44  # of the SQL: halving the distance to the limit 44 times leaves less than 1e-13


def _retriever(spark, sf, mode="parallel", boost=False):
    r = Retriever(base.encoder(), DIM, CLIENTS, RetrievalConfig(mode=mode, attribute_boost=boost))
    r.index(base.corpus(spark, sf))
    return r


def _question_vectors(spark, sf):
    return base.questions(spark, sf).select("qid", "question", base.encoder()(F.col("question")).alias("x"))


def question_entities(spark, sf):
    return question_mentions(base.questions(spark, sf))


def seed_entities(spark, sf):
    return _retriever(spark, sf).seeds(base.questions(spark, sf)).select("client_id", "qid", "mention", "entity_id", *rounded("score", digits=9))


def dense_passages(spark, sf):
    """Ten closest passages per client and question, the score min-max scaled over all passages of the client."""
    r = _retriever(spark, sf)
    q = _question_vectors(spark, sf).withColumn("client_id", F.explode(F.array(*[F.lit(c) for c in range(CLIENTS)])))
    v = r.graph.passages.select("client_id", "passage_id", base.encoder()(F.col("text")).alias("x"))
    best = top_k_dot(q, v, 10, query_key="qid", vector_key="passage_id").withColumn("score", F.round("score", 9))
    away = q.select("client_id", "qid", F.transform("x", lambda x: -x).alias("x"))  # the farthest passage gives the least score
    least = top_k_dot(away, v, 1, query_key="qid", vector_key="passage_id").select("client_id", "qid", F.round(-F.col("score"), 9).alias("lo"))
    most = best.where("rank = 1").select("client_id", "qid", F.col("score").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("scaled")
    spanned = best.join(least, ["client_id", "qid"]).join(most, ["client_id", "qid"]).select("client_id", "qid", "passage_id", "rank", "score", scaled)
    return spanned.select("client_id", "qid", "passage_id", "rank", "score", *rounded("scaled"))


def _spread(spark, sf, mode):
    r = _retriever(spark, sf, mode)
    seeds = materialise(r.seeds(base.questions(spark, sf)))
    return r, r.spread(seeds, _question_vectors(spark, sf).select("qid", "x"))


def spread_weights(spark, sf):
    _, (weights, _) = _spread(spark, sf, "parallel")
    return weights.select("client_id", "qid", "entity_id", *rounded("weight"))


def activated_entities(spark, sf):
    _, (_, activated) = _spread(spark, sf, "parallel")
    return activated.select("client_id", "qid", "entity_id", F.col("tier").cast("int").alias("tier"), *rounded("score"))


def activated_entities_ordered(spark, sf):
    """Sequential mode: a sentence taken by an earlier entity is gone for later ones."""
    _, (_, activated) = _spread(spark, sf, "ordered")
    return activated.select("client_id", "qid", "entity_id", F.col("tier").cast("int").alias("tier"), *rounded("score"))


def passage_entity_bonus(spark, sf):
    r, (_, activated) = _spread(spark, sf, "parallel")
    bonus = ps.entity_bonus(activated, r.graph.entity_texts, r.graph.passages)
    return bonus.select("client_id", "qid", "node", *rounded("bonus"))


def ranked_passages(spark, sf):
    """Full retrieval: seeds, spreading, passage weights, personalised PageRank, top five per client."""
    ranked, _ = _retriever(spark, sf).retrieve(base.questions(spark, sf))
    return ranked.select("client_id", "qid", "passage_id", "rank", *rounded("score", digits=9))


def ranked_passages_boosted(spark, sf):
    """The same with the keyword boost for attribute questions."""
    ranked, _ = _retriever(spark, sf, boost=True).retrieve(base.questions(spark, sf))
    return ranked.select("client_id", "qid", "passage_id", "rank", *rounded("score", digits=9))


def ranked_passages_ordered(spark, sf):
    """Full retrieval with sequential spreading."""
    ranked, _ = _retriever(spark, sf, "ordered").retrieve(base.questions(spark, sf))
    return ranked.select("client_id", "qid", "passage_id", "rank", *rounded("score", digits=9))


def federated_ranking(spark, sf):
    """Best five passages of a question over all clients."""
    ranked, _ = _retriever(spark, sf).retrieve(base.questions(spark, sf))
    return merge_clients(ranked, 5).select("qid", "client_id", "passage_id", "rank")


def evidence_graph_edges(spark, sf):
    """Relabelled induced edges around the activated entities and the five best ranked passages."""
    r = _retriever(spark, sf)
    _, edges = r.evidence(*r.retrieve(base.questions(spark, sf)))
    return edges.select("client_id", "qid", "src", "dst", "edge_type")


def anchor_map(spark, sf):
    """Slots of the five best ranked passages matched to graph nodes by title."""
    r = _retriever(spark, sf)
    ranked, _ = r.retrieve(base.questions(spark, sf))
    return r.anchor_map(ranked)


def _global_graph(spark, sf):
    """Embeddings as the global graph: neighbouring vector ids are linked; the mean vector of every label is a query."""
    e = table(spark, sf, "embeddings").select(F.lit(0).alias("graph_id"), F.col("vec_id").alias("node_id"), F.pmod("label", F.lit(3)).alias("node_type"), F.col("embedding").alias("x"))
    ids = table(spark, sf, "embeddings").select("vec_id")
    edges = ids.select("vec_id", F.explode(F.array(F.lit(1), F.lit(7))).alias("step")).join(
        ids.select(F.col("vec_id").alias("dst")), F.col("vec_id") + F.col("step") == F.col("dst")).select(
        F.lit(0).alias("graph_id"), F.col("vec_id").alias("src"), "dst", F.lit(1.0).alias("weight"))
    means = sum_vectors(table(spark, sf, "embeddings"), ["label"], "embedding", 64, mean=True)
    queries = means.select(F.lit(0).alias("graph_id"), F.col("label").alias("qid"), "x")
    return queries, e, edges


def global_seeds(spark, sf):
    q, n, _ = _global_graph(spark, sf)
    return ev.global_seeds(q, n, 16).select("qid", "node_id", "rank", *rounded("score"))


def global_subgraph(spark, sf):
    q, n, e = _global_graph(spark, sf)
    _, _, edges = ev.global_subgraph(q, n, e, top_r=4)
    return edges.select("qid", "src", "dst", "weight")


def global_subgraph_capped(spark, sf):
    q, n, e = _global_graph(spark, sf)
    _, kept, _ = ev.global_subgraph(q, n, e, top_r=4, max_nodes=10)
    return kept.select("qid", "node_id", "local_id", F.col("node_type").cast("int").alias("node_type"))


QUERIES = {f.__name__: f for f in (
    question_entities, seed_entities, dense_passages, spread_weights, activated_entities, activated_entities_ordered, passage_entity_bonus,
    ranked_passages, ranked_passages_boosted, ranked_passages_ordered, federated_ranking, evidence_graph_edges, anchor_map,
    global_seeds, global_subgraph, global_subgraph_capped)}

_Q_MENTIONS = f"""q_raw AS (
  SELECT qid, unnest(regexp_extract_all(sentence, '{base.SQL_MENTION}', 1)) AS entity FROM (
    SELECT item_id AS qid, {sql_strip('s')} AS sentence FROM (SELECT item_id, unnest({sql_sentences('text')}) AS s FROM benchmark))),
q_men AS (SELECT DISTINCT qid, lower(entity) AS entity FROM q_raw WHERE entity NOT IN ({base.SQL_STOP}) AND NOT regexp_matches(entity, '^\\d+(st|nd|rd|th)?$'))"""

_QVEC = f"bq AS (SELECT item_id AS qid, text FROM benchmark), {sql_encode('qv', 'bq', 'text', 'qid')}"

_SEEDS = f"""{NODES}, {_Q_MENTIONS},
ent_src AS (SELECT client_id, hash_id, text FROM nodes WHERE node_type = 0),
{sql_encode('qe', 'q_men', 'entity', 'qid, entity')},
{sql_encode('en', 'ent_src', 'text', 'client_id, hash_id')},
sim AS (SELECT n.client_id, q.qid, q.entity AS mention, n.hash_id AS entity_id, round({sql_dot('q.v', 'n.v')}, 9) AS score FROM qe q, en n),
seeds AS (SELECT client_id, qid, mention, entity_id, score FROM sim
  QUALIFY row_number() OVER (PARTITION BY client_id, qid, mention ORDER BY score DESC, entity_id) = 1)"""


def _hop(n: int, source: str, used: str) -> str:
    anti = f"AND (r.client_id, r.qid, r.sentence_id) NOT IN (SELECT client_id, qid, sentence_id FROM {used})" if used else ""
    return f"""reach{n} AS (
  SELECT a.client_id, a.qid, a.entity_id, a.score, l.sentence_id, round({sql_dot('s.v', 'q.v')}, 9) AS sim
  FROM {source} a JOIN inc l ON l.client_id = a.client_id AND l.entity_id = a.entity_id
  JOIN sv s ON s.client_id = l.client_id AND s.hash_id = l.sentence_id JOIN qv q ON q.qid = a.qid WHERE a.score >= 0.5),
open{n} AS (SELECT * FROM reach{n} r WHERE TRUE {anti}),
pick{n} AS (SELECT DISTINCT client_id, qid, sentence_id FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id, qid, entity_id ORDER BY sim DESC, sentence_id) AS rn FROM open{n}) WHERE rn <= 1),
carry{n} AS (SELECT o.client_id, o.qid, o.sentence_id, sum(o.score) * max(o.sim) AS c FROM open{n} o
  JOIN pick{n} p ON p.client_id = o.client_id AND p.qid = o.qid AND p.sentence_id = o.sentence_id GROUP BY ALL HAVING sum(o.score) * max(o.sim) > 0),
cur{n} AS (SELECT c.client_id, c.qid, l.entity_id, sum(c.c) AS score FROM carry{n} c
  JOIN inc l ON l.client_id = c.client_id AND l.sentence_id = c.sentence_id GROUP BY ALL)"""


_SPREAD = f"""{_SEEDS}, {_QVEC},
sent_src AS (SELECT client_id, hash_id, text FROM nodes WHERE node_type = 1),
{sql_encode('sv', 'sent_src', 'text', 'client_id, hash_id')},
inc AS (SELECT DISTINCT client_id, 'entity-' || md5(entity) AS entity_id, 'sentence-' || md5(sentence) AS sentence_id FROM mentions),
uniq AS (SELECT client_id, qid, entity_id, arg_max(score, mention) AS score, sum(score) AS total FROM seeds GROUP BY ALL),
cur0 AS (SELECT client_id, qid, entity_id, total AS score FROM uniq),
{_hop(1, 'cur0', '')},
{_hop(2, 'cur1', 'pick1')},
spread_weights AS (SELECT client_id, qid, entity_id, sum(w) AS weight FROM (
  SELECT client_id, qid, entity_id, score AS w FROM uniq UNION ALL SELECT client_id, qid, entity_id, score FROM cur1
  UNION ALL SELECT client_id, qid, entity_id, score FROM cur2) GROUP BY ALL),
activated AS (SELECT * FROM (
  SELECT client_id, qid, entity_id, score, 0 AS tier FROM uniq UNION ALL SELECT client_id, qid, entity_id, score, 1 FROM cur1 WHERE score >= 0.5
  UNION ALL SELECT client_id, qid, entity_id, score, 2 FROM cur2 WHERE score >= 0.5)
  QUALIFY row_number() OVER (PARTITION BY client_id, qid, entity_id ORDER BY tier DESC) = 1)"""

def _visit(n: int, used: str) -> str:
    """One hop in order: entities take their best free sentence one after the other."""
    anti = f"AND (l.client_id, a.qid, l.sentence_id) NOT IN (SELECT client_id, qid, sentence_id FROM {used})" if used else ""
    return f"""act{n} AS MATERIALIZED (SELECT client_id, qid, entity_id, score, row_number() OVER (PARTITION BY client_id, qid ORDER BY place) AS place FROM go{n} WHERE score >= 0.5),
free{n} AS MATERIALIZED (SELECT a.client_id, a.qid, a.place, a.score, l.sentence_id, round({sql_dot('s.v', 'q.v')}, 9) AS sim FROM act{n} a JOIN inc l ON l.client_id = a.client_id AND l.entity_id = a.entity_id
  JOIN sv s ON s.client_id = l.client_id AND s.hash_id = l.sentence_id JOIN qv q ON q.qid = a.qid WHERE TRUE {anti}),
wish{n} AS MATERIALIZED (SELECT client_id, qid, place, list(sentence_id ORDER BY sim DESC, sentence_id) AS wishes FROM free{n} GROUP BY ALL),
walk{n}(client_id, qid, place, gone, picks) USING KEY (client_id, qid) AS (
  SELECT DISTINCT client_id, qid, 0::BIGINT, []::VARCHAR[], []::VARCHAR[] FROM act{n}
  UNION
  SELECT w.client_id, w.qid, w.place + 1, CASE WHEN f.pick IS NULL THEN w.gone ELSE list_append(w.gone, f.pick) END, list_append(w.picks, f.pick)
  FROM walk{n} w JOIN (SELECT a.client_id, a.qid, a.place, v.qid AS has, list_filter(h.wishes, lambda x: NOT list_contains(v.gone, x))[1] AS pick FROM act{n} a
    JOIN walk{n} v ON v.client_id = a.client_id AND v.qid = a.qid AND a.place = v.place + 1
    LEFT JOIN wish{n} h ON h.client_id = a.client_id AND h.qid = a.qid AND h.place = a.place) f ON f.client_id = w.client_id AND f.qid = w.qid AND f.place = w.place + 1),
took{n} AS MATERIALIZED (SELECT w.client_id, w.qid, f.place, f.sentence_id, f.score * f.sim AS score FROM walk{n} w JOIN free{n} f ON f.client_id = w.client_id AND f.qid = w.qid AND w.picks[f.place] = f.sentence_id),
trig{n} AS (SELECT t.client_id, t.qid, l.entity_id, t.score, t.place FROM took{n} t JOIN inc l ON l.client_id = t.client_id AND l.sentence_id = t.sentence_id WHERE t.score >= 0.5),
sum{n} AS MATERIALIZED (SELECT client_id, qid, entity_id, sum(score) AS weight, arg_max(score, place) AS score, min(place) AS first FROM trig{n} GROUP BY ALL)"""


_ORDERED = f"""{_SEEDS}, {_QVEC},
sent_src AS (SELECT client_id, hash_id, text FROM nodes WHERE node_type = 1),
{sql_encode('sv', 'sent_src', 'text', 'client_id, hash_id')},
inc AS (SELECT DISTINCT client_id, 'entity-' || md5(entity) AS entity_id, 'sentence-' || md5(sentence) AS sentence_id FROM mentions),
uniq AS (SELECT client_id, qid, entity_id, arg_max(score, mention) AS score, min(mention) AS position FROM seeds GROUP BY ALL),
go1 AS (SELECT client_id, qid, entity_id, score, row_number() OVER (PARTITION BY client_id, qid ORDER BY position, entity_id) AS place FROM uniq),
{_visit(1, '')},
go2 AS (SELECT client_id, qid, entity_id, score, row_number() OVER (PARTITION BY client_id, qid ORDER BY first, entity_id) AS place FROM sum1),
{_visit(2, 'took1')},
spread_weights AS (SELECT client_id, qid, entity_id, sum(w) AS weight FROM (
  SELECT client_id, qid, entity_id, score AS w FROM uniq UNION ALL SELECT client_id, qid, entity_id, weight FROM sum1 UNION ALL SELECT client_id, qid, entity_id, weight FROM sum2) GROUP BY ALL),
activated AS (SELECT * FROM (SELECT client_id, qid, entity_id, score, 1 AS tier FROM uniq UNION ALL SELECT client_id, qid, entity_id, score, 2 FROM sum1 UNION ALL SELECT client_id, qid, entity_id, score, 3 FROM sum2)
  QUALIFY row_number() OVER (PARTITION BY client_id, qid, entity_id ORDER BY tier DESC) = 1)"""

_NAMED = """named AS (SELECT a.*, lower(n.text) AS needle FROM activated a JOIN nodes n ON n.client_id = a.client_id AND n.hash_id = a.entity_id),
needles AS (SELECT DISTINCT client_id, needle FROM named),
occ AS (SELECT p.client_id, p.passage_id, n.needle,
    CAST((length(lower(p.text)) - length(replace(lower(p.text), n.needle, ''))) / length(n.needle) AS BIGINT) AS k
  FROM passages p JOIN needles n ON n.client_id = p.client_id WHERE contains(lower(p.text), n.needle)),
bonus AS (SELECT o.client_id, a.qid, o.passage_id AS node, sum(a.score * ln(1 + o.k) / greatest(a.tier, 1)) AS bonus
  FROM occ o JOIN named a ON a.client_id = o.client_id AND a.needle = o.needle GROUP BY ALL)"""
_BONUS = f"{_SPREAD},\n{_NAMED}"

_DENSE = f"""{sql_encode('pv', 'passages', 'text', 'client_id, passage_id')},
dense AS (SELECT p.client_id, q.qid, p.passage_id, round({sql_dot('p.v', 'q.v')}, 9) AS s FROM pv p, qv q)"""


def _walk() -> str:
    return ",\n".join(f"""y{k} AS MATERIALIZED (SELECT qid, id, sum(v) AS v FROM (
  SELECT qid, id, v FROM y0 UNION ALL SELECT y.qid, m.dst, m.p * y.v FROM y{k - 1} y JOIN imoves m ON m.src = y.id) GROUP BY qid, id)""" for k in range(1, SQL_STEPS + 1))


def _ranking(boost: bool, spread: str = _SPREAD) -> str:
    from ..functions.text import ATTRIBUTE_KEYWORDS

    words = ", ".join(f"'{k}'" for k in ATTRIBUTE_KEYWORDS)
    extra = ""
    if boost:
        is_attr = f"len([k FOR k IN [{words}] IF list_contains(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+'), k)]) > 0"
        overlap = f"len([k FOR k IN [{words}] IF contains(lower(b.text), k) AND contains(lower(t.text), k)])"
        extra = f"+ CASE WHEN {is_attr} THEN 0.25 * ln(1 + {overlap}) ELSE 0 END"
    return f"""{spread},
{_NAMED}, {_DENSE}, {TRANSITIONS},
span AS (SELECT client_id, qid, min(s) AS lo, max(s) AS hi FROM dense GROUP BY ALL),
ids AS MATERIALIZED (SELECT client_id, hash_id, row_number() OVER () AS id FROM nodes),
imoves AS MATERIALIZED (SELECT s.id AS src, d.id AS dst, 0.5::DOUBLE * m.p AS p FROM moves m
  JOIN ids s ON s.client_id = m.client_id AND s.hash_id = m.src JOIN ids d ON d.client_id = m.client_id AND d.hash_id = m.dst),
reset AS (
  SELECT d.client_id, d.qid, d.passage_id AS node, greatest(0.05::DOUBLE * (1.5::DOUBLE * CASE WHEN hi = lo THEN 1 ELSE (s - lo) / (hi - lo) END
      + ln(1 + greatest(coalesce(bo.bonus, 0), -0.999999)) {extra}), 0) AS v
  FROM dense d JOIN span g ON g.client_id = d.client_id AND g.qid = d.qid
  LEFT JOIN bonus bo ON bo.client_id = d.client_id AND bo.qid = d.qid AND bo.node = d.passage_id
  JOIN bq b ON b.qid = d.qid JOIN passages t ON t.client_id = d.client_id AND t.passage_id = d.passage_id
  UNION ALL SELECT client_id, qid, entity_id, greatest(weight, 0) FROM spread_weights),
y0 AS MATERIALIZED (SELECT r.qid, i.id, r.v FROM reset r JOIN ids i ON i.client_id = r.client_id AND i.hash_id = r.node),
{_walk()},
mass AS (SELECT i.client_id, y.qid, i.hash_id AS node, y.v AS y FROM y{SQL_STEPS} y JOIN ids i ON i.id = y.id),
total AS (SELECT client_id, qid, sum(y) AS t FROM mass GROUP BY ALL),
pr AS (SELECT m.client_id, m.qid, m.node AS passage_id, m.y / t.t AS score,
    row_number() OVER (PARTITION BY m.client_id, m.qid ORDER BY CASE WHEN m.y > 0 THEN round(ln(m.y), 9) ELSE -1e9 END DESC, m.node) AS rank
  FROM mass m JOIN total t ON t.client_id = m.client_id AND t.qid = m.qid WHERE starts_with(m.node, 'passage-')),
flat AS (SELECT client_id, qid, passage_id, s AS score, row_number() OVER (PARTITION BY client_id, qid ORDER BY s DESC, passage_id) AS rank FROM dense),
ranked AS (
  SELECT * FROM pr WHERE rank <= 5 AND (client_id, qid) IN (SELECT client_id, qid FROM seeds)
  UNION ALL SELECT * FROM flat WHERE rank <= 5 AND (client_id, qid) NOT IN (SELECT client_id, qid FROM seeds))"""


_GLOBAL = f"""n AS (SELECT vec_id AS node_id, label % 3 AS node_type, [x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings),
e AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1.0::DOUBLE AS weight FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 OR b.vec_id = a.vec_id + 7),
c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL),
m AS (SELECT label AS qid, list(v ORDER BY i) AS v FROM c GROUP BY label),
s AS (SELECT q.qid, n.node_id, list_dot_product(q.v, n.v) / sqrt(list_dot_product(q.v, q.v)) AS score FROM m q, n),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node_id) AS rank FROM s),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
k AS (SELECT qid, node_id FROM r WHERE rank <= 4 UNION SELECT qid, dst FROM r JOIN u ON u.src = r.node_id WHERE rank <= 4)"""

SQL = {
    "question_entities": f"WITH {_Q_MENTIONS} SELECT qid, entity FROM q_men",
    "seed_entities": f"WITH {_SEEDS} SELECT client_id, qid, mention, entity_id, round(score, 9) + 0.0 AS score FROM seeds",
    "dense_passages": f"""WITH {base.PASSAGES}, {_QVEC}, {_DENSE},
        r AS (SELECT *, row_number() OVER (PARTITION BY client_id, qid ORDER BY s DESC, passage_id) AS rank,
          CASE WHEN max(s) OVER w = min(s) OVER w THEN 1 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS scaled FROM dense WINDOW w AS (PARTITION BY client_id, qid))
        SELECT client_id, qid, passage_id, CAST(rank AS INTEGER) AS rank, s AS score, round(scaled, 6) + 0.0 AS scaled FROM r WHERE rank <= 10""",
    "spread_weights": f"WITH {_SPREAD} SELECT client_id, qid, entity_id, round(weight, 6) + 0.0 AS weight FROM spread_weights",
    "activated_entities": f"WITH {_SPREAD} SELECT client_id, qid, entity_id, tier, round(score, 6) + 0.0 AS score FROM activated",
    "passage_entity_bonus": f"WITH {_BONUS} SELECT client_id, qid, node, round(bonus, 6) + 0.0 AS bonus FROM bonus",
    "ranked_passages": f"WITH {_ranking(False)} SELECT client_id, qid, passage_id, CAST(rank AS INTEGER) AS rank, round(score, 9) + 0.0 AS score FROM ranked",
    "ranked_passages_boosted": f"WITH {_ranking(True)} SELECT client_id, qid, passage_id, CAST(rank AS INTEGER) AS rank, round(score, 9) + 0.0 AS score FROM ranked",
    "activated_entities_ordered": f"WITH RECURSIVE {_ORDERED} SELECT client_id, qid, entity_id, tier, round(score, 6) + 0.0 AS score FROM activated",
    "ranked_passages_ordered": f"WITH RECURSIVE {_ranking(False, _ORDERED)} SELECT client_id, qid, passage_id, CAST(rank AS INTEGER) AS rank, round(score, 9) + 0.0 AS score FROM ranked",
    "federated_ranking": f"""WITH {_ranking(False)}, f AS (
        SELECT qid, client_id, passage_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, client_id, passage_id) AS rank FROM ranked)
        SELECT qid, client_id, passage_id, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 5""",
    "evidence_graph_edges": f"""WITH {_ranking(False)}, lk AS (SELECT DISTINCT client_id, 'sentence-' || md5(sentence) AS o, 'entity-' || md5(entity) AS e, 0 AS edge_type FROM mentions
          UNION ALL SELECT DISTINCT client_id, passage_id, 'entity-' || md5(entity), 1 FROM mentions),
        kept_h AS (SELECT client_id, qid, entity_id AS h FROM activated UNION SELECT client_id, qid, passage_id FROM ranked
          UNION SELECT a.client_id, a.qid, l.o FROM activated a JOIN lk l ON l.client_id = a.client_id AND l.e = a.entity_id AND l.edge_type = 0),
        kept AS (SELECT k.client_id, k.qid, k.h, row_number() OVER (PARTITION BY k.client_id, k.qid ORDER BY n.node_id) - 1 AS local_id
          FROM kept_h k JOIN nodes n ON n.client_id = k.client_id AND n.hash_id = k.h),
        hf AS (SELECT l.client_id, a.qid, a.local_id AS src, b.local_id AS dst, l.edge_type FROM lk l
          JOIN kept a ON a.client_id = l.client_id AND a.h = l.o JOIN kept b ON b.client_id = l.client_id AND b.h = l.e AND b.qid = a.qid)
        SELECT client_id, qid, src, dst, edge_type FROM hf UNION ALL SELECT client_id, qid, dst, src, edge_type FROM hf""",
    "anchor_map": f"""WITH {_ranking(False)}, own AS (SELECT client_id, {base.sql_title('text')} AS title, min(node_id) AS node_id FROM nodes WHERE node_type = 2 GROUP BY ALL)
        SELECT t.client_id, t.qid, CAST(t.rank - 1 AS INTEGER) AS slot, coalesce(o.node_id, -1) AS node_id FROM ranked t
        JOIN passages p ON p.client_id = t.client_id AND p.passage_id = t.passage_id
        LEFT JOIN own o ON o.client_id = t.client_id AND o.title = {base.sql_title('p.text')} AND o.title <> ''""",
    "global_seeds": f"WITH {_GLOBAL} SELECT qid, node_id, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 16",
    "global_subgraph": f"""WITH {_GLOBAL}, l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY node_id) - 1 AS i FROM k)
        SELECT a.qid, a.i AS src, b.i AS dst, e.weight FROM e JOIN l a ON a.node_id = e.src JOIN l b ON b.node_id = e.dst AND b.qid = a.qid""",
    "global_subgraph_capped": f"""WITH {_GLOBAL}, cap AS (SELECT k.qid, k.node_id, row_number() OVER (PARTITION BY k.qid ORDER BY round(s.score, 9) DESC, k.node_id) AS p FROM k JOIN s ON s.qid = k.qid AND s.node_id = k.node_id)
        SELECT c.qid, c.node_id, row_number() OVER (PARTITION BY c.qid ORDER BY c.node_id) - 1 AS local_id, n.node_type FROM cap c JOIN n ON n.node_id = c.node_id WHERE p <= 10""",
}
