"""Evidence subgraphs per question and cosine retrieval in the condensed global graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_of
from ..functions.vectors import cosine, sum_vectors
from .graph import PASSAGE, SENTENCE_ENTITY, both_directions, first_node_by_title, induced_edges, relabelled
from .ranking import top_k
from .similarity import top_k_dot

QUESTION_KEYS = ["client_id", "qid"]


def evidence_nodes(activated: DataFrame, ranked: DataFrame, nodes: DataFrame, edges: DataFrame, top_passages: int = 5) -> DataFrame:
    """(client_id, qid, node_id): activated entities, the sentences next to them, the top passages.

    Ids missing from the graph are ignored."""
    ids = nodes.select("client_id", "hash_id", "node_id")
    entities = activated.select(*QUESTION_KEYS, F.col("entity_id").alias("hash_id")).distinct().join(ids, ["client_id", "hash_id"]).select(*QUESTION_KEYS, "node_id")
    passages = ranked.where(F.col("rank") <= top_passages).select(*QUESTION_KEYS, F.col("passage_id").alias("hash_id")).join(
        ids, ["client_id", "hash_id"]).select(*QUESTION_KEYS, "node_id")
    types = nodes.where(F.col("node_type") == 1).select("client_id", F.col("node_id").alias("dst"))
    se = edges.where(F.col("edge_type") == SENTENCE_ENTITY).select("client_id", F.col("src").alias("node_id"), "dst").join(types, ["client_id", "dst"], "left_semi")
    sentences = entities.join(se, ["client_id", "node_id"]).select(*QUESTION_KEYS, F.col("dst").alias("node_id"))
    return entities.unionByName(sentences).unionByName(passages).distinct()


def evidence_graph(kept: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (client_id, qid, local_id, node_id, node_type) and relabelled induced edges."""
    inside = induced_edges(edges, kept, QUESTION_KEYS)
    local, out = relabelled(kept, inside, QUESTION_KEYS)
    return local.join(nodes.select("client_id", "node_id", "node_type"), ["client_id", "node_id"]).select(
        *QUESTION_KEYS, "local_id", "node_id", "node_type"), out


def anchored_nodes(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """(client_id, qid, node_id): anchor nodes and their one-hop neighbours; misses (-1) are ignored."""
    seeds = anchors.where("node_id >= 0").select(*QUESTION_KEYS, "node_id").distinct()
    near = seeds.join(edges.select("client_id", F.col("src").alias("node_id"), "dst"), ["client_id", "node_id"]).select(
        *QUESTION_KEYS, F.col("dst").alias("node_id"))
    return seeds.unionByName(near).distinct()


def mean_query(kept: DataFrame, node_vectors: DataFrame, dim: int, keys: list[str] | None = None) -> DataFrame:
    """Mean vector of a question's evidence nodes, the query into the global graph."""
    keys = keys or QUESTION_KEYS
    return sum_vectors(kept.join(node_vectors.select("client_id", "node_id", "x"), ["client_id", "node_id"]), keys, "x", dim, mean=True)


def global_seeds(queries: DataFrame, nodes: DataFrame, top_r: int = 16, group: str = "graph_id") -> DataFrame:
    """(graph_id, qid, node_id, score, rank): best ``top_r`` nodes by cosine (fewer if the graph is smaller)."""
    q = queries.select(group, "qid", "x")
    v = nodes.select(group, "node_id", "x")
    return top_k_dot(q, v, top_r, group=group, query_key="qid", vector_key="node_id", normalise=True)


def global_subgraph(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top_r: int = 16, max_nodes: int | None = None,
                    group: str = "graph_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, kept nodes (seeds and their undirected neighbours, optionally only the ``max_nodes``
    most similar) and relabelled induced edges of every query.

    queries: group, qid, x. nodes: group, node_id, node_type, x. edges: group, src, dst, weight.
    """
    seeds = global_seeds(queries, nodes, top_r, group)
    around = both_directions(edges.select(group, "src", "dst")).select(group, F.col("src").alias("node_id"), F.col("dst").alias("near")).distinct()
    near = seeds.join(around, [group, "node_id"]).select(group, "qid", F.col("near").alias("node_id"))
    kept = seeds.select(group, "qid", "node_id").unionByName(near).distinct()
    if max_nodes is not None:
        scored = kept.join(nodes.select(group, "node_id", "x"), [group, "node_id"]).join(
            queries.select(group, "qid", F.col("x").alias("qx")), [group, "qid"]).select(
            group, "qid", "node_id", F.round(cosine(F.col("x"), F.col("qx")), 9).alias("score"))
        kept = top_k(scored, [group, "qid"], [F.col("score").desc(), F.col("node_id")], max_nodes).select(group, "qid", "node_id")
        seeds = seeds.join(kept, [group, "qid", "node_id"], "left_semi")
    inside = induced_edges(edges, kept, [group, "qid"])
    local, out = relabelled(kept, inside, [group, "qid"])
    return seeds, local.join(nodes.select(group, "node_id", "node_type"), [group, "node_id"]), out


def passage_node_map(slots: DataFrame, nodes: DataFrame, per_client: bool = False) -> DataFrame:
    """Slots (qid, slot, text[, client_id]) to graph nodes by title; a miss is (-1, -1).

    ``per_client`` matches inside the slot's own client, otherwise the lowest client wins."""
    titled = slots.withColumn("title", title_of(F.col("text")))
    if per_client:
        own = nodes.where(F.col("node_type") == PASSAGE).withColumn("title", title_of(F.col("text"))).where("title <> ''").groupBy(
            "client_id", "title").agg(F.min("node_id").alias("node_id"))
        return titled.join(own, ["client_id", "title"], "left").select(
            "client_id", "qid", "slot", F.coalesce("node_id", F.lit(-1).cast("bigint")).alias("node_id"))
    first = first_node_by_title(nodes)
    return titled.join(first, "title", "left").select(
        "qid", "slot", F.coalesce("client_id", F.lit(-1)).alias("client_id"), F.coalesce("node_id", F.lit(-1).cast("bigint")).alias("node_id"))
