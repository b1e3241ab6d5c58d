"""Entity / sentence / passage graphs as node and edge tables keyed by client_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import ENTITY_PREFIX, PASSAGE_PREFIX, SENTENCE_PREFIX, chunk_client, entity_key, key_bytes, key_text, passage_key, sentence_key, title_client
from ..functions.text import parse_chunk_index, title_of
from ..session import materialise
from .matching import automaton, occurrences
from .ranking import next_in_order, numbered

ENTITY, SENTENCE, PASSAGE = NODE_TYPES = 0, 1, 2
SENTENCE_ENTITY, PASSAGE_ENTITY = 0, 1
MAX_SHIFTS = 500_000  # rows of the numbering's offsets that may be broadcast


# --- partitioning -----------------------------------------------------------------------------

def partition_by_title(passages: DataFrame, num_clients: int, title: str = "title") -> DataFrame:
    return passages.withColumn("client_id", title_client(F.col(title), num_clients))


def partition_by_index(chunks: DataFrame, num_clients: int, index: str = "idx") -> DataFrame:
    return chunks.withColumn("client_id", chunk_client(F.col(index), num_clients))


def partition_stats(assigned: DataFrame, num_clients: int, key: str) -> DataFrame:
    """One row per client (empty clients count 0) with the overall totals next to it."""
    spark = assigned.sparkSession
    sizes = assigned.groupBy("client_id").agg(F.count(F.lit(1)).alias("size"))
    clients = spark.range(num_clients).select(F.col("id").cast("int").alias("client_id"))
    per_client = clients.join(sizes, "client_id", "left").select("client_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    spread = assigned.groupBy(key).agg(F.min("client_id").alias("a"), F.max("client_id").alias("b")).agg(
        F.coalesce(F.sum((F.col("a") != F.col("b")).cast("int")), F.lit(0)).alias("shared_keys")
    )
    totals = per_client.agg(
        F.count(F.lit(1)).alias("num_clients"), F.sum("size").alias("total"),
        F.min("size").alias("min_size"), F.max("size").alias("max_size"),
    )
    return (
        per_client.join(F.broadcast(totals.join(F.broadcast(spread))))
        .withColumn("no_overlap", F.col("shared_keys") == 0)
        .drop("shared_keys")
    )


def first_node_by_title(nodes: DataFrame) -> DataFrame:
    """(title, client_id, node_id) of the first passage with that title: lowest client, then lowest node."""
    titled = nodes.where(F.col("node_type") == PASSAGE).withColumn("title", title_of(F.col("text"))).where("title <> ''")
    return titled.groupBy("title").agg(F.min(F.struct("client_id", "node_id")).alias("first")).select(
        "title", "first.client_id", "first.node_id"
    )


# --- links between texts ----------------------------------------------------------------------

def sentence_links(mentions: DataFrame) -> DataFrame:
    """(client_id, sentence, entity): equal sentences of different passages are one sentence."""
    return mentions.select("client_id", "sentence", "entity").distinct()


def passage_entities(found: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """(client_id, passage_id, entities): the different entities of a passage; with ``passages`` also those without any."""
    rows = found.select("client_id", "passage_id", "entities")
    if passages is not None:
        rows = rows.unionByName(passages.select("client_id", "passage_id", F.array().cast("array<string>").alias("entities")))
    return rows.groupBy("client_id", "passage_id").agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("entities"))


def passage_weights(found: DataFrame, passages: DataFrame) -> DataFrame:
    """(client_id, passage_id, entity, occurrences, weight): share of an entity in its passage's mentions.

    The entities of one passage (bounded by its own text) are gathered and counted in a single pass
    over the text; searching the text once per entity would be quadratic in the passage length. A
    passage whose counts are all zero gets weight 0.
    """
    gathered = passage_entities(found)
    client = found.schema["client_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [occurrences(automaton(words), text) for words, text in zip(batch["entities"], batch["text"])]
            sizes = batch["entities"].map(len).to_numpy()
            n = [hits.get(w, 0) for hits, words in zip(found, batch["entities"]) for w in words]
            total = np.repeat(np.array([sum(hits.values()) for hits in found], dtype=np.int64), sizes)
            yield pd.DataFrame({
                "client_id": np.repeat(batch["client_id"].to_numpy(), sizes), "passage_id": np.repeat(batch["passage_id"].to_numpy(), sizes),
                "entity": [w for words in batch["entities"] for w in words], "occurrences": n,
                "weight": np.array(n, dtype=np.float64) / np.maximum(total, 1),
            })

    return gathered.join(passages.select("client_id", "passage_id", "text"), ["client_id", "passage_id"]).mapInPandas(
        count, f"client_id {client}, passage_id string, entity string, occurrences bigint, weight double")


def adjacent_passages(passages: DataFrame) -> DataFrame:
    """(client_id, src, dst, weight 1.0) between passages that follow each other by index prefix."""
    indexed = passages.withColumn("idx", parse_chunk_index(F.trim(F.col("text")))).where("idx >= 0")
    linked = next_in_order(indexed.select("client_id", "idx", "passage_id"), ["client_id"], "idx", "passage_id", name="dst")
    return (
        linked.where("dst is not null and dst <> passage_id")
        .select("client_id", F.col("passage_id").alias("src"), "dst", F.lit(1.0).alias("weight")).distinct()
    )


def retrieval_edges(weights: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Undirected weighted entity-passage and passage-passage edges by hash id, both directions."""
    forward = weights.select(
        "client_id", F.col("passage_id").alias("src"), entity_key(F.col("entity")).alias("dst"), "weight"
    ).unionByName(adjacent)
    forward = forward.where("src <> dst")
    return both_directions(forward)


def both_directions(edges: DataFrame) -> DataFrame:
    """The edges and their reverses, from one scan."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )).alias("_end")
    return edges.select(*rest, ends).select("_end.src", "_end.dst", *rest)


# --- tripartite graph -------------------------------------------------------------------------

def sentence_names(found: DataFrame) -> DataFrame:
    """(client_id, key, names): the different entities of every different sentence; ``key`` holds the bytes of its hash id."""
    return found.select("client_id", F.unhex(F.md5("sentence")).alias("key"), "entities").groupBy("client_id", "key").agg(
        F.array_distinct(F.flatten(F.collect_set("entities"))).alias("names"))


def placed_nodes(found: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities, then sentences, then passages, numbered contiguously per client in hash order.

    Returns (client_id, node_type, key, names, bucket, place) and (client_id, bucket, shift); a node's number is
    shift + place - 1. ``key`` holds the bytes of the hash id and ``names`` the entities a sentence or passage mentions
    (an entity: its own name). Texts stay where they are: only keys and names are shuffled, and links
    follow from ``names`` without another pass over the mentions.
    """
    own = found.select("client_id", F.explode("entities").alias("name")).distinct()
    entities = own.select("client_id", F.lit(ENTITY).alias("node_type"), F.unhex(F.md5("name")).alias("key"), F.array("name").alias("names"))
    sentences = sentence_names(found).select("client_id", F.lit(SENTENCE).alias("node_type"), "key", "names")
    whole = passage_entities(found, passages).select(
        "client_id", F.lit(PASSAGE).alias("node_type"), key_bytes(F.col("passage_id")).alias("key"), F.col("entities").alias("names")).where("key IS NOT NULL")
    bucket = F.col("node_type") * F.lit(4096) + F.conv(F.substring(F.hex("key"), 1, 3), 16, 10).cast("int")
    within = Window.partitionBy("client_id", "bucket").orderBy("key")
    placed = materialise(entities.unionByName(sentences).unionByName(whole).withColumn("bucket", bucket).withColumn("place", F.row_number().over(within)))
    before = Window.partitionBy("client_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("client_id", "bucket").agg(F.max("place").cast("bigint").alias("n"))
    return placed, materialise(sizes.select("client_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))


def numbered_nodes(placed: DataFrame, shifts: DataFrame) -> DataFrame:
    """(client_id, node_id, node_type, key, names) of ``placed_nodes``."""
    few = shifts.limit(MAX_SHIFTS + 1).count() <= MAX_SHIFTS
    return placed.join(F.broadcast(shifts) if few else shifts, ["client_id", "bucket"]).select(
        "client_id", (F.col("shift") + F.col("place") - 1).cast("bigint").alias("node_id"), "node_type", "key", "names")


def node_hash(node_type: int, text: Column) -> Column:
    return {ENTITY: entity_key, SENTENCE: sentence_key, PASSAGE: passage_key}[node_type](text)


def hash_ids(numbered: DataFrame) -> DataFrame:
    """(client_id, node_id, node_type, hash_id) of numbered nodes."""
    prefix = F.when(F.col("node_type") == ENTITY, ENTITY_PREFIX).when(F.col("node_type") == SENTENCE, SENTENCE_PREFIX).otherwise(PASSAGE_PREFIX)
    return numbered.select("client_id", "node_id", "node_type", key_text(prefix, F.col("key")).alias("hash_id"))


def entity_links(numbered: DataFrame) -> DataFrame:
    """(client_id, other, entity, edge_type) by node id: every link once, from its sentence or passage; weights and
    passage-passage links left out."""
    edge_type = F.when(F.col("node_type") == SENTENCE, SENTENCE_ENTITY).otherwise(PASSAGE_ENTITY).alias("edge_type")
    ends = numbered.where(F.col("node_type") != ENTITY).select("client_id", F.col("node_id").alias("other"), edge_type, F.explode("names").alias("name"))
    entities = numbered.where(F.col("node_type") == ENTITY).select("client_id", F.element_at("names", 1).alias("name"), F.col("node_id").alias("entity"))
    return ends.join(entities, ["client_id", "name"]).select("client_id", "other", "entity", "edge_type")


def edges_of(links: DataFrame) -> DataFrame:
    """(client_id, src, dst, edge_type), both directions; a projection of the links."""
    return both_directions(links.select("client_id", F.col("other").alias("src"), F.col("entity").alias("dst"), "edge_type")).select(
        "client_id", "src", "dst", "edge_type")


def neighbours_of(links: DataFrame) -> DataFrame:
    """Neighbour table of the tripartite graph with entity_start / entity_end flags and the edge type.

    Links are unique and always join an entity to a non-entity, so nothing has to be deduplicated."""
    ends = F.explode(F.array(
        F.struct(F.col("other").alias("a"), F.col("entity").alias("b"), F.lit(False).alias("s"), F.lit(True).alias("e")),
        F.struct(F.col("entity").alias("a"), F.col("other").alias("b"), F.lit(True).alias("s"), F.lit(False).alias("e")))).alias("x")
    return links.select("client_id", "edge_type", ends).select(
        "client_id", F.col("x.a").alias("node_id"), F.col("x.b").alias("neighbour"), F.col("x.s").alias("entity_start"), F.col("x.e").alias("entity_end"), "edge_type")


# --- neighbourhoods and subgraphs ---------------------------------------------------------------

def undirected_neighbours(edges: DataFrame) -> DataFrame:
    """(client_id, node_id, neighbour) without self loops or repeats, closed under reversal."""
    plain = edges.select("client_id", "src", "dst").where("src <> dst")
    return both_directions(plain).select("client_id", F.col("src").alias("node_id"), F.col("dst").alias("neighbour")).distinct()


def degrees(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("client_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))


def typed_degrees(neighbours: DataFrame, nodes: DataFrame) -> DataFrame:
    """(client_id, node_id, deg_s, deg_p) for every entity, 0 where it has no such neighbour."""
    if "edge_type" in neighbours.columns:
        typed = neighbours.where("entity_start").withColumn("_t", F.when(F.col("edge_type") == SENTENCE_ENTITY, SENTENCE).otherwise(PASSAGE))
    else:
        types = nodes.select("client_id", F.col("node_id").alias("neighbour"), F.col("node_type").alias("_t"))
        typed = neighbours.join(types, ["client_id", "neighbour"])
    counts = typed.groupBy("client_id", "node_id").agg(
        F.sum((F.col("_t") == SENTENCE).cast("int")).alias("deg_s"),
        F.sum((F.col("_t") == PASSAGE).cast("int")).alias("deg_p"),
    )
    entities = nodes.where(F.col("node_type") == ENTITY).select("client_id", "node_id")
    return entities.join(counts, ["client_id", "node_id"], "left").select(
        "client_id", "node_id",
        F.coalesce("deg_s", F.lit(0)).cast("bigint").alias("deg_s"), F.coalesce("deg_p", F.lit(0)).cast("bigint").alias("deg_p"),
    )


def exact_two_hop(neighbours: DataFrame, start: DataFrame) -> DataFrame:
    """(client_id, start, node_id) at distance exactly two of every start node; for any graph."""
    n1 = start.select("client_id", F.col("node_id").alias("start")).join(
        neighbours.select("client_id", F.col("node_id").alias("start"), F.col("neighbour").alias("mid")), ["client_id", "start"]
    )
    reach = n1.join(
        neighbours.select("client_id", F.col("node_id").alias("mid"), F.col("neighbour").alias("node_id")), ["client_id", "mid"]
    ).select("client_id", "start", "node_id").where("node_id <> start").distinct()
    one_hop = n1.select("client_id", "start", F.col("mid").alias("node_id"))
    return reach.join(one_hop, ["client_id", "start", "node_id"], "left_anti")


def induced_edges(edges: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with both ends kept. ``keys`` are the graph columns shared by both sides plus any query
    key present only in ``kept``; the result carries all of them.

    With a query key an edge meets the queries of the end that fewer queries keep, and the other end is
    looked up per query: a hub kept by every query is never paired with all edges of the graph."""
    graph_keys = [k for k in keys if k in edges.columns]
    if len(graph_keys) == len(keys):
        left = edges.join(kept.select(*keys, F.col("node_id").alias("src")), [*graph_keys, "src"])
        return left.join(kept.select(*keys, F.col("node_id").alias("dst")), [*keys, "dst"])
    sizes = kept.groupBy(*graph_keys, "node_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = edges.join(sizes.withColumnsRenamed({"node_id": "src", "_n": "_ns"}), [*graph_keys, "src"]).join(
        sizes.withColumnsRenamed({"node_id": "dst", "_n": "_nd"}), [*graph_keys, "dst"])
    fewer = F.col("_ns") <= F.col("_nd")
    turned = sized.select(*edges.columns, F.when(fewer, F.col("src")).otherwise(F.col("dst")).alias("_few"), F.when(fewer, F.col("dst")).otherwise(F.col("src")).alias("_many"))
    met = turned.join(kept.select(*keys, F.col("node_id").alias("_few")), [*graph_keys, "_few"])
    return met.join(kept.select(*keys, F.col("node_id").alias("_many")), [*keys, "_many"]).drop("_few", "_many")


def relabelled(kept: DataFrame, edges: DataFrame, keys: list[str], node_range: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """Local ids 0.. per key in node order, and the edges rewritten to them."""
    local = numbered(kept, keys, [F.col("node_id")], F.floor(F.col("node_id") / F.lit(node_range)), "local_id")
    ids = local.select(*keys, "node_id", "local_id")
    rest = [c for c in edges.columns if c not in (*keys, "src", "dst")]
    out = (
        edges.join(ids.withColumnRenamed("node_id", "src").withColumnRenamed("local_id", "src_local"), [*keys, "src"])
        .join(ids.withColumnRenamed("node_id", "dst").withColumnRenamed("local_id", "dst_local"), [*keys, "dst"])
        .select(*keys, F.col("src_local").alias("src"), F.col("dst_local").alias("dst"), *rest)
    )
    return local, out
