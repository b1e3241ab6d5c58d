"""Corpus to graph: mentions, links, weights, nodes and vectors as one set of tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SENTENCE_PREFIX, entity_key, key_text, packed_key, unpacked_key
from ..functions.vectors import union_all
from ..operators import graph
from ..operators.encode import Encoder, chunk_vectors, hash_encoder, pooled_vectors
from ..operators.recognise import Recogniser, distinct_passages, mentions_of, passage_mentions, passage_sentences
from ..session import materialise


@dataclass
class GraphIndex:
    """Tables of the entity/sentence/passage graph of all clients; each is built on first use and
    kept in the checkpoint folder because several plans read it."""

    source: DataFrame
    encoder: Encoder
    dim: int
    recogniser: Recogniser | None = None
    known_mentions: DataFrame | None = None
    _encoded: dict[int, DataFrame] = field(default_factory=dict, repr=False)

    @classmethod
    def build(cls, passages: DataFrame, encoder: Encoder | None = None, dim: int = 384,
              recogniser: Recogniser | None = None) -> "GraphIndex":
        """``passages`` needs client_id and text."""
        return cls(passages, encoder or hash_encoder(dim), dim, recogniser)

    @cached_property
    def passages(self) -> DataFrame:
        return materialise(distinct_passages(self.source))

    @cached_property
    def found(self) -> DataFrame:
        """(client_id, passage_id, sentence, entities): every sentence with entities once per passage."""
        from ..sources.store import merge_mentions, unread_passages

        if self.known_mentions is None:
            return materialise(passage_sentences(self.passages, self.recogniser))
        fresh = passage_mentions(unread_passages(self.passages, self.known_mentions), self.recogniser)
        return materialise(merge_mentions(self.known_mentions, fresh).groupBy("client_id", "passage_id", "sentence").agg(
            F.collect_set("entity").alias("entities")))

    @property
    def mentions(self) -> DataFrame:
        return mentions_of(self.found)

    @cached_property
    def numbered(self) -> DataFrame:
        return graph.numbered_nodes(*graph.placed_nodes(self.found, self.passages))

    @property
    def ids(self) -> DataFrame:
        """(client_id, node_id, node_type, hash_id): the nodes without their texts."""
        return graph.hash_ids(self.numbered)

    def texts(self, node_type: int) -> DataFrame:
        """(client_id, text) of the nodes of one type, each once."""
        if node_type == graph.PASSAGE:
            return self.passages.select("client_id", "text")
        column = F.col("sentence") if node_type == graph.SENTENCE else F.explode("entities")
        return self.found.select("client_id", column.alias("text")).distinct()

    @property
    def entity_texts(self) -> DataFrame:
        """(client_id, hash_id, text) of the entities."""
        return self.texts(graph.ENTITY).select("client_id", graph.node_hash(graph.ENTITY, F.col("text")).alias("hash_id"), "text")

    @cached_property
    def nodes(self) -> DataFrame:
        texts = union_all([self.texts(t).select("client_id", graph.node_hash(t, F.col("text")).alias("hash_id"), "text") for t in graph.NODE_TYPES])
        return materialise(self.ids.join(texts, ["client_id", "hash_id"]).select("client_id", "node_id", "node_type", "hash_id", "text"))

    @cached_property
    def links(self) -> DataFrame:
        return materialise(graph.entity_links(self.numbered))

    @property
    def edges(self) -> DataFrame:
        return graph.edges_of(self.links)

    @property
    def neighbours(self) -> DataFrame:
        return graph.neighbours_of(self.links)

    @cached_property
    def vectors(self) -> DataFrame:
        """(client_id, node_id, node_type, hash_id, x)."""
        return materialise(union_all([self.of_type(t) for t in graph.NODE_TYPES]).join(self.ids, ["client_id", "hash_id"]).select(
            "client_id", "node_id", "node_type", "hash_id", "x"))

    @cached_property
    def chunks(self) -> DataFrame:
        return materialise(chunk_vectors(self.nodes, self.encoder))

    @cached_property
    def text_vectors(self) -> DataFrame:
        return materialise(pooled_vectors(self.chunks, self.dim))

    @cached_property
    def entity_passage_weights(self) -> DataFrame:
        return materialise(graph.passage_weights(self.found, self.passages))

    @cached_property
    def _transitions(self) -> DataFrame:
        from ..operators.passages import transition

        edges = graph.retrieval_edges(self.entity_passage_weights, graph.adjacent_passages(self.passages))
        return materialise(transition(edges.withColumns({"src": packed_key(F.col("src")), "dst": packed_key(F.col("dst"))})))

    @property
    def transitions(self) -> DataFrame:
        """(client_id, src, dst, p); shuffled and kept with packed ids."""
        return self._transitions.withColumns({"src": unpacked_key(F.col("src")), "dst": unpacked_key(F.col("dst"))})

    @cached_property
    def rank_blocks(self):
        from ..operators.blockrank import WHOLE_NODES, rank_blocks

        nodes = self.ids.where(F.col("node_type").isin(graph.ENTITY, graph.PASSAGE)).select("client_id", F.col("hash_id").alias("node"))
        texts = self.passages.select("client_id", F.col("passage_id").alias("node"), "text")
        vectors = self.of_type(graph.PASSAGE).select("client_id", F.col("hash_id").alias("node"), "x").join(texts, ["client_id", "node"])
        return rank_blocks(nodes, self.transitions, vectors, whole_nodes=WHOLE_NODES)

    @cached_property
    def _sentence_names(self) -> DataFrame:
        return materialise(graph.sentence_names(self.found))

    @property
    def sentence_incidence(self) -> DataFrame:
        """(client_id, entity_id, sentence_id)."""
        links = self._sentence_names.select("client_id", F.explode("names").alias("entity"), "key")
        return links.select("client_id", entity_key(F.col("entity")).alias("entity_id"), key_text(F.lit(SENTENCE_PREFIX), F.col("key")).alias("sentence_id"))

    def sentence_vectors(self, asked: DataFrame) -> DataFrame:
        """(client_id, hash_id, x) of the sentences ``asked`` for (client_id, hash_id); only those are encoded."""
        texts = self.found.select("client_id", graph.node_hash(graph.SENTENCE, F.col("sentence")).alias("hash_id"), F.col("sentence").alias("text"))
        return self._encode(texts.join(asked, ["client_id", "hash_id"], "left_semi").select("client_id", "text").distinct(), graph.SENTENCE)

    def _encode(self, texts: DataFrame, node_type: int) -> DataFrame:
        """(client_id, hash_id, x); equal texts of different clients are encoded once."""
        held = texts.groupBy("text").agg(F.collect_set("client_id").alias("clients"))
        encoded = held.select("clients", graph.node_hash(node_type, F.col("text")).alias("hash_id"), self.encoder(F.col("text")).alias("x"))
        return materialise(encoded.select(F.explode("clients").alias("client_id"), "hash_id", "x"))

    def of_type(self, node_type: int) -> DataFrame:
        """(client_id, hash_id, x) of the nodes of one type; equal texts of different clients are encoded once."""
        if node_type not in self._encoded:
            self._encoded[node_type] = self._encode(self.texts(node_type), node_type)
        return self._encoded[node_type]
