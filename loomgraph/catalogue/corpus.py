"""Corpus, hashing, partitioning and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import text as tx
from ..operators import graph
from ..sources import corpus as src
from ..sources.records import positional_split
from ..sources.store import missing_texts
from . import base
from .base import PASSAGES, SPACE, sql_squeeze, sql_strip, sql_title, table


def hash_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", hs.entity_key(F.col("source")).alias("entity_id"), hs.sentence_key(F.col("lang")).alias("sentence_id"),
        hs.passage_key(F.col("text")).alias("passage_id"), hs.title_id(F.col("text")).alias("title_id"),
        hs.title_sentence_id(hs.title_id(F.col("text")), F.col("doc_id")).alias("title_sentence_id"), hs.audit_id(F.col("doc_id")).alias("audit_id"))


def title_partition(spark, sf):
    d = table(spark, sf, "pages").select("page_id", "url")
    return graph.partition_by_title(d, 7, "url").select("page_id", "client_id")


def chunk_parse(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text"))).alias("text"))
    parsed = src.parse_chunks(d)
    return parsed.select("idx", F.md5("text").alias("text_md5"), F.md5("body").alias("body_md5"))


def chunk_partition_stats(spark, sf):
    return graph.partition_stats(base.corpus(spark, sf, 5), 5, "text")


def title_first_wins(spark, sf):
    p = base.corpus(spark, sf).withColumn("node_id", F.col("idx").cast("bigint")).withColumn("node_type", F.lit(graph.PASSAGE))
    return graph.first_node_by_title(p).select(F.md5("title").alias("title_md5"), "client_id", "node_id")


def passage_slots_to_nodes(spark, sf):
    """Two slots per document, its title and a title that nobody has, looked up among the passages of all clients; misses give -1."""
    from ..operators.evidence import passage_node_map

    p = base.corpus(spark, sf).withColumn("node_id", F.col("idx").cast("bigint")).withColumn("node_type", F.lit(graph.PASSAGE))
    texts = F.posexplode(F.array(F.col("text"), F.concat(F.lit("no such title "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))))
    slots = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), texts.alias("slot", "text"))
    return passage_node_map(slots, p)


def text_windows(spark, sf):
    d = table(spark, sf, "documents")
    staged = d.select("doc_id", tx.window_tokens(F.col("text")).alias("tokens"))
    return staged.select("doc_id", F.posexplode(tx.chunk_windows(F.col("tokens"), 64)).alias("chunk_id", "chunk")).select(
        "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.md5("chunk").alias("chunk_md5"))


def titled_passages(spark, sf):
    """Conversations as titled documents: passage text from the turns' sentences."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), tx.sentences(F.col("text")).alias("sentences"))
    return c.select("conv_id", "turn", F.md5(tx.titled_passage(F.col("title"), F.col("sentences"))).alias("text_md5"),
                    F.md5(tx.evidence_text(F.col("title"), F.col("sentences"))).alias("evidence_md5"))


def first_document_per_text(spark, sf):
    """Distractor-style import: documents as evidence of questions grouped by language and source."""
    d = table(spark, sf, "documents").withColumn("qpos", F.floor(F.col("doc_id") / 10)).withColumn("cpos", F.col("doc_id") % 10)
    return src._number_chunks(d.select("qpos", "cpos", F.col("source").alias("title"), F.col("text").alias("key"))).select(
        "idx", F.col("first.qpos").alias("qpos"), F.col("first.cpos").alias("cpos"), F.md5("key").alias("text_md5"))


def incremental_upsert(spark, sf):
    """New hash ids when all documents arrive at a store that holds the English ones."""
    d = table(spark, sf, "documents")
    store = d.where("lang = 'en'").select(hs.passage_key(F.col("text")).alias("hash_id")).distinct()
    return missing_texts(d, store, "passage").select("hash_id")


def split_by_position(spark, sf):
    from ..operators.ranking import numbered

    d = table(spark, sf, "documents").select("doc_id")
    rows = numbered(d, [], [F.col("doc_id")], F.floor(F.col("doc_id") / 4096), "idx")
    return positional_split(rows).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def attribute_overlap(spark, sf):
    """Questions about attributes against the documents that share a keyword with them."""
    q = base.questions(spark, sf).select("qid", tx.is_attribute_query(F.col("question")).alias("is_attribute"),
                                         tx.keyword_overlap(F.col("question"), F.col("question")).cast("bigint").alias("keywords"))
    return q


def mention_labels(spark, sf):
    """Mentions per label before the label filter, over all sentences of all documents."""
    from ..operators.recognise import pattern_recogniser

    p = base.corpus(spark, sf)
    s = p.select("client_id", F.explode(tx.sentences(F.col("text"))).alias("sentence"))
    m = s.select("client_id", F.explode(pattern_recogniser()(F.col("sentence"))).alias("m"))
    return m.groupBy("client_id", F.col("m.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def encode_md5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", base.encoder()(F.col("text")).alias("x"))
    return d.select("doc_id", F.posexplode("x").alias("i", "value")).select("doc_id", F.col("i").cast("bigint").alias("i"), *base.rounded("value"))


def encode_blake2b(spark, sf):
    """The default encoder; there is no SQL for its digest."""
    from ..operators.encode import hash_encoder

    d = table(spark, sf, "documents").select("doc_id", hash_encoder(64)(F.col("text")).alias("x"))
    return d.select("doc_id", F.posexplode("x").alias("i", "value")).select("doc_id", F.col("i").cast("bigint").alias("i"), *base.rounded("value"))


QUERIES = {f.__name__: f for f in (
    hash_ids, title_partition, chunk_parse, chunk_partition_stats, title_first_wins, passage_slots_to_nodes, text_windows,
    titled_passages, first_document_per_text, incremental_upsert, split_by_position, attribute_overlap, mention_labels,
    encode_md5, encode_blake2b)}

_KEYWORDS = ", ".join(f"'{k}'" for k in tx.ATTRIBUTE_KEYWORDS)

SQL = {
    "hash_ids": """SELECT doc_id, 'entity-' || md5(source) AS entity_id, 'sentence-' || md5(lang) AS sentence_id,
        'passage-' || md5(text) AS passage_id, sha1(text) AS title_id, sha1(sha1(text) || '::' || doc_id) AS title_sentence_id,
        (doc_id * 1103515245 + 12345) % 2147483647 AS audit_id FROM documents""",
    "title_partition": """SELECT page_id, CAST((
        (CAST('0x' || substr(md5(url), 1, 8) AS BIGINT)::HUGEINT * CAST(79228162514264337593543950336 % 7 AS HUGEINT) % 7)
        + (CAST('0x' || substr(md5(url), 9, 8) AS BIGINT)::HUGEINT * 18446744073709551616 % 7)
        + (CAST('0x' || substr(md5(url), 17, 8) AS BIGINT)::HUGEINT * 4294967296 % 7)
        + CAST('0x' || substr(md5(url), 25, 8) AS BIGINT)) % 7 AS INTEGER) AS client_id FROM pages""",
    "chunk_parse": f"""WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN text ELSE doc_id || ':' || text END AS text FROM documents)
        SELECT CASE WHEN regexp_matches(text, '^\\d+:') THEN CAST(regexp_extract(text, '^(\\d+):', 1) AS INTEGER) ELSE -1 END AS idx,
        md5(text) AS text_md5, md5({sql_strip("regexp_replace(text, '^\\d+:', '')")}) AS body_md5 FROM c""",
    "chunk_partition_stats": """WITH a AS (SELECT doc_id % 5 AS client_id FROM documents),
        s AS (SELECT CAST(c AS INTEGER) AS client_id, (SELECT count(*) FROM a WHERE a.client_id = c) AS size FROM (SELECT unnest(range(5)) AS c))
        SELECT client_id, CAST(size AS BIGINT) AS size, count(*) OVER () AS num_clients, CAST(sum(size) OVER () AS BIGINT) AS total,
        min(size) OVER () AS min_size, max(size) OVER () AS max_size, TRUE AS no_overlap FROM s""",
    "title_first_wins": f"""WITH {PASSAGES}, t AS (SELECT {sql_title('text')} AS title, client_id, idx FROM passages),
        r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY client_id, idx) AS rn FROM t WHERE title <> '')
        SELECT md5(title) AS title_md5, client_id, idx AS node_id FROM r WHERE rn = 1""",
    "passage_slots_to_nodes": f"""WITH {PASSAGES}, t AS (SELECT * FROM (SELECT {sql_title('text')} AS title, client_id, idx FROM passages) QUALIFY row_number() OVER (PARTITION BY title ORDER BY client_id, idx) = 1),
        s AS (SELECT doc_id, 0 AS slot, text FROM documents UNION ALL SELECT doc_id, 1, 'no such title ' || doc_id || chr(10) || text FROM documents)
        SELECT doc_id AS qid, slot, coalesce(t.client_id, -1) AS client_id, coalesce(t.idx, -1) AS node_id
        FROM s d LEFT JOIN t ON t.title = {sql_title('d.text')} AND t.title <> ''""",
    "text_windows": f"""WITH t AS (SELECT doc_id, string_split({sql_squeeze('text')}, ' ') AS w FROM documents),
        c AS (SELECT doc_id, w, unnest(range(greatest(CAST(ceil(len(w) / 64.0) AS BIGINT), 1))) AS chunk_id FROM t)
        SELECT doc_id, chunk_id, md5(array_to_string(w[chunk_id * 64 + 1 : chunk_id * 64 + 64], ' ')) AS chunk_md5 FROM c""",
    "titled_passages": f"""WITH s AS (
          SELECT conv_id, turn, 'Conversation ' || conv_id AS title,
                 [{sql_strip('x')} FOR x IN {base.sql_sentences('text')} IF {sql_strip('x')} <> ''] AS l FROM conversations),
        u AS (SELECT conv_id, turn, title, [l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i] AS d FROM s)
        SELECT conv_id, turn, md5('Title: ' || title || chr(10) || coalesce(array_to_string(d, chr(10)), '')) AS text_md5,
        md5(title || ': ' || coalesce(array_to_string(d[1:3], ' '), '')) AS evidence_md5 FROM u""",
    "first_document_per_text": """WITH f AS (
          SELECT source, text, min(doc_id) AS first_id FROM documents GROUP BY source, text)
        SELECT row_number() OVER (ORDER BY first_id) - 1 AS idx, first_id // 10 AS qpos, first_id % 10 AS cpos, md5(text) AS text_md5 FROM f""",
    "incremental_upsert": """SELECT DISTINCT 'passage-' || md5(text) AS hash_id FROM documents
        WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en')""",
    "split_by_position": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
        SELECT CASE WHEN idx < floor(0.8 * n) THEN 'train' WHEN idx < floor(0.9 * n) THEN 'val' ELSE 'test' END AS split,
        count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r GROUP BY 1""",
    "attribute_overlap": f"""SELECT item_id AS qid,
        len([k FOR k IN [{_KEYWORDS}] IF list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), k)]) > 0 AS is_attribute,
        CAST(len([k FOR k IN [{_KEYWORDS}] IF contains(lower(text), k)]) AS BIGINT) AS keywords FROM benchmark""",
    "mention_labels": f"""WITH {base.MENTIONS},
        per AS (SELECT DISTINCT passage_id, client_id, sentence, entity FROM raw_mentions WHERE entity NOT IN ({base.SQL_STOP}))
        SELECT client_id, CASE WHEN regexp_matches(entity, '^\\d+$') THEN 'CARDINAL'
          WHEN regexp_matches(entity, '^\\d+(st|nd|rd|th)$') THEN 'ORDINAL' ELSE 'NAME' END AS label, count(*) AS n FROM per GROUP BY 1, 2""",
    "encode_md5": f"""WITH {base.sql_encode('e', 'documents', 'text', 'doc_id')}
        SELECT doc_id, CAST(unnest(range({base.DIM})) AS BIGINT) AS i, round(unnest(v), 6) + 0.0 AS value FROM e""",
}
