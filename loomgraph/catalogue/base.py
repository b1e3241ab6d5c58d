"""Table access, the corpus views used by several queries, and SQL fragments they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_chunk_index
from ..operators.encode import hash_encoder
from ..operators.graph import partition_by_index
from ..operators.recognise import DROPPED_LABELS, STOP_MENTIONS  # noqa: F401
from ..plans.index import GraphIndex
from ..session import spread

CLIENTS = 2
DIM = 32
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the text table arrives as one small file and is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def corpus(spark: SparkSession, sf_dir: str, clients: int = CLIENTS) -> DataFrame:
    """(client_id, idx, text): documents as indexed chunks, partitioned by index."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")).alias("text"))
    return partition_by_index(docs.withColumn("idx", parse_chunk_index(F.col("text"))), clients)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def encoder():
    return hash_encoder(DIM, "md5")


def index(spark: SparkSession, sf_dir: str, clients: int = CLIENTS) -> GraphIndex:
    return GraphIndex.build(corpus(spark, sf_dir, clients), encoder(), DIM)


def rounded(*names: str, digits: int = DIGITS):
    """Columns rounded for output; negative zero becomes zero."""
    return [(F.round(F.col(n).cast("double"), digits) + F.lit(0.0)).alias(n) for n in names]


# --- SQL fragments ------------------------------------------------------------------------------

SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SPACE}+', ' ', 'g'))"


def sql_title(expr: str) -> str:
    bare = sql_strip(f"regexp_replace({expr}, '^\\d+:', '')")
    return f"lower({sql_strip(f'split_part({bare}, chr(58), 1)')})"


def sql_sentences(expr: str) -> str:
    return f"regexp_split_to_array(regexp_replace({expr}, '([.!?])[\\s\\v]+', '\\1' || chr(10), 'g'), '[\\r\\n]+')"


SQL_STOP = ", ".join(f"'{w}'" for w in STOP_MENTIONS)
SQL_MENTION = r"(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*|\d+(?:st|nd|rd|th)|\d+)"

PASSAGES = f"""passages AS (
  SELECT CAST(doc_id % {CLIENTS} AS INTEGER) AS client_id, doc_id AS idx, doc_id || ':' || text AS text,
         'passage-' || md5(doc_id || ':' || text) AS passage_id FROM documents)"""

MENTIONS = f"""{PASSAGES},
raw_sentences AS (
  SELECT client_id, passage_id, {sql_strip('s')} AS sentence
  FROM (SELECT client_id, passage_id, unnest({sql_sentences('text')}) AS s FROM passages)),
raw_mentions AS (
  SELECT client_id, passage_id, sentence, unnest(regexp_extract_all(sentence, '{SQL_MENTION}', 1)) AS entity
  FROM raw_sentences WHERE sentence <> ''),
mentions AS (
  SELECT DISTINCT client_id, passage_id, sentence, entity FROM raw_mentions
  WHERE entity NOT IN ({SQL_STOP}) AND NOT regexp_matches(entity, '^\\d+(st|nd|rd|th)?$'))"""

NODES = f"""{MENTIONS},
keyed AS (
  SELECT DISTINCT client_id, 0 AS node_type, entity AS text, 'entity-' || md5(entity) AS hash_id FROM mentions
  UNION ALL SELECT DISTINCT client_id, 1, sentence, 'sentence-' || md5(sentence) FROM mentions
  UNION ALL SELECT DISTINCT client_id, 2, text, passage_id FROM passages),
nodes AS (
  SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY node_type, hash_id) - 1 AS node_id,
         node_type, hash_id, text FROM keyed)"""

LINKS = f"""{NODES},
links AS (
  SELECT DISTINCT client_id, 'sentence-' || md5(sentence) AS src, 'entity-' || md5(entity) AS dst, 0 AS edge_type FROM mentions
  UNION ALL SELECT DISTINCT client_id, passage_id, 'entity-' || md5(entity), 1 FROM mentions),
half AS (
  SELECT l.client_id, s.node_id AS src, d.node_id AS dst, l.edge_type FROM links l
  JOIN nodes s ON s.client_id = l.client_id AND s.hash_id = l.src
  JOIN nodes d ON d.client_id = l.client_id AND d.hash_id = l.dst),
edges AS (
  SELECT client_id, src, dst, edge_type FROM half UNION ALL SELECT client_id, dst, src, edge_type FROM half)"""

WEIGHTS = """pairs AS (SELECT DISTINCT client_id, passage_id, entity FROM mentions),
counted AS (
  SELECT p.client_id, p.passage_id, p.entity,
         CAST((length(t.text) - length(replace(t.text, p.entity, ''))) / length(p.entity) AS BIGINT) AS occurrences
  FROM pairs p JOIN passages t ON t.client_id = p.client_id AND t.passage_id = p.passage_id),
weights AS (
  SELECT client_id, passage_id, entity, occurrences,
         CASE WHEN sum(occurrences) OVER w > 0 THEN occurrences::DOUBLE / sum(occurrences) OVER w ELSE 0 END AS weight
  FROM counted WINDOW w AS (PARTITION BY client_id, passage_id))"""

ADJACENT = """adjacent AS (
  SELECT DISTINCT client_id, src, dst, 1.0::DOUBLE AS weight FROM (
    SELECT client_id, passage_id AS src, lead(passage_id) OVER (PARTITION BY client_id ORDER BY idx, passage_id) AS dst FROM passages)
  WHERE dst IS NOT NULL AND dst <> src)"""


def sql_encode(name: str, source: str, text: str, key: str, dim: int = DIM) -> str:
    """CTEs giving ``name`` (key columns, v DOUBLE[]): the md5 hash encoding of every source row."""
    keys = [k.strip() for k in key.split(",")]
    join = " AND ".join(f"g.{k} = c.{k}" for k in keys)
    cols = ", ".join(f"g.{k}" for k in keys)
    return f"""{name}_tok AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM {source}),
{name}_val AS (
  SELECT {key}, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) AS h, count(*) AS n FROM {name}_tok GROUP BY {key}, tok),
{name}_cell AS (
  SELECT {key}, h % {dim} AS i, CAST(sum(CASE WHEN (h >> 8) & 1 = 1 THEN -n ELSE n END) AS DOUBLE) AS c
  FROM {name}_val GROUP BY {key}, h % {dim}),
{name}_norm AS (SELECT {key}, greatest(sqrt(sum(c * c)), 1e-12) AS nrm FROM {name}_cell GROUP BY {key}),
{name}_grid AS (SELECT {key}, unnest(range({dim})) AS i FROM (SELECT DISTINCT {key} FROM {source})),
{name} AS (
  SELECT {cols}, list(CAST(CAST(coalesce(c.c / n.nrm, 0) AS FLOAT) AS DOUBLE) ORDER BY g.i) AS v
  FROM {name}_grid g LEFT JOIN {name}_cell c ON {join} AND g.i = c.i
  LEFT JOIN {name}_norm n ON {join.replace('c.', 'n.')}
  GROUP BY {cols})"""


def sql_dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"
