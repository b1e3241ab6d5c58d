"""The registered queries of this package and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import context_mixing, dialogue, mixing, order_minhash, quality, resampling, run_index, secrets, structure_repair, tiling, token_counts, token_store, vector_links
from .common import count_words, table, tokenizer_path


def op4_run_index(spark, sf_dir):
    return run_index.digest(table(spark, sf_dir, "documents"))


def op5_token_store(spark, sf_dir):
    return token_store.digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_quality_rules(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"))


PIECE = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def op1_token_rollup(spark, sf_dir):
    """Four batches over all documents: counts by words, removal of every tenth document, a new tokenizer
    version (words and single stops) for every third that is left, and one batch sent again; then totals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    words = count_words(F.col("text"))
    pieces = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(PIECE)).cast("bigint")
    rollup = token_counts.Rollup(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}")
    tenth, third = F.col("doc_id") % 10 == 0, F.col("doc_id") % 3 == 0
    removed = token_counts.changes_of(docs.where(tenth), "delete", F.lit(0), "words", words, "words")
    rollup.commit(1, token_counts.changes_of(docs, "insert", words, "words"))
    rollup.commit(2, removed)
    rollup.fold()
    rollup.commit(3, token_counts.changes_of(docs.where(third & ~tenth), "revise", pieces, "pieces", words, "words"))
    rollup.commit(2, removed)
    return rollup.totals()


OP1_SQL = r"""
SELECT source, lang, CASE WHEN doc_id % 3 = 0 THEN 'pieces' ELSE 'words' END AS version, count(*)::BIGINT AS documents,
       sum(len(regexp_extract_all(coalesce(text, ''), CASE WHEN doc_id % 3 = 0 THEN '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]' ELSE '[^\x20\x09-\x0D]+' END)))::BIGINT AS tokens
FROM documents WHERE (doc_id % 10 = 0) IS NOT TRUE GROUP BY ALL"""


def op2_perspective_rotation(spark, sf_dir):
    return dialogue.digest(table(spark, sf_dir, "conversations"))


def op3_source_mix(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_order_minhash(spark, sf_dir):
    return order_minhash.digest(table(spark, sf_dir, "documents"))


def op8_context_mixing(spark, sf_dir):
    return context_mixing.scores(table(spark, sf_dir, "documents"))


def op9_secret_forest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.weak_findings(secrets.candidates(docs))))


def op10_string_tiling(spark, sf_dir):
    return tiling.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark, sf_dir):
    return resampling.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_structure_repair(spark, sf_dir):
    return structure_repair.digest(table(spark, sf_dir, "conversations"))


def op13_pca_tiles(spark, sf_dir):
    return vector_links.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_token_rollup": op1_token_rollup, "op2_perspective_rotation": op2_perspective_rotation, "op3_source_mix": op3_source_mix, "op4_run_index": op4_run_index, "op5_token_store": op5_token_store, "op6_quality_rules": op6_quality_rules, "op7_order_minhash": op7_order_minhash,
           "op8_context_mixing": op8_context_mixing, "op9_secret_forest": op9_secret_forest, "op10_string_tiling": op10_string_tiling, "op11_importance_resampling": op11_importance_resampling,
           "op12_structure_repair": op12_structure_repair, "op13_pca_tiles": op13_pca_tiles}
SQL = {"op1_token_rollup": OP1_SQL, "op2_perspective_rotation": dialogue.DIGEST_SQL, "op3_source_mix": mixing.DIGEST_SQL, "op6_quality_rules": quality.digest_sql(),
       "op11_importance_resampling": resampling.DIGEST_SQL, "op12_structure_repair": structure_repair.DIGEST_SQL}
