"""From raw documents to token files: quality rules, near-dedup, decontamination, mixing, binary output.

Each stage works on all rows that its predecessor kept. ``run`` writes every stage as Parquet into a
folder of its own below the shared checkpoint folder and reads it again for the next one.
"""

from __future__ import annotations

from loomgraph.llm import mixing, order_minhash, quality, tiling, token_store
from loomgraph.llm.common import table, tokenizer_path
from loomgraph.session import materialise


def quality_rules(spark, docs, sf_dir):
    """Documents that break no quality rule."""
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near copies."""
    return order_minhash.one_of_each(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that no benchmark item contaminates."""
    return tiling.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """The documents that the mix takes, one row for each repeat, cut where a target is reached."""
    return mixing.mixed_documents(docs)


def token_files(spark, docs, sf_dir):
    """Wavelet-matrix shards of the token ids; per row what is read back from them."""
    return token_store.digest(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]
ORACLE_SQL = None  # near-dedup and tokenizing have no SQL; tests/llm compares the rows with a brute-force version


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
