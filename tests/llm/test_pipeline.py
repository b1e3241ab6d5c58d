"""The five stages against a plain-Python version on the smallest table."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from loomgraph.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "token_files"]


def test_whole_run(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state, kept = docs, [{r.doc_id for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == docs.columns
        rows = state.collect()
        kept.append({r.doc_id for r in rows})
    assert all(b <= a for a, b in zip(kept, kept[1:])) and len(kept[1]) < len(kept[0])
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_odd_rows(spark, odd):
    state = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == odd.columns
    assert state.count() > 0
