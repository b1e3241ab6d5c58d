import zlib

import numpy as np
import pytest

from loomgraph.llm import token_store as ts
from loomgraph.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("n, k", [(1, 1), (7, 3), (600, 5), (5000, 1000), (3000, 70000)])
def test_shard_round_trip(n, k):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, k, n).astype(np.uint32)
    shard = ts.Shard(**ts.pack_shard(ids))
    assert (shard.decode() == ids).all()
    for i in rng.integers(0, n, 20):
        token = int(ids[i])
        assert shard.access(i) == token
        assert shard.rank(token, i) == (ids[:i] == token).sum()
        assert shard.select(token, shard.rank(token, i)) == i
    assert shard.select(int(ids[0]), n) == -1 and shard.rank(999_999, n) == 0


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    texts = ["", " ", "a", "Hello, world! It's 12's  two\n\nlines\n end ", "don't  stop", "tab\tx y\r\nz", "café über, naïve.\nNext one", "wide　 space 　x", "a\x1c b", "a \x85b",
             "<|endoftext|> is text", "x <|endoftext|>", "1st 2nd $3.50 (really) €5", "你好 世界", "emoji \U0001f600 end", "under_score a__b", "é combining", "word.,;:!? word"]
    got = ts.PieceEncoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_in_order(odd, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in ts.digest(odd, PATH, shard_tokens=500).collect())
    want = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids))
                  for r in odd.collect() for ids in [whole.encode(r.text or "", add_special_tokens=False).ids + [2]])
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [g[1] for g in got] == [w[1] if w[0] else None for w in want]
    assert sorted((g[2], g[3]) for g in got) == sorted((w[3], w[2]) for w in want)
    assert ts.digest(empty, PATH).count() == 0


def test_files_can_be_read_again(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    ts.write_shards(odd, PATH, path)
    again = spark.read.schema(ts.SHARD_SCHEMA).parquet(path)
    assert ts.read_documents(again).count() == odd.count()
