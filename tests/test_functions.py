import hashlib
import re
import string

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import hashing as hs
from loomgraph.functions import scoring as sc
from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vx
from loomgraph.operators.evaluate import list_metrics, score_predictions

TEXTS = ["42:hello", "multi\nline body", "0:  spaced  ", "7:##x\n##y", "", "  ", "The café, a naïve RÉSUMÉ — an \"old\" one!", "a b c", "x" * 5, "Ünïcödé the end."]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def values(df):
    return [r[1] for r in sorted(df.collect(), key=lambda r: r[0])]


def py_normalise(s):
    s = "".join(c for c in s.lower() if c not in set(string.punctuation))
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


@pytest.mark.parametrize("n", [2, 5, 7, 1000003])
def test_title_client_is_md5_modulo(spark, n):
    titles = [f"title {i} é" for i in range(50)]
    got = values(frame(spark, titles).select("i", hs.title_client(F.col("t"), n)))
    assert got == [int(hashlib.md5(t.encode()).hexdigest(), 16) % n for t in titles]


def test_title_client_rejects_bad_counts():
    with pytest.raises(ValueError):
        hs.title_client(F.lit("x"), 0)


def test_content_keys(spark):
    r = frame(spark, ["Ada"]).select(hs.entity_key(F.col("t")), hs.title_id(F.col("t")), hs.title_sentence_id(hs.title_id(F.col("t")), F.lit(3)), hs.audit_id(F.lit(12345678901))).head()
    sha = hashlib.sha1(b"Ada").hexdigest()
    assert r[0] == "entity-" + hashlib.md5(b"Ada").hexdigest()
    assert r[1] == sha and r[2] == hashlib.sha1(f"{sha}::3".encode()).hexdigest()
    assert r[3] == (12345678901 * 1103515245 + 12345) % 2147483647


def test_chunk_parsing(spark):
    df = frame(spark)
    assert values(df.select("i", tx.parse_chunk_index(F.col("t"))))[:5] == [42, -1, 0, 7, -1]
    assert values(df.select("i", tx.parse_chunk_body(F.col("t"))))[:4] == ["hello", "multi\nline body", "spaced", "##x\n##y"]


def test_normalise_matches_python(spark):
    assert values(frame(spark).select("i", tx.normalise_answer(F.col("t")))) == [py_normalise(t) for t in TEXTS]


def test_windows_match_python_split(spark):
    texts = TEXTS + [" ".join(f"w{i}" for i in range(n)) for n in (63, 64, 65, 200)]
    staged = frame(spark, texts).select("i", tx.window_tokens(F.col("t")).alias("k"))
    got = values(staged.select("i", tx.chunk_windows(F.col("k"), 64)))
    want = [[" ".join(t.split()[i:i + 64]) for i in range(0, len(t.split()), 64)] or [""] for t in texts]
    assert got == want


def test_title_of(spark):
    texts = ["3: The Title : body", "No colon", "12:Only", ":empty head", "  9:x"]
    def py(t):
        return re.sub(r"^\d+:", "", t, count=1).strip().partition(":")[0].strip().lower()
    assert values(frame(spark, texts).select("i", tx.title_of(F.col("t")))) == [py(t) for t in texts]


def test_occurrences_and_overlap(spark):
    r = frame(spark, ["aXaXaa"]).select(tx.occurrences(F.col("t"), F.lit("aX")), tx.occurrences(F.col("t"), F.lit("aa")), tx.occurrences(F.lit("aaa"), F.lit("aa"))).head()
    assert tuple(r) == (2, 1, 1)
    r = frame(spark, ["Where was she born?"]).select(tx.is_attribute_query(F.col("t")), tx.keyword_overlap(F.col("t"), F.lit("Reborn, but where"))).head()
    assert tuple(r) == (True, 2)


def test_prompt_and_answer(spark):
    df = frame(spark, ["Thought: x Answer: 42 ", "no marker"])
    assert values(df.select("i", tx.answer_of(F.col("t")))) == ["42", "no marker"]
    p = df.select(tx.reading_prompt(F.array(F.lit("p1"), F.lit("p2")), F.lit("q?"))).head()[0]
    assert p == "p1\np2\nQuestion: q?\n Thought: "
    assert df.select(tx.question_field(F.lit("Who?"))).head()[0] == "Question: Who?\nAnswer: "


def test_scores(spark):
    rows = [("The cat sat", "cat sat down"), ("", ""), ("x", ""), ("Paris, France", "paris"), ("a b b", "b b b c")]
    df = spark.createDataFrame(rows, "pred string, label string")
    got = [(r.hit, r.em, round(r.f1, 6)) for r in score_predictions(df).collect()]
    assert got == [(0, 0, 0.8), (1, 1, 1.0), (1, 0, 0.0), (1, 0, round(2 / 3, 6)), (0, 0, round(4 / 6, 6))]
    blank = df.select(sc.contains_non_blank(F.col("pred"), F.col("label")).alias("c")).collect()
    assert [r.c for r in blank] == [0, 0, 0, 1, 0]


def test_list_metrics(spark):
    df = spark.createDataFrame([("Paris|London", "paris|rome"), ("nothing", "x")], "pred string, label string")
    r = list_metrics(df).head()
    assert (r.accuracy, r.hit, r.precision, r.recall, r.f1) == pytest.approx((25.0, 50.0, 25.0, 25.0, 25.0))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vx.l2_normalise(F.col("a")), vx.l2_normalise(F.col("b")), vx.cosine(F.col("a"), F.col("b")), vx.layer_norm(F.col("a")), vx.dot(F.col("a"), F.col("a"))).head()
    assert r[0] == pytest.approx([0.6, 0.8]) and r[1] == [0.0, 0.0] and r[2] == 0.0 and r[4] == 25.0
    assert r[3] == pytest.approx([-0.5 / (0.25 + 1e-5) ** 0.5, 0.5 / (0.25 + 1e-5) ** 0.5])
    s = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "k int, x array<double>")
    assert {r.k: r.x for r in vx.sum_vectors(s, ["k"], "x", 2, mean=True).collect()} == {1: [2.0, 3.0], 2: [5.0, 5.0]}
    t = spark.createDataFrame([(0.5,), (-0.5,), (0.1,)], "v double").select(vx.soft_threshold(F.col("v"), F.lit(0.2)))
    assert [round(r[0], 9) for r in t.collect()] == [0.3, -0.3, 0.0]


def test_hash_encoder_matches_definition(spark):
    import numpy as np

    from loomgraph.operators.encode import hash_encoder

    def direct(text, dim):
        v = np.zeros(dim)
        for token in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1.0 if (h >> 8) & 1 == 0 else -1.0
        n = np.linalg.norm(v)
        return v / n if n else v

    got = values(frame(spark).select("i", hash_encoder(48)(F.col("t"))))
    for g, t in zip(got, TEXTS):
        assert g == pytest.approx(direct(t, 48).tolist(), abs=1e-6)


def test_hash_encoder_memory_is_bounded_by_a_few_texts(spark):
    """A batch of long texts is encoded part by part: its tokens are never held at once."""
    import random
    import tracemalloc

    import pandas as pd

    from loomgraph.operators.encode import hash_encoder

    rng = random.Random(1)
    texts = pd.Series([" ".join(f"w{rng.randrange(100_000)}" for _ in range(300)) for _ in range(2000)])
    encode = hash_encoder(32, "md5").func
    tracemalloc.start()
    got = list(encode(iter([texts, texts.iloc[:0]])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = list(encode(iter([texts.iloc[[1999]]])))[0]
    assert [len(g) for g in got] == [2000, 0] and got[0].iloc[1999].tolist() == alone.iloc[0].tolist()
    assert peak < 24 << 20
