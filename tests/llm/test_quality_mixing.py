import re
from collections import Counter

import pytest

from compare import connect
from loomgraph.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_columns(odd):
    got = quality.digest(odd).collect()
    texts = [r["text"] for r in odd.collect()]
    assert len(got) == len(texts)
    assert Counter(tuple(r)[1:6] for r in got) == Counter(base(t) for t in texts)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_stage_keeps_columns(odd, empty):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3}
    assert 9 not in {r.doc_id for r in kept.collect()}
    assert quality.keep_good(empty).count() == 0


def test_rule_table_is_a_parameter(odd):
    rules = (quality.Rule("no_c", "n_symbols", "one", "max", 0),)
    assert {r.doc_id for r in quality.keep_good(odd, rules=rules, base_rules=()).collect()} == {r.doc_id for r in odd.collect()} - {9, 12}


def shares(sizes):
    """Targets by repeated resharing of what exceeds three times a source."""
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda x: (x is None, x)))}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        weight = sum(weights[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weights[s] / weight for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_targets(odd):
    rows = mixing.digest(odd).collect()
    assert len(rows) == odd.count()
    source = Counter()
    texts = {}
    for r in odd.collect():
        n = len(WORD.findall(r.text or ""))
        source[r.source] += n
        texts.setdefault((r.doc_id, n), r.source)
    want = shares(source)
    taken = Counter()
    for r in rows:
        s = texts[(r.doc_id, r["size"])]
        taken[s] += r.taken
        assert r.source_size == source[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r["size"]
    for s in source:
        assert abs(taken[s] - want[s]) <= 1
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.digest(odd.repartition(5)).collect()))


def test_mix_pieces_are_equal_blocks(odd):
    m = mixing.mix(odd, longest_block=64)
    slots = {}
    for r in m.pieces.collect():
        slots.setdefault((r.skey, r.block), []).append(r.to_word - r.from_word)
    last = {}
    for s, b in slots:
        last[s] = max(last.get(s, 0), b)
    sizes = {sum(v) for (s, b), v in slots.items() if b < last[s]}
    assert len(sizes) <= 1


def test_mixed_documents(odd, empty):
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    words = Counter()
    for r in got.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.mix(odd).pieces.collect():
        want[r.source] += r.to_word - r.from_word
    assert words == want
    assert mixing.mixed_documents(empty).count() == 0 and mixing.digest(empty).count() == 0


def test_golden_points_are_spread(spark):
    from pyspark.sql import functions as F

    xs = sorted(r[0] for r in spark.range(0, 1000).select(mixing.point(F.col("id"))).collect())
    assert [(k * 2654435769) % (1 << 32) for k in range(3)] == [r[0] for r in spark.range(0, 3).select(mixing.point(F.col("id"))).orderBy("id").collect()]
    gaps = [b - a for a, b in zip(xs, xs[1:])]
    assert max(gaps) < 3 * (1 << 32) / 1000


@pytest.mark.parametrize("name", ["op1_token_rollup", "op2_perspective_rotation", "op3_source_mix", "op6_quality_rules"])
def test_matches_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries
    from compare import compare

    sf = "/root/testdata/sf0.001"
    rows, _, _, problem = compare(spark, connect(sf), sf, queries()[name], oracle_sql()[name])
    assert problem is None and rows > 0
