import hashlib
import math
import random
import re
import zlib

from loomgraph.llm import resampling as rs


def brute(rows, target, longest, buckets, share, least):
    def grams(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    found, wanted = [grams(t) for _, t in rows], [grams(t) for t in target]
    s, t = [0] * buckets, [0] * buckets
    for side, held in ((s, found), (t, wanted)):
        for _, g in held:
            for b in g:
                side[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, _), (n, g) in zip(rows, found):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        out.append([doc_id, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(order[:share * len(order) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_equals_direct_computation(spark):
    rng = random.Random(5)
    words = ["Ab", "cd", "ef'g", "über", "ÉT", "x1", "the", "of"]
    rows = [(k, rng.choice([" ", "\n", "--"]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(120)]
    target = [" ".join(rng.choice(words[:3]) for _ in range(30)) for _ in range(5)]
    docs, wanted = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    for longest, buckets, share in ((1, 10_000, 10), (3, 97, 25)):
        got = rs.resampled(docs, wanted, longest=longest, buckets=buckets, share=share).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, target, longest, buckets, share, 20)


def test_overlapping_spans():
    data = rs.collapsed("A b--c\x00D  é1")
    assert data == "a b c d é1".encode()
    assert [m[0] for m in rs.span_pattern(2).finditer(data, overlapped=True)] == [b"a b", b"b c", b"c d", "d é1".encode()]
    assert not list(rs.span_pattern(2).finditer(b"", overlapped=True)) and not list(rs.span_pattern(3).finditer(b"a b", overlapped=True))


def test_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("hill river stone " * 20,), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = rs.resampled(odd, target, share=50).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, ["hill river stone " * 20], 1, 10_000, 50, 20)
    assert rs.resampled(empty, target).count() == 0
    none = rs.resampled(odd, empty).collect()
    assert sorted(map(tuple, none), key=str) == brute(rows, [], 1, 10_000, 10, 20)
    assert rs.digest(odd, target).columns == ["doc_id", "n_features", "weight", "score", "rank"]
