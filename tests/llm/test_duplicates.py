import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import order_minhash as om
from loomgraph.llm import run_index as ri
from loomgraph.llm import tiling, words

from conftest import prose


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(1500):
        a = [rng.randrange(rng.choice((2, 5, 30))) for _ in range(rng.randrange(30))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(5) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(8)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(6))
        d = edit(a, b)
        assert all(om.distance_within(a, b, m) == (d <= m) for m in (0, 1, 2, 5, 12))


def test_words_do_not_depend_on_segments(monkeypatch):
    texts = ["Hello, World! Été über 12ab", None, "", "hello world", "x" * 100]
    h, o = words.word_hashes(texts)
    monkeypatch.setattr(words, "SEGMENT", 16)
    h2, o2 = words.word_hashes(texts)
    assert (h == h2).all() and (o == o2).all() and o.tolist() == [0, 5, 5, 5, 7, 8] and h[0] == h[5]


def test_occurrence_labels():
    values, owner = om.shingles(*words.word_hashes(["a b c d e a b c d e a b c d e", "a b", "", "a b"]))
    assert Counter(owner.tolist()) == {0: 11, 1: 1, 3: 1} and len(set(values[owner == 0])) == 11 and values[-1] == values[-2]


def test_classes(spark, odd, empty):
    rng, rows = random.Random(1), []
    for g in range(30):
        text = prose(100 + g, 150).split()
        for c in range(rng.randrange(1, 8)):
            changed = list(text)
            for _ in range(rng.randrange(0, 6)):
                changed[rng.randrange(len(changed))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed), g))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, g int")
    got = {r.doc_id: r.class_id for r in om.digest(frame).collect()}
    first = {}
    for d, _, g in rows:
        first.setdefault(g, d)
    assert got == {d: first[g] for d, _, g in rows}
    small = om.digest(odd).collect()
    assert len(small) == odd.count()
    by = {(r.doc_id, r.class_id) for r in small}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (7, 7), (None, None)} <= by
    assert om.digest(empty).count() == 0


def test_pairs_inside_a_common_passage(spark):
    """Texts that share half their words with all others still find the one text that they are a copy of."""
    base = prose(9, 60)
    rows = [(i, base + " " + prose(1000 + i // 2, 60)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in om.digest(frame).collect()} == {i: i - i % 2 for i in range(40)}


def test_copies_unlike_each_other(spark):
    """Copies with a passage inserted at different places are like the original and some others only; the classes are those of brute force."""
    rng, texts = random.Random(31), []
    for g in range(12):
        base = prose(500 + g, 120).split()
        texts.append(" ".join(base))
        for c in range(9):
            at, extra = rng.randrange(120), [f"x{g}y{c % 3}z{i}" for i in range(rng.randrange(20, 29))]
            texts.append(" ".join(base[:at] + extra + base[at:]))
    texts += [" ".join(t.split()[20:]) for t in texts[::5]]
    texts = sorted(set(texts))
    rng.shuffle(texts)
    split, root = [t.lower().split() for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and om.similar(split[i], split[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in om.digest(frame).collect()} == dict(enumerate(root))


def test_pairs_grow_with_the_texts(spark, monkeypatch):
    """n texts that share a passage of 60 words and differ in 30 are no copies; the pairs aligned for them stay in proportion to n."""
    passage, counts, plain = prose(70, 60), [], om.aligned

    def counting(pairs, words, percent):
        counts[-1] += pairs.count()
        return plain(pairs, words, percent)

    monkeypatch.setattr(om, "aligned", counting)
    for n in (100, 400):
        counts.append(0)
        rows = [(i, f"{passage} {prose(3000 + i, 30)}") for i in range(n)] + [(1000, f"{passage} {prose(3005, 29)} end")]
        got = {r.doc_id: r.class_id for r in om.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got == {i: i for i in range(n)} | {1000: 5}
    assert counts[1] <= 6 * counts[0] and counts[1] <= 64 * 400


def test_one_of_each(odd, empty):
    got = om.one_of_each(odd)
    assert got.columns == odd.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 0 and ids[11] == 2 and ids[4] == 1 and ids[None] == 2
    assert om.one_of_each(empty).count() == 0


def plain_tiling(a, b, least):
    ma, mb, out = [0] * len(a), [0] * len(b), []
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if not any(ma[i:i + best]) and not any(mb[j:j + best]):
                ma[i:i + best] = mb[j:j + best] = [1] * best
                out.append((i, j, best))


def test_tiling_equals_the_plain_method():
    rng = random.Random(2)
    for _ in range(600):
        v = rng.choice((2, 3, 8))
        a, b = [rng.randrange(v) for _ in range(rng.randrange(40))], [rng.randrange(v) for _ in range(rng.randrange(25))]
        least = rng.randrange(1, 5)
        assert tiling.tiles(a, b, least) == plain_tiling(a, b, least)


def test_contamination(spark, odd, empty):
    item = prose(77, 40).split()
    moved = " ".join(item[20:]) + " and then something else entirely came between, " + " ".join(item[:20]).upper() + "!"
    rows = [(1, "x " + moved), (2, " ".join(item[:12])), (3, "short item"), (None, " ".join(item)), (4, None), (5, ""), (6, prose(1, 5000) + " " + " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(10, " ".join(item), "k"), (11, "Short, item", "k"), (12, None, "k"), (13, "", "k"), (None, " ".join(item), "k")], "item_id bigint, text string, key string")
    got = Counter((r.doc_id, r.item_id) for r in tiling.digest(docs, items).collect())
    assert got == Counter([(d, i) for d in (1, None, 6) for i in (10, None)] + [(3, 11)])
    assert {r.doc_id for r in tiling.without_benchmark(docs, items).collect()} == {2, 4, 5}
    kept = tiling.without_benchmark(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert tiling.digest(empty, items).count() == 0 and tiling.digest(docs, items.limit(0)).count() == 0


def test_portions(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(i, 20)) for i in range(7)], "item_id bigint, text string")
    assert [len(p) for p in tiling.portions(items, "item_id", "text", 3)] == [3, 3, 1]


def removed(rows, length):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i:i + length] for _, t in raw for i in range(len(t) - length + 1))
    out = Counter()
    for d, t in raw:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i:i + length] = True
        edges = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0))
        out[(d, len(t), int(mark.sum()), len(edges) // 2, hashlib.sha256(np.frombuffer(t, np.uint8)[~mark].tobytes()).hexdigest())] += 1
    return out


def test_portions_end_at_words(spark):
    items = spark.createDataFrame([(i, prose(i, n)) for i, n in enumerate([5, 5, 5, 30, 1, 9, 0])], "item_id bigint, text string")
    got = [[(i, len(w)) for i, w in p] for p in tiling.portions(items.coalesce(1), "item_id", "text", most_words=12)]
    assert got == [[(0, 5), (1, 5)], [(2, 5)], [(3, 30)], [(4, 1), (5, 9)]]


def test_index_equals_counting():
    rng = random.Random(4)
    for _ in range(300):
        v, length = rng.choice((1, 2, 3)), rng.choice((2, 3, 5))
        pieces = [bytes(rng.randrange(97, 97 + v) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 6))]
        seen = Counter(p[i:i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if seen[p[i:i + length]] > 1] for p in pieces]
        assert [x.tolist() for x in ri.repeated_starts(pieces, length)] == want


@pytest.mark.parametrize("text", [b"", b"a", b"aa", b"\x00\x00a\x00", b"banana" * 50, bytes(range(256)) * 3, b"ab" * (1 << 20) + b"abb"])
def test_suffixes_in_order(text):
    data = np.frombuffer(text, np.uint8)
    order = ri.suffix_array(data)
    rank = np.empty(len(data) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(data)), -1
    a, b = order[:-1], order[1:]
    assert sorted(order.tolist()) == list(range(len(data)))
    assert ((data[a] < data[b]) | ((data[a] == data[b]) & (rank[a + 1] < rank[b + 1]))).all()


def test_places_that_stand_alone_are_sorted_once(monkeypatch):
    rng, sorts, plain = np.random.default_rng(1), [], np.argsort
    text = np.concatenate((rng.integers(0, 200, 50_000), np.tile(rng.integers(0, 200, 700), 2))).astype(np.uint8)
    monkeypatch.setattr(np, "argsort", lambda v, **k: sorts.append(len(v)) or plain(v, **k))
    ri.suffix_array(text)
    assert sum(sorts) < 1.3 * len(text)


def test_lone_routes_are_not_indexed(spark):
    routed = spark.createDataFrame([(1, 1, 1, 0, b"a"), (1, 1, 1, 0, b"a"), (2, 2, 2, 0, b"b"), (2, 2, 3, 0, b"c"), (3, 3, 4, 0, b"d")], "route bigint, pick bigint, content bigint, shift int, piece binary")
    copied, crowded, sparse = ri.by_bytes(routed.withColumn("bytes", F.col("piece")), 5)
    assert [r.route for r in copied.collect()] == [1] and crowded.count() == 0
    assert sorted(bytes(r.piece) for r in sparse.collect()) == [b"b", b"c"]


@pytest.mark.parametrize("many", [256, 3])
def test_repeats_equal_counting(spark, odd, many):
    rng = random.Random(5)
    noise = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    x, passage = noise("abcdefgh ", 900), noise("abcdefgh ", 380)
    rows = [(1, x), (2, "zz" + x[100:700] + "yy"), (3, "q" * 1500), (4, "ab" * 2000), (5, None), (6, ""), (7, x[:450] + "é" + x[300:]), (8, "k" * 399), (9, "w" * 400), (10, noise("mnop ", 300) * 3)]
    rows += [(100 + i, noise("xyzw", 60) + passage + rng.choice(["1234567890ABCDEFGHIJKLMN", noise("xyzw", 60)])) for i in range(40)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, key string")
    assert Counter(map(tuple, ri.digest(frame, many=many).collect())) == removed(rows, 400)
    assert Counter(map(tuple, ri.digest(odd, many=many).collect())) == removed([(r.doc_id, r.text) for r in odd.collect()], 400)


def test_common_passage_is_indexed_once(spark, monkeypatch):
    """What goes to the indexes does not grow with the number of texts that hold a passage; marks equal counting."""
    passage, sizes, rng = prose(70, 160), [], random.Random(5)
    texts = [prose(800 + i, 40) + "".join(rng.choice("0123456789") for _ in range(30)) + passage + prose(900 + i, 40) for i in range(24)]
    plain = ri.by_bytes

    def seen(routed, many):
        copied, crowded, sparse = plain(routed, many)
        sizes.append(sparse.groupBy("route").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
        return copied, crowded, sparse

    monkeypatch.setattr(ri, "by_bytes", seen)
    rows = list(enumerate(texts))
    got = ri.digest(spark.createDataFrame(rows, "doc_id bigint, text string"), many=4).collect()
    assert Counter(map(tuple, got)) == removed(rows, 400) and sizes[0] < 4


def test_rows_of_a_frequent_pick_are_dealt_out(spark, monkeypatch):
    """The pieces of a passage that all texts hold do not meet in one task of the join with the picks that occur again."""
    passage, written, plain = prose(71, 160), [], ri.materialise
    rows = [(i, prose(2000 + i, 40) + passage + prose(5000 + i, 40)) for i in range(160)]

    def seen(df):
        out = plain(df)
        if set(out.columns) == {"key", "first", "windows", "back", "pick", "content"}:
            written.append(out)
        return out

    monkeypatch.setattr(ri, "materialise", seen)
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "1k",
                "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "adaptive.skewJoin.skewedPartitionFactor": "0.1"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = ri.digest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert Counter(map(tuple, got)) == removed(rows, 400)
    shared = written[1].groupBy("pick", F.input_file_name().alias("file")).count().groupBy("pick").agg(F.sum("count").alias("n"), F.max("count").alias("most")).where("n >= 160")
    shares = [r.most / r.n for r in shared.collect()]
    assert shares and max(shares) <= 0.5


def test_long_text_in_stretches(spark, empty, monkeypatch):
    rng = random.Random(6)
    part = "".join(rng.choice("abcdefgh ") for _ in range(700))
    text = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000)) + part
    got = ri.digest(spark.createDataFrame([(1, text), (2, "0" + part)], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in got} == {(1, 700, 1), (2, 700, 1)}
    assert ri.digest(empty).count() == 0
