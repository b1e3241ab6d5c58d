"""Near-duplicates by Order MinHash, verified by banded alignment.

1. Sketch. Each text gives five-word shingles labelled by their occurrence in the text. Each of ``sketches``
   hash functions takes the ``picks`` labelled shingles of least value and keeps them in text order; the
   ordered tuple is one bucket key. Two texts share a key with a chance that follows both the share of equal
   shingles and their order, that is, edit similarity.
2. Candidates. Equal texts are one node. All nodes of a bucket are compared with the most typical one (which
   shares its buckets with most texts) and, where that leaves the bucket in several components, with one drawn by a
   hash, so a group of any size costs two pairs per member. Pairs whose lengths or least values (one per hash function) rule similarity out are dropped before any
   text is fetched. A bucket still in several components goes on: every member loses the shingles that it shares
   with the typical one, and what is left is sketched and bucketed again among members with the same typical text.
   So texts that share no more than a passage part at once, and copies that share more meet again. Each level
   takes shingles away, so levels end; each costs two pairs per member and bucket.
3. Verification. Word sequences are aligned within a band: edit distance by bit vectors along diagonals
   of at most (1 - similarity) * longer length; similarity is 1 - distance / longer length.
4. Classes. Connected components of the verified links by alternating stars, as Spark joins.

No bucket, partner or candidate is capped. A pair is not tested where no sketch agrees or fewer than ``agree`` of the
least values do: below one in 10**5 where 0.8 of the shingles are shared, 2 % at 0.5. Word changes spread evenly
share few shingles: by the formula 12 % are missed at similarity 0.9, 62 % at 0.857, 96 % at 0.8. In a bucket of
several components the same chance holds for the shingles that two members do not share with its typical text.

Defined results: a null text is a class of its own; texts without a word are linked to equal texts only;
equal texts (repeated rows included) share a class; a class is named by its least doc_id, null if it has
none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .words import chunks, mixed, word_hashes

SHINGLE = 5
SKETCHES = 32
PICKS = 3
PERCENT = 80
AGREE = 9  # of the least values of SKETCHES hash functions
FEW = 14  # values below the cut of a hash function expected per text
BIG = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(7)
WEIGHT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
SEED = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values, text of each value): occurrence-labelled shingles in text order; a text of fewer than
    ``k`` words is one shingle."""
    counts = np.diff(offsets)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    values = sum(padded[i:i + len(words)] * WEIGHT[i] for i in range(k)) if len(words) else words
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(offsets[1:], counts) - np.arange(len(words))  # words from here to the end of the text
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[offsets[t]:offsets[t + 1]]
        values[offsets[t]] = (own * WEIGHT[:len(own)]).sum()
    valid = (left >= k) | ((np.repeat(counts, counts) < k) & (left == np.repeat(counts, counts)))
    values, owner = mixed(values[valid]), owner[valid]
    key = mixed(values + owner.astype(np.uint64) * WEIGHT[60])
    order = np.argsort(key, kind="stable")
    run = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(order) else np.zeros(0, bool)
    if not run.all():
        first = np.maximum.accumulate(np.where(run, np.arange(len(run)), 0))
        occurrence = np.empty(len(run), np.uint64)
        occurrence[order] = np.arange(len(run)) - first
        values = np.where(occurrence > 0, mixed(values + occurrence * WEIGHT[61]), values)
    return values, owner


def sketch(values: np.ndarray, owner: np.ndarray, texts: int, sketches: int = SKETCHES, picks: int = PICKS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and least values (16 bits of each), texts x sketches; rows of texts without shingles are zero."""
    counts = np.bincount(owner, minlength=texts)
    need = np.minimum(counts, picks)
    out, least = np.zeros((texts, sketches), np.uint64), np.zeros((texts, sketches), np.uint16)
    held = np.concatenate((values, np.zeros(1, np.uint64)))
    cut = np.where(counts <= 4 * FEW, BIG, (float(1 << 63) * 2 * FEW / np.maximum(counts, 2 * FEW + 1)).astype(np.uint64))
    limit = np.repeat(cut, counts)
    for j in range(sketches):
        v = (values ^ SEED[j]) * WEIGHT[j]
        v ^= v >> np.uint64(32)
        near = np.flatnonzero(v <= limit)
        got = np.bincount(owner[near], minlength=texts)
        if (lack := got < need).any():  # too few below the cut: take all values of these texts
            near = np.flatnonzero((v <= limit) | np.repeat(lack, counts))
            got = np.bincount(owner[near], minlength=texts)
        order = near[np.lexsort((v[near], owner[near]))]
        start = np.concatenate(([0], np.cumsum(got)[:-1]))
        place = np.full((texts, picks), len(values))
        for p in range(picks):
            has = need > p
            place[has, p] = order[start[has] + p]
        least[:, j] = mixed(held[place[:, 0]]) >> np.uint64(48)
        place.sort(axis=1)
        key = np.full(texts, SEED[200 + j], np.uint64)
        for p in range(picks):
            key = mixed(key * WEIGHT[62] + held[place[:, p]])
        out[:, j] = np.where(counts > 0, key, np.uint64(0))
    return out, least


def distance_within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance of two sequences is ``most`` or less, by bit vectors along the band of
    diagonals that such an alignment can touch."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    lead = 0
    while lead < len(b) and a[lead] == b[lead]:
        lead += 1
    a, b = a[lead:], b[lead:]
    tail = 0
    while tail < len(b) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not b or len(a) <= most:
        return len(a) <= most
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    width = 2 * most + 2
    full, last = (1 << width) - 1, 1 << (width - 1)
    plus, minus, distance, start = full & ~((1 << (width - most - 1)) - 1), 0, most, most + 1 - width
    across, diagonals, bound = last >> 1, len(a) - most, 2 * most + len(b) - len(a)
    for i, x in enumerate(b):
        same = places.get(x, 0)
        same = (same >> start if start >= 0 else same << -start) & full
        zero = ((((same & plus) + plus) ^ plus) | same | minus) & full
        up = minus | (full & ~(zero | plus))
        down = zero & plus
        if i < diagonals:
            if not zero & last:
                distance += 1
                if distance > bound:
                    return False
        else:
            if up & across:
                distance += 1
            if down & across:
                distance -= 1
            across >>= 1
        half = zero >> 1
        plus = down | (full & ~(half | up))
        minus = half & up
        start += 1
    return distance <= most


def similar(a: list, b: list, percent: int = PERCENT) -> bool:
    return distance_within(a, b, (100 - percent) * max(len(a), len(b)) // 100)


def text_key(text):
    """16 bytes that name a text; null for a null text."""
    return F.unhex(F.md5(text))


ENTRY = "grp bigint, key binary, n int, values binary, least binary, keys array<bigint>"


def entries(grp, key, n, values: np.ndarray, owner: np.ndarray, sketches: int, picks: int, held: bool) -> pd.DataFrame:
    """Rows of ENTRY from the shingles of several texts; ``values`` are kept where ``held``."""
    found, least = sketch(values, owner, len(key), sketches, picks)
    cuts = np.searchsorted(owner, np.arange(len(key) + 1))
    return pd.DataFrame({"grp": grp, "key": key, "n": n, "values": [values[a:b].tobytes() if held else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                         "least": pd.Series([x.tobytes() for x in least], dtype=object), "keys": pd.Series(list(found.view(np.int64)), dtype=object)})


def sketched(rows: DataFrame, sketches: int, picks: int) -> DataFrame:
    """Rows of ENTRY, in one group and without values, of rows (key, text); texts without a word are left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                words, offsets = word_hashes(texts[a:b])
                some = np.flatnonzero(np.diff(offsets) > 0)
                values, owner = shingles(words, offsets)
                yield entries(0, batch["key"].iloc[a:b].iloc[some].values, np.diff(offsets)[some], values, np.searchsorted(some, owner), sketches, picks, False)

    return rows.mapInPandas(work, ENTRY)


def shingle_values(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(grp, key, values): all shingles of the texts named by ``keys``, in the one group of the first level."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            offsets = np.concatenate(([0], np.cumsum([len(w) for w in batch["words"]])))
            values, owner = shingles(np.concatenate(batch["words"].tolist()).view(np.uint64), offsets) if len(batch) else (np.zeros(0, np.uint64), np.zeros(0, int))
            cuts = np.searchsorted(owner, np.arange(len(batch) + 1))
            yield pd.DataFrame({"grp": 0, "key": batch["key"].values, "values": [values[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]})

    return words.join(keys, "key", "left_semi").mapInPandas(work, "grp bigint, key binary, values binary")


def residuals(held: DataFrame, pairs: DataFrame, sketches: int, picks: int) -> DataFrame:
    """Rows of ENTRY: for (grp, a, b, n) what text b has beyond text a, in a group of its own for each (grp, a)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, size = 0, 0
            for k, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                size += len(x) + len(y)
                if size < 1 << 24 and k + 1 < len(batch):
                    continue
                part = batch.iloc[at:k + 1]
                left = [own[~np.isin(own, np.frombuffer(head, np.uint64))] for head, own in zip(part["x"], (np.frombuffer(y, np.uint64) for y in part["y"]), strict=True)]
                some = [i for i, v in enumerate(left) if len(v)]
                if some:
                    part = part.iloc[some]
                    owner = np.repeat(np.arange(len(some)), [len(left[i]) for i in some])
                    yield entries(part["next"].values, part["b"].values, part["n"].values, np.concatenate([left[i] for i in some]), owner, sketches, picks, True)
                at, size = k + 1, 0

    one = held.select("grp", F.col("key").alias("a"), F.col("values").alias("x"))
    two = held.select("grp", F.col("key").alias("b"), F.col("values").alias("y"))
    joined = pairs.join(one, ["grp", "a"]).join(two, ["grp", "b"])
    return joined.select(F.xxhash64("grp", "a").alias("next"), "b", "n", "x", "y").mapInPandas(work, ENTRY)


def agreeing(pairs: DataFrame, nodes: DataFrame, agree: int) -> DataFrame:
    """The pairs (grp, a, b) with at least ``agree`` equal least values."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), -1) for c in ("x", "y"))
            yield batch.loc[(x == y).sum(axis=1) >= agree, ["a", "b"]]

    one, two = (nodes.select("grp", F.col("key").alias(k), F.col("least").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(one, ["grp", "a"]).join(two, ["grp", "b"]).select("a", "b", "x", "y").mapInPandas(work, "a binary, b binary")


def with_heads(nodes: DataFrame) -> DataFrame:
    """(grp, bucket, c, key, n, typical, drawn): members of every bucket of two or more with its two heads as (key, n).

    The typical one shares its buckets with most texts (largest sum of logarithms of their sizes); keys are digests of
    texts, so the least one is a fair draw."""
    members = nodes.select("grp", "key", "n", F.explode("keys").alias("k")).select("grp", "key", "n", F.xxhash64("grp", "k").alias("bucket"))
    several = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = materialise(members.join(several, "bucket"))
    common = members.groupBy("grp", "key").agg(F.round(F.sum(F.log("c")), 6).alias("common"))
    told, who = members.join(common, ["grp", "key"]), F.struct("key", "n")
    heads = told.groupBy("bucket").agg(F.max_by(who, F.struct("common", "key")).alias("typical"), F.min_by(who, "key").alias("drawn"))
    return members.join(heads, "bucket")


def aligned(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose word sequences are similar; ``words``: (key, words)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[bytes, list] = {}
            keep = []
            for b, x, y in zip(batch["b"], batch["x"], batch["y"], strict=True):
                if b not in held:
                    held = {b: y.tolist()}
                keep.append(similar(x.tolist(), held[b], percent))
            yield batch.loc[keep, ["a", "b"]]

    one = words.select(F.col("key").alias("a"), F.col("words").alias("x"))
    two = words.select(F.col("key").alias("b"), F.col("words").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInPandas(work, "a binary, b binary")


def words_of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, words) for the named texts, one row per text; texts are shuffled once, whatever the number of keys."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                words, offsets = word_hashes(texts[a:b])
                yield pd.DataFrame({"key": batch["key"].iloc[a:b].values, "words": pd.Series(np.split(words.view(np.int64), offsets[1:-1]), dtype=object)})

    wanted = rows.join(keys.hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return wanted.mapInPandas(work, "key binary, words array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in ``links`` (a, b): the least key that it is connected to."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("key"), F.col("v").alias("root"))
        seen = state


def joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(key, root) after more ``links`` (a, b): only the roots that these join are worked through again."""
    if roots is None:
        return materialise(components(links))
    if links.isEmpty():
        return roots
    named = roots.select(F.col("key").alias("k"), F.col("root").alias("r"))
    between = links
    for end in ("a", "b"):
        between = between.join(named, F.col(end) == F.col("k"), "left").withColumn(end, F.coalesce("r", end)).drop("k", "r")
    merged = materialise(components(between.where("a <> b").distinct()))
    moved = roots.join(merged.select(F.col("key").alias("root"), F.col("root").alias("now")), "root", "left").select("key", F.coalesce("now", "root").alias("root"))
    return materialise(moved.unionByName(merged.join(roots, "key", "left_anti").select("key", "root")))


def near_roots(rows: DataFrame, sketches: int = SKETCHES, picks: int = PICKS, percent: int = PERCENT, agree: int = AGREE) -> DataFrame:
    """(key, root) of every text of ``rows`` (key, text) that has a verified link to another one."""
    nodes = sketched(rows, sketches, picks).groupBy("key").agg(*[F.first(c).alias(c) for c in ("grp", "n", "least", "keys")])
    nodes, tested, roots, drawn, words = materialise(nodes), None, None, None, None

    def candidates(members: DataFrame, head: str, nodes: DataFrame) -> DataFrame:
        h = F.col(head)
        near = members.where((F.col("key") != h["key"]) & (100 * F.least("n", h["n"]) >= percent * F.greatest("n", h["n"])))
        return agreeing(near.select("grp", F.least("key", h["key"]).alias("a"), F.greatest("key", h["key"]).alias("b")).distinct(), nodes, agree)

    while True:
        grouped = materialise(with_heads(nodes))
        fresh = candidates(grouped, "typical", nodes)
        fresh = (fresh if drawn is None else fresh.unionByName(drawn)).distinct()
        fresh = materialise(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"))
        tested = fresh if tested is None else tested.unionByName(fresh)
        if words is None:  # of all that share a bucket, for this and later levels
            words = materialise(words_of_keys(rows, grouped.select("key").distinct()))
        roots = joined_roots(roots, materialise(aligned(fresh, words, percent)))
        # buckets of three or more that are not yet one component go on: with their drawn heads, and with what members share beyond the typical one
        placed = grouped.where("c > 2").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        apart = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        placed = materialise(placed.join(apart, "bucket", "left_semi").select("grp", "bucket", "key", "n", "typical", "drawn"))
        if placed.isEmpty():
            return roots
        drawn = candidates(placed, "drawn", nodes)
        rest = materialise(placed.where(F.col("key") != F.col("typical.key")).select("grp", F.col("typical.key").alias("a"), F.col("key").alias("b"), "n").distinct())
        if "values" not in nodes.columns:
            nodes = materialise(shingle_values(words, rest.select(F.explode(F.array("a", "b")).alias("key")).distinct()))
        nodes = materialise(residuals(nodes, rest, sketches, picks))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, root, doc_id, copies): for every different text its class and its least doc_id."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL")
    roots = near_roots(rows.select("key", "text"), **options)
    per = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return per.join(roots.unionByName(roots.select(F.col("root").alias("key"), "root").distinct()), "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"), "doc_id", "copies")


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size."""
    found = materialise(classes(docs, **options))
    names = found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = found.join(names, "root").where("class_size > 1").select("key", "class_id", "class_size")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    joined = keyed.join(named, "key", "left")
    return joined.select("doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                         F.coalesce("class_size", F.lit(1)).alias("class_size"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` without the members of a class beyond its first document."""
    found = materialise(classes(docs, **options))
    # first document of a class: least doc_id (null last), then least text key
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    heads = found.join(first, "root").where(F.col("first.key") == F.col("key")).select("key", F.col("doc_id").alias("head"), "copies")
    several = found.join(first, "root").where((F.col("first.key") != F.col("key")) | (F.col("copies") > 1)).select(F.col("key").alias("several"))
    keyed = docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("several"))
    single = keyed.join(several, "several", "left_anti").select("row")
    copied = heads.where("copies > 1").select(F.col("key").alias("several"), "head")
    again = keyed.join(copied, "several").where(F.col("row.doc_id").eqNullSafe(F.col("head")))
    again = again.groupBy("several").agg(F.min("row").alias("row")).select("row")
    return single.unionByName(again).select(*[F.col("row")[c].alias(c) for c in docs.columns])
