"""Benchmark decontamination by greedy string tiling.

1. Seeds. Every run of ``seed`` words of a test item is hashed. Documents are scanned once; those that share a
   seed with an item give a candidate (document, item) and send along only the stretches of words around
   their seeds, never the whole text.
2. Tiling. For a candidate the longest common runs of words are marked first, never overlapping, found by
   Karp-Rabin hashes of ``seed`` words and checked word by word; what a mark leaves of a shorter match
   is tried again at its own length, until no run of ``least`` words is left. Order does not matter, so
   passages that were moved about are found.
3. Verdict. A document is contaminated by an item when its tiles cover ``percent`` of the item's words.

The seed table is broadcast in portions of at most ``portion`` items, one scan each, so its size is bounded
however many items there are.

Defined results: words are those of ``words.word_hashes`` (case and punctuation do not count); items shorter
than ``seed`` words match as one run of all their words; items and documents without words never match;
repeated rows are judged one by one; null ids are carried along; equal items each give their own rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .words import chunks, mixed, word_hashes

SEED = 5
PERCENT = 50
PORTION = 50_000
PORTION_WORDS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin values of all runs of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for i in range(k):
        value = value * BASE + words[i:i + n]
    return mixed(value)


def tiles(text: list, test: list, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (text_start, test_start, length), longest first, then by place in the text.

    A match is a maximal common run. Taking the longest may cut shorter ones; what is left of a cut match
    between marks goes back into the queue with its new length, so each step takes the longest that is left."""
    if least < 1 or len(text) < least or len(test) < least:
        return []
    places: dict[tuple, list[int]] = {}
    for j in range(len(test) - least + 1):
        places.setdefault(tuple(test[j:j + least]), []).append(j)
    queue, open_runs = [], {}
    for i in range(len(text) - least + 1):
        for j in places.get(tuple(text[i:i + least]), ()):
            d = i - j
            start, stop = open_runs.get(d, (i, -1))
            if stop != i - 1 + least:
                if stop >= 0:
                    queue.append((start - stop, start, start - d))
                start = i
            open_runs[d] = (start, i + least)
    queue += [(start - stop, start, start - d) for d, (start, stop) in open_runs.items()]
    heapq.heapify(queue)
    in_text, in_test, out = bytearray(len(text)), bytearray(len(test)), []
    while queue:
        minus, i, j = heapq.heappop(queue)
        n = -minus
        if not any(in_text[i:i + n]) and not any(in_test[j:j + n]):
            in_text[i:i + n] = in_test[j:j + n] = b"\x01" * n
            out.append((i, j, n))
            continue
        run = 0
        for k in range(n + 1):
            if k < n and not in_text[i + k] and not in_test[j + k]:
                run += 1
            else:
                if run >= least:
                    heapq.heappush(queue, (-run, i + k - run, j + k - run))
                run = 0
    return out


def portions(items: DataFrame, item_id: str, text: str, most: int = PORTION, most_words: int = PORTION_WORDS) -> Iterator[list[tuple]]:
    """(item_id, words) of at most ``most`` items and ``most_words`` words at a time (a longer item alone);
    the driver holds one portion."""
    total = 0
    rows, held = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")), []
    for row in rows.toLocalIterator():
        words, _ = word_hashes([row["text"]])
        if held and total + len(words) > most_words:
            yield held
            held, total = [], 0
        if len(words):
            held.append((row["item_id"], words))
            total += len(words)
        if len(held) == most:
            yield held
            held, total = [], 0
    if held:
        yield held


def candidates(docs: DataFrame, items: list[tuple], seed: int) -> DataFrame:
    """(doc, item, stretches): for each document row (its key columns in ``doc``) and item that share a
    seed, the words around the seeds; stretches are separated by a zero."""
    by_length: dict[int, tuple[list, list]] = {}
    for k, (_, words) in enumerate(items):
        n = min(seed, len(words))
        values = np.unique(rolled(words, n))
        held = by_length.setdefault(n, ([], []))
        held[0].append(values)
        held[1].append(np.full(len(values), k))
    table = []
    for n, (values, owners) in by_length.items():
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        sieve = np.zeros(1 << 22, bool)
        sieve[(v >> np.uint64(42)).astype(np.int64)] = True
        table.append((n, v, o, sieve))
    lengths = np.array([len(w) for _, w in items])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)
    sizes = spark.sparkContext.broadcast(lengths)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                words, offsets = word_hashes(texts[a:b])
                found: dict[tuple[int, int], list[int]] = {}
                for n, values, owners, sieve in shared.value:
                    rolls = rolled(words, n)
                    hit = np.flatnonzero(sieve[(rolls >> np.uint64(42)).astype(np.int64)])
                    low = np.searchsorted(values, rolls[hit])
                    real = (low < len(values)) & (values[np.minimum(low, len(values) - 1)] == rolls[hit])
                    hit, low = hit[real], low[real]
                    text_of = np.searchsorted(offsets, hit, side="right") - 1
                    inside = hit + n <= offsets[text_of + 1]
                    for at, row, x in zip(hit[inside].tolist(), text_of[inside].tolist(), low[inside].tolist(), strict=True):
                        while x < len(values) and values[x] == rolls[at]:
                            found.setdefault((row, int(owners[x])), []).append(at)
                            x += 1
                rows = []
                for (row, k), ats in found.items():
                    parts, stop = [], -1
                    for at in sorted(ats):
                        first, last = max(at, int(offsets[row])), min(at + seed, int(offsets[row + 1]))
                        if first > stop:
                            parts.append(np.zeros(1, np.uint64))
                            stop = first
                        parts.append(words[stop:last])
                        stop = max(stop, last)
                    rows.append((batch["doc"].iloc[a + row], k, int(sizes.value[k]), int(offsets[row + 1] - offsets[row]), np.concatenate(parts).view(np.int64)))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc", "item", "item_words", "doc_words", "words"])

    return docs.mapInPandas(scan, "doc string, item int, item_words int, doc_words int, words array<bigint>")


def contaminated(docs: DataFrame, items: DataFrame, doc_key, text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED,
                 percent: int = PERCENT) -> DataFrame:
    """(doc, item_id, item_words, covered, tiles) of the documents that are covered enough.

    ``doc_key`` is a string column that names a document row; ``tiles`` counts the marked runs."""
    spark = docs.sparkSession
    rows = docs.select(doc_key.alias("doc"), F.col(f"`{text}`").alias("text"))
    out = spark.createDataFrame([], "doc string, item_id bigint, item_words int, covered int, tiles int")
    for portion in portions(items, item_id, item_text):
        known = spark.sparkContext.broadcast([(i, w.view(np.int64).tolist()) for i, w in portion])

        def tile(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for doc, item, words in zip(batch["doc"], batch["item"], batch["words"], strict=True):
                    name, test = known.value[item]
                    marked = tiles(words.tolist(), test, min(seed, len(test)))
                    covered = sum(n for _, _, n in marked)
                    if 100 * covered >= percent * len(test):
                        rows.append((doc, name, len(test), covered, len(marked)))
                found = pd.DataFrame(rows, columns=["doc", "item_id", "item_words", "covered", "tiles"])
                yield found.astype({"item_id": "Int64"})

        found = materialise(candidates(rows, portion, seed))
        # a document can share seeds with few or many items; candidates are dealt out anew for the tiling
        spread = found.select("doc", "item", "words").repartition(F.xxhash64("doc", "item"))
        out = out.unionByName(spread.mapInPandas(tile, out.schema))
    return out


def digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per contaminated (doc_id, item_id) with the item's words, the words covered and the tiles."""
    found = contaminated(docs, items, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), **options)
    return found.select(F.when(F.col("doc") != "", F.col("doc").cast("bigint")).alias("doc_id"), "item_id", "item_words", "covered", "tiles")


def without_benchmark(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose text is not contaminated by any item."""
    key = F.md5(F.col("text"))
    bad = contaminated(docs, items, F.coalesce(key, F.lit("")), **options).select("doc").distinct()
    name = "key of the text"
    keyed = docs.withColumn(name, F.coalesce(key, F.lit("")))
    return keyed.join(bad, F.col(f"`{name}`") == bad["doc"], "left_anti").drop(name)
