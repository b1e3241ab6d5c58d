"""Removal of long repeated byte strings by run-length compressed Burrows-Wheeler indexes.

1. Routing. Every window of ``length`` bytes picks its leftmost least 32-byte hash; equal windows pick the same.
   Consecutive windows with one pick form a piece. Pieces whose pick occurs nowhere else hold no repeated
   window and go no further. Equal pieces are stored once with their number.
2. Index. The remaining different pieces of a pick meet in one shard; shards have about ``shard_bytes`` bytes. A
   shard's Burrows-Wheeler transform is kept as runs with the text places of both ends of each run. The match
   with the next smaller suffix is compared byte by byte at the run ends only; within a run it follows from the
   place before (one byte shorter), so the statistics stream along the text from run end to run end.
3. Marking. Places whose match reaches ``length`` bytes start a repeated window; so do all windows of a piece
   that occurs more than once. Marks return to all texts with that piece, are merged and cut out.

A pick with very many different pieces (a passage that a large part of all texts share) is split by the place
of the window about the pick and by the bytes that all such windows have in common, so no group is larger
than what agrees in nearly a whole window. Nothing is capped.

Defined results: a null text is empty; texts shorter than ``length`` bytes lose nothing; matches never cross
texts; repeated rows remove each other's windows; null or repeated ids are carried along; very long texts are
scanned in stretches that overlap by a window; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import shuffles_dropped
from .order_minhash import text_key
from .words import PRIME, mixed, powers

LENGTH = 400
GRAM = 32
STRETCH = 1 << 20  # bytes scanned at once; below 2**PLACE_BITS
PLACE_BITS = 21
SHARD_BYTES = 600_000
MANY = 256  # different pieces of a pick from which it is split
PART = 24  # window places of a part of a split pick
SEPARATOR = 255  # never occurs in UTF-8


def sums_of(data: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][:len(data)])))


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mixed((sums[stop] - sums[start]) * powers(len(sums))[1][start])


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, from running minima of blocks of w in both directions."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def picked(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int):
    """Pieces of the stretches [start, stop) of ``data``: (stretch, first window, windows, pick, hash, content).

    ``first window`` counts from ``data``; ``content`` names the piece's bytes and the place of its pick."""
    if len(data) < length:
        return None
    sums = sums_of(data)
    at = np.arange(len(data) - GRAM + 1)
    h = span_hash(sums, at, at + GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((h & ~low) | at.astype(np.uint64), length - GRAM + 1)
    some = stops - starts >= length
    windows = np.where(some, stops - starts - length + 1, 0)
    owner = np.repeat(np.arange(len(starts)), windows)
    if not len(owner):
        return None
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    pick = (least[place] & low).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.concatenate((edge, [len(owner)])))
    first, pick, owner = place[edge], pick[edge], owner[edge]
    content = mixed(span_hash(sums, first, first + count + length - 1) + (pick - first).astype(np.uint64) * PRIME + count.astype(np.uint64))
    return owner, first, count, pick, h[pick], content


def stretches(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[int], list[int], list[int], list[int]]]:
    """(data, text numbers, offsets in the text, starts, stops): texts laid end to end, long ones in parts."""
    held, rows, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), STRETCH // 2 - length):
            part = t[at:at + STRETCH // 2 - 1]
            if len(part) < length:
                continue
            if size + len(part) > STRETCH:
                yield np.frombuffer(b"".join(held), np.uint8), *map(list, zip(*rows, strict=True))
                held, rows, size = [], [], 0
            rows.append((k, at, size, size + len(part)))
            held.append(part)
            size += len(part)
    if rows:
        yield np.frombuffer(b"".join(held), np.uint8), *map(list, zip(*rows, strict=True))


def pieces_of(rows: DataFrame, length: int) -> DataFrame:
    """(key, first, windows, back, pick, content) of the pieces of rows (key, text)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                keys = batch["key"].iloc[a:a + 512].to_numpy()
                texts = [t.encode("utf-8", "replace") for t in batch["text"].iloc[a:a + 512]]
                for data, text, offset, start, stop in stretches(texts, length):
                    start, stop = np.array(start), np.array(stop)
                    found = picked(data, start, stop, length)
                    if found is None:
                        continue
                    owner, first, count, pick, h, content = found
                    # overlapping parts of a long text meet in whole windows: none is seen twice
                    yield pd.DataFrame({"key": keys[np.array(text)[owner]], "first": (first - start[owner] + np.array(offset)[owner]).astype(np.int64),
                                        "windows": count.astype(np.int32), "back": (pick - first).astype(np.int32), "pick": h.view(np.int64), "content": content.view(np.int64)})

    return rows.mapInPandas(work, "key binary, first bigint, windows int, back int, pick bigint, content bigint")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by tripling, starting from as many letters as fit one number; a place that already differs from all
    others is not sorted again. Ranks are the first places of equal beginnings in the order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)  # zero is the end
    bits = len(used).bit_length()
    width = 64 // bits
    padded = np.concatenate((code[text], np.zeros(width, np.uint64)))
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = (key << np.uint64(bits)) | padded[i:i + n]
    parts, shift = (3, np.uint64(21)) if n < 1 << 21 else (2, np.uint64(32))
    order, ranks = np.empty(n, np.int64), np.empty(n, np.uint32)
    head, at, live = np.empty(n, bool), np.arange(n), np.arange(n)
    while True:
        by = np.argsort(key)
        key, live = key[by], live[by]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        order[at], head[at] = live, first
        ranks[live] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        at = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
        if not len(at):
            return order
        live = order[at]
        key = ranks[live].astype(np.uint64)
        for k in range(1, parts):
            after = live + k * width
            key = (key << shift) | np.where(after < n, ranks[np.minimum(after, n - 1)] + np.uint32(1), np.uint32(0))
        width *= parts


class RunIndex:
    """Runs of the Burrows-Wheeler transform of a text, with the text places of the ends of each run."""

    def __init__(self, text: np.ndarray):
        self.text = text
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1].astype(np.int16), -1)
        head = np.concatenate(([True], before[1:] != before[:-1]))
        self.letters = before[head]
        first = np.flatnonzero(head)
        last = np.concatenate((first[1:], [len(text)])) - 1
        self.lengths = last - first + 1
        self.first, self.last = order[first], order[last]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at i and j, eight bytes at a time."""
        n = len(self.text)
        padded = np.concatenate((self.text, np.zeros(16, np.uint8))).astype(np.uint64)
        word = np.zeros(n + 8, np.uint64)
        for k in range(8):
            word |= padded[k:k + n + 8] << np.uint64(8 * k)
        out, live, step = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        while len(live):
            a, b = i[live] + step, j[live] + step
            inside = (a < n) & (b < n)
            differ = np.where(inside, word[np.minimum(a, n)] ^ word[np.minimum(b, n)], np.uint64(1))
            same = differ == 0
            out[live[same]] = step + 8
            rest = live[~same]
            if len(rest):
                d = differ[~same]
                lowest = d & (~d + np.uint64(1))
                out[rest] = step + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
            live, step = live[same], step + 8
        return np.minimum(out, n - np.maximum(i, j))

    def statistics(self) -> np.ndarray:
        """For every place the longest match with any other place (separators not yet looked at).

        The match with the next smaller suffix is known where a run begins, with the next larger one where a
        run ends; elsewhere it is one byte shorter than at the place before."""
        n = len(self.text)
        if len(self.first) < 2:
            return np.zeros(n, np.int64) if n < 2 else np.arange(n - 1, -1, -1)
        shared = self.common(self.last[:-1], self.first[1:])
        best = np.zeros(n, np.int64)
        for places, values in ((self.first, np.concatenate(([0], shared))), (self.last, np.concatenate((shared, [0])))):
            known = np.full(n, -1, np.int64)
            known[places] = values
            source = np.maximum.accumulate(np.where(known >= 0, np.arange(n), -1))
            stream = np.where(source >= 0, known[np.maximum(source, 0)] - (np.arange(n) - source), 0)
            best = np.maximum(best, stream)
        return best


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the places where a string of ``length`` bytes starts that starts elsewhere too."""
    text = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in pieces), np.uint8)
    match = RunIndex(text).statistics()
    out, at = [], 0
    for p in pieces:
        own = match[at:at + max(len(p) - length + 1, 0)]
        out.append(np.flatnonzero(own >= length))
        at += len(p) + 1
    return out


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) runs of ascending places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate(([0], cut + 1))].tolist(), (places[np.concatenate((cut, [len(places) - 1]))] + 1).tolist(), strict=True))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table whose shuffle files go as soon as it is written."""
    with shuffles_dropped(df.sparkSession):
        return materialise(df)


def one_text(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text, ...) with the columns of ``keys`` (one row per key), one row per text. Copies are merged where they are read."""
    return rows.groupBy("key").agg(F.first("text").alias("text")).join(keys, "key")


def by_bytes(routed: DataFrame, many: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copied, crowded, sparse) of routed pieces: ``copied`` (route, bytes) names those that occur more than once, whose
    windows are all repeated; the others hold one row per different piece, ``crowded`` of routes with ``many`` of them or more.
    A route with one different piece is in neither: the windows of a piece differ in where they hold its pick."""
    different = routed.groupBy("route", "bytes").agg(F.count("*").alias("n"), F.min(F.struct("pick", "content", "shift")).alias("one"), F.first("piece").alias("piece"))
    different = written(different.select("route", "bytes", "n", "one.*", "piece"))
    per = written(different.groupBy("route").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    routes = lambda some: different.join(per.where(some).select("route").hint("merge"), "route", "left_semi")
    return different.where("n > 1").select("route", "bytes"), routes(F.col("kinds") >= many), routes(F.col("kinds") < many)


def window_marks(pieces: DataFrame, length: int) -> DataFrame:
    """(pick, content, a, b) of every window of ``pieces`` (one row per different piece of a route) that its route holds again."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for route, pick, content, shift, piece in zip(*(batch[c] for c in ("route", "pick", "content", "shift", "piece")), strict=True):
                digests = [hashlib.blake2b(piece[i:i + length], digest_size=16).digest() for i in range(len(piece) - length + 1)]
                yield pd.DataFrame({"route": route, "window": digests, "pick": pick, "content": content, "a": np.arange(shift, shift + len(digests), dtype=np.int32)})

    held = written(pieces.select("route", "pick", "content", "shift", "piece").mapInPandas(windows, "route bigint, window binary, pick bigint, content bigint, a int"))
    again = written(held.groupBy("route", "window").agg(F.count("*").alias("n")).where("n > 1").select("route", "window"))
    return held.join(again, ["route", "window"], "left_semi").select("pick", "content", "a", (F.col("a") + 1).alias("b"))


def marks_of(rows: DataFrame, length: int, shard_bytes: int, many: int) -> DataFrame:
    """(key, spans array<[begin, end)>) of the byte spans to remove from each different text.

    Counts are written before rows are joined to them, so Spark can deal the rows of one frequent key to several tasks.
    Large joins are planned alike for all sizes, so that small runs show how they grow."""
    spark = rows.sparkSession
    pieces = pieces_of(rows, length)
    pieces = written(pieces)
    known = written(pieces.groupBy("pick").agg(F.count("*").alias("n")).where("n > 1").select("pick"))
    pieces = written(pieces.join(known.hint("merge"), "pick", "left_semi"))
    kinds = pieces.groupBy("pick", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "windows", "back")).alias("one"))
    kinds = written(kinds)
    per = written(kinds.groupBy("pick").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    asked = kinds.join(per, "pick").select(F.col("one.key").alias("key"), F.struct("pick", "content", "one.first", "one.windows", "one.back", (F.col("kinds") >= many).alias("split")).alias("p"))
    asked = asked.groupBy("key").agg(F.collect_list("p").alias("ps"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, ps in zip(batch["text"], batch["ps"], strict=True):
                raw = text.encode("utf-8", "replace")
                for p in ps:
                    piece = raw[p["first"]:p["first"] + p["windows"] + length - 1]
                    if not p["split"]:
                        out.append((p["pick"], p["pick"], p["content"], 0, piece))
                        continue
                    span = length - GRAM  # windows start at back - span .. back, counted from the piece
                    low = p["back"] - span
                    for part in range(-(-(span + 1) // PART)):
                        a, b = low + part * PART, low + part * PART + PART - 1
                        first, last = max(a, 0), min(b, p["windows"] - 1)
                        if first <= last:
                            core = hashlib.blake2b(piece[b:a + length], digest_size=8, salt=part.to_bytes(2, "little")).digest()
                            out.append((int.from_bytes(core, "little", signed=True) ^ p["pick"], p["pick"], p["content"], first, piece[first:last + length]))
            if out:
                yield pd.DataFrame(out, columns=["route", "pick", "content", "shift", "piece"])

    routed = written(one_text(rows, asked).mapInPandas(cut, "route bigint, pick bigint, content bigint, shift int, piece binary"))
    routed = routed.withColumn("bytes", F.unhex(F.md5("piece")))
    copied, crowded, sparse = by_bytes(routed, many)
    size = sparse.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))

    def index(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["route", "pick", "content", "shift"])
        out = []
        for (pick, content, shift), starts in zip(group[["pick", "content", "shift"]].itertuples(index=False), repeated_starts(group["piece"].tolist(), length), strict=True):
            out += [(pick, content, shift + a, shift + b) for a, b in runs(starts)]
        return pd.DataFrame(out, columns=["pick", "content", "a", "b"])

    found = sparse.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).groupBy("shard").applyInPandas(index, "pick bigint, content bigint, a int, b int")
    whole = routed.join(copied, ["route", "bytes"], "left_semi").select("pick", "content", F.col("shift").alias("a"), (F.col("shift") + F.length("piece") - (length - 1)).alias("b"))
    found = found.unionByName(whole).unionByName(window_marks(crowded, length))
    several = kinds.where("n > 1").select("pick", "content", F.lit(0).alias("a"), F.col("one.windows").alias("b"))
    marks = written(found.join(several, ["pick", "content"], "left_anti").unionByName(several))
    spans = pieces.join(marks, ["pick", "content"]).select("key", (F.col("first") + F.col("a")).alias("begin"), (F.col("first") + F.col("b") + (length - 1)).alias("end"))
    return written(spans.distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans")))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the maximal removed spans and the remaining bytes of every document."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    marks = marks_of(rows.select("key", "text"), length, shard_bytes, many)

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                raw, merged = text.encode("utf-8", "replace"), []
                for s in spans if spans is not None else ():
                    if merged and s["begin"] <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], s["end"]))
                    else:
                        merged.append((s["begin"], s["end"]))
                kept, at = [], 0
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                out.append((None if pd.isna(key) else int(key), len(raw), [{"begin": a, "end": b} for a, b in merged], b"".join([*kept, raw[at:]])))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])
            yield frame.astype({"doc_id": "Int64"})

    return rows.join(marks, "key", "left").select("doc_id", "text", "spans").mapInPandas(
        remove, "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary")


def digest(docs: DataFrame, **options) -> DataFrame:
    found = without_repeats(docs, **options)
    removed = F.aggregate(F.transform("spans", lambda s: s["end"] - s["begin"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
