"""Personalised PageRank of many questions to its limit, by blocks of the graph and of the questions.

The entity-passage graph of a client of up to ``WHOLE_NODES`` nodes is one block, a larger one is cut into blocks of at
most ``BLOCK_NODES`` nodes; transitions are cut into packs of one source block and a range of one target block. For a block of ``QUESTION_BLOCK`` questions a task holds one matrix (nodes of the
block x questions), solves the block exactly given what other blocks send, and sends on what leaves the block. All
numbers are positive and rounds start from nothing, so values only grow, and with damping d the distance to the limit
is at most d / (1 - d) times the growth of the last round: rounds stop when that is below ``TOLERANCE`` of the mass. A
graph of one block per client ends in the first round and writes no start matrix. A block is solved for as many questions
at a time as ``CELLS`` numbers hold, so a task's memory does not grow with the block.

No table of passages by questions leaves a task: scores travel as packed chunks of a block, results as the best
passages of every block and question.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ATTRIBUTE_KEYWORDS
from ..session import client_hint, materialise
from .passages import QuestionBatch, keyword_mask
from .ranking import top_k

BLOCK_NODES = 65_536
WHOLE_NODES = 1 << 20
PACK_PLACES = 1 << 14
CELLS = 1 << 22
QUESTION_BLOCK = 32
TOLERANCE = 1e-13
EDGE_CELLS = 1 << 17  # products at a time, few enough for a core's cache
CHEBYSHEV_STEPS = 40
# kinds of rows that meet in the task of one block and question block
SCORES, BONUS, WEIGHT, EDGES, MESSAGE, RESET, BEST, TOTAL, SIZE = range(9)
ROW = ("client_id int, block int, qblock int, kind int, other int, a binary, b binary, c binary, i array<int>, j array<int>, v array<double>, lo array<double>, hi array<double>")
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


@dataclass
class RankBlocks:
    """nodes: client_id, node, block, place; passages: client_id, block, place, x, mask; edges: client_id, block, to, a, b, c
    (source places, target places in order, probabilities); sizes: client_id, block, n."""

    nodes: DataFrame
    passages: DataFrame
    edges: DataFrame
    sizes: DataFrame


def rank_blocks(nodes: DataFrame, transitions: DataFrame, passage_vectors: DataFrame, block_nodes: int = BLOCK_NODES,
                whole_nodes: int = 0) -> RankBlocks:
    """Blocks (one for a client of up to ``whole_nodes`` nodes) of (client_id, node) with ``transitions`` (client_id, src, dst, p) and vectors (client_id, node, x, text)."""
    n = F.count(F.lit(1))
    counts = nodes.groupBy("client_id").agg(F.when(n <= whole_nodes, F.lit(1)).otherwise(F.ceil(n / F.lit(block_nodes))).cast("int").alias("blocks"))
    placed = nodes.join(client_hint(nodes)(counts), "client_id").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    inside = Window.partitionBy("client_id", "block").orderBy("node")
    placed = materialise(placed.select("client_id", "node", "block", (F.row_number().over(inside) - 1).alias("place")))
    end = lambda name, block, place: placed.select("client_id", F.col("node").alias(name), F.col("block").alias(block), F.col("place").alias(place))
    moves = transitions.join(end("src", "block", "s"), ["client_id", "src"]).join(end("dst", "to", "d"), ["client_id", "dst"])
    client = nodes.schema["client_id"].dataType.simpleString()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["d", "s"])
        return group.iloc[:1][["client_id", "block", "to"]].assign(
            a=[group["s"].to_numpy(np.int32).tobytes()], b=[group["d"].to_numpy(np.int32).tobytes()], c=[group["p"].to_numpy(np.float64).tobytes()])

    packs = moves.select("client_id", "block", "to", "s", "d", "p").groupBy("client_id", "block", "to", F.floor(F.col("d") / PACK_PLACES)).applyInPandas(
        pack, f"client_id {client}, block int, to int, a binary, b binary, c binary")
    vectors = passage_vectors.join(placed, ["client_id", "node"]).select("client_id", "block", "place", F.col("x").cast("array<double>").alias("x"), keyword_mask(F.col("text")).alias("mask"))
    vectors = vectors.repartition("client_id", "block", F.floor(F.col("place") / 4096)).sortWithinPartitions("client_id", "block", "place")
    return RankBlocks(placed, materialise(vectors), materialise(packs), placed.groupBy("client_id", "block").agg(F.count(F.lit(1)).cast("int").alias("n")))


def score_chunks(passages: DataFrame, batch: QuestionBatch, boost: float = 0.0) -> DataFrame:
    """Rows of kind SCORES: ``a`` places, ``b`` inner products (places x questions of the block), ``c`` keyword boosts,
    ``lo`` and ``hi`` the extremes per question."""
    shared = passages.sparkSession.sparkContext.broadcast((batch.vectors, batch.masks))  # a batch of questions is bounded
    width = QUESTION_BLOCK

    def score(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, masks = shared.value
        bits = np.array([bin(n).count("1") for n in range(1 << len(ATTRIBUTE_KEYWORDS))]) if boost > 0 else None
        for part in rows:
            out = []
            for (client, block), group in part.groupby(["client_id", "block"], sort=False):
                s = np.round(np.stack([np.asarray(v, dtype=np.float64) for v in group["x"]]) @ q.T, 9) + 0.0
                more = boost * np.log1p(bits[group["mask"].to_numpy()[:, None] & masks[None, :]]) if boost > 0 else None
                places = group["place"].to_numpy(np.int32).tobytes()
                for at in range(0, len(q), width):
                    held = np.ascontiguousarray(s[:, at:at + width])
                    out.append((client, block, at // width, SCORES, 0, places, held.tobytes(), None if more is None else np.ascontiguousarray(more[:, at:at + width]).tobytes(),
                                None, None, None, held.min(axis=0).tolist(), held.max(axis=0).tolist()))
            yield pd.DataFrame(out, columns=COLUMNS)

    return passages.select("client_id", "block", "place", "x", "mask").mapInPandas(score, ROW)


def _spans(chunks: DataFrame) -> DataFrame:
    """(client_id, qblock, lo, hi): extremes of every question over all passages of the client."""
    long = chunks.select("client_id", "qblock", F.posexplode(F.arrays_zip("lo", "hi")).alias("slot", "x"))
    per = long.groupBy("client_id", "qblock", "slot").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    rows = per.groupBy("client_id", "qblock").agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("r"))
    return rows.select("client_id", "qblock", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


def _sparse(values: DataFrame, blocks: RankBlocks, batch: QuestionBatch, kind: int) -> DataFrame:
    """Rows of ROW from (client_id, qid, node, value)."""
    slots = batch.slots.select("qid", (F.col("block") * batch.width + F.col("slot")).alias("at"))
    held = values.join(F.broadcast(slots), "qid").join(blocks.nodes, ["client_id", "node"])
    packed = held.groupBy("client_id", "block", F.floor(F.col("at") / QUESTION_BLOCK).cast("int").alias("qblock")).agg(
        F.collect_list(F.struct(F.col("place").cast("int").alias("i"), F.pmod("at", F.lit(QUESTION_BLOCK)).cast("int").alias("j"), F.col("value").cast("double").alias("v"))).alias("r"))
    return _row(packed, kind, i=F.col("r.i"), j=F.col("r.j"), v=F.col("r.v"))


def _row(df: DataFrame, kind: int, **given) -> DataFrame:
    types = dict(c.split(" ", 1) for c in ROW.split(", "))
    made = {"client_id": F.col("client_id"), "block": F.col("block"), "qblock": F.col("qblock"), "kind": F.lit(kind), **given}
    return df.select(*[made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS])


def _times(edges: list, y: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Adds to ``out`` what every node gets over the edges (source, target in order, probability)."""
    rows = max(EDGE_CELLS // max(y.shape[1], 1), 1)
    for src, dst, p in edges:
        for at in range(0, len(src), rows):
            s, d, w = (x[at:at + rows] for x in (src, dst, p))
            first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            sent = y.take(s, axis=0)
            sent *= w[:, None]
            out[d[first]] += np.add.reduceat(sent, first, axis=0)
    return out


def local_limit(start: np.ndarray, edges: list, damping: float) -> np.ndarray:
    """y = start + damping * (transitions inside the block)^T y, to rounding.

    Transitions of an undirected graph have real eigenvalues within [-1, 1], so a Chebyshev sequence needs about half
    the steps of plain ones; plain steps finish, and take over where the graph is directed. The residual is measured."""
    if not edges:
        return start
    before, y, omega = np.zeros_like(start), start.copy(), 1.0
    small, least, chebyshev = 1e-15 * np.abs(start).sum(axis=0), np.inf, True
    for step in range(CHEBYSHEV_STEPS + math.ceil(math.log(1e-18) / math.log(damping))):
        ahead = start + damping * _times(edges, y, np.zeros_like(y))
        left = np.abs(ahead - y).sum(axis=0)
        if (left <= small).all() or (not chebyshev and left.sum() >= least):  # converged, or down to rounding
            return ahead
        if chebyshev and (step >= CHEBYSHEV_STEPS or left.sum() > 2 * least):
            chebyshev, ahead, left = False, start if left.sum() > 2 * least else ahead, np.full(1, np.inf)
        omega = 2.0 / (2.0 - damping * damping) if step == 0 else 1.0 / (1.0 - damping * damping * omega / 4.0)
        y, before = (omega * (ahead - before) + before, y) if chebyshev else (ahead, y)
        least = left.sum() if not chebyshev else min(least, left.sum())
    return y


def best_of(values: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of the ``k`` best rows of every column; ties to the smaller place."""
    n, width = values.shape
    keep = min(k, n)
    if not keep:
        return np.zeros(0, int), np.zeros(0, int)
    cut = np.partition(values, n - keep, axis=0)[n - keep]
    slots, rows = [], []
    for slot in range(width):
        near = np.flatnonzero(values[:, slot] >= cut[slot])
        near = near[np.lexsort((places[near], -values[near, slot]))][:keep]
        slots.append(np.full(len(near), slot))
        rows.append(near)
    return np.concatenate(slots), np.concatenate(rows)


def _level(y: np.ndarray) -> np.ndarray:
    """Logarithms to 9 digits, by which passages are ranked; nothing comes last."""
    return np.where(y > 0, np.round(np.log(np.maximum(y, 1e-300)), 9), -1e9)


def _reset(held: dict[int, pd.DataFrame], n: int, width: int, some: slice, ratio: float, node_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(start matrix of a block for ``some`` of its questions, places of its passages) from its score chunks, bonuses and entity weights."""
    shape = n, some.stop - some.start
    start, places = np.zeros(shape), []

    def sparse(kind: int) -> np.ndarray:
        out = np.zeros(shape)
        for r in held.get(kind, pd.DataFrame()).itertuples():
            i, j, v = np.asarray(r.i), np.asarray(r.j), np.asarray(r.v, np.float64)
            own = (j >= some.start) & (j < some.stop)
            np.add.at(out, (i[own], j[own] - some.start), v[own])
        return out

    bonus = sparse(BONUS)
    size = held[SIZE].iloc[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        for r in held.get(SCORES, pd.DataFrame()).itertuples():
            at = np.frombuffer(r.a, np.int32)
            lo, hi = (np.asarray(x, np.float64)[some] for x in (size.lo, size.hi))
            s = np.frombuffer(r.b, np.float64).reshape(len(at), width)[:, some]
            total = ratio * np.where(hi == lo, 1.0, (s - lo) / (hi - lo)) + np.log(1.0 + bonus[at])
            if r.c is not None:
                total = total + np.frombuffer(r.c, np.float64).reshape(len(at), width)[:, some]
            total = total * node_weight
            start[at] = np.where(np.isfinite(total) & (total > 0), total, 0.0)
            places.append(at)
    weights = sparse(WEIGHT)
    start += np.where(np.isfinite(weights) & (weights > 0), weights, 0.0)
    return start, np.concatenate(places) if places else np.zeros(0, np.int32)


def ranked_blocks(blocks: RankBlocks, batch: QuestionBatch, chunks: DataFrame, bonus: DataFrame, weights: DataFrame, k: int, *,
                  ratio: float = 1.5, node_weight: float = 0.05, damping: float = 0.5, tolerance: float = TOLERANCE) -> DataFrame:
    """(client_id, qid, passage_id, score, rank): the ``k`` passages of largest PageRank per client and question.

    ``chunks`` come from ``score_chunks``; bonus: client_id, qid, node, bonus; weights: client_id, qid, entity_id, weight."""
    questions = len(batch.ids)
    if not questions:
        return batch.slots.sparkSession.createDataFrame([], f"client_id int, qid {batch.id_type}, passage_id string, score double, rank int")

    several = not blocks.edges.where("block <> to").isEmpty()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        held = {kind: rows for kind, rows in group.groupby("kind")}
        client, block, qblock = (int(group[c].iloc[0]) for c in ("client_id", "block", "qblock"))
        width = min(QUESTION_BLOCK, questions - qblock * QUESTION_BLOCK)
        row = lambda kind, to=block, **given: dict.fromkeys(COLUMNS) | {"client_id": client, "block": to, "qblock": qblock, "kind": kind, **given}
        n = len(np.frombuffer(held[RESET].iloc[0].b, np.float64)) // width if RESET in held else int(held[SIZE].iloc[0].other)
        inside, leaving = [], []
        for e in held.get(EDGES, pd.DataFrame()).itertuples():
            pack = np.frombuffer(e.a, np.int32), np.frombuffer(e.b, np.int32), np.frombuffer(e.c, np.float64)
            (inside if e.other == block else leaving).append((int(e.other), pack))
        targets = [np.unique(dst, return_inverse=True) for _, (_, dst, _) in leaving]
        messages = [np.empty((len(touched), width)) for touched, _ in targets]
        resets = np.empty((n, width)) if several and RESET not in held else None
        slots, best, values, totals = [], [], [], []
        step = max(1, min(width, CELLS // max(n, 1)))
        for at in range(0, width, step):
            some = slice(at, min(at + step, width))
            if RESET in held:
                r = held[RESET].iloc[0]
                start, places = np.frombuffer(r.b, np.float64).reshape(n, width)[:, some].copy(), np.frombuffer(r.a, np.int32)
            else:
                start, places = _reset(held, n, width, some, ratio, node_weight)
                if resets is not None:
                    resets[:, some] = start
            for m in held.get(MESSAGE, pd.DataFrame()).itertuples():
                to = np.frombuffer(m.a, np.int32)
                start[to] += np.frombuffer(m.b, np.float64).reshape(len(to), width)[:, some]
            y = local_limit(start, [p for _, p in inside], damping)
            for (_, (src, _, p)), (touched, new), sent in zip(leaving, targets, messages):
                sent[:, some] = damping * _times([(src, new, p)], y, np.zeros((len(touched), some.stop - some.start)))
            slot, found = best_of(_level(y[places]), places, k)
            slots.append(slot + at)
            best.append(places[found])
            values.append(y[places[found], slot])
            totals.append(y.sum(axis=0))
        out = [row(MESSAGE, to, a=touched.tobytes(), b=sent.tobytes()) for (to, _), (touched, _), sent in zip(leaving, targets, messages)]
        if resets is not None:
            out.append(row(RESET, a=places.tobytes(), b=resets.tobytes()))
        out.append(row(BEST, i=np.concatenate(slots).tolist(), j=np.concatenate(best).tolist(), v=np.concatenate(values).tolist()))
        out.append(row(TOTAL, v=np.concatenate(totals).tolist()))
        return pd.DataFrame(out, columns=COLUMNS)

    qblocks = F.explode(F.sequence(F.lit(0), F.lit((questions - 1) // QUESTION_BLOCK))).alias("qblock")
    edges = _row(blocks.edges.select("*", qblocks), EDGES, other=F.col("to"), a=F.col("a"), b=F.col("b"), c=F.col("c"))
    spans = _spans(chunks)
    sizes = blocks.sizes.select("*", qblocks).join(client_hint(blocks.sizes)(spans.withColumnRenamed("qblock", "q").withColumnRenamed("client_id", "c")), (F.col("c") == F.col("client_id")) & (F.col("q") == F.col("qblock")), "left")
    inputs = chunks.unionByName(edges).unionByName(_row(sizes, SIZE, other=F.col("n"), lo=F.col("lo"), hi=F.col("hi")))
    inputs = inputs.unionByName(_sparse(bonus.withColumnRenamed("bonus", "value"), blocks, batch, BONUS))
    inputs = inputs.unionByName(_sparse(weights.select("client_id", "qid", F.col("entity_id").alias("node"), F.col("weight").alias("value")), blocks, batch, WEIGHT))
    state = first = materialise(inputs.groupBy("client_id", "block", "qblock").applyInPandas(solve, ROW))
    if several:
        fixed = first.where(F.col("kind") == RESET).unionByName(edges)
        while True:
            after = materialise(fixed.unionByName(state.where(F.col("kind") == MESSAGE)).groupBy("client_id", "block", "qblock").applyInPandas(solve, ROW))
            growth = _totals(after).join(_totals(state).withColumnRenamed("total", "was"), ["client_id", "qblock", "slot"]).agg(
                F.max((F.col("total") - F.col("was")) / F.greatest("total", F.lit(1e-300)))).head()[0]
            state = after
            if growth is None or growth * damping / (1.0 - damping) <= tolerance:
                break
    found = state.where(F.col("kind") == BEST).select("client_id", "block", "qblock", F.explode(F.arrays_zip("i", "j", "v")).alias("r")).select(
        "client_id", "block", "qblock", F.col("r.i").alias("slot"), F.col("r.j").alias("place"), F.col("r.v").alias("y"))
    scored = _named(found, blocks, batch).join(_totals(state), ["client_id", "qblock", "slot"])
    level = F.when(F.col("y") > 0, F.round(F.log("y"), 9)).otherwise(F.lit(-1e9))
    best = top_k(scored.select("client_id", "qid", F.col("node").alias("passage_id"), (F.col("y") / F.col("total")).alias("score"), level.alias("level")),
                 ["client_id", "qid"], [F.col("level").desc(), F.col("passage_id")], k)
    return best.select("client_id", "qid", "passage_id", "score", "rank")


def _totals(state: DataFrame) -> DataFrame:
    long = state.where(F.col("kind") == TOTAL).select("client_id", "qblock", F.posexplode("v").alias("slot", "t"))
    return long.groupBy("client_id", "qblock", "slot").agg(F.sum("t").alias("total"))


def _named(found: DataFrame, blocks: RankBlocks, batch: QuestionBatch) -> DataFrame:
    """Adds qid and node to rows (client_id, block, qblock, slot, place)."""
    slots = batch.slots.select("qid", (F.col("block") * batch.width + F.col("slot")).alias("at"))
    at = F.col("qblock") * QUESTION_BLOCK + F.col("slot")
    return found.withColumn("at", at).join(F.broadcast(slots), "at").drop("at").join(blocks.nodes, ["client_id", "block", "place"])


def dense_best(blocks: RankBlocks, batch: QuestionBatch, chunks: DataFrame, k: int) -> DataFrame:
    """(client_id, qid, passage_id, score, rank) by inner product, from the same chunks."""
    questions = len(batch.ids)

    def best(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            out = []
            for r in part.itertuples():
                places = np.frombuffer(r.a, np.int32)
                s = np.frombuffer(r.b, np.float64).reshape(len(places), min(QUESTION_BLOCK, questions - r.qblock * QUESTION_BLOCK))
                slot, at = best_of(s, places, k)
                out.append(pd.DataFrame({"client_id": r.client_id, "block": r.block, "qblock": r.qblock, "slot": slot, "place": places[at], "score": s[at, slot]}))
            if out:
                yield pd.concat(out)

    found = chunks.select("client_id", "block", "qblock", "a", "b").mapInPandas(best, "client_id int, block int, qblock int, slot int, place int, score double")
    named = _named(found, blocks, batch).select("client_id", "qid", F.col("node").alias("passage_id"), "score")
    return top_k(named, ["client_id", "qid"], [F.col("score").desc(), F.col("passage_id")], k).select("client_id", "qid", "passage_id", "score", "rank")
