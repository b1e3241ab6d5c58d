"""Near-duplicate vectors: PCA-ordered tiled comparison with suffix-norm bounds.

1. Equal vectors are one node with a count, so copies of one vector never meet each other.
2. Directions of largest variance come from second moments summed over all vectors (width x width numbers).
   Unit vectors at cosine c are sqrt(2 - 2c) apart, and no projection is longer, so vectors are dealt into grid cells
   of that width over the first three directions: only neighbouring cells can hold links. Rows sorted by cell and
   projection are cut into tiles of at most ``tile`` rows, each with the box of its leading projections.
3. Tiles of neighbouring cells whose boxes are near enough are compared: products of the leading directions first; a
   pair is settled once the product plus or minus the product of the rest's norms cannot cross the threshold, and
   what is open goes on with the next directions. Pairs within 1e-9 of the threshold are computed from the vectors.
4. A tile pair hands on counts per vector and a spanning forest of its links, never the pairs themselves. Connected
   components of the forests are those of all links.

The result does not depend on the directions or tiles; they only decide how early a comparison ends. No pair is
left out and no group is capped.

Defined results: null, zero and empty vectors and those with null, NaN or infinite components link with nothing
(n_links 0, their own component); so do vectors of different lengths. Repeated rows and ids are vectors of their own;
component_id is the least vec_id that is not null, and null where there is none; kept tells vec_id = component_id,
null with null included. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import batch_rows, shuffle_parts
from .order_minhash import components

COSINE = 0.95
TILE = 1024
GROUP_BYTES = 1 << 25  # vectors of the tiles that a task holds while others stream past
GRID = 3  # directions of the grid of cells
BOX = 8  # directions of a tile's box
STEPS = (16, 32)  # directions after which pairs are tested, before all of them
SLACK = 1e-9


def moments(vectors: DataFrame) -> DataFrame:
    """(width, i, line): line i of the summed outer products of the unit vectors of each width."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, rows in batch.groupby("width")["vector"]:
                x = unit(np.array(rows.tolist(), np.float64))
                held[width] = held.get(width, 0) + x.T @ x
        for width, m in held.items():
            yield pd.DataFrame({"width": width, "i": np.arange(width), "line": list(m)})

    parts = vectors.select("width", "vector").mapInPandas(work, "width int, i int, line array<double>")
    return parts.groupBy("width", "i").agg(F.collect_list("line").alias("lines")).select("width", "i", F.aggregate(
        "lines", F.array_repeat(F.lit(0.0), F.col("width")), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("line"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthonormal directions by falling variance for the most frequent width; other widths keep their own axes.

    One matrix of width x width numbers comes to the driver, whatever the number of vectors."""
    most = vectors.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    if most is None:
        return {}
    lines = moments(vectors.where(F.col("width") == most["width"])).orderBy("i").collect()
    _, axes = np.linalg.eigh(np.array([r["line"] for r in lines]))
    return {most["width"]: np.ascontiguousarray(axes[:, ::-1])}


def turned(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    return x @ axes[x.shape[1]] if x.shape[1] in axes else x


def tiles(vectors: DataFrame, axes: dict[int, np.ndarray], cosine: float, tile: int) -> DataFrame:
    """(tile, cell, ids, counts, data, low, high): vectors (node, copies, width, vector) in tiles of one cell each."""
    side = math.sqrt(2 - 2 * cosine) + SLACK

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby("width"):
                p = turned(unit(np.array(rows["vector"].tolist(), np.float64)), axes)[:, :GRID + 1]
                cells = np.floor(p[:, :GRID] / side).astype(int)
                yield rows.assign(cell=[[w, *c] for w, c in zip(rows["width"], cells.tolist(), strict=True)], along=p[:, -1])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Consecutive rows of one cell become tiles; the last one may wait for the next batch."""
        part, held, cell, made = None, [], None, 0

        def packed() -> pd.DataFrame:
            x = np.array([r[3] for r in held], np.float64)
            p = turned(unit(x), axes)[:, :BOX]
            single = x.astype("<f4")
            data = single if (single == x).all() else x  # floats travel as floats, without loss
            return pd.DataFrame([{"tile": (part << 32) + made, "cell": cell, "ids": np.array([r[0] for r in held], "<i8").tobytes(), "counts": np.array([r[1] for r in held], "<i8").tobytes(),
                                  "data": data.tobytes(), "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist()}])

        for batch in batches:
            for row in zip(batch["node"], batch["copies"], batch["cell"].map(list), batch["vector"], batch["part"], strict=True):
                if held and (row[2] != cell or len(held) >= tile):
                    yield packed()
                    held, made = [], made + 1
                cell, part = row[2], row[4]
                held.append(row)
        if held:
            yield packed()

    placed = vectors.mapInPandas(place, "node bigint, copies bigint, width int, vector array<double>, cell array<int>, along double")
    dealt = placed.repartitionByRange(shuffle_parts(vectors.sparkSession), "cell", "along", "node").sortWithinPartitions("cell", "along", "node")
    dealt = dealt.select("node", "copies", "cell", "vector", F.spark_partition_id().cast("bigint").alias("part"))
    return dealt.mapInPandas(cut, "tile bigint, cell array<int>, ids binary, counts binary, data binary, low array<double>, high array<double>")


def tile_pairs(tiled: DataFrame, cosine: float) -> DataFrame:
    """(a, b): pairs of tiles that can hold links, each once.

    Cells are joined with the cells next to them, so tiles far apart are never named together."""
    boxes = tiled.select("tile", "cell", "low", "high")
    near = boxes.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(3 ** GRID - 1))))  # base-3 digits are steps of -1, 0, 1
    moved = [F.get("cell", F.lit(0))] + [F.get("cell", F.lit(k + 1)) + F.pmod(F.floor(F.col("shift") / 3 ** k), F.lit(3)).cast("int") - 1 for k in range(GRID)]
    moved = [F.when(F.size("cell") > k, m) for k, m in enumerate(moved)]
    one = near.where(F.col("shift") < F.lit(3) ** (F.size("cell") - 1)).select(F.col("tile").alias("a"), F.filter(F.array(*moved), lambda x: x.isNotNull()).alias("cell"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    two = boxes.select(F.col("tile").alias("b"), "cell", F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    both = one.join(two, "cell").where("a <= b")
    gap = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    least = F.aggregate(gap, F.lit(0.0), lambda a, x: a + x * x)
    return both.where(least <= 2 - 2 * cosine + SLACK).select("a", "b")


def tile_groups(tiled: DataFrame) -> DataFrame:
    """(tile, lead): groups of neighbouring tiles. A group holds GROUP_BYTES of vectors at most, and there are some for every core."""
    part = F.shiftright("tile", 32).alias("part")
    sizes = tiled.groupBy(part).agg(F.count("*").alias("n"), F.max(F.length("ids").cast("bigint") * F.get("cell", F.lit(0))).alias("bytes"))
    whole = sizes.agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes")).first()
    span = max(1, min(GROUP_BYTES // max(whole["bytes"] or 0, 1), (whole["n"] or 0) // (4 * tiled.sparkSession.sparkContext.defaultParallelism)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    place = F.col("at") + F.col("tile").bitwiseAND(F.lit((1 << 32) - 1))
    return tiled.select("tile", part).join(F.broadcast(starts), "part").select("tile", F.floor(place / span).alias("lead"))


class Tile:
    """Unpacked rows of one tile with their turned unit vectors and the norms of what follows each step."""

    def __init__(self, ids: bytes, counts: bytes, data: bytes, width: int, axes: dict[int, np.ndarray]):
        self.ids, self.counts = np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i8")
        kind = "<f4" if len(data) == 4 * width * len(self.ids) else "<f8"
        self.raw = np.frombuffer(data, kind).reshape(len(self.ids), width).astype(np.float64)
        self.x = turned(unit(self.raw), axes)
        self.ends = [s for s in STEPS if s < self.x.shape[1]] + [self.x.shape[1]]
        self.rest = [np.sqrt((self.x[:, e:] ** 2).sum(axis=1)) for e in self.ends]


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of two vectors in double precision from their own components."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.sumprod(x.tolist(), y.tolist()) / math.sqrt(math.sumprod(x.tolist(), x.tolist()) * math.sumprod(y.tolist(), y.tolist()))


def linked(one: Tile, two: Tile, cosine: float) -> np.ndarray:
    """Whether row i of ``one`` and row j of ``two`` are at ``cosine`` or more, for all i and j."""
    so_far = one.x[:, :one.ends[0]] @ two.x[:, :two.ends[0]].T
    slack = np.multiply.outer(one.rest[0], two.rest[0])
    out = so_far - slack >= cosine + SLACK
    i, j = np.nonzero(~out & (so_far + slack >= cosine - SLACK))
    value, start = so_far[i, j], one.ends[0]
    for step, end in enumerate(one.ends[1:], 1):
        for at in range(0, len(i), 1 << 18):  # bounded memory where many pairs are open
            part = slice(at, at + (1 << 18))
            value[part] += np.einsum("ij,ij->i", one.x[i[part], start:end], two.x[j[part], start:end])
        slack = one.rest[step][i] * two.rest[step][j]
        sure = value - slack >= cosine + SLACK
        out[i[sure], j[sure]] = True
        still = ~sure & (value + slack >= cosine - SLACK)
        i, j, value, start = i[still], j[still], value[still], end
    for a, b in zip(i, j, strict=True):
        out[a, b] = exact_cosine(one.raw[a], two.raw[b]) >= cosine
    return out


def forest(links: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest with the components of the bipartite ``links``, as (node of one, node of two).

    Each round gives every open row of ``one`` its least column and joins rows by what they share."""
    label = np.where(links.any(axis=0), links.argmax(axis=0), -1)  # first row of every column
    cols = np.flatnonzero(label >= 0)
    edges = [(label[cols], cols)]  # a star around each first row
    root = np.arange(len(one))

    def find(r: int) -> int:
        while root[r] != r:
            root[r] = root[root[r]]
            r = root[r]
        return r

    more = []
    for r in np.flatnonzero(links.any(axis=1)):
        heads, first = np.unique(label[links[r]], return_index=True)
        columns = np.flatnonzero(links[r])[first]
        for h, c in zip(heads.tolist(), columns.tolist(), strict=True):
            x, y = find(r), find(h)
            if x != y:
                root[max(x, y)] = min(x, y)
                more.append((r, c))
    if more:
        edges.append(tuple(np.array(e) for e in zip(*more, strict=True)))
    rows, columns = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    return one[rows], two[columns]


def compared(tiled: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(kind, a, b): kind 0 gives ``b`` more links of node ``a``, kind 1 an edge of the forest between two nodes.

    A group of tiles travels once with the tiles that its own meet behind it, in one sorted stream, so a tile travels
    once for every group it meets."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, lead = {}, None
        for batch in batches:
            for group, b, partners, ids, counts, data, width in zip(*(batch[c] for c in ("lead", "b", "partners", "ids", "counts", "data", "width")), strict=True):
                if group != lead:
                    own, lead = {}, group
                if not len(partners):
                    own[b] = Tile(ids, counts, data, width, axes)
                    continue
                other = own[b] if b in own else Tile(ids, counts, data, width, axes)
                for a in partners:
                    links = linked(own[a], other, cosine)
                    if own[a] is other:
                        np.fill_diagonal(links, False)
                    if not links.any():
                        continue
                    found = [(0, own[a].ids, links @ other.counts)]
                    if own[a] is not other:
                        found.append((0, other.ids, own[a].counts @ links))
                    found.append((1, *forest(links, own[a].ids, other.ids)))
                    for kind, x, y in found:
                        some = y != 0 if kind == 0 else x != y
                        yield pd.DataFrame({"kind": kind, "a": x[some], "b": y[some]})

    groups = materialise(tile_groups(tiled))
    named = pairs.join(groups.select(F.col("tile").alias("a"), F.col("lead").alias("lead_a")), "a").join(groups.select(F.col("tile").alias("b"), F.col("lead").alias("lead_b")), "b")
    turn = F.pmod(F.xxhash64("lead_a", "lead_b"), F.lit(2)) == 0  # either group leads, so none has all its partners behind it
    led = named.select(F.when(turn, F.col("lead_b")).otherwise(F.col("lead_a")).alias("lead"), (F.col("lead_a") == F.col("lead_b")).alias("inside"),
                       F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"))
    met = led.groupBy("lead", "inside", "b").agg(F.collect_list("a").alias("partners"))
    packs = tiled.select(F.col("tile").alias("b"), "ids", "counts", "data", F.get("cell", F.lit(0)).alias("width"))
    empty = F.lit(b"")
    columns = ["lead", "b", "partners", "ids", "counts", "data", "width"]
    within = met.where("inside").select("lead", "b", "partners", empty.alias("ids"), empty.alias("counts"), empty.alias("data"), F.lit(0).alias("width"))
    sent = met.where("NOT inside").join(packs, "b").select(*columns)
    held = packs.join(groups.withColumnRenamed("tile", "b"), "b").withColumn("partners", F.array().cast("array<bigint>")).select(*columns)
    stream = held.unionByName(within).unionByName(sent).withColumn("late", F.size("partners") > 0)
    stream = stream.repartition(shuffle_parts(tiled.sparkSession), "lead").sortWithinPartitions("lead", "late", "b").drop("late")
    return stream.mapInPandas(work, "kind int, a bigint, b bigint")


def usable(vector) -> F.Column:
    """The vector as doubles where it can link, else null."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return F.when(F.coalesce(fine, F.lit(False)), x)


def links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), usable(F.col(f"`{embedding}`")).alias("vector"))
    # 0.0 and -0.0 are one value; equal vectors are one node
    keyed = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    keyed = keyed.withColumn("key", F.when(F.col("vector").isNotNull(), F.md5(F.to_json(F.struct("vector")))))
    nodes = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("vector")))
    axes = directions(nodes)
    tiled = materialise(tiles(nodes.select("node", "copies", "width", "vector"), axes, cosine, tile))
    with batch_rows(tiled.sparkSession, 32):  # a row holds a whole tile
        found = materialise(compared(tiled, tile_pairs(tiled, cosine), axes, cosine))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    roots = components(found.where("kind = 1").select("a", "b"))
    rooted = nodes.join(roots.withColumnRenamed("key", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").join(counts, "node", "left").select("key", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    alone = F.col("key").isNull()
    out = keyed.select("vec_id", "key").join(named, "key", "left")
    out = out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def digest(vectors: DataFrame) -> DataFrame:
    return links(vectors)
