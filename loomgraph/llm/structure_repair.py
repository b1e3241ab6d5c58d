"""Repair of conversation structure by cheapest edits, found by bidirectional Dijkstra over the edit lattice.

1. Faults. Turns of a conversation are taken by turn (null first), then role and text. A turn is blank (no visible
   character), else a duplicate (role and text seen earlier), else truncated (last visible character ends no sentence).
2. Lattice. A node is a number of turns read and a state of the grammar (s?(ua)+)? over role initials. Keep costs 0,
   Rerole to user or assistant 3, Delete 4 (the only way for blank and duplicate turns), Insert of an empty user or
   assistant turn 3; a truncated turn that stays adds 3.
3. Search. A forward and a reverse heap meet; both go on until no open pair can equal the best sum, so every crossing
   of equal cost is settled. Nodes on cheapest paths are marked back from the crossings, and a walk over sets of
   marked nodes spells the least audit: equal audits read equally many turns, so a set holds at most four nodes.
4. Long conversations. Turns get their order from ranges over all rows and are searched in parts of ``part`` turns.
   Costs between the four states at both ends of a part are combined along the conversation (four numbers a
   boundary), every part is searched with these costs as heads start, and the sets at the boundaries are handed on.
   The audit is one row, as asked, a letter a turn; texts never meet in one row, only in one stream for the hash.

Defined results: null roles and texts are one space; null conv_ids are one conversation, as are null turns one turn;
repeated rows are duplicates; a conversation without turns is no row of ``repair`` (``digest`` gives it zeros); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import shuffle_parts

PART = 4096
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT for a truncated turn that stays
BLANKS = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
# states: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
FAR = 1 << 60


def moves_of(symbol: str) -> list[list[tuple[str, int, int]]]:
    """(edit, next state, cost) from every state over one turn; ``-`` is a turn that must go, upper case a cut one."""
    out, cut = [], CUT if symbol.isupper() else 0
    for state in range(4):
        found = [("D", state, DELETE)]
        for role, after in STEP[state].items() if symbol != "-" else ():
            if role == symbol.lower():
                found.append(("K", after, KEEP + cut))
            if role in NAMES:
                found.append(("R", after, REROLE + cut))
        out.append(found)
    return out


MOVES = {symbol: moves_of(symbol) for symbol in "suaxSUAX-"}
BACK = {symbol: [[(state, cost) for state in range(4) for _, after, cost in moves[state] if after == q] for q in range(4)] for symbol, moves in MOVES.items()}
INSERTS = [[after for role, after in STEP[state].items() if role in NAMES] for state in range(4)]
INSERTS_BACK = [[state for state in range(4) if q in INSERTS[state]] for q in range(4)]


def between(symbols: str) -> list[int]:
    """Costs from every state before the turns to every state after them, 16 numbers, inserts at both ends included."""
    out = []
    for start in range(4):
        cost = [FAR] * 4
        cost[start] = 0
        for symbol in [*symbols, None]:
            for _ in range(3):
                for state in range(4):
                    for after in INSERTS[state]:
                        cost[after] = min(cost[after], cost[state] + INSERT)
            if symbol is not None:
                ahead = [FAR] * 4
                for state, found in enumerate(MOVES[symbol]):
                    for _, after, c in found:
                        ahead[after] = min(ahead[after], cost[state] + c)
                cost = ahead
        out += cost
    return [min(c, FAR) for c in out]


class Search:
    """Both searches over one part; ``entry`` and ``exit`` are costs up to its first and from its last nodes."""

    def __init__(self, symbols: str, entry: list[int], exit: list[int], last: bool):
        self.symbols, self.n, self.last, self.exit = symbols, len(symbols), last, exit
        self.ahead, self.behind, self.best = {}, {}, FAR
        self.meet(entry, exit)
        self.good = self.marked()

    def after(self, node: int) -> list[tuple[str, int, int]]:
        """(edit, next node, cost); node = 4 * turns read + state."""
        i, state = divmod(node, 4)
        out = [(edit, 4 * i + 4 + q, cost) for edit, q, cost in MOVES[self.symbols[i]][state]] if i < self.n else []
        return out + [("I", 4 * i + q, INSERT) for q in INSERTS[state]] if i < self.n or self.last else out

    def before(self, node: int) -> list[tuple[int, int]]:
        i, state = divmod(node, 4)
        out = [(4 * i - 4 + q, cost) for q, cost in BACK[self.symbols[i - 1]][state]] if i else []
        return out + [(4 * i + q, INSERT) for q in INSERTS_BACK[state]] if i < self.n or self.last else out

    def meet(self, entry: list[int], exit: list[int]) -> None:
        """Fill ``ahead`` and ``behind`` (settled costs) and ``best``, the least total."""
        open_ahead = {q: c for q, c in enumerate(entry) if c < FAR}
        open_behind = {4 * self.n + q: c for q, c in enumerate(exit) if c < FAR}
        forward, reverse = ([(c, v) for v, c in held.items()] for held in (open_ahead, open_behind))
        heapq.heapify(forward)
        heapq.heapify(reverse)
        for v, c in open_ahead.items():
            self.best = min(self.best, c + open_behind.get(v, FAR))
        while forward and reverse and forward[0][0] + reverse[0][0] <= self.best:
            one = len(self.ahead) <= len(self.behind)
            heap, settled, held, other = (forward, self.ahead, open_ahead, open_behind) if one else (reverse, self.behind, open_behind, open_ahead)
            c, v = heapq.heappop(heap)
            if v in settled:
                continue
            settled[v] = c
            for w, cost in ((x[1], x[2]) for x in self.after(v)) if one else self.before(v):
                if c + cost < held.get(w, FAR):
                    held[w] = c + cost
                    heapq.heappush(heap, (c + cost, w))
                    self.best = min(self.best, c + cost + other.get(w, FAR))

    def marked(self) -> set[int]:
        """Forward nodes on cheapest paths: those at a crossing of least cost, and back from these along exact edges."""
        todo = []
        for v, c in self.ahead.items():
            at_end = v >= 4 * self.n and c + self.exit[v - 4 * self.n] == self.best
            if at_end or c + self.behind.get(v, FAR) == self.best or any(c + cost + self.behind.get(w, FAR) == self.best for _, w, cost in self.after(v)):
                todo.append(v)
        good = set(todo)
        while todo:
            v = todo.pop()
            for w, cost in self.before(v):
                if w not in good and self.ahead.get(w, FAR) + cost == self.ahead[v]:
                    good.add(w)
                    todo.append(w)
        return good

    def on_path(self, v: int, cost: int) -> bool:
        return (v in self.good and self.ahead[v] == cost) or cost + self.behind.get(v, FAR) == self.best

    def walk(self, mask: int, entry: list[int]) -> tuple[str, int]:
        """Least audit from the entry states in ``mask``, and the states in which it leaves the part."""
        front = {q: entry[q] for q in range(4) if mask >> q & 1 and self.on_path(q, entry[q])}
        audit = []
        while True:
            done = [v - 4 * self.n for v, c in front.items() if v >= 4 * self.n and c + self.exit[v - 4 * self.n] == self.best]
            if done:
                return "".join(audit), sum(1 << q for q in done)
            found: dict[str, dict[int, int]] = {}
            for v, c in front.items():
                for edit, w, cost in self.after(v):
                    if self.on_path(w, c + cost):
                        found.setdefault(edit, {})[w] = c + cost
            edit = min(found)
            audit.append(edit)
            front = found[edit]


def least_edits(symbols: str) -> tuple[int, str]:
    """Cost and audit of one whole conversation, given one symbol per turn."""
    exit = [0 if q in ENDS else FAR for q in range(4)]
    search = Search(symbols, [0, FAR, FAR, FAR], exit, True)
    return search.best, search.walk(1, [0, FAR, FAR, FAR])[0]


def faults(turns: DataFrame) -> DataFrame:
    """(conv, seq, turn, role, text, fault, symbol, initial) of rows (conv, turn, role, text), in order of ``seq``.

    ``seq`` numbers the rows of a range of all rows, so a long conversation spans many ranges."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = turns.repartitionByRange(shuffle_parts(turns.sparkSession), *order).sortWithinPartitions(*order)
    visible = F.trim(F.col("text"), F.lit(BLANKS))
    end = F.substring(visible, -1, 1)
    rows = materialise(rows.select("conv", F.monotonically_increasing_id().alias("seq"), "turn", "role", "text", F.md5("text").alias("said"),
                                   F.when(visible == "", F.lit("blank")).when(end.isin(".", "!", "?"), F.lit(None)).otherwise(F.lit("truncated")).alias("own")))
    seen = rows.where("own IS NULL OR own <> 'blank'").groupBy("conv", "role", "said").agg(F.min("seq").alias("first"), F.count("*").alias("c")).where("c > 1")
    seen = seen.select(F.col("conv").alias("s_conv"), F.col("role").alias("s_role"), F.col("said").alias("s_said"), "first")
    joined = rows.join(seen, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("role") == F.col("s_role")) & (F.col("said") == F.col("s_said")), "left")
    fault = F.when(F.col("own") == "blank", F.lit("blank")).when(F.col("first") < F.col("seq"), F.lit("duplicate")).otherwise(F.col("own"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("-")).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return joined.withColumn("fault", fault).select("conv", "seq", "turn", "role", "text", "fault", symbol.alias("symbol"), known.alias("initial"))


def in_parts(rows: DataFrame, part: int) -> DataFrame:
    """(conv, part, symbols, initials, first, last): consecutive turns of a conversation; parts order as their numbers."""
    held = rows.groupBy("conv", F.floor(F.col("seq") / part).alias("part")).agg(F.sort_array(F.collect_list(F.struct("seq", "symbol", "initial"))).alias("rows"))
    held = held.select("conv", "part", F.array_join("rows.symbol", "").alias("symbols"), F.array_join("rows.initial", "").alias("initials"))
    ends = held.groupBy("conv").agg(F.min("part").alias("first"), F.max("part").alias("last")).withColumnRenamed("conv", "e_conv")
    return held.join(ends, F.col("conv").eqNullSafe(F.col("e_conv"))).drop("e_conv")


def boundary_costs(parts: DataFrame) -> DataFrame:
    """(o_conv, o_part, entry, exit): exact costs of the four states at both ends of every part of a conversation of several."""

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["conv", "part"]].assign(costs=[between(s) for s in batch["symbols"]])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        costs, n = group["costs"].tolist(), len(group)
        entry, exit = [[0, FAR, FAR, FAR]], [[0 if q in ENDS else FAR for q in range(4)]]
        for k in range(n - 1):
            entry.append([min(FAR, *(entry[-1][p] + costs[k][4 * p + q] for p in range(4))) for q in range(4)])
            back = costs[n - 1 - k]
            exit.append([min(FAR, *(exit[-1][q] + back[4 * p + q] for q in range(4))) for p in range(4)])
        return pd.DataFrame({"o_conv": group["conv"], "o_part": group["part"], "entry": entry, "exit": exit[::-1]})

    several = parts.where("first < last").select("conv", "part", "symbols").mapInPandas(cross, "conv string, part bigint, costs array<bigint>")
    return several.groupBy("conv").applyInPandas(fold, "o_conv string, o_part bigint, entry array<bigint>, exit array<bigint>")


def searched(parts: DataFrame, offsets: DataFrame) -> DataFrame:
    """(conv, part, first, last, cost, walks): the least audit of each part for every set of states it may begin in."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cost, walks = [], []
            for symbols, part, first, last, entry, exit in zip(*(batch[c] for c in ("symbols", "part", "first", "last", "entry", "exit")), strict=True):
                entry = [0, FAR, FAR, FAR] if first == last else [int(c) for c in entry]
                exit = [0 if q in ENDS else FAR for q in range(4)] if first == last else [int(c) for c in exit]
                search = Search(symbols, entry, exit, part == last)
                able = [q for q in range(4) if search.on_path(q, entry[q])]
                masks = [m for m in range(1, 16) if all(q in able for q in range(4) if m >> q & 1)]
                cost.append(search.best)
                walks.append([{"mask": m, "audit": a, "out": o} for m in masks for a, o in [search.walk(m, entry)]])
            yield batch[["conv", "part", "first", "last"]].assign(cost=cost, walks=walks)

    held = parts.join(offsets, F.col("conv").eqNullSafe(F.col("o_conv")) & (F.col("part") == F.col("o_part")), "left").drop("o_conv", "o_part", "initials")
    return held.mapInPandas(work, "conv string, part bigint, first bigint, last bigint, cost bigint, walks array<struct<mask:int,audit:string,out:int>>")


def chosen(found: DataFrame) -> DataFrame:
    """(conv, part, first, last, cost, audit): the walk of each part that begins where the part before ended."""

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group, mask, masks = group.sort_values("part"), 1, []
        for steps in group["steps"]:
            masks.append(mask)
            mask = next(s["out"] for s in steps if s["mask"] == mask)
        return pd.DataFrame({"m_conv": group["conv"], "m_part": group["part"], "begin": masks})

    steps = found.where("first < last").select("conv", "part", F.transform("walks", lambda w: F.struct(w["mask"].alias("mask"), w["out"].alias("out"))).alias("steps"))
    begins = steps.groupBy("conv").applyInPandas(chain, "m_conv string, m_part bigint, begin int")
    held = found.join(begins, F.col("conv").eqNullSafe(F.col("m_conv")) & (F.col("part") == F.col("m_part")), "left")
    walk = F.filter("walks", lambda w: w["mask"] == F.coalesce(F.col("begin"), F.lit(1)))[0]
    return held.select("conv", "part", "first", "last", "cost", walk["audit"].alias("audit"))


def repaired_turns(rows: DataFrame, edits: DataFrame, part: int) -> DataFrame:
    """(conv, place, edit, role, text): the turns after the edits.

    A grammar word has the system turn exactly if its length is odd, so a turn's role follows from its place. Each
    part is rendered by itself from a stream that holds its audit before its turns."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, at, place, odd, out, conv = "", 0, 0, 0, [], None

        def inserted():
            nonlocal at, place
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, "I", NAMES["ua"[(place - odd) % 2]], ""))
                at, place = at + 1, place + 1

        for batch in batches:
            for c, kind, n, a, role, text in zip(*(batch[x] for x in ("conv", "kind", "n", "odd", "role", "text")), strict=True):
                if kind == 0:
                    inserted()  # what the part before has at its end
                    conv, audit, at, place, odd = c, text, 0, n, a
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit != "D":
                    out.append((conv, place, edit, role if edit == "K" else NAMES["ua"[(place - odd) % 2]], text))
                    place += 1
            if out:
                yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])
                out = []
        inserted()
        if out:
            yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])

    left = F.length("audit") - F.regexp_count("audit", F.lit("D"))
    earlier, all_parts = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv")
    heads = edits.withColumn("left", left).select("conv", "part", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("seq"), F.coalesce(F.sum("left").over(earlier), F.lit(0)).cast("bigint").alias("n"),
                                                  (F.sum("left").over(all_parts) % 2).cast("bigint").alias("odd"), F.lit("").alias("role"), F.col("audit").alias("text"))
    none = F.lit(0).cast("bigint")
    bodies = rows.select("conv", F.floor(F.col("seq") / part).alias("part"), F.lit(1).alias("kind"), "seq", none.alias("n"), none.alias("odd"), "role", "text")
    stream = heads.unionByName(bodies).repartition(shuffle_parts(rows.sparkSession), "conv", "part").sortWithinPartitions("conv", "part", "kind", "seq")
    return stream.mapInPandas(work, "conv string, place bigint, edit string, role string, text string")


def hashed(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of (conv, place, role, text): SHA-256 of ``role:text`` lines, fed turn by turn in order."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, digest = None, None
        for batch in batches:
            out = []
            for c, role, text in zip(batch["conv"], batch["role"], batch["text"], strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            if out:
                yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
        if digest is not None:
            yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "repaired_sha256"])

    stream = turns.select("conv", "place", "role", "text").repartition(shuffle_parts(turns.sparkSession), "conv").sortWithinPartitions("conv", "place")
    return stream.mapInPandas(work, "conv string, repaired_sha256 string")


def named(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    return turns.select(F.col(f"`{conv_id}`").cast("string").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
                        F.coalesce(F.col(f"`{text}`"), space).alias("text"))


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Two tables: the repaired turns (conv, place, edit, role, text) and a report per conversation (conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit); ``conv`` is the conversation's id as text."""
    rows = materialise(faults(named(turns, conv_id, turn, role, text)))
    parts = materialise(in_parts(rows, part))
    edits = materialise(chosen(materialise(searched(parts, boundary_costs(parts)))))
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    per_turn = rows.groupBy("conv", "turn").agg(count("blank"), count("duplicate"), count("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
    report = per_turn.groupBy("conv").agg(gaps, *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
    # pairs of neighbours: those inside a part, and the last of a part with the first of the next
    before = F.lag(F.substring("initials", -1, 1)).over(Window.partitionBy("conv").orderBy("part"))
    joined = parts.select("conv", F.concat(F.coalesce(before, F.lit("")), "initials").alias("initials"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials") - 1), lambda k: F.substring(F.col("initials"), k, F.lit(2)))
    wrong = F.when(F.length("initials") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    illegal = joined.groupBy(F.col("conv").alias("i_conv")).agg(F.sum(wrong).alias("illegal"))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit")
    whole = edits.groupBy(F.col("conv").alias("w_conv")).agg(F.first("cost").alias("cost"), audit)
    report = report.join(illegal, F.col("conv").eqNullSafe(F.col("i_conv"))).join(whole, F.col("conv").eqNullSafe(F.col("w_conv")))
    return repaired_turns(rows, edits, part), report.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def damaged(turns: DataFrame) -> DataFrame:
    """The given turns with faults put in by a checksum of their place: dropped, emptied, stops removed, repeated, role set."""
    space = F.lit(" ")
    place = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), place.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def digest(turns: DataFrame, part: int = PART) -> DataFrame:
    """One row per conversation of ``turns`` after damage and repair."""
    fixed, report = repair(damaged(turns), part=part)
    sums = hashed(fixed).withColumnRenamed("conv", "h_conv")
    ids = turns.select("conv_id").distinct().withColumn("id", F.col("conv_id").cast("string"))
    out = ids.join(report, F.col("id").eqNullSafe(F.col("conv")), "left").join(sums, F.col("id").eqNullSafe(F.col("h_conv")), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


# Costs from the last turn back: for every state the least (cost, audit) of what follows; the edits are then numbered
DIGEST_SQL = r"""
WITH RECURSIVE t AS (SELECT list(r ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda x: 0::UBIGINT)),
             lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END) AS r FROM range(256) s(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::UBIGINT)),
             lambda a, y: xor(a // 256, crc[1 + (xor(a % 256, y))::INT])), 4294967295::UBIGINT) % 20 AS kind FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen FROM d),
m AS (SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM n),
f AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS r, fault IS NOT NULL AND fault <> 'truncated' AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut,
             count(*) OVER (PARTITION BY conv_id) AS size FROM m),
e AS (SELECT conv_id, size AS i, {'c': 0, 'a': ''} AS q0, {'c': 6, 'a': 'II'} AS q1, {'c': 3, 'a': 'I'} AS q2, {'c': 0, 'a': ''} AS q3 FROM f WHERE i = 1
      UNION ALL
      SELECT conv_id, i, least(b0, {'c': 3 + best.c, 'a': 'I' || best.a}), least(b1, {'c': 3 + best.c, 'a': 'I' || best.a}), best, least(b3, {'c': 3 + b2.c, 'a': 'I' || b2.a}) FROM (
      SELECT *, least(b2, {'c': 3 + b3.c, 'a': 'I' || b3.a}) AS best FROM (
      SELECT e.conv_id, e.i - 1 AS i, list_min([{'c': 4 + q0.c, 'a': 'D' || q0.a}] || CASE WHEN gone THEN [] ELSE [{'c': 3 + cut + q2.c, 'a': 'R' || q2.a}] || CASE r WHEN 's' THEN [{'c': cut + q1.c, 'a': 'K' || q1.a}] WHEN 'u' THEN [{'c': cut + q2.c, 'a': 'K' || q2.a}] ELSE [] END END) AS b0,
             list_min([{'c': 4 + q1.c, 'a': 'D' || q1.a}] || CASE WHEN gone THEN [] ELSE [{'c': 3 + cut + q2.c, 'a': 'R' || q2.a}] || CASE WHEN r = 'u' THEN [{'c': cut + q2.c, 'a': 'K' || q2.a}] ELSE [] END END) AS b1,
             list_min([{'c': 4 + q2.c, 'a': 'D' || q2.a}] || CASE WHEN gone THEN [] ELSE [{'c': 3 + cut + q3.c, 'a': 'R' || q3.a}] || CASE WHEN r = 'a' THEN [{'c': cut + q3.c, 'a': 'K' || q3.a}] ELSE [] END END) AS b2,
             list_min([{'c': 4 + q3.c, 'a': 'D' || q3.a}] || CASE WHEN gone THEN [] ELSE [{'c': 3 + cut + q2.c, 'a': 'R' || q2.a}] || CASE WHEN r = 'u' THEN [{'c': cut + q2.c, 'a': 'K' || q2.a}] ELSE [] END END) AS b3
      FROM e JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i))),
a AS (SELECT conv_id, q0.c AS cost, q0.a AS audit FROM e WHERE i = 0),
o AS (SELECT conv_id, p, substr(audit, p, 1) AS edit, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) - 1 AS place, length(replace(audit, 'D', '')) % 2 AS odd
      FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM a)),
s AS (SELECT o.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said
      FROM o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i AND edit <> 'I' WHERE edit <> 'D' GROUP BY o.conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM f) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id"""
