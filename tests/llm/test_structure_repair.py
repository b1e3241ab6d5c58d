import hashlib
import random
import re
import zlib

import pytest

from loomgraph.llm import structure_repair as sr

NEXT = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}


def table_from_the_end(symbols):
    """Least (cost, audit) by a table over all states, from the last turn back."""
    after = None
    for i in range(len(symbols), -1, -1):
        here = [(10**9, "")] * 4
        for q in range(4):
            found = [(0, "")] if after is None and q in (0, 3) else []
            if after is not None:
                found.append((4 + after[q][0], "D" + after[q][1]))
                cut = 3 if symbols[i].isupper() else 0
                for role, p in NEXT[q] if symbols[i] != "-" else ():
                    if role == symbols[i].lower():
                        found.append((cut + after[p][0], "K" + after[p][1]))
                    if role != "s":
                        found.append((3 + cut + after[p][0], "R" + after[p][1]))
            here[q] = min(found, default=here[q])
        for _ in range(4):
            for q in range(4):
                for role, p in NEXT[q]:
                    if role != "s":
                        here[q] = min(here[q], (3 + here[p][0], "I" + here[p][1]))
        after = here
    return after[0]


def direct(turns):
    """The digest of rows (conv_id, turn, role, text) with plain loops."""
    held = {}
    for conv, turn, role, text in turns:
        rows = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in held.items():
        rows.sort()
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in rows:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "-" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
            if fault:
                counts[fault] += 1
        cost, audit = table_from_the_end(symbols)
        numbers = [t for known, t, _, _ in rows if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        size, lines, at = len(audit.replace("D", "")), [], 0
        roles = (["system"] if size % 2 else []) + ["user", "assistant"] * (size // 2)
        for edit in audit:
            if edit != "D":
                role = rows[at][2] if edit == "K" else roles[len(lines)]
                lines.append(f"{role}:{'' if edit == 'I' else rows[at][3]}")
            at += edit != "I"
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_equals_table():
    rng = random.Random(1)
    for _ in range(3000):
        symbols = "".join(rng.choice("suaxSUAX-uaua") for _ in range(rng.randrange(1, 14)))
        assert sr.least_edits(symbols) == table_from_the_end(symbols)
    assert sr.least_edits("") == (0, "")


def test_long_clean_conversation_opens_one_state_a_turn():
    search = sr.Search("ua" * 2000, [0, sr.FAR, sr.FAR, sr.FAR], [0, sr.FAR, sr.FAR, 0], True)
    assert search.best == 0 and max(len(search.ahead), len(search.behind)) <= 4001
    assert search.walk(1, [0, sr.FAR, sr.FAR, sr.FAR])[0] == "K" * 4000


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 25)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "  ", "", None, f"word {turn}", f"line one.\nline {turn}?", "why? \n\t", "x" * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 1]), role, text))
    rows += [(70, t, "ua"[t % 2].replace("u", "user").replace("a", "assistant"), f"turn {t}.") for t in range(400)] + [(71, None, "user", "a?"), (71, None, "user", "a?")]
    return rows


@pytest.mark.parametrize("part", [1, 3, 4096])
def test_digest_equals_direct_computation(spark, turns, part):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in turns], "conv_id bigint, turn bigint, role string, text string, seq string, symbol string, part int")
    assert found(sr.digest(df, part=part)) == direct(turns)


def test_given_table_and_empty(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(sr.digest(df)) == direct([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert sr.digest(df.limit(0)).count() == 0


def test_repaired_turns_follow_the_grammar(spark, turns):
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    fixed, report = sr.repair(df, part=4)
    held = {}
    for r in fixed.orderBy("conv", "place").collect():
        held.setdefault(r.conv, []).append(r)
    for r in report.collect():
        rows = held.get(r.conv, [])
        assert [x.place for x in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in rows))
        assert "".join(x.edit for x in rows) == r.audit.replace("D", "")
