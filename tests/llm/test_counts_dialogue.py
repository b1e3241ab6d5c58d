import pytest

from loomgraph.llm import dialogue, token_counts
from loomgraph.llm.token_counts import Rollup

CHANGES = "op string, source string, lang string, version string, tokens bigint, old_source string, old_lang string, old_version string, old_tokens bigint, extra string"


def rows(rollup):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_batches_are_applied_once(spark, tmp_path):
    change = lambda *r: spark.createDataFrame([(*x, "e") for x in r], CHANGES)
    rollup = Rollup(spark, str(tmp_path / "counts"))
    assert rows(rollup) == {}
    first = change(("insert", "a", "en", "1", 10, None, None, None, None), ("insert", "a", "en", "1", 5, None, None, None, None), ("insert", None, None, "1", None, None, None, None, None))
    assert rollup.commit(1, first) and not rollup.commit(1, first)
    assert rows(rollup) == {("a", "en", "1"): (2, 15), (None, None, "1"): (1, 0)}
    assert rollup.commit(2, change(("revise", "b", "en", "2", 7, "a", "en", "1", 5), ("delete", None, None, None, None, None, None, "1", None)))
    assert rows(rollup) == {("a", "en", "1"): (1, 10), ("b", "en", "2"): (1, 7)}
    rollup.fold()
    assert rows(rollup) == {("a", "en", "1"): (1, 10), ("b", "en", "2"): (1, 7)}
    assert not rollup.commit(2, first) and rollup.commit(3, change()) and rollup.commit(4, change(("delete", None, None, None, None, "a", "en", "1", 10)))
    rollup.fold()
    assert rows(rollup) == {("b", "en", "2"): (1, 7)}


def test_cut_off_batch_is_written_again(spark, tmp_path):
    change = spark.createDataFrame([("insert", "a", "en", "1", 10, None, None, None, None, "e")], CHANGES)
    rollup = Rollup(spark, str(tmp_path / "counts"))
    rollup.commit(1, change)
    (tmp_path / "counts" / "batch=1" / "_SUCCESS").unlink()
    assert rows(rollup) == {}
    assert rollup.commit(1, change) and rows(rollup) == {("a", "en", "1"): (1, 10)}


def test_unknown_change_stops(spark, tmp_path):
    with pytest.raises(Exception, match="unknown change"):
        Rollup(spark, str(tmp_path / "c")).commit(1, spark.createDataFrame([("x", "a", "en", "1", 1, None, None, None, None, "e")], CHANGES))


def test_changes_of_documents(odd):
    from pyspark.sql import functions as F

    assert token_counts.signed(token_counts.changes_of(odd, "insert", F.lit(1), "1")).count() == odd.count()


def expected(turns, part):
    by = {}
    for t in turns:
        by.setdefault(t[0], []).append(t)
    key = lambda t: (t[1] is None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or "")
    out = {}
    for conv, ts in by.items():
        ts.sort(key=key)
        for view in {t[2] for t in ts}:
            start = 0
            for at in range(0, len(ts), part):
                text, masks = "", []
                for _, _, who, said in ts[at:at + part]:
                    head = "<|assistant|>\n" if who == view else "<|user" + ("" if who is None else ":" + who) + "|>\n"
                    begin = len(text) + len(head)
                    text += head + (said or "") + "<|end|>\n"
                    if who == view:
                        masks.append((begin, len(text)))
                out[(conv, view, at // part)] = (start, text, masks)
                start += len(text)
    return out


@pytest.mark.parametrize("part", [2, 256])
def test_perspectives(spark, part):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo é\U0001f600"), (1, 2, "cem", None), (1, 2, "ann", ""), (1, None, "bob", "late"), (2, 0, None, "alone"), (None, 1, "ann", "x"),
             (1, 0, "ann", "hi"), (3, 0, "z", "long " * 30000)]
    frame = spark.createDataFrame([(*t, "v", "w") for t in turns], "conv_id bigint, turn bigint, role string, text string, place string, view string")
    got = {(r.conv_id, r["view"], r.part): (r.start, r.text, [tuple(m) for m in r.masks]) for r in dialogue.perspectives(frame, part_turns=part).collect()}
    assert got == expected(turns, part)


def test_no_turns(spark):
    assert dialogue.perspectives(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
