import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.encode import hash_encoder
from loomgraph.sources import corpus as src
from loomgraph.sources import records as rec
from loomgraph.sources import store
from loomgraph.streaming.ingest import ingest_batch, ingest_stream, read_mentions


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_multihop_file(spark, tmp_path):
    """A ring of five titles: question k reads the titles k, k + 1, ..., 1 + k % 3 of them, so titles are shared by up to three questions."""
    ring = ["Anvil", "Brook", "Cedar", "Delta", "Ember"]
    lines = [[f"{title} has {n} parts. " for n in range(1, 2 + i)] + ["\t"] for i, title in enumerate(ring)]
    reads = [[(k + j) % 5 for j in range(1 + k % 3)] for k in range(5)]
    items = [{"_id": f"ring-{k}", "question": f"What follows {ring[k]}?", "answer": ring[(k + 1) % 5], "type": "comparison", "level": "hard",
              "supporting_facts": [[ring[t], j] for j, t in enumerate(reads[k][1:])], "context": [[ring[t], lines[t]] for t in reads[k]]} for k in range(5)]
    path = write(tmp_path / "ring.json", items)
    passages, questions = src.read_multihop(spark, path)
    got = {r.title: r for r in passages.collect()}
    assert sorted(got) == ring
    for i, title in enumerate(ring):
        kept = [f"{title} has {n} parts." for n in range(1, 2 + i)]
        assert got[title].sentences == kept and got[title].text == "\n".join([f"Title: {title}", *kept])
        assert got[title].passage_id == hashlib.sha1(title.encode()).hexdigest()
    asked = {r.question_id: r for r in questions.collect()}
    for k in range(5):
        assert asked[f"ring-{k}"].passage_ids == [hashlib.sha1(ring[t].encode()).hexdigest() for t in reads[k]]
        assert [(f.title, f.sent_idx) for f in asked[f"ring-{k}"].supporting_facts] == [(ring[t], j) for j, t in enumerate(reads[k][1:])]
    assert src.read_multihop(spark, path, max_samples=2)[1].count() == 2
    _, sentences = src.corpus_index(passages)
    assert sentences.count() == sum(range(1, 6))
    _, splits = src.read_multihop_splits(spark, path, path, max_dev=2)
    assert {r.split: r.n for r in splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {"train": 5, "dev": 2}


def test_chunks_and_questions(spark, tmp_path):
    (tmp_path / "set").mkdir()
    write(tmp_path / "set" / "chunks.json", ["0:zero", "1:## one\nmore", "none"])
    write(tmp_path / "set" / "questions.json", [{"id": "a", "question": "q", "answer": "x", "evidence": [["T", ["s1", "s2"]], ["U", ["s3"]]]},
                                                 {"id": "b", "source": "s", "question": "r", "answer": "y", "question_type": "t"}])
    chunks, questions = src.read_dataset(spark, str(tmp_path), "set")
    assert {(r.idx, r.body) for r in chunks.collect()} == {(0, "zero"), (1, "## one\nmore"), (-1, "none")}
    q = {r.question_id: r for r in questions.collect()}
    assert q["a"].source == "" and q["a"].evidence[0].sentences == ["s1", "s2"] and q["b"].evidence == []
    assert {r.title for r in src.question_titles(questions).collect()} == {"T", "U"}


def test_imports_number_chunks_by_first_appearance(spark):
    rows = spark.createDataFrame([(0, "a", "q", "x", "bridge", (["T", "U"], [["s1", "s2"], ["u"]])), (1, "b", "q", "x", None, (["U", "T"], [["u"], ["other"]]))],
                                 "pos bigint, id string, question string, answer string, type string, context struct<title:array<string>,sentences:array<array<string>>>")
    chunks, questions = src.import_distractor(rows)
    assert [r.text for r in sorted(chunks.collect(), key=lambda r: r.idx)] == ["0:T: s1 s2", "1:U: u", "2:T: other"]
    assert {r.question_id: r.question_type for r in questions.collect()} == {"a": "bridge", "b": ""}
    rows = spark.createDataFrame([(0, "a", "q", "x", "True", "[{'title': 'T', 'paragraph_text': 'One. Two'}]"), (1, "b", "q", "x", "false", "[]"), (2, "c", "q", "x", "True", "oops("),
                                  (3, "d", "q", "x", "True", "[{'title': '', 'paragraph_text': 'Three'}]")],
                                 "pos bigint, id string, question string, answer string, answerable string, paragraphs string")
    chunks, questions = src.import_paragraphs(rows)
    assert [r.text for r in sorted(chunks.collect(), key=lambda r: r.idx)] == ["0:T: One. Two", "1:Three"]
    got = {r.question_id: r for r in questions.collect()}
    assert set(got) == {"a", "c", "d"} and got["a"].evidence[0].sentences == ["One", "Two"] and got["c"].evidence == []


def test_question_records(spark):
    q = spark.createDataFrame([("few", "cats?", "A", [("T", ["cats sit", "b", "c", "d"])]), ("none", "why?", "B", []),
                               ("many", "red fish", "C", [(f"T{i}", [w]) for i, w in enumerate(["blue bird", "red fish", "green dog"])])],
                              "question_id string, question string, answer string, evidence array<struct<title:string,sentences:array<string>>>")
    got = {r.id: r for r in src.question_records(q, hash_encoder(64), top_k=1).collect()}
    assert got["few"].desc == "T: cats sit b c" and got["none"].desc == "why?" and got["many"].desc == "T1: red fish"
    assert len(got["many"].retrieved_passages) == 3


def test_records_descriptions_and_splits(spark, tmp_path):
    """Every source of an id, a label and a description once, in twelve records."""
    with pytest.raises(FileNotFoundError):
        rec.read_records(spark, str(tmp_path))
    rows = [{"id": f"n{k}", "question": f"Number {k}?", "answer": str(k)} for k in range(8)]
    rows += [{"_id": "listed", "question": "Which two?", "label": json.dumps(["Oak", "Elm", "Fir"])}, {"question": None, "answer": "[not a list"},
             {"id": "full", "answer": "MIXED Case", "retrieved_passages": ["first", "", "third"], "desc": "   "}, {"id": "kept", "retrieved_passages": ["unused"], "desc": "\tits own\n"}]
    rows[4]["desc"] = "replaced by the file"
    (tmp_path / "manifest.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "cached_desc").mkdir()
    (tmp_path / "cached_desc" / "n4.txt").write_text("from\na file")
    records = rec.read_records(spark, str(tmp_path))
    got = {r.idx: r for r in rec.dataset_rows(records, rec.read_cached_descriptions(spark, str(tmp_path))).collect()}
    assert [got[k].id for k in range(12)] == [f"n{k}" for k in range(8)] + ["listed", "9", "full", "kept"]
    assert [got[k].label for k in (3, 8, 9, 10, 11)] == ["3", "oak|elm|fir", "[not a list", "mixed case", ""]
    assert [got[k].desc for k in (3, 4, 10, 11)] == ["", "from\na file", "\n\nRetrieved passages:\nfirst\n\nthird", "its own"]
    assert got[7].question == "Question: Number 7?\nAnswer: " and got[9].question == "Question: \nAnswer: "
    by_place = {r.idx: r.split for r in rec.file_split(spark, str(tmp_path), records).collect()}
    assert [by_place[k] for k in range(12)] == ["train"] * 9 + ["val"] + ["test"] * 2
    (tmp_path / "split").mkdir()
    wanted = {k: ("val", "test", "train")[k % 3] for k in range(11)}  # the last record is in no file
    for name in ("train", "val", "test"):
        (tmp_path / "split" / f"{name}_indices.txt").write_text("\n\n".join(f" {k}" for k, split in wanted.items() if split == name))
    assert {r.idx: r.split for r in rec.file_split(spark, str(tmp_path), records).collect()} == wanted


def test_store_upsert_encodes_only_new(spark, tmp_path):
    path = str(tmp_path / "passage")
    frame = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    store.upsert_texts(spark, path, frame("a", "b", "a"), "passage", hash_encoder(8))
    store.upsert_texts(spark, path, frame("b", "c"), "passage", hash_encoder(8))
    got = store.read_store(spark, path).collect()
    assert sorted(r.text for r in got) == ["a", "b", "c"] and all(r.hash_id == "passage-" + hashlib.md5(r.text.encode()).hexdigest() for r in got)
    asked = spark.createDataFrame([(1, [got[2].hash_id, got[0].hash_id])], "request_id int, hash_ids array<string>")
    assert [r.hash_id for r in sorted(store.vectors_in_order(store.read_store(spark, path), asked).collect(), key=lambda r: r.place)] == [got[2].hash_id, got[0].hash_id]


def test_build_once(spark, tmp_path):
    path, calls = str(tmp_path / "x"), []

    def build():
        calls.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert store.build_once(spark, path, build, force).count() == 3
    assert len(calls) == 2


def test_graphml_and_mention_cache(spark, tmp_path):
    import xml.dom.minidom

    nodes = spark.createDataFrame([("a", "x < y & \"z\""), ("b", "t")], "hash_id string, text string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "src string, dst string, weight double")
    store.write_graphml(nodes, edges, str(tmp_path / "g"))
    parts = [p.read_text() for d in sorted((tmp_path / "g").iterdir()) for p in sorted(d.glob("part-*"))]
    doc = xml.dom.minidom.parseString("".join(parts))
    assert len(doc.getElementsByTagName("node")) == 2 and len(doc.getElementsByTagName("edge")) == 1
    p, s = store.read_mentions_json(spark, write(tmp_path / "n.json", {"passage_hash_id_to_entities": {"p1": ["A", "B"]}, "sentence_to_entities": {"s.": ["A"]}}))
    assert p.count() == 2 and s.count() == 1


def test_ingest_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "stores")
    one = spark.createDataFrame([(0, "Ada Lovelace met Boole."), (0, "Ada Lovelace met Boole."), (1, "Paris shines.")], "client_id int, text string")
    two = spark.createDataFrame([(0, "Ada Lovelace met Boole."), (0, "Boole slept.")], "client_id int, text string")
    for n, batch in ((0, one), (1, two), (1, two)):
        ingest_batch(batch, n, root, hash_encoder(8))
    assert sorted(r.text for r in store.read_store_partitions(spark, f"{root}/entity").collect()) == ["Ada Lovelace", "Boole", "Paris"]
    assert store.read_store_partitions(spark, f"{root}/passage").count() == 3
    assert read_mentions(spark, root + "/mentions").count() == 4


def test_ingest_stream(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.createDataFrame([(0, "Ada met Boole.")], "client_id int, text string").write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("client_id int, text string").parquet(inbox)
    for _ in range(2):
        q = ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), hash_encoder(8), available_now=True)
        q.awaitTermination(120)
        spark.createDataFrame([(0, "Ada met Boole."), (0, "Turing came.")], "client_id int, text string").write.mode("append").parquet(inbox)
    assert sorted(r.text for r in store.read_store_partitions(spark, str(tmp_path / "out" / "entity")).collect()) == ["Ada", "Boole", "Turing"]


def test_cli_parser_and_plugins():
    from loomgraph.cli import _plugin, parser

    args = parser().parse_args(["preprocess", "--num-clients", "3", "--entity-ratio", "0.1"])
    assert args.num_clients == 3 and args.entity_ratio == 0.1
    with pytest.raises(SystemExit):
        _plugin(None, "generator")
    assert _plugin("json:dumps", "generator")([1]) == "[1]"


def test_python_literals_and_large_indexes(spark):
    texts = [repr([{"title": "T", "paragraph_text": "it's \"x\"", "is_supporting": False}, {"title": None, "paragraph_text": "True", "n": 1}]),
             '[{"title": "J", "paragraph_text": "null", "s": true}]', "no list", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(src.literal_list(F.col("t"))).collect()]
    assert [[tuple(d) for d in g] for g in got] == [[("T", "it's \"x\""), (None, "True")], [("J", "null")], [], []]
    chunks = src.parse_chunks(spark.createDataFrame([("99999999999:foo",), ("0:a",), ("b",)], "text string")).collect()
    assert [r.idx for r in chunks] == [99999999999, 0, -1]
