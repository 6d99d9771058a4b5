"""Record operators, file sources and provider steps on inline rows."""

import json

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text
from mnemospark.functions.providers import HashEmbedder, ScriptedGenerator
from mnemospark.operators import records
from mnemospark.plans import extraction
from mnemospark.sources import captions, files


def test_entries_are_found_in_their_granularity(spark):
    c = captions.captions_from_rows(spark, {"10sec": [{"text": "same", "date": "DAY1", "start_time": "0", "end_time": "1"}] * 2, "1h": [{"text": "same", "date": "DAY1", "start_time": "5", "end_time": "6"}]})
    found = spark.createDataFrame([("10sec", "same", 0.5)], "granularity string, content string, score double")
    got = records.entries_of_texts(found, c).collect()
    assert [(r.id, r.score) for r in got] == [("10sec_1", 0.5)]


def test_required_lookup(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x", 1)], "k string, v int")
    with pytest.raises(ValueError):
        records.required_lookup(a, b, "k")
    assert records.required_lookup(a.filter("k = 'x'"), b, "k").count() == 1


def test_seeding_by_granularity(spark):
    c = spark.createDataFrame([("10sec", "A surgeon grasps."), ("10sec", "A surgeon grasps."), ("30sec", "A surgeon grasps.")], "granularity string, text string")
    chunk = c.limit(1).select(text.chunk_id(F.col("text")).alias("chunk"))
    docs = records.seeded_documents(c, chunk.withColumn("entities", F.array(F.lit("surgeon"))), chunk.withColumn("triples", F.array(F.array(F.lit("surgeon"), F.lit("grasps"), F.lit("forceps")))))
    got = {r.granularity: (r.extracted_entities, r.extracted_triples) for r in docs.collect()}
    assert docs.count() == 2 and got["10sec"] == (["surgeon"], [["surgeon", "grasps", "forceps"]]) and got["30sec"] == ([], [])


def test_merge_documents_drops_bad_triples(spark):
    docs = spark.createDataFrame([("c1", "p"), ("c2", "q")], "idx string, passage string")
    e = spark.createDataFrame([("c1", ["b", "a", "b"])], "chunk string, entities array<string>")
    t = spark.createDataFrame([("c1", [["a", "r", "b"], ["a", "r"], ["a", "r", "b"]])], "chunk string, triples array<array<string>>")
    got = {r.idx: r for r in records.merged_documents(docs, e, t).collect()}
    assert got["c1"].extracted_entities == ["a", "b"] and got["c1"].extracted_triples == [["a", "r", "b"]] and got["c2"].extracted_triples == []
    x = spark.createDataFrame([([["a", "b", "c"], ["x"]], [[1]])], "t array<array<string>>, e array<array<int>>").select(records.valid_with_evidence(F.col("t"), F.col("e")).alias("v")).first().v
    assert [(p.triple, p.evidence) for p in x] == [(["a", "b", "c"], [1])]


def test_alignment(spark):
    a = spark.createDataFrame([(0, "3"), (1, "7")], "pos int, key string")
    assert records.aligned(a, a, "pos", ["key"]).count() == 2
    with pytest.raises(ValueError):
        records.aligned(a, a.filter("pos = 0"), "pos", ["key"])
    with pytest.raises(ValueError):
        records.aligned(a, a.withColumn("key", F.lit("3")), "pos", ["key"])


def test_sampling(spark):
    df = spark.range(10)
    assert [r.id for r in records.head_rows(df, ["id"], "3").collect()] == [0, 1, 2] and records.head_rows(df, ["id"], "all").count() == 10
    assert records.seeded_sample(df, "id", 4, 1).collect() == records.seeded_sample(df.repartition(5), "id", 4, 1).collect()


def test_merged_passages(spark):
    p = spark.createDataFrame([(1, 1, "T\na"), (1, 2, "U\nb"), (1, 3, "T\nc"), (1, 4, "V")], "query_id int, ordinal int, text string")
    assert [r.text for r in records.merged_passages(p).orderBy("ordinal").collect()] == ["T\na\nc", "U\nb", "V"]


def test_files(spark, tmp_path):
    for unit in ("u1", "u2"):
        (tmp_path / unit).mkdir()
    (tmp_path / "u1" / "10sec.json").write_text("[]")
    assert [r.unit_id for r in files.units_with(spark, str(tmp_path)).collect()] == ["u1"]
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x"}, {"id": "y"}]))
    assert [(r.pos, r.id) for r in files.indexed_rows(spark, str(tmp_path / "a.json"), "id: string").collect()] == [(0, "x"), (1, "y")]
    for n in ("f_2.jpg", "f_10.jpg"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.frame_index for r in files.read_images(spark, str(tmp_path)).orderBy("frame_index").collect()] == [2, 10]
    have = spark.createDataFrame([("/r/a/v1.mp4",), ("/r/b/v1.mp4",), ("/r/c/v2.mp4",)], "path string")
    want = spark.createDataFrame([("b/v1",), ("v2.srt",), ("none",)], "name string")
    assert {r.name: r.path for r in files.resolved_videos(want, have, "/r").collect()} == {"b/v1": "/r/b/v1.mp4", "v2.srt": "/r/c/v2.mp4", "none": None}
    v = spark.createDataFrame([("a",)], "id string")
    files.write_graph(v, v, str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g"))[0].count() == 1
    (tmp_path / "conf.json").write_text('{"a": {"b": 1}}')
    assert files.read_config(spark, str(tmp_path / "conf.json"))["a"]["b"] == 1
    r = spark.range(1).select(files.frame_times(F.lit(5.0), F.lit(20.0), F.lit(10.0), 1.0, 3).alias("t"), files.segment_seconds(F.lit(0.0), F.lit(5.0), 2.0).alias("s"), files.frame_indices(F.lit(100), F.lit(25.0), 1.0, 64).alias("i")).first()
    assert r.t == [5.0, 7.5, 10.0] and r.s == [0.0, 2.0, 4.0] and r.i == [0, 33, 66, 99]


def test_text_helpers(spark):
    q = "Which? (A) one (B) two (C) three (D) four"
    r = spark.range(1).select(text.inline_choices(F.lit(q)).alias("c"), text.inline_choices(F.lit("(A) x (C) y")).alias("n"), text.plain_punctuation(F.lit("“a”，b…")).alias("p"), text.render("Hi ${x} and {y}!", x=F.lit("A"), y=F.lit(None)).alias("t"), text.final_answer(F.lit("Thought: x Answer: y")).alias("a")).first()
    assert r.c == {"A": "one", "B": "two", "C": "three", "D": "four"} and r.n is None and r.p == '"a",b...' and r.t == "Hi A and !" and r.a == "y"
    r = spark.range(1).select(text.extracted_entities(F.lit('so {"named_entities": ["a", "b", "a"]}')).alias("e"), text.extracted_triples(F.lit('{"triples": [["a", "r", "b"], ["x"]]}')).alias("t"), text.extracted_triples(F.lit("broken")).alias("n")).first()
    assert r.e == ["a", "b"] and r.t == [["a", "r", "b"]] and r.n == []


def test_extraction_steps(spark):
    g = ScriptedGenerator([(r"as \{\"named", '{"named_entities": ["surgeon"]}'), (r"Entities: \[\"surgeon\"\]", '{"triples": [["Surgeon", "holds", "clip"]]}'), (r"suggest\?.*1\. \(a, b, c\)", '{"triples": [["a", "likes", "c"]]}'), (r"Summarise.*\nx\ny", "both"), (r"help with", '["i3"]'), (r"Question", "Answer: yes")])
    p = spark.createDataFrame([("c1", "text")], "chunk string, passage string")
    assert [tuple(r) for r in extraction.facts_table(extraction.extract_facts(p, g)).collect()] == [("c1", "surgeon", "holds", "clip")]
    rows = spark.createDataFrame([("d", k, 100 + k, [["a", "b", "c"]]) for k in range(12)], "by string, ordinal int, code long, triples array<array<string>>")
    assert {r.key: r.triples for r in extraction.infer_semantics(rows, g).collect()} == {109: [["a", "likes", "c"]], 111: [["a", "likes", "c"]]}
    caps = spark.createDataFrame([(1, 5, 0, "x"), (1, 7, 1, "y"), (1, 700, 2, "z")], "d long, start long, ordinal int, text string")
    assert [r.text for r in extraction.summarised_windows(caps, 600, g).orderBy("w_start").collect()] == ["both", "z"]
    ranked = spark.createDataFrame([("q", f"i{k}", "t", 1.0 - k / 10) for k in range(4)] + [("r", "i0", "t", 0.5)], "query_id string, item_id string, content string, score double")
    queries = spark.createDataFrame([("q", "what"), ("r", "who")], "query_id string, question string")
    got = sorted((r.query_id, r.rank, r.item_id) for r in extraction.rerank(ranked, queries, g, 2).collect())
    assert got == [("q", 1, "i3"), ("q", 2, "i0"), ("r", 1, "i0")]
    q = spark.createDataFrame([(1, "red cup")], "query_id long, question string")
    passages = spark.createDataFrame([(1, "blue sky"), (2, "a red cup")], "passage_id long, content string")
    found = extraction.dense_retrieve(q, passages, HashEmbedder(), 1)
    assert found.first().key_id == 2 and extraction.answer_from_passages(q, found, passages, g).first().answer == "yes"
