"""Operators on inline rows and as invariants."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions.providers import HashEmbedder, ScriptedGenerator, embed_column, generate
from mnemospark.operators import consolidation, evallog, gates, graph, intervals, lsh, metrics, mixing, similarity, store, windows
from mnemospark.sources import captions, parsers, sinks


def test_interval_joins_against_brute_force(spark):
    rng = random.Random(1)
    spans = lambda n: [(k, a := rng.randint(0, 500), a + rng.randint(0, 90)) for k in range(n)]
    left, right = spans(80), spans(60)
    l, r = spark.createDataFrame(left, "i long, a long, b long"), spark.createDataFrame(right, "j long, c long, d long")
    for inclusive in (True, False):
        got = {(x.i, x.j) for x in intervals.overlap_join(l, r, ("a", "b"), ("c", "d"), 25, inclusive).collect()}
        want = {(i, j) for i, a, b in left for j, c, d in right if (a <= d and b >= c if inclusive else a < d and b > c)}
        assert got == want


def test_cue_on_a_border(spark):
    """A cue over a border is in both segments; one that ends at a border only in the first."""
    cues = spark.createDataFrame([(1, 9.5, 10.5), (2, 8.0, 10.0)], "id int, s double, e double")
    seg = intervals.fixed_segments(spark.createDataFrame([(25.0,)], "duration double"), "duration", 10)
    got = intervals.overlap_join(cues, seg.select("seg", "seg_start", "seg_end"), ("s", "e"), ("seg_start", "seg_end"), 10, False)
    assert sorted((r.id, r.seg) for r in got.collect()) == [(1, 0), (1, 1), (2, 0)]
    assert [r.seg_end for r in seg.orderBy("seg").collect()] == [10.0, 20.0, 25.0]


def test_anchored_windows_equal_the_walk(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 4000)) for g in range(5) for _ in range(60)]
    got = {(r.g, r.s): r.w_start for r in windows.anchored_windows(spark.createDataFrame(rows, "g int, s long"), "s", 600, ["g"]).collect()}
    for g in range(5):
        first = min(s for h, s in rows if h == g)
        for s in sorted(s for h, s in rows if h == g):
            assert got[g, s] == (first if s < first + 600 else s // 600 * 600)


def test_positions(spark):
    df = spark.createDataFrame([(k,) for k in [5, 900, 7, 100000, 8, 6]], "k long")
    assert [r.position for r in windows.positions(df, "k").orderBy("k").collect()] == list(range(6))
    assert windows.positions(df.limit(0), "k").collect() == []


def _graph(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_pagerank_against_numpy(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("c", "d", 1.0), ("a", "b", 1.0)]
    reset = spark.createDataFrame([("q", "a", 2.0), ("q", "d", 1.0), ("q", "x", 1.0), ("q", "b", -1.0), ("q", "c", float("nan"))], "query_id string, id string, weight double")
    got = {r.id: r.rank for r in graph.personalised_pagerank(_graph(spark, edges), reset, 0.85, 25, cut=7).collect()}
    names = list("abcdx")
    w = np.zeros((5, 5))
    for s, t, x in edges:
        i, j = names.index(s), names.index(t)
        w[i, j] += x
        w[j, i] += x
    total = w.sum(axis=1)
    share = np.divide(w, total[:, None], out=np.zeros_like(w), where=total[:, None] > 0)
    p = np.array([0.5, 0, 0, 0.25, 0.25])
    r = p.copy()
    for _ in range(25):
        r = 0.85 * r @ share + (0.15 + 0.85 * r[total == 0].sum()) * p
    assert all(abs(got.get(n, 0) - x) < 1e-12 for n, x in zip(names, r, strict=True)) and abs(sum(got.values()) - 1) < 1e-12


def test_delete_and_add_again(spark):
    facts = spark.createDataFrame([("c1", "a", "r", "b"), ("c2", "a", "r", "b"), ("c2", "b", "r", "d")], "chunk string, s string, p string, o string")
    gone = store.delete_documents(facts, spark.createDataFrame([("c2",)], "chunk string"))
    assert {tuple(r) for r in gone["lost_facts"].collect()} == {("b", "r", "d")} and [r.entity for r in gone["lost_entities"].collect()] == ["d"]
    again = gone["facts"].unionByName(facts.filter("chunk = 'c2'"))
    edges = lambda f: sorted(map(tuple, graph.fact_edges(f).collect()))
    assert edges(again) == edges(facts)


def test_synonyms_replace_counts(spark):
    facts = spark.createDataFrame([("c1", "a", "r", "b")], "chunk string, s string, p string, o string")
    syn = graph.synonym_edges(spark.createDataFrame([("a", "b", 0.9), ("a", "a", 1.0), ("b", "c", 0.7)], "query_id string, key_id string, score double"))
    got = {(r.src, r.dst): r.weight for r in graph.all_edges(facts, syn).collect()}
    assert got["a", "b"] == 0.9 and got["b", "a"] == 1.0 and ("b", "c") not in got and got["c1", "a"] == 1.0


def test_phrase_weights(spark):
    """Score over chunks, averaged over occurrences; unknown phrases drop out."""
    facts = spark.createDataFrame([("c1", "a", "r", "b"), ("c2", "a", "r", "d")], "chunk string, s string, p string, o string")
    scores = spark.createDataFrame([("q", "a", "b", 8.0), ("q", "a", "zz", 4.0)], "query_id string, s string, o string, score double")
    assert {r.entity: r.weight for r in graph.phrase_weights(scores, facts).collect()} == {"a": 3.0, "b": 8.0}


def test_log(spark):
    log = spark.createDataFrame([("1", 1, "error", None), ("1", 2, "success", "B"), ("2", 3, "success", "Unable to generate answer"), ("3", 4, "success", " ")], "ID string, seq int, status string, response string")
    ok = evallog.successful(F.col("status"), F.col("response"))
    q = spark.createDataFrame([(i,) for i in "1234"], "ID string")
    assert [tuple(r) for r in evallog.latest(log, "ID", "seq").filter("ID = '1'").collect()] == [("1", 2, "success", "B")]
    assert sorted(r.ID for r in evallog.pending(q, log, "ID", "seq", ok).collect()) == ["2", "3", "4"]
    assert tuple(evallog.completion_counts(evallog.merged(q, log, "ID", "seq"), ok).first()) == (1, 2, 1, 4)


def test_report(spark):
    rows = [("EntityLog", True, True, 2, 10, 1.0), ("EntityLog", False, False, 4, 30, 3.0), ("EventRecall", True, True, 1, 20, 2.0)]
    got = {r.task: r for r in evallog.report(spark.createDataFrame(rows, "task string, evaluate boolean, completed boolean, num_rounds int, total_tokens long, elapsed_seconds double")).collect()}
    assert (got["Overall"].completed, got["Overall"].accuracy, got["Overall"].avg_rounds) == ("2/3", 66.7, 2.3)
    assert got["EntityLog"].completed == "1/2" and got["EntityLog"].avg_tokens == 20.0
    page = sinks.render_report(evallog.report(spark.createDataFrame([("<b>", True, True, 1, 1, 1.0)], "task string, evaluate boolean, completed boolean, num_rounds int, total_tokens long, elapsed_seconds double")), "T")
    assert "&lt;b&gt;" in page["html"] and json.loads(page["json"])


def test_manifest(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "ID string")
    m = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "ordinal int, ID string")
    assert [r.ID for r in evallog.select_manifest(rows, m("3", "1"), "ID").collect()] == ["3", "1"]
    for bad in (["4"], ["1", "1"]):
        with pytest.raises(ValueError):
            evallog.select_manifest(rows, m(*bad), "ID")


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("e", "a", 1)], "query_id string, doc_id string, rank int")
    labels = spark.createDataFrame([("q", "b", 1.0), ("q", "c", 1.0)], "query_id string, doc_id string, rel double")
    got = {(r.query_id, r.k): r for r in metrics.cut_metrics(ranked, labels, [1, 5]).collect()}
    x = got["q", 5]
    assert got["q", 1].precision == 0 and x.recall == 1 and x.hit == 1 and x.mrr == 0.5 and abs(x.ap - (1 / 2 + 2 / 3) / 2) < 1e-12
    ideal = 1 + 1 / np.log2(3)
    assert abs(x.ndcg - (1 / np.log2(3) + 1 / 2) / ideal) < 1e-12
    assert got["e", 1].recall == 1.0 and got["e", 1].ndcg == 0.0


def test_token_f1_and_exact_match(spark):
    df = spark.createDataFrame([(1, "the red red fox", ["red fox red", "no"]), (2, "x", ["y"])], "id int, p string, g array<string>")
    assert {r.id: r.f1 for r in metrics.token_f1(df, "id", "p", "g").collect()} == {1: 1.0, 2: 0.0}
    assert [r.e for r in df.select(metrics.exact_match(F.lit("No!"), F.col("g")).alias("e")).collect()] == [1, 0]


def test_top_k_join_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    got = similarity.top_k_join(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "key_id"), 5, blocks=4, query_block=50, skip_self=True).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    want = {(q, int(k), r + 1) for q in range(120) for r, k in enumerate(np.lexsort((np.arange(120), -s[q]))[:5])}
    assert {(r.query_id, r.key_id, r["rank"]) for r in got} == want


def test_band_shape_and_clusters(spark):
    assert lsh.band_shape(0.7, 256) == (25, 10)
    base = " ".join(f"word{k}" for k in range(200))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " more"), (4, "short one"), (5, "short one"), (6, None), (7, " ".join(f"other{k}" for k in range(50)))], "id long, content string")
    got = {r.id: (r.cluster, r.kept) for r in lsh.clusters(docs).collect()}
    assert got[1] == (1, True) and got[2] == got[3] == (1, False) and got[4] == (4, True) and got[5] == (5, True) and got[6] == (6, True) and got[7] == (7, True)


def test_consolidation(spark):
    kind = "snapshot_ts long, triple_id long, s string, p string, o string, evidence array<string>"
    rows = [(1, 1, "cup", "is on", "table", ["e1"]), (1, 2, "sky", "has", "stars", ["e2"]), (2, 3, "cup", "is on", "table", ["e3"]), (2, 4, "cup", "is on", "table", ["e4"])]
    embed = lambda df: embed_column(df.withColumn("t", F.concat_ws(" ", "s", "p", "o")), "id", "t", HashEmbedder())
    decide = lambda df: df.select("triple_id", "s", "p", "o", F.array(F.get("related", F.lit(0))["triple_id"], F.lit(99).cast("long")).alias("removed"))
    got = {(r.snapshot_ts, r.triple_id): r.evidence for r in consolidation.fold(spark.createDataFrame(rows, kind), embed, decide).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 2), (2, 3), (2, 4)} and got[2, 3] == ["e3", "e1"] and got[2, 4] == ["e4", "e1"]


def test_gates(spark):
    units = spark.createDataFrame([("u1",), ("u2",)], "unit_id string")
    have = spark.createDataFrame([("u1", "x", 3), ("u1", "y", 0), ("u2", "x", 1), ("u2", "y", 2)], "unit_id string, kind string, size long")
    assert [tuple(r) for r in gates.artifact_gaps(units, have, ["x", "y"]).collect()] == [("u1", "y", "empty")]
    with pytest.raises(ValueError):
        gates.require_unique(have, "unit_id")
    with pytest.raises(ValueError):
        gates.require_known(have, units.limit(1), "unit_id")
    with pytest.raises(ValueError):
        gates.require_same_size(units, have)


def test_mixing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "source string, id int")
    order = lambda x: [r.id for r in x.orderBy("turn", "seat").collect()]
    assert order(mixing.round_robin(df, "source", ["id"])) == [1, 4, 2, 3]
    assert order(mixing.round_robin(df, "source", ["id"], "first_exhausted")) == [1, 4]
    assert mixing.capped_by_cluster(df, "source", "id", 1, 3).count() == 3
    assert {r.source: r.pool for r in mixing.other_label_pools(df, "source", "id", 10).collect()} == {"a": [4], "b": [1, 2, 3]}
    both = mixing.concatenate({"x": df, "y": df.withColumn("z", F.lit(1))})
    assert both.count() == 8 and both.filter("z is null").count() == 4
    neg = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(s).alias("score")) for k, s in ((1, 0.9), (2, 0.7), (3, 0.2))])
    got = spark.range(1).select(mixing.hard_negatives(neg, F.lit(1.0), above=0.3, ratio=0.8).alias("n")).first().n
    assert [x.id for x in got] == [2]


def test_hard_negative_chain(spark):
    kind = "q int, positive_id string, positive_score double, negatives array<struct<id: string, score: double>>, by_positive array<struct<id: string, score: double>>, earlier array<struct<id: string, score: double>>"
    neg = [("d1-2", 0.9), ("d2-1", 0.8), ("d3-1", 0.7), ("d4-1", 0.6), ("d5-1", 0.5)]
    by = [("d5-1", 0.95), ("d4-1", 0.4), ("d2-1", 0.99)]
    df = spark.createDataFrame([(1, "d1-1", 1.0, neg, by, None), (2, "d1-1", 0.1, neg, by, [("old", 0.2)]), (3, "d1-1", 0.1, neg, by, None), (4, "d9-1", 1.0, [], [], None)], kind)

    def kept(wanted=1, **how):
        return {r.q: [n.id for n in r.negatives] for r in mixing.hard_negative_chain(df, wanted, **how).collect()}

    assert kept(same_document=True)[1] == ["d2-1", "d3-1", "d4-1", "d5-1"]
    assert kept(positive_above=0.9)[1] == ["d1-2", "d2-1", "d3-1", "d4-1"]  # only what leads the ranking
    assert kept(positive_ranks=(1, 3))[1] == ["d1-2", "d3-1", "d5-1"]
    assert kept(margin=0.25, ranks=(1, 9)) == {1: ["d4-1", "d5-1"]}  # the slice comes after the bounds
    assert kept(ratio=0.85) == {1: ["d2-1", "d3-1", "d4-1", "d5-1"], 2: ["old"]}  # what was used before, where nothing is left
    assert kept(wanted=6) == {1: [n for n, _ in neg], 2: [n for n, _ in neg], 3: [n for n, _ in neg]} and kept(wanted=7) == {}


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"text": "a", "start_time": "9000000", "end_time": "09001000", "date": "DAY1"}, {"text": "b", "date": "DAY12", "start_time": "11094300", "end_time": "11095800"}]))
    got = captions.read_captions(spark, {"30sec": str(tmp_path / "c.json"), "odd": "nowhere"}).orderBy("idx").collect()
    assert [r.id for r in got] == ["30sec_0", "30sec_1"] and got[0].start_ts == 109000000 and got[0].video_path == "" and got[1].start_ts == 1211094300
    (tmp_path / "x_11000000.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\nfirst\nsecond\n\n2\n00:00:03,000 --> 00:00:04,000\n\n\n3\n00:00:05,000 --> 00:00:06,250\nthird\n")
    cues = captions.read_subtitles(spark, str(tmp_path / "*.srt"))
    assert [(r.start_seconds, r.end_seconds, r.text) for r in cues.orderBy("cue").collect()] == [(1.5, 2.0, "first second"), (5.0, 6.25, "third")]
    last = captions.hour_offset(captions.read_subtitles(spark, str(tmp_path / "*.srt"), last_line=True)).orderBy("cue").first()
    assert last.text == "second" and last.start_seconds == 11 * 3600 + 1.5
    raw = spark.createDataFrame([('{"5": {"consolidated_semantic_triples": [["a", "b"], ["a", "b", "c", "d"]]}, "6": {"consolidated_semantic_triples": []}}',)], "value string")
    assert [(r.id, r.subject, r.object) for r in captions.snapshot_triples(raw).collect()] == [("semantic_5_0", "a", "c")]
    t = captions.translated_captions(spark.createDataFrame([("a-b-100-200", "x")], "custom_id string, text string")).first()
    assert (t.start_time, t.end_time) == ("100", "200")
    with pytest.raises(ValueError):
        captions.flattened_questions(spark.createDataFrame([("v", [("1", "q"), ("1", "r")])], "video string, qa array<struct<uid: string, question: string>>"))
    clips = spark.createDataFrame([("c1", "p1", "s1"), ("c2", "p2", "s2"), ("c3", "p3", "s3")], "clip_id string, source_video_path string, start_time string")
    vec = spark.createDataFrame([("c1", [1.0]), ("p2", [2.0]), ("s2", [9.0])], "key string, embedding array<double>")
    assert {r.clip_id: r.embedding for r in captions.clips_with_embeddings(clips, vec).collect()} == {"c1": [1.0], "c2": [2.0], "c3": None}


def test_parsers(spark):
    assert len(parsers.EVALUATION) == 22 and len(parsers.TRAINING) == 17
    rows = spark.createDataFrame([("What?", ["A. a", "B. b c."], "B", "v")], "question string, options array<string>, answer string, videoID string")
    got = parsers.parse(parsers.EVALUATION, "videomme", rows).first()
    assert (got.cand_names, got.cand_texts, got.label_name, got.query_media) == (["A. a", "B. b c."], ["a", "b c"], "B. b c.", "v.mp4")
    assert got.query_text.endswith("Question:  What?\nA. a\nB. b c.")
    picture = spark.createDataFrame([("<|image_1|>Say", "it", "i.png", ["one", "two"])], "qry_inst string, qry_text string, qry_img_path string, tgt_text array<string>")
    assert parsers.parse(parsers.EVALUATION, "image_qa", picture).first().query_text == "\nSay it\n"
    clips = spark.createDataFrame([("q", "v/x.mp4", ["f/query", "f/positive_1", "f/n2"])], "query string, video_path string, clips array<string>")
    assert parsers.parse(parsers.EVALUATION, "moment_retrieval", clips).first().label_name == "f/positive_1"
    with pytest.raises(ValueError):
        parsers.parse(parsers.TRAINING, "nothing", rows)


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("chunk", "h1", "x", [1.0]), ("chunk", "h1", "x", [1.0])], "namespace string, hash_id string, content string, embedding array<double>")
    sinks.append_vectors(v, str(tmp_path / "v"))
    sinks.compact(spark, str(tmp_path / "v"), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1
    df = spark.createDataFrame([(1,)], "a int")
    sinks.write_once(df, str(tmp_path / "o"))
    sinks.write_once(df.union(df), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 1
    m = sinks.merge_splits(spark.createDataFrame([(1, "k", "old"), (2, "k", "new")], "split int, key string, v string")).first()
    assert m.v == "new"
    cache = spark.createDataFrame([], "key string, response string")
    asked = spark.createDataFrame([("p", "m", "f"), ("p", "m", "f")], "prompt string, model string, format string")
    first = sinks.cached_calls(asked, cache, lambda d: d.select("key", F.lit("r").alias("response")))
    assert [r.response for r in first.collect()] == ["r"]
    again = sinks.cached_calls(asked, first, lambda d: d.select("key", F.lit("never").alias("response")))
    assert [r.response for r in again.collect()] == ["r"]
    sinks.write_subtitles(spark.createDataFrame([("n", 1, 0.5, 1.0, "hi")], "name string, cue int, start_seconds double, end_seconds double, text string"), str(tmp_path / "s"))
    assert captions.read_subtitles(spark, str(tmp_path / "s" / "*" / "*.txt")).first().text == "hi"


def test_providers(spark):
    class Breaks:
        def generate(self, prompts):
            if "bad" in prompts:
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, p string").coalesce(1)
    assert {r.id: r.response for r in generate(df, "id", "p", Breaks()).collect()} == {1: "A", 2: None, 3: "C"}
    assert ScriptedGenerator([(r"say (\w+)", r"\1!")]).generate(["say hi", "x"]) == ["hi!", "Unable to generate answer"]
    v = HashEmbedder(16).embed(["one two", "one two", ""])
    assert (v[0] == v[1]).all() and abs(np.linalg.norm(v[0]) - 1) < 1e-9 and not v[2].any()


def test_written_tables_can_be_dropped(spark):
    from mnemospark.session import drop_written, shared_dir, written

    drop_written(spark)
    t = written(spark.range(3).toDF("a"), "kept")
    assert t.count() == 3 and shared_dir(spark).rpartition("/")[2] in t.inputFiles()[0]
    assert drop_written(spark) == 1 and drop_written(spark) == 0


def test_pagerank_with_salted_hubs(spark):
    from mnemospark.operators import graph

    edges = spark.createDataFrame([("hub", f"v{k}", 1.0 + k % 3) for k in range(40)] + [("v1", "v2", 2.0), ("v3", "far", 1.0)], "src string, dst string, weight double")
    reset = spark.createDataFrame([(1, "v1", 1.0), (1, "hub", 2.0), (2, "far", 1.0)], "query_id long, id string, weight double")
    plain, salted = ({(r.query_id, r.id): round(r.rank, 12) for r in graph.personalised_pagerank(edges, reset, 0.85, 5, hub=n).collect()} for n in (1000, 7))
    assert plain == salted and len(plain) == 84
