"""Training sets: the chosen positives and negatives against plain rules over small rows."""

import pytest

from mnemospark.functions.text import plain_text
from mnemospark.operators.mixing import label_contrasts
from mnemospark.sources import parsers

CTX = "array<struct<title: string, text: string>>"


def _parse(parser, rows, **conf):
    return parsers.parse(parsers.TRAINING, parser, rows, conf).collect()


def test_plain_text(spark):
    x = spark.createDataFrame([("a\u2010b\u201cc\u201d\u2032\u2033 \u2026\u0001\u00ad x . . . y\u2044z\u000bw",), (None,), ("",)], "t string")
    got = [r[0] for r in x.select(plain_text(x.t)).collect()]
    assert got == ["a-b\"c\"''' ... x ... y/z w".replace("''' ...", "''' ..."), None, ""]


def test_label_contrasts(spark):
    """Every row meets a text of its label and texts of others; hot, single, null and repeated rows."""
    rows = [(i, "hot", f"h{i}") for i in range(300)] + [(300 + i, "b", f"b{i}") for i in range(4)] + [(400, "one", "o"), (401, None, "n"), (5, "hot", "h5")]
    got = label_contrasts(spark.createDataFrame(rows, "id long, label string, t string"), "label", "t", ["id"], 4, seed=3).collect()
    assert len(got) == 306
    label_of = {t: k for _, k, t in rows}
    for r in got:
        assert label_of[r.same] == r.label and r.n_label == (301 if r.label == "hot" else 4 if r.label == "b" else 1)
        assert len(r.others) == 4 and all(label_of[t] != r.label for t in r.others)
        if r.label != "one" and r.label == "hot":
            assert len(set(r.others)) == 4  # five others: none twice
    assert len({r.same for r in got if r.label == "hot"}) > 100
    alone = label_contrasts(spark.createDataFrame(rows[:5], "id long, label string, t string"), "label", "t", ["id"], 2).collect()
    assert [r.others for r in alone] == [[]] * 5
    assert label_contrasts(spark.createDataFrame([], "id long, label string, t string"), "label", "t", ["id"], 2).count() == 0


def test_text_retrieval(spark):
    pos, neg = [("T. ", "p", "doc1-0")], [("", "n0", "doc1-3"), ("N", "n1", "d2-0"), ("", "n2", "d3-0"), ("", "n3", "d4-0"), ("", "n4", "d5-0")]
    kind = "array<struct<title: string, text: string, doc_id: string>>"
    schema = f"query string, pos {kind}, neg {kind}, neg_scores array<double>, neg_docids array<string>, pos_score double, posbased_neg_docids array<string>, posbased_neg_scores array<double>, prev_neg array<string>, dataset string, BM25_query array<string>"
    scores, ids = [0.95, 0.9, 0.5, 0.4, 0.3], [n[2] for n in neg]
    row = ("q", pos, neg, scores, ids, 1.0, ["d3-0"], [0.99], ["old"], "arguana", [" ", " gen "])
    x = spark.createDataFrame([row], schema)
    (r,) = _parse("beir", x, doc_prompt="d ")
    assert (r.query_text, r.pos_text, r.neg_text) == ("q", "d T. p", [])
    assert _parse("beir", x, name="s_title")[0].pos_text == "p"
    assert _parse("beir", x, query_group_name="g")[0].query_text == "gen"
    assert _parse("beir", x, query_group_name="g", query_group_range="0-1")[0].query_text == "gen"
    (r,) = _parse("beir", x, num_hardneg=4)  # the positive's document goes, all others stay
    assert sorted(r.neg_text) == ["N. n1", "n2", "n3", "n4"]
    (r,) = _parse("beir", x, num_hardneg=2, posbased_filter_score=0.9, posneg_ratio=0.6)
    assert sorted(r.neg_text) == ["n3", "n4"]
    assert _parse("beir", x, num_hardneg=10) == []  # four of ten are too few
    assert _parse("beir", x, num_hardneg=1, neg_score_threshold=0.1)[0].neg_text == ["old"]
    assert "old" in _parse("beir", x, num_hardneg=2, prevneg_ratio=1.0)[0].neg_text
    assert _parse("beir", x.withColumn("pos", x.pos.getField("text"))) and _parse("beir", x.limit(0), num_hardneg=1) == []


def test_instructed_retrieval(spark):
    x = spark.createDataFrame([("find[SEP]q", [("web", "p")], [("w", "h")], [("", "r1"), ("w", "r2")]), ("bare", [(None, "p")], [], [])], f"question string, positive_ctxs {CTX}, hard_negative_ctxs {CTX}, negative_ctxs {CTX}")
    a, b = sorted(_parse("berri", x, num_hardneg=3), key=lambda r: r.query_text, reverse=True)
    assert (a.query_text, a.pos_text, sorted(a.neg_text)) == ("find:\tq", "web:\tp", ["r1", "w:\th", "w:\tr2"])
    assert (b.query_text, b.pos_text, b.neg_text) == ("bare", "p", [])
    assert {r.query_text for r in _parse("berri", x, add_prompt_ratio=0.0)} == {"q", "bare"}
    assert _parse("berri", x, num_hardneg=1)[0].neg_text in (["w:\th"], [])


def test_label_sets(spark):
    x = spark.createDataFrame([("t1", "a1", "cs.AI math"), ("t2", None, "cs.LG"), ("t3", "a3", "q-bio.NC")], "title string, abstract string, categories string")
    got = {r.query_text: r for r in _parse("mteb_cluster", x, num_hardneg=2)}
    assert set(got) == {"t1\na1", "t2\n", "t3\na3"} and got["t1\na1"].pos_text in ("cs.AI", "math")
    assert sorted(got["t1\na1"].neg_text) == ["cs.LG", "q-bio.NC"]
    seen = {r.pos_text for s in range(12) for r in _parse("mteb_cluster", x, name="arxiv", seed=s)}
    assert {"cs", "cs.LG", "q"} <= seen <= {"cs", "cs.AI", "cs.LG", "math", "q", "q-bio.NC"}
    assert _parse("mteb_cluster", x, num_hardneg=1, labels=["x", "cs.LG"], data_format="s2s")[1].neg_text in (["x"], ["cs.LG"])
    y = spark.createDataFrame([("one two", " A ", ["n"]), ("three", "a", []), ("four", "b", None)], "text string, label_text string, neg array<string>")
    got = {r.query_text: r for r in _parse("mteb_training", y, num_hardneg=1, labels=["a", "b"])}
    assert [(got[k].pos_text, got[k].neg_text) for k in ("one two", "three", "four")] == [("a", ["n"]), ("a", ["b"]), ("b", ["a"])]
    got = {r.query_text: r for r in _parse("mteb_training", y, num_hardneg=1, data_type="against_text")}
    assert got["three"].pos_text in ("one two", "three") and got["three"].neg_text == ["four"] and got["four"].pos_text == "four" and got["one two"].neg_text == ["n"]
    z = spark.createDataFrame([("abcd", "l"), ("efgh", "l")], "title string, label string")
    assert {tuple(r.neg_text) for r in _parse("mteb_cluster", z, num_hardneg=2, data_type="against_text", data_format="s2s")} == {("cd", "cd"), ("gh", "gh")}


def test_declared_sets(spark):
    x = spark.createDataFrame([("", "", "t", ""), ("q", None, "", "p.png"), ("<|image_1|>q", "i.png", "t", None)], "qry string, qry_image_path string, pos_text string, pos_image_path string")
    got = _parse("mmeb", x, root="r")
    assert [(r.query_text, r.query_media, r.pos_media, r.neg_text) for r in got] == [("q", None, ["r/p.png"], []), ("<|image_pad|>q", ["r/i.png"], None, [])]
    talk = spark.createDataFrame([("v", [("<video>\nwhat?",), ("that",)])], "video string, conversations array<struct<value: string>>")
    (r,) = _parse("llavahound_caption", talk, mode="video_retrieval")
    assert (r.query_text, r.pos_text, r.pos_media) == ("Find a video that contains the following visual content: that", "Understand the content of the provided video: <|video_pad|>", ["v"])
    with pytest.raises(ValueError):
        _parse("llavahound_caption", talk, mode="none")
    page = spark.createDataFrame([("q", ("a.png",), "ChartQA")], "query string, image struct<path: string>, source string")
    (r,) = _parse("visrag", page)
    assert r.query_text.startswith("This query is related to retrieving a relevant chart") and r.query_text.endswith(": " + " q ")
    assert r.pos_text == "A statistical chart comparing values or analyzing trends.  <|image_pad|>"
