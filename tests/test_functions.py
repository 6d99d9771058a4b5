"""Time codes, text, repair and vectors on inline rows."""

import math

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import repair, text, timecode, vectors


def one(spark, value, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(value.alias("v")).first().v


@pytest.mark.parametrize(
    ("date", "time", "code"),
    [("DAY1", "11094300", 111094300), ("DAY12", "9000000", 1209000000), ("day3", "00000000", 300000000)],
)
def test_time_code(spark, date, time, code):
    assert one(spark, timecode.time_code(F.col("d"), F.col("t")), d=date, t=time) == code


def test_zero_fill_never_cuts(spark):
    assert one(spark, timecode.zero_fill(F.col("t")), t="123456789") == "123456789"


def test_seconds_and_clock(spark):
    assert one(spark, timecode.code_seconds(F.col("c")), c=111094399) == 11 * 3600 + 9 * 60 + 43
    assert one(spark, timecode.code_total_seconds(F.col("c")), c=1200000100) == 12 * 86400 + 1
    assert one(spark, timecode.seconds_clock(F.col("s")), s=90061) == "25010100"
    assert one(spark, timecode.floor_clock(F.col("s")), s=59.9999999999) == "00010000"
    assert one(spark, timecode.ceil_clock(F.col("s")), s=60.0000000001) == "00010000"
    assert one(spark, timecode.human_clock(F.col("s"), True), s=3661.5) == "01:01:01,500"
    assert one(spark, timecode.display(F.col("c")), c=1211094300) == "DAY12 11:09:43"


def test_range_and_target(spark):
    q = "see day 1 11:09:43 - DAY 2 00:00:05"
    assert tuple(one(spark, timecode.range_bounds(F.col("q")), q=q)) == (111094300, 200000500)
    assert one(spark, timecode.range_bounds(F.col("q")), q="DAY 1 11:09:43 alone") is None
    spans = one(spark, timecode.target_spans(F.col("t")), t="11094300DAY2_11101200; 09000000DAY1;odd")
    assert [tuple(s) for s in spans] == [(211094300, 211101200), (109000000, 109000000)]


def many(spark, rows, names, value):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {names}")
    return [r.v for r in df.select("k", value.alias("v")).orderBy("k").collect()]


def test_choice_letter(spark):
    options = {"a": "red van", "B": "blue boat", "C": "none, of these."}
    cases = {
        "c": "C",
        " Blue boat. ": "B",
        "(a) red van": "A",
        "C. none, of these": "C",
        "I saw water.\nanswer is (b), not C": "B",
        "Answer: A\nno, wait\n ( B ) \nthe answer - c!": "C",
        "C\nanswer: E": "C",
        "Answers vary: B": None,
        "perhaps B or C": None,
        "answer is boat": "B",
        "": None,
        None: None,
    }
    value = repair.choice_letter(F.col("r"), F.create_map(*[F.lit(x) for kv in options.items() for x in kv]))
    assert many(spark, [(r,) for r in cases], "r string", value) == list(cases.values())


def test_repair_prediction(spark):
    skills = [f"{n}: {k % 5 + 1}/5" for k, n in enumerate(repair.SKILLS)]
    cases = [
        ("tal", "first 12-15.5 sec, later 20 -\t21 Seconds; never 9 - 3 seconds or 4-5 minutes", "12-15.5, 20-21 seconds."),
        ("tal", "9 - 3 seconds", None),
        ("tal", "```\nprediction: 0-0 secs\n```", "0-0 seconds."),
        ("stg", "at 3 sec:[ 1,2 , 3,4 ] then 5.5 seconds : [0.5, 0, 9, 9], not 6 seconds: [1, 2, 3]", "3 seconds: [1, 2, 3, 4]\n5.5 seconds: [0.5, 0, 9, 9]"),
        ("stg", "3 seconds [1, 2, 3, 4]", None),
        ("dense_captioning_x", "4-6 seconds: cut: along the: line\n  7-5 seconds: back: wards\n8-9 secs.: tie : a knot \n10-11 seconds: alone", "4-6 seconds: cut: along the: line\n8-9 seconds: tie: a knot"),
        ("dense_captioning", "nothing here", None),
        ("skill_assessment", "; ".join(reversed(skills)).replace("/5", " / 5"), ", ".join(skills)),
        ("skill_assessment", ", ".join(skills[1:]), None),
        ("skill_assessment", ", ".join(skills).replace("1/5", "6/5"), None),
        ("cvs_assessment", "Cystic plate : 2\nhepatocystic triangle:0\nWe see. TWO STRUCTURES: 1.", "Two structures: 1, Cystic plate: 2, Hepatocystic triangle: 0"),
        ("cvs_assessment", "Two structures: 7, Cystic plate: 1, Hepatocystic triangle: 0", None),
        ("next_action", 'next action : "Tie the knot.."\nthen rest', "Tie the knot"),
        ("next_action", "Next action: ``", None),
        ("region_caption", "Description:\n a  clip\ton the\nvessel", "a clip on the vessel"),
        ("video_summary", "```text\nall done", "all done"),
        ("anything", "Response: as  it is", "as  it is"),
        ("anything", " \n ", None),
        ("tal", None, None),
    ]
    value = repair.repair_prediction(F.col("q"), F.col("r"))
    assert many(spark, [c[:2] for c in cases], "q string, r string", value) == [c[2] for c in cases]
    done = repair.is_repairable(F.lit("tal"), F.col("s"), F.col("r"))
    assert many(spark, [("success", "1-2 secs"), ("success", "none"), ("error", "1-2 secs")], "s string, r string", done) == [True, False, False]


def test_repair_json(spark):
    cases = {
        '{"k": [1, 2]}': '{"k": [1, 2]}',
        '{"k": [{"m": 1}, {"m": 2': '{"k": [{"m": 1}]}',
        '[["x]", "y\\"{"], ["z"': '[["x]", "y\\"{"]]',
        "[[[": "[[[]]]",
        None: None,
    }
    assert many(spark, [(x,) for x in cases], "x string", repair.repair_json(F.col("x"))) == list(cases.values())


def test_small_parsers(spark):
    assert one(spark, repair.sections(F.col("x")), x="so [[ ## p ## ]]\n7\n[[ ## q ## ]] 8 [[ ## p ## ]]9") == {"q": "8", "p": "9"}
    assert one(spark, repair.json_payload(F.col("x")), x="see ```json\n{'k': (1, 2)}\n``` end") == "{'k': (1, 2)}"
    assert one(spark, repair.json_payload(F.col("x")), x='so [3, {"k": 4}] it is') == '[3, {"k": 4}]'
    assert one(spark, repair.json_of_literal(F.col("x")), x="{'k': (1, None)}") == '{"k": [1, null]}'
    assert one(spark, repair.unescape(F.col("x")), x="\\u00e9 \\ud83d\\ude00") == "é 😀"
    assert one(spark, repair.nearest(F.col("x"), F.array(F.lit("xyz"), F.lit("abd"))), x="abc") == "abd"
    assert one(spark, text.qa_normalise(F.col("x")), x="The  Cat's, a hat!") == "cats hat"
    assert one(spark, text.kg_normalise(F.col("x")), x=" A-b  C! ") == "a b  c"
    assert one(spark, text.with_title(F.col("t"), F.col("x")), t="Title. ", x="text") == "Title. text"
    assert one(spark, text.first_person(F.col("x"), "Jake"), x="Jake: Jake's cup, Jake drinks") == "my cup, I drinks"
    got = one(spark, text.decision(F.col("x")), x='so {"decision": "Search", "selected_memory": {"memory_type": "Visual", "search_query": "q"}}')
    assert tuple(got) == ("search", "visual", "q")
    assert one(spark, text.id_list(F.col("x"), F.array(F.lit("a1"), F.lit("b2"))), x='ids: ["b2", "zz"]') == ["b2"]
    assert one(spark, text.id_list(F.col("x"), F.array(F.lit("a1"), F.lit("b2"))), x="I pick a1") == ["a1"]
    assert one(spark, text.metric_block(F.col("x"), ["mIoU", "F1"]), x="mIoU: 0.1\nmIoU: 0.25\n") == {"mIoU": 0.25}
    assert one(spark, text.question_text(F.col("q"), text.choices_map({"B": F.lit("two"), "A": F.lit("one"), "C": F.lit("")})), q="Which?") == "Which? (A) one (B) two"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0))
    df = spark.range(1)
    r = df.select(vectors.dot(a, b).alias("d"), vectors.cosine(a, b).alias("c"), vectors.unit(a).alias("u"), vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vectors.max_sim(F.array(a, b), F.array(b)).alias("m")).first()
    assert (r.d, r.z, r.m) == (8.0, 0.0, 12.0) and math.isclose(r.c, 0.8) and [round(x, 9) for x in r.u] == [0.6, 0.8]
    x = vectors.min_max(spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "g int, s double"), "s", ["g"], "n").orderBy("g", "s")
    assert [r.n for r in x.collect()] == [0.0, 1.0, 1.0]
