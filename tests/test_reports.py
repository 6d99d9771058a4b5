"""Run reports and keyed vector files: edge cases beside the queries' SQL twins."""

import json

import pytest
from pyspark.sql import functions as F

from mnemospark.sources import reports

RESULT = "ID string, video_id string, type string, response string, choices map<string, string>, answer string, evaluate boolean, num_rounds int"
CHOICES = {"A": "Red.", "B": "blue", "C": "green"}


@pytest.mark.parametrize("response, letter", [("A", "A"), ("(b) x", "B"), ("c. green", "C"), ("D", "D"), ("Blue.", "B"), ("red", "A"), ("Aé", ""), ("E", ""), ("", ""), (None, ""), ("Always", "")])
def test_predicted_letter(spark, response, letter):
    x = spark.createDataFrame([(response, CHOICES)], "r string, c map<string, string>")
    assert x.select(reports.predicted_letter(F.col("r"), F.col("c"))).first()[0] == letter


def test_answer_report(spark, tmp_path):
    rows = [("1", "v", "a; b", "A", CHOICES, "A", True, 2), ("2", None, None, "B", CHOICES, None, False, None), ("3", "v", "a", "Error", None, "A", None, 5), ("4", "v", " ; ", None, CHOICES, "A", False, 1)]
    results = spark.createDataFrame(rows, RESULT)
    reports.write_answer_report(results, {"agent": "x|y"}, str(tmp_path / "r"))
    m = json.loads((tmp_path / "r/metrics.json").read_text())
    assert m["overall"] == {"accuracy": 0.25, "correct": 1, "total": 4}
    assert {k: (v["correct"], v["total"]) for k, v in m["by_question_type"].items()} == {"a": (1, 1), "b": (1, 1), "unknown": (0, 1)}
    assert m["run_statistics"]["agent_rounds"] == {"total": 2, "average": 1.0} and "token_usage" not in m["run_statistics"]
    page = (tmp_path / "r/report.md").read_text()
    assert "| Overall | x\\|y |  |  | 1/4 | 25.0 | 1.0 | n/a | n/a |" in page
    said = {r.sample_key: r.prediction for r in spark.read.json(str(tmp_path / "r/predictions")).collect()}
    assert said == {"1": "A", "2": "B", "3": "", "4": ""}
    reports.write_answer_report(results.limit(0), {}, str(tmp_path / "e"))
    assert json.loads((tmp_path / "e/metrics.json").read_text())["overall"] == {"accuracy": 0.0, "correct": 0, "total": 0}
    assert "| 0/0 | 0.0 | n/a | n/a | n/a |" in (tmp_path / "e/report.md").read_text()


def test_leaderboard(spark, tmp_path):
    kind = "sample_key string, qa_type string, status string, num_rounds int, total_tokens int, elapsed_seconds double"
    records = spark.createDataFrame([("1", "tal", "success", 1, 10, 1.0), ("2", "tal", "error", None, None, None), ("3", None, "success", 2, 2, 2.0)], kind)
    reports.write_leaderboard(records, {"metrics": {"stg_miou": 0.5, "vs_llm": 4.0}, "warnings": ["w"], "errors": ["e"]}, {"agent": "a"}, str(tmp_path / "l"))
    page = (tmp_path / "l/report.md").read_text()
    assert "| Overall | 2/3 | 1.0 | 4 | 1.0 |\n| TAL | 1/2 | 0.5 | 5 | 0.5 |\n\n" in page
    assert "| STG_mIoU | 50.0% |" in page and "| VS_llm | 4.00 |" in page and "- Warning: w\n- Error: e" in page and "not_evaluated" in page
    reports.write_leaderboard(records.limit(0), {}, {}, str(tmp_path / "e"))
    assert "| Overall | 0/0 | 0.0 | 0 | 0.0 |" in (tmp_path / "e/report.md").read_text()


def test_keyed_vectors(spark, tmp_path):
    kind, path = "video_id string, start_time string, embedding array<float>, at int", str(tmp_path / "k")
    first = [("v", "1", [1.0], 1), ("v", "1", [2.0], 2), ("v", "2", None, 3), (None, "1", [3.0], 4), ("w", None, [3.0], 5)]
    reports.write_keyed_vectors(spark.createDataFrame(first, kind), path, "at")
    reports.write_keyed_vectors(spark.createDataFrame([("v", "9", [9.0], 1), ("u", "1", [4.0], 1)], kind), path, "at")
    got = sorted((r.video_id, r.start_time, r.embedding) for r in reports.read_keyed_vectors(spark, path).collect())
    assert got == [("u", "1", [4.0]), ("v", "1", [2.0])]
    asked = reports.read_keyed_vectors(spark, path, spark.createDataFrame([("u",), ("u",), ("x",)], "video_id string"))
    assert [r.video_id for r in asked.collect()] == ["u"]
