"""Files of an evaluation run: records and predictions as distributed JSON lines, metrics and a page from small aggregates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import answer_normalise
from mnemospark.session import written
from mnemospark.sources.files import put_file

#: The metrics and tasks of the leaderboard, in its order, and the metrics that a judge gives on its own scale.
LEADERBOARD_METRICS = {
    "CVS_acc": "cvs_acc",
    "NAP_acc": "nap_acc",
    "NAP_exact_acc (diagnostic)": "nap_exact_acc",
    "SA_acc": "sa_acc",
    "STG_mIoU": "stg_miou",
    "TAG_mIoU@0.3": "tag_miou_03",
    "TAG_mIoU@0.5": "tag_miou_05",
    "DVC_F1": "dvc_f1",
    "DVC_llm": "dvc_llm",
    "VS_llm": "vs_llm",
    "RC_llm": "rc_llm",
}
LEADERBOARD_TASKS = {
    "tal": "TAL",
    "stg": "STG",
    "dvc": "DVC",
    "next_action": "Next Action",
    "rc": "Region Caption",
    "vs": "Video Summary",
    "skill_assessment": "Skill Assessment",
    "cvs_assessment": "CVS Assessment",
}
JUDGED = ("dvc_llm", "vs_llm", "rc_llm")


def predicted_letter(response: Column, choices: Column) -> Column:
    """The letter A to D that a response begins with, else the one whose text (map letter -> text) it is, else an empty string."""
    first = F.regexp_extract(F.trim(response), r"(?U)^\(?([A-Da-d])[.)]?\s*(?:$|\s|\W)", 1)
    same = [F.when(answer_normalise(F.try_element_at(choices, F.lit(k))) == answer_normalise(response), F.lit(k)) for k in "ABCD"]
    return F.coalesce(F.when(first != "", F.upper(first)), *same, F.lit(""))


def answer_records(results: DataFrame) -> DataFrame:
    """One record a result (ID, video_id, type: a ';' list, response, choices, answer, evaluate, num_rounds).

    status is error where the response is empty, null or 'Error'. A result without a type counts as 'unknown'.
    """
    said = F.coalesce("response", F.lit(""))
    types = F.filter(F.transform(F.split(F.coalesce("type", F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    return results.select(
        F.col("ID").cast("string").alias("sample_key"),
        F.when(said.isin("Error", ""), "error").otherwise("success").alias("status"),
        F.coalesce(F.col("video_id").cast("string"), F.lit("")).alias("video_id"),
        F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("unknown"))).alias("question_types"),
        said.alias("raw_prediction"),
        predicted_letter(said, F.col("choices")).alias("prediction"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("evaluate", F.lit(False)).alias("evaluate"),
        F.coalesce(F.col("num_rounds").cast("long"), F.lit(0).cast("long")).alias("agent_rounds"),
    )


def answer_metrics(records: DataFrame) -> DataFrame:
    """(question_type, correct, total, accuracy, measured, agent_rounds): a null type is the whole run.

    The whole run counts every record, its rounds and measured those that succeeded; a type counts its successes only.
    """
    ok = F.col("status") == "success"
    sums = lambda: [F.count_if("evaluate").alias("correct"), F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("measured"), F.coalesce(F.sum(F.when(ok, F.col("agent_rounds"))), F.lit(0)).cast("long").alias("agent_rounds")]
    whole = records.agg(*sums()).withColumn("question_type", F.lit(None).cast("string"))
    each = records.filter(ok).withColumn("question_type", F.explode("question_types")).groupBy("question_type").agg(*sums())
    share = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0))
    return whole.unionByName(each).select("question_type", "correct", "total", share.alias("accuracy"), "measured", "agent_rounds")


def _cell(value) -> str:
    return str(value).replace("|", "\\|").replace("\n", "<br>")


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |", *("| " + " | ".join(_cell(c) for c in r) + " |" for r in rows)]


def write_answer_report(results: DataFrame, about: dict[str, str], path: str, title: str = "Run Report", usage: dict | None = None) -> None:
    """records and predictions (sample_key, prediction) as JSON lines, metrics.json and report.md.

    about: agent, mode and model. usage: token counts of the run, where known. Only the sums of each question type reach the driver.
    """
    records = written(answer_records(results), "answer-records")
    records.write.mode("overwrite").json(f"{path}/records")
    records.select("sample_key", "prediction").write.mode("overwrite").json(f"{path}/predictions")
    rows = {r["question_type"]: r for r in answer_metrics(records).orderBy("question_type").collect()}  # one a type
    whole = rows.pop(None)
    block = lambda r: {k: r[k] for k in ("accuracy", "correct", "total")}
    mean = whole["agent_rounds"] / whole["measured"] if whole["measured"] else 0.0
    stats = {"measured_tasks": whole["measured"], "agent_rounds": {"total": whole["agent_rounds"], "average": mean}, "agent_rounds_by_type": {k: r["agent_rounds"] for k, r in rows.items()}}
    stats |= {"token_usage": usage} if usage else {}
    metrics = {"overall": block(whole), "by_question_type": {k: block(r) for k, r in rows.items()}, "run_statistics": stats}
    tokens = (usage or {}).get("total_tokens")
    shown = lambda x: "n/a" if x is None else f"{x:.1f}"
    named = [about.get(k, "") for k in ("agent", "mode", "model")]
    line = lambda name, r, rounds, used: [name, *named, f"{r['correct']}/{r['total']}", f"{r['accuracy'] * 100:.1f}", shown(rounds), shown(used), "n/a"]
    page = _table(
        ["Task", "Agent", "Mode", "Model", "Completed", "Accuracy (%)", "Avg. rounds", "Avg. tokens", "Avg. time (s)"],
        [line("Overall", whole, mean if whole["measured"] else None, tokens / whole["measured"] if tokens and whole["measured"] else None), *(line(k, r, r["agent_rounds"] / r["total"], None) for k, r in rows.items())],
    )
    spark = results.sparkSession
    put_file(spark, f"{path}/metrics.json", json.dumps(metrics, indent=2, ensure_ascii=False) + "\n")
    put_file(spark, f"{path}/report.md", "\n".join([f"# {title}", "", *page]) + "\n")


def task_statistics(records: DataFrame) -> DataFrame:
    """(task, n, completed, avg_rounds, avg_tokens, avg_seconds) for each task (task, else qa_type, else 'unknown'); a null task is the whole run.

    records: sample_key, status, num_rounds, total_tokens, elapsed_seconds; one a sample (``evallog.latest``).
    """
    known = [F.col(c) for c in ("task", "qa_type") if c in records.columns]
    x = records.withColumn("_task", F.coalesce(*known, F.lit("unknown")))
    mean = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return x.rollup("_task").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("completed"), mean("num_rounds").alias("avg_rounds"), mean("total_tokens").alias("avg_tokens"), mean("elapsed_seconds").alias("avg_seconds")).withColumnRenamed("_task", "task")


def metric_text(name: str, value: float | None) -> str:
    """A judge's score with two places, any other as a percentage."""
    return "n/a" if value is None else f"{value:.2f}" if name in JUDGED else f"{value * 100:.1f}%"


def write_leaderboard(records: DataFrame, evaluation: dict, about: dict[str, str], path: str, title: str = "Run Report", usage: dict | None = None) -> None:
    """report.md (statistics of the known tasks, the leaderboard's metrics, the evaluation's status, token usage) and metrics.json.

    evaluation: metrics (name -> value), and status, warnings, errors, evaluator and judge where known.
    """
    rows = {r["task"]: r for r in task_statistics(records).filter(F.col("task").isNull() | F.col("task").isin(*LEADERBOARD_TASKS)).collect()}
    whole, metrics = rows.pop(None, None), evaluation.get("metrics", {})
    line = lambda name, r: [name, f"{r['completed']}/{r['n']}", f"{r['avg_rounds'] or 0:.1f}", f"{r['avg_tokens'] or 0:.0f}", f"{r['avg_seconds'] or 0:.1f}"]
    empty = {"completed": 0, "n": 0, "avg_rounds": 0, "avg_tokens": 0, "avg_seconds": 0}
    whole = whole or empty
    status = evaluation.get("status", "not_evaluated")
    page = [f"# {title}", "", "- " + " | ".join(f"{k.capitalize()}: {about.get(k, '')}" for k in ("agent", "mode", "model")), "", "## Run Statistics", ""]
    page += _table(["Task", "Completed", "Avg. rounds", "Avg. tokens", "Avg. time (s)"], [line("Overall", whole), *(line(label, rows[k]) for k, label in LEADERBOARD_TASKS.items() if k in rows)])
    page += ["", "## Leaderboard Metrics", "", f"Evaluator: `{evaluation.get('evaluator', 'n/a')}` | Judge: `{evaluation.get('judge')}`", ""]
    page += _table(["Metric", "Value"], [[label, metric_text(k, metrics.get(k))] for label, k in LEADERBOARD_METRICS.items()])
    page += ["", f"Evaluation status: **{status}** ({whole['n']} records)"]
    page += [f"- {kind}: {text}" for kind in ("Warning", "Error") for text in evaluation.get(f"{kind.lower()}s", [])]
    if usage:
        page += ["", "## Token Usage", "", f"- input: {usage.get('input_tokens', 0):,} | output: {usage.get('output_tokens', 0):,} | total: {usage.get('total_tokens', 0):,}"]
    spark = records.sparkSession
    put_file(spark, f"{path}/report.md", "\n".join(page) + "\n")
    put_file(spark, f"{path}/metrics.json", json.dumps({**about, "records": whole["n"], "leaderboard_metrics": metrics, "evaluation_status": status, "warnings": evaluation.get("warnings", []), "errors": evaluation.get("errors", [])}, indent=2, ensure_ascii=False) + "\n")


KEYED = "bucket int, video_id string, start_time string, embedding array<double>"


def write_keyed_vectors(vectors: DataFrame, path: str, order: str, buckets: int = 64) -> None:
    """Adds vectors (video_id, start_time, embedding) of videos that the store at path does not have yet.

    Of one (video_id, start_time) the row last by order stays; rows without a key or an embedding go. Rows are dealt to bucket folders by video and
    written in ranges of (bucket, video, time): a lookup reads one folder, a long video is several files, and row groups are pruned by key.
    """
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")
    x = vectors.select(F.col("video_id").cast("string").alias("video_id"), F.col("start_time").cast("string").alias("start_time"), F.col("embedding").cast("array<double>").alias("embedding"), F.col(order).alias("_order"))
    x = x.filter("video_id is not null and start_time is not null and embedding is not null")
    spark = vectors.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        x = x.join(spark.read.schema(KEYED).parquet(path).select("video_id").distinct(), "video_id", "left_anti")
    last = x.groupBy("video_id", "start_time").agg(F.max_by("embedding", "_order").alias("embedding")).withColumn("bucket", bucket)
    last.repartitionByRange("bucket", "video_id", "start_time").sortWithinPartitions("bucket", "video_id", "start_time").write.mode("append").partitionBy("bucket").parquet(path)


def read_keyed_vectors(spark: SparkSession, path: str, videos: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """(video_id, start_time, embedding) of the store, or of some videos (video_id) only, whose folders alone are read."""
    rows = spark.read.schema(KEYED).parquet(path)
    if videos is not None:
        asked = videos.select(F.col("video_id").cast("string").alias("video_id")).distinct()
        rows = rows.join(asked.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")), ["bucket", "video_id"], "left_semi")
    return rows.select("video_id", "start_time", "embedding")
