"""Report files of a run and keyed vector files: written, read back, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mnemospark.plans.registry import query
from mnemospark.plans.tables import EVENTS_SQL, clock_events, table
from mnemospark.session import shared_dir
from mnemospark.sources import reports


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_RESULTS = f"""{EVENTS_SQL}, r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ['unknown'] ELSE [event_type, 'u' || (user_id % 3)] END AS types, event_id % 5 <> 0 AS ok,
    CASE event_id % 5 WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE '' END AS letter, event_id % 3 = 0 AS right_, event_id % 4 AS rounds FROM ev)"""


def _results(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    said = F.get(F.array(F.lit("Error"), F.lit("(b) two"), F.lit(" Three. "), F.lit("D"), F.lit("no idea")), (F.col("event_id") % 5).cast("int"))
    choices = F.create_map(*[F.lit(x) for x in ("A", "one", "B", "two", "C", "three", "D", "four")])
    types = F.when(F.col("event_id") % 7 != 0, F.concat("event_type", F.lit("; u"), (F.col("user_id") % 3).cast("string"), F.lit(";")))
    return e.select(F.col("event_id").alias("ID"), F.col("user_id").alias("video_id"), types.alias("type"), said.alias("response"), choices.alias("choices"), F.lit("B").alias("answer"), (F.col("event_id") % 3 == 0).alias("evaluate"), (F.col("event_id") % 4).alias("num_rounds"))


@query(
    "answer_report_files",
    f"""WITH {_RESULTS}, t AS (SELECT unnest(types) AS k, right_, rounds FROM r WHERE ok),
    a AS (SELECT count(*) FILTER (right_) AS c, count(*) AS n, count(*) FILTER (ok) AS m, sum(rounds) FILTER (ok) AS s FROM r),
    b AS (SELECT k, count(*) FILTER (right_) AS c, count(*) AS n, sum(rounds) AS s FROM t GROUP BY k)
    SELECT 'prediction ' || letter AS part, count(*)::VARCHAR AS shown, sum(event_id)::BIGINT AS checksum FROM r GROUP BY letter
    UNION ALL SELECT 'record ' || CASE WHEN ok THEN 'success' ELSE 'error' END, count(*)::VARCHAR, sum(event_id * len(types))::BIGINT FROM r GROUP BY ok
    UNION ALL SELECT 'Overall', c || '/' || n || ' ' || printf('%.1f', 100.0 * c / n) || ' ' || printf('%.1f', s / m) || ' ' || printf('%.1f', 9000.0 / m), NULL FROM a
    UNION ALL SELECT k, c || '/' || n || ' ' || printf('%.1f', 100.0 * c / n) || ' ' || printf('%.1f', s / n) || ' n/a', NULL FROM b""",
)
def answer_report_files(spark, sf_dir):
    """Events as answers of a run: the report's table, its predictions and records, as read back from the files."""
    path = _folder(spark, "answers")
    reports.write_answer_report(_results(spark, sf_dir), {"agent": "a|b", "mode": "test", "model": "m"}, path, usage={"total_tokens": 9000})
    total = lambda x, part, weight: x.groupBy(part.alias("part")).agg(F.count(F.lit(1)).cast("string").alias("shown"), F.sum(F.col("sample_key").cast("long") * weight).alias("checksum"))
    predicted = spark.read.schema("sample_key string, prediction string").json(f"{path}/predictions")
    records = spark.read.schema("sample_key string, status string, question_types array<string>").json(f"{path}/records")
    cells = F.split("value", r" (?<!\\)\| ")
    lines = spark.read.text(f"{path}/report.md").filter("startswith(value, '| ') and not startswith(value, '| Task') and not startswith(value, '| ---')").select(cells.alias("c"))
    page = lines.select(F.replace(F.col("c")[0], F.lit("| "), F.lit("")).alias("part"), F.concat_ws(" ", F.col("c")[4], F.col("c")[5], F.col("c")[6], F.col("c")[7]).alias("shown"), F.lit(None).cast("long").alias("checksum"))
    return total(predicted, F.concat(F.lit("prediction "), "prediction"), 1).unionByName(total(records, F.concat(F.lit("record "), "status"), F.size("question_types"))).unionByName(page)


_TASKS = ["tal", "stg", "dvc", "vs", "other"]


@query(
    "leaderboard_files",
    f"""WITH {EVENTS_SQL}, r AS (SELECT {_TASKS}[user_id % 5 + 1] AS task, event_type = 'purchase' AS ok, event_id % 4 AS rounds, user_id AS tokens, value FROM ev),
    s AS (SELECT task, count(*) AS n, count(*) FILTER (ok) AS c, avg(rounds) AS a, avg(tokens) AS t FROM r GROUP BY ROLLUP (task)),
    l AS (SELECT CASE task WHEN 'tal' THEN 'TAL' WHEN 'stg' THEN 'STG' WHEN 'dvc' THEN 'DVC' WHEN 'vs' THEN 'Video Summary' ELSE 'Overall' END AS label, * FROM s WHERE task IS NULL OR task <> 'other')
    SELECT label, c || '/' || n AS shown, round(a, 6) AS rounds, round(t, 6) AS tokens FROM l
    UNION ALL SELECT 'CVS_acc', round(100.0 * (SELECT c::DOUBLE / n FROM s WHERE task IS NULL), 1)::VARCHAR || '%', NULL, NULL UNION ALL SELECT 'DVC_llm', '3.25', NULL, NULL
    UNION ALL SELECT unnest(['NAP_acc', 'NAP_exact_acc (diagnostic)', 'SA_acc', 'STG_mIoU', 'TAG_mIoU@0.3', 'TAG_mIoU@0.5', 'DVC_F1', 'VS_llm', 'RC_llm']), 'n/a', NULL, NULL""",
)
def leaderboard_files(spark, sf_dir):
    """Events as records of a run: statistics of the known tasks, and the page's columns read back from its file."""
    e = clock_events(spark, sf_dir)
    task = F.get(F.array(*map(F.lit, _TASKS)), (F.col("user_id") % 5).cast("int"))
    records = e.select(F.col("event_id").alias("sample_key"), task.alias("task"), F.when(F.col("event_type") == "purchase", "success").otherwise("error").alias("status"), (F.col("event_id") % 4).alias("num_rounds"), F.col("user_id").alias("total_tokens"), F.lit(0.0).alias("elapsed_seconds"))
    stats = reports.task_statistics(records)
    whole = stats.filter("task is null").first()
    path = _folder(spark, "leaderboard")
    reports.write_leaderboard(records, {"metrics": {"cvs_acc": whole["completed"] / whole["n"], "dvc_llm": 3.25}, "status": "done"}, {"agent": "a"}, path, usage={"total_tokens": 5})
    c = F.split(F.regexp_replace("value", r"^\| | \|$", ""), r" \| ")
    page = spark.read.text(f"{path}/report.md").filter("startswith(value, '| ') and not startswith(value, '| Task') and not startswith(value, '| Metric') and not startswith(value, '| ---')").select(c[0].alias("label"), c[1].alias("shown"))
    named = F.create_map(*[F.lit(x) for kv in reports.LEADERBOARD_TASKS.items() for x in kv])
    exact = stats.select(F.coalesce(F.try_element_at(named, "task"), F.when(F.col("task").isNull(), F.lit("Overall"))).alias("label"), F.round("avg_rounds", 6).alias("rounds"), F.round("avg_tokens", 6).alias("tokens"))
    return page.join(exact, "label", "left").select("label", "shown", "rounds", "tokens")


@query(
    "keyed_vector_files",
    """WITH e AS (SELECT label, vec_id % 50 AS t, vec_id, embedding[1]::DOUBLE AS x, len(embedding) AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
    SELECT 'v' || label AS video_id, t::VARCHAR AS start_time, round(arg_max(x, vec_id) + CASE WHEN label % 2 = 0 THEN 0 ELSE 1000 END, 6) AS first_value, arg_max(n, vec_id) AS n FROM e GROUP BY label, t""",
)
def keyed_vector_files(spark, sf_dir):
    """Vectors by video and start time in two runs: the second leaves videos of the first as they are."""
    e = table(spark, sf_dir, "embeddings").filter("label is not null").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), (F.col("vec_id") % 50).alias("start_time"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    path = _folder(spark, "keyed")
    reports.write_keyed_vectors(e.filter("label % 2 = 0"), path, "vec_id")
    reports.write_keyed_vectors(e.withColumn("embedding", F.transform("embedding", lambda x: x + 1000)), path, "vec_id")
    x = reports.read_keyed_vectors(spark, path, e.select("video_id"))
    return x.select("video_id", "start_time", F.round(F.col("embedding")[0], 6).alias("first_value"), F.size("embedding").cast("long").alias("n"))
