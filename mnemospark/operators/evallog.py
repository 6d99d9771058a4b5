"""Append-only evaluation logs: last record wins, resume, merge, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import NO_ANSWER


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each key; one partial aggregate, no window over a hot key's rows."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), F.col(seq)).alias("_r")).select(key, "_r.*")


def successful(status: Column, answer: Column) -> Column:
    """Status success and an answer that is neither blank nor the sentinel."""
    text = F.coalesce(F.trim(answer), F.lit(""))
    return F.coalesce((status == "success") & (text != "") & (text != NO_ANSWER), F.lit(False))


def error_records(rows: DataFrame, message: Column, status: str = "error") -> DataFrame:
    """Log records of questions (ID and what else is known) that failed: fields that rows lack are empty."""
    known = [c for c in ("video_id", "type", "duration", "question", "answer") if c in rows.columns]
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in known else F.lit("").alias(c) for c in ("video_id", "type", "duration", "question", "answer")]
    choices = F.col("choices") if "choices" in rows.columns else F.create_map().cast("map<string,string>")
    history = F.array().cast("array<string>")
    return rows.select("ID", F.lit(status).alias("status"), *filled, choices.alias("choices"), message.alias("response"), history.alias("round_history"), F.lit(0).alias("num_rounds"), F.lit(False).alias("evaluate"))


def pending(questions: DataFrame, log: DataFrame, key: str, seq: str, ok: Column) -> DataFrame:
    """Questions whose latest record is not a success."""
    return questions.join(latest(log, key, seq).filter(ok).select(key), key, "left_anti")


def merged(questions: DataFrame, log: DataFrame, key: str, seq: str) -> DataFrame:
    """Every question with its latest record; status 'missing' where there is none."""
    out = questions.join(latest(log, key, seq), key, "left")
    return out.withColumn("status", F.coalesce("status", F.lit("missing")))


def completion_counts(results: DataFrame, ok: Column) -> DataFrame:
    """success, error, missing, total over merged results."""
    missing = F.col("status") == "missing"
    return results.agg(
        F.count_if(ok & ~missing).alias("success"),
        F.count_if(~ok & ~missing).alias("error"),
        F.count_if(missing).alias("missing"),
        F.count(F.lit(1)).alias("total"),
    )


def report(results: DataFrame, task: str = "task") -> DataFrame:
    """Completed, accuracy and averages for each task and Overall, in one rollup.

    results: task, evaluate, completed, num_rounds, total_tokens, elapsed_seconds.
    """
    r = results.rollup(task).agg(
        F.grouping(task).alias("overall"),
        F.count_if("completed").alias("n_completed"),
        F.count(F.lit(1)).alias("n_total"),
        F.round(100 * F.avg(F.coalesce(F.col("evaluate").cast("int"), F.lit(0))), 1).alias("accuracy"),
        F.round(F.avg(F.coalesce("num_rounds", F.lit(0))), 1).alias("avg_rounds"),
        F.round(F.avg(F.coalesce("total_tokens", F.lit(0))), 1).alias("avg_tokens"),
        F.round(F.avg(F.coalesce("elapsed_seconds", F.lit(0.0))), 1).alias("avg_seconds"),
    )
    name = F.when(F.col("overall") == 1, "Overall").otherwise(F.col(task))
    done = F.concat_ws("/", F.col("n_completed").cast("string"), F.col("n_total").cast("string"))
    return r.select(name.alias("task"), done.alias("completed"), "accuracy", "avg_rounds", "avg_tokens", "avg_seconds")


def multi_value_accuracy(results: DataFrame, types: str, correct: str) -> DataFrame:
    """Accuracy for each value of a ';' list."""
    each = results.select(F.explode(F.split(types, r"\s*;\s*")).alias("type"), correct).filter("type <> ''")
    return each.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def select_manifest(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows in manifest order (manifest: ordinal, key); duplicate or unknown ids are errors."""
    again = manifest.groupBy(key).count().filter("count > 1").select(key).head(5)
    if again:
        raise ValueError(f"ids occur more than once: {[r[0] for r in again]}")
    unknown = manifest.join(rows, key, "left_anti").select(key).head(5)
    if unknown:
        raise ValueError(f"unknown ids: {[r[0] for r in unknown]}")
    return manifest.join(rows, key).orderBy("ordinal")
