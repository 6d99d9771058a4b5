"""Writers: vector tables, logs, caches, reports. All large outputs are distributed writes; reports are small."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def append_vectors(df: DataFrame, path: str) -> None:
    """Appends new rows (namespace, hash_id, content, embedding); nothing is rewritten."""
    df.write.mode("append").partitionBy("namespace").parquet(path)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """One row a key, written once to a new place."""
    spark.read.parquet(path).dropDuplicates(["namespace", "hash_id"]).write.mode("error").partitionBy("namespace").parquet(target)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_in_order(df: DataFrame, ordinal: str, path: str) -> None:
    """JSON lines whose files, by name, hold the rows in the order of ordinal."""
    df.orderBy(ordinal).write.mode("overwrite").json(path)


def is_readable(df: DataFrame) -> bool:
    """Whether every file of a table can be read to its end and there are rows."""
    try:
        return df.count() > 0
    except Exception as e:
        if any(k in str(e) for k in ("PATH_NOT_FOUND", "UNABLE_TO_INFER", "FAILED_READ_FILE", "MALFORMED_RECORD", "corrupt", "Corrupt")):
            return False
        raise


def write_once(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Writes unless a whole readable result is there already."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        reader = spark.read.schema(df.schema).format(fmt)
        if fmt == "json":
            reader = reader.option("mode", "FAILFAST")
        if is_readable(reader.load(path).withColumn("_all", F.xxhash64("*")).filter("_all is not null")):
            return
    df.write.mode("overwrite").format(fmt).save(path)


def write_report(spark: SparkSession, rows: DataFrame, title: str, path: str) -> None:
    """A small aggregate as report.json, report.md and report.html."""
    from mnemospark.sources.files import put_file

    pages = render_report(rows, title)
    for kind, name in (("json", "json"), ("markdown", "md"), ("html", "html")):
        put_file(spark, f"{path}/report.{name}", pages[kind])


def write_submission(asked: DataFrame, log: DataFrame, key: str, seq: str, about: dict[str, str], path: str) -> None:
    """submission (key, answer) of the successful latest records, missing (key) of the others, and a manifest of the run."""
    from mnemospark.operators.evallog import merged, successful
    from mnemospark.session import written

    whole = written(merged(asked, log, key, seq).withColumn("_ok", successful(F.col("status"), F.col("answer"))), "submission")
    whole.filter("_ok").select(key, "answer").write.mode("overwrite").json(f"{path}/submission")
    whole.filter("not _ok").select(key).write.mode("overwrite").json(f"{path}/missing")
    facts = [F.lit(v).alias(k) for k, v in about.items()]
    whole.agg(F.count(F.lit(1)).alias("expected"), F.count_if("_ok").alias("answered")).select(*facts, "expected", "answered").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """avg_ent_chars, avg_ent_words over all extracted entities, four places."""
    e = docs.select(F.explode("extracted_entities").alias("e"))
    return e.agg(F.round(F.avg(F.length("e")), 4).alias("avg_ent_chars"), F.round(F.avg(F.size(F.split("e", r"\s+"))), 4).alias("avg_ent_words"))


def merge_splits(splits: DataFrame) -> DataFrame:
    """Rows (split, key, ...): of one key the row of the latest split."""
    w = Window.partitionBy("key").orderBy(F.desc("split"))
    return splits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def by_source(df: DataFrame, path: str, source: str = "source") -> None:
    """One folder for each source; hot sources keep several files."""
    df.write.mode("overwrite").partitionBy(source).parquet(path)


def retrieval_tables(pairs: DataFrame, path: str) -> None:
    """queries, corpus and qrels of (query_id, query, doc_id, text, score) as JSON lines."""
    pairs.select("query_id", "query").distinct().write.mode("overwrite").json(f"{path}/queries")
    pairs.select("doc_id", "text").distinct().write.mode("overwrite").json(f"{path}/corpus")
    pairs.select("query_id", "doc_id", "score").distinct().write.mode("overwrite").json(f"{path}/qrels")


def score_matrix(scores: DataFrame, experiments: list[str]) -> DataFrame:
    """dataset by experiment; experiments are named, so the plan needs no extra pass."""
    return scores.groupBy("dataset").pivot("experiment", experiments).agg(F.round(F.avg("score"), 6))


def cached_calls(prompts: DataFrame, cache: DataFrame, call) -> DataFrame:
    """(key, response) for prompts (prompt, model, format): cached rows, and call() for the others only."""
    keyed = prompts.withColumn("key", F.sha2(F.to_json(F.struct("prompt", "model", "format")).cast("binary"), 256)).dropDuplicates(["key"])
    misses = keyed.join(cache.select("key"), "key", "left_anti")
    return keyed.select("key").join(cache, "key").unionByName(call(misses).select("key", "response"))


def render_report(rows: DataFrame, title: str) -> dict[str, str]:
    """A small aggregate as JSON, Markdown and HTML; values are escaped."""
    names, data = rows.columns, [r.asDict() for r in rows.collect()]
    cells = [["" if d[n] is None else str(d[n]) for n in names] for d in data]
    md = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in cells)]
    row = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in r) + "</tr>"
    page = f"<!doctype html><title>{html.escape(title)}</title><table>{row('th', names)}{''.join(row('td', r) for r in cells)}</table>"
    return {"json": json.dumps(data, default=str), "markdown": "\n".join(md), "html": page}


def write_subtitles(cues: DataFrame, path: str) -> None:
    """SRT text, one folder a file name, cues in order; a failed job leaves no partial output (commit protocol)."""
    from mnemospark.functions.timecode import human_clock

    body = F.concat(F.col("cue").cast("string"), F.lit("\n"), human_clock(F.col("start_seconds"), True), F.lit(" --> "), human_clock(F.col("end_seconds"), True), F.lit("\n"), F.col("text"), F.lit("\n"))
    whole = cues.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", body.alias("b")))), lambda e: e["b"]), "\n").alias("value"))
    whole.write.mode("overwrite").partitionBy("name").text(path)
