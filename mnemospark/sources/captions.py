"""Readers of captions, snapshots, clips and subtitles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.timecode import day_number, time_code

#: Granularities in their order.
GRANULARITIES = ["10sec", "30sec", "3min", "10min", "1h"]
CAPTION = "text string, start_time string, end_time string, date string, video_path string"


def normalise_captions(raw: DataFrame) -> DataFrame:
    """Caption rows (granularity, idx, CAPTION) with id '{granularity}_{idx}' and time codes; missing values become ''."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "start_time", "end_time", "date", "video_path")]
    x = raw.select("granularity", "idx", *text)
    return x.select("*", F.concat_ws("_", "granularity", F.col("idx").cast("string")).alias("id"), time_code(F.col("date"), F.col("start_time")).alias("start_ts"), time_code(F.col("date"), F.col("end_time")).alias("end_ts"))


def read_captions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Captions of all known granularities, each a JSON array in a file; other granularities are skipped."""
    parts = []
    for g in (g for g in GRANULARITIES if g in paths):
        rows = spark.read.text(paths[g], wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{CAPTION.replace(' string', ': string')}>>")).alias("idx", "c"))
        parts.append(rows.select(F.lit(g).alias("granularity"), F.col("idx").cast("long").alias("idx"), "c.*"))
    if not parts:
        return spark.createDataFrame([], f"granularity string, idx long, {CAPTION}, id string, start_ts long, end_ts long")
    return normalise_captions(reduce(DataFrame.unionByName, parts))


def captions_from_rows(spark: SparkSession, rows: dict[str, list[dict]]) -> DataFrame:
    flat = [(g, k, *[r.get(c) for c in ("text", "start_time", "end_time", "date", "video_path")]) for g in GRANULARITIES for k, r in enumerate(rows.get(g, []))]
    return normalise_captions(spark.createDataFrame(flat, f"granularity string, idx long, {CAPTION}"))


def snapshot_triples(raw: DataFrame, column: str = "value") -> DataFrame:
    """Triples of JSON snapshot maps {ts: {consolidated_semantic_triples: [[s, p, o], ...]}}.

    Triples under three elements go, further elements are ignored, ids are semantic_{ts}_{idx}.
    """
    kind = "map<string, struct<consolidated_semantic_triples: array<array<string>>>>"
    each = raw.select(F.explode(F.from_json(column, kind)).alias("ts", "s")).select(F.col("ts").cast("long").alias("snapshot_ts"), F.posexplode(F.filter("s.consolidated_semantic_triples", lambda t: F.size(t) >= 3)).alias("idx", "t"))
    return each.select("snapshot_ts", "idx", F.concat_ws("_", F.lit("semantic"), F.col("snapshot_ts").cast("string"), F.col("idx").cast("string")).alias("id"), F.get("t", F.lit(0)).alias("subject"), F.get("t", F.lit(1)).alias("predicate"), F.get("t", F.lit(2)).alias("object"))


def clips_with_embeddings(clips: DataFrame, vectors: DataFrame) -> DataFrame:
    """clips (ordinal, clip_id, source_video_path, start_time, ...) with the embedding found by id, else path, else start."""
    out = clips
    for k, by in enumerate(("clip_id", "source_video_path", "start_time")):
        out = out.join(vectors.select(F.col("key").alias(by), F.col("embedding").alias(f"_e{k}")), by, "left")
    return out.withColumn("embedding", F.coalesce("_e0", "_e1", "_e2")).drop("_e0", "_e1", "_e2")


def parse_subtitles(files: DataFrame, last_line: bool = False) -> DataFrame:
    """Cues of SRT files (path, value): path, cue, start_seconds, end_seconds, text; cues without text go.

    Text lines are joined by spaces, or the last line alone is the text.
    """
    blocks = files.select("path", F.posexplode(F.split(F.trim(F.regexp_replace("value", "\r\n?", "\n")), r"\n[ \t]*\n+")).alias("cue", "block"))
    stamp = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"
    part = lambda k: F.regexp_extract("block", stamp, k).cast("double")
    clock = lambda k: part(k) * 3600 + part(k + 1) * 60 + part(k + 2) + part(k + 3) / 1000
    lines = F.filter(F.transform(F.split(F.regexp_replace("block", rf"(?s)^.*?{stamp}[^\n]*\n?", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.when(F.size(lines) > 0, F.element_at(lines, -1)) if last_line else F.array_join(lines, " ")
    return blocks.filter(F.col("block").rlike(stamp)).select("path", "cue", clock(1).alias("start_seconds"), clock(5).alias("end_seconds"), text.alias("text")).filter(F.coalesce("text", F.lit("")) != "")


def hour_offset(cues: DataFrame) -> DataFrame:
    """Cues of hour-named files (..._11000000.srt) moved by their hour."""
    hour = F.coalesce(F.regexp_extract("path", r"_(\d{2})\d{6}[^/]*$", 1).try_cast("int"), F.lit(0)) * 3600
    return cues.withColumn("start_seconds", F.col("start_seconds") + hour).withColumn("end_seconds", F.col("end_seconds") + hour)


def read_subtitles(spark: SparkSession, path: str, last_line: bool = False) -> DataFrame:
    return parse_subtitles(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"), last_line)


def translated_captions(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """JSONL rows (custom_id, text, keep): the last two '-' parts of custom_id are start and end."""
    parts = F.split("custom_id", "-")
    return rows.select(*keep, F.try_element_at(parts, F.lit(-2)).alias("start_time"), F.try_element_at(parts, F.lit(-1)).alias("end_time"), "text")


def read_openie(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) by chunk from one offline extraction file; both maps are required."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "ner_results map<string, array<string>>, triple_results map<string, array<array<string>>>").alias("r"))
    if not raw.filter("r.ner_results is null or r.triple_results is null").isEmpty():
        raise ValueError("an extraction file needs ner_results and triple_results")
    return raw.select(F.explode("r.ner_results").alias("chunk", "entities")), raw.select(F.explode("r.triple_results").alias("chunk", "triples"))


def flattened_questions(records: DataFrame) -> DataFrame:
    """Records with a qa array as one row a question; repeated uids are an error."""
    out = records.select("*", F.explode("qa").alias("_q")).drop("qa").select("*", "_q.*").drop("_q")
    if again := out.groupBy("uid").count().filter("count > 1").head(3):
        raise ValueError(f"uid occurs more than once: {[r.uid for r in again]}")
    return out


def consecutive_groups(entries: DataFrame, by: str, ordinal: str, valid: str) -> DataFrame:
    """Adds island: runs of valid entries in order, cut by invalid ones (gaps and islands); invalid rows go."""
    w = Window.partitionBy(by).orderBy(ordinal)
    cut = F.sum(F.when(F.col(valid), 0).otherwise(1)).over(w)
    return entries.withColumn("island", cut.cast("long")).filter(valid)


def first_video(files: DataFrame) -> DataFrame:
    """(stem, path): the first path of each file stem."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return files.groupBy(stem.alias("stem")).agg(F.min("path").alias("path"))


def natural_order(names: DataFrame, column: str) -> DataFrame:
    """Rows in natural order: the number in the name counts as a number."""
    return names.orderBy(F.regexp_replace(column, r"\d+", ""), F.regexp_extract(column, r"(\d+)", 1).try_cast("long"), column)


def day_of_file(path: Column) -> Column:
    return day_number(F.regexp_extract(path, r"(?i)(DAY\d+)", 1))
