"""Caption jobs: segments of videos to captions by a provider, whole videos only, with translation and transcription.

A captioner, translator or transcriber is a Generator whose prompt names the media; frames and sound stay in the provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.providers import Generator, generate
from mnemospark.functions.text import NO_ANSWER, render
from mnemospark.functions.timecode import ceil_clock, floor_clock
from mnemospark.operators.intervals import fixed_segments, overlap_join
from mnemospark.sources.files import frame_times

PROMPTS = {
    "caption": "Describe ${video_path} from ${start} to ${end} at ${frames}.\nSpoken: ${spoken}",
    "translate": "Translate into English: ${text}",
    "transcribe": "Write down what is said in ${path}.",
}


def caption_rows(segments: DataFrame, text: Column) -> DataFrame:
    """Caption rows (video, start_time, end_time, text, date, video_path) of segments (video, video_path, seg_start, seg_end)."""
    return segments.select("video", floor_clock(F.col("seg_start")).alias("start_time"), ceil_clock(F.col("seg_end")).alias("end_time"), text.alias("text"), F.lit("DAY1").alias("date"), "video_path")


def spoken_in(segments: DataFrame, cues: DataFrame, unit: int) -> DataFrame:
    """segments (video, seg, ...) with what the cues (video, start_seconds, end_seconds, text) that overlap them say, in order."""
    hits = overlap_join(segments, cues, ("seg_start", "seg_end"), ("start_seconds", "end_seconds"), unit, inclusive=False, on=["video"])
    said = hits.groupBy("video", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_seconds", "text"))), lambda e: e["text"]), " ").alias("spoken"))
    return segments.join(said, ["video", "seg"], "left").withColumn("spoken", F.coalesce("spoken", F.lit("")))


def caption_videos(videos: DataFrame, cues: DataFrame, generator: Generator, unit: int = 30, fps: float = 0.5, most_frames: int = 10, tries: int = 3) -> DataFrame:
    """Caption rows of videos (video, video_path, duration), one for each segment of unit seconds.

    All or nothing: a video with a segment that got no caption has no rows. seg is the order within the video.
    """
    cut = fixed_segments(videos, "duration", unit)
    told = spoken_in(cut, cues, unit).withColumn("key", F.concat_ws("#", "video", F.col("seg").cast("string")))
    frames = F.array_join(F.transform(frame_times(F.col("seg_start"), F.col("seg_end"), F.col("duration"), fps, most_frames), lambda t: F.round(t, 2).cast("string")), ",")
    asked = told.withColumn("prompt", render(PROMPTS["caption"], video_path=F.col("video_path"), start=F.col("seg_start"), end=F.col("seg_end"), frames=F.coalesce(frames, F.lit("")), spoken=F.col("spoken")))
    got = asked.join(generate(asked, "key", "prompt", generator, tries), "key")
    failed = F.coalesce(F.trim("response"), F.lit("")).isin("", NO_ANSWER)
    whole = got.groupBy("video").agg(F.count_if(failed).alias("n")).filter("n = 0").select("video")
    return caption_rows(got.join(whole, "video"), F.col("response"))


def translated(rows: DataFrame, generator: Generator, key: str = "custom_id") -> DataFrame:
    """rows (key, text) with the text translated; a row without an answer keeps its own."""
    got = generate(rows.withColumn("prompt", render(PROMPTS["translate"], text=F.col("text"))), key, "prompt", generator)
    answer = F.when(~F.coalesce("response", F.lit(NO_ANSWER)).isin("", NO_ANSWER), F.col("response"))
    return rows.join(got, key).withColumn("text", F.coalesce(answer, "text")).drop("response")


def transcribed(media: DataFrame, generator: Generator) -> DataFrame:
    """(path, value) of media (path): what the provider hears, as subtitle text for parse_subtitles; silent media have no row."""
    got = generate(media.withColumn("prompt", render(PROMPTS["transcribe"], path=F.col("path"))), "path", "prompt", generator)
    return got.filter(~F.coalesce("response", F.lit(NO_ANSWER)).isin("", NO_ANSWER)).withColumnRenamed("response", "value")


def output_path(video: Column, transcript: Column, root: str, unit: int | None = None) -> Column:
    """Where a video's captions go: root/stem/<unit>sec.json, or the transcript's relative path as .json under root."""
    bare = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    stem = F.regexp_extract(bare(video), r"([^/]+)$", 1)
    if unit is not None:
        return F.concat(F.lit(f"{root}/"), stem, F.lit(f"/{unit}sec.json"))
    return F.concat(F.lit(f"{root}/"), bare(transcript), F.lit(".json"))


def write_captions(captions: DataFrame, path: str) -> None:
    """JSON lines, a folder for each video, rows in order of time; only whole jobs are seen (commit protocol)."""
    captions.repartition("video").sortWithinPartitions("video", "start_time").write.mode("overwrite").partitionBy("video").json(path)


def outside(files: DataFrame, keep: DataFrame) -> DataFrame:
    """files (path) whose stem is not among keep (video): what a clean-up may remove."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return files.withColumn("video", stem).join(keep.select("video"), "video", "left_anti").select("path")
