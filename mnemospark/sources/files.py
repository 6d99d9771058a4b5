"""Readers of vectors, graphs, images, manifests and dataset folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "hash_id string, content string, embedding array<float>, namespace string"


def read_vectors(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """The vector store; a namespace reads its partition only."""
    df = spark.read.parquet(path)
    return df.filter(F.col("namespace") == namespace) if namespace else df


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def read_images(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """(path, content, frame_index) of an image folder; the last number of a name is its index."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return df.select("path", "content", F.regexp_extract("path", r"(\d+)[^\d/]*$", 1).try_cast("long").alias("frame_index"))


def kept_ids(rows: DataFrame, key: str, duration: str | None = None) -> DataFrame:
    """Distinct ids of a Parquet scan that reads two columns; the predicate is pushed to it."""
    return (rows.filter(F.col("duration") == duration) if duration else rows).select(key).distinct()


def indexed_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of a file that holds one JSON array, with their position, for selection by a manifest."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("pos", "r")).select("pos", "r.*")


def units_with(spark: SparkSession, root: str, name: str = "10sec.json") -> DataFrame:
    """(unit_id, path) of the folders under root that hold a file of this name; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    return df.select(F.regexp_extract("path", rf"([^/]+)/{name}$", 1).alias("unit_id"), "path").orderBy("unit_id")


def resolved_videos(wanted: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """wanted (name) with the path of its video: by relative key without suffix, else by stem (smallest path wins)."""
    key = F.regexp_replace(F.regexp_replace("path", rf"^{root}/?" if root else "^$", ""), r"\.[^./]+$", "")
    stem = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    by_key = files.groupBy(key.alias("_key")).agg(F.min("path").alias("_p1"))
    by_stem = files.groupBy(stem(key).alias("_stem")).agg(F.min("path").alias("_p2"))
    bare = F.regexp_replace("name", r"\.[^./]+$", "")
    x = wanted.withColumn("_key", bare).withColumn("_stem", stem(bare)).join(by_key, "_key", "left").join(by_stem, "_stem", "left")
    return x.withColumn("path", F.coalesce("_p1", "_p2")).drop("_key", "_stem", "_p1", "_p2")


def frame_times(start: Column, end: Column, duration: Column, fps: float, most: int) -> Column:
    """Seconds at which frames are read: at fps within the clamped range, spread evenly down to most, ends kept."""
    a, b = F.greatest(F.lit(0.0), F.least(start, duration)), F.greatest(F.lit(0.0), F.least(end, duration))
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.floor((b - a) * fps).cast("int") + 1))
    return F.when(b > a, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, a).otherwise(a + (b - a) * i / (n - 1))))


def segment_seconds(start: Column, end: Column, step: float) -> Column:
    """start, start + step, … below end; start alone where the segment is shorter."""
    n = F.greatest(F.ceil((end - start) / step).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * F.lit(step))


def frame_indices(total: Column, native_fps: Column, fps: float, most: int) -> Column:
    """Distinct frame numbers at fps, at most most of them, the first and the last always."""
    n = F.greatest(F.lit(2), F.least(F.lit(most), F.floor(total / native_fps * fps).cast("int")))
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * (total - 1) / (n - 1)).cast("long"))
    return F.when(total <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(spread))


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, on whatever file system path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def parse_config(text: str) -> dict:
    """Dataset configuration from YAML, or JSON where no YAML library is installed."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def read_config(spark: SparkSession, path: str) -> dict:
    return parse_config(spark.read.text(path, wholetext=True).first().value)
