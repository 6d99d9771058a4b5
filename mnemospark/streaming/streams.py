"""Streams over append-only folders: high-water marks, last record wins, incremental upserts, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemospark.operators.store import missing
from mnemospark.sources.versioned import VectorStore


def folder(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the files that arrive in path; the checkpoint of a query is its high-water mark."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def latest_records(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Running last record of each key (update mode); state is one row a key."""
    return log.groupBy(key).agg(F.max_by(F.struct("*"), F.col(seq)).alias("record"))


def upsert_store(incoming: DataFrame, store_path: str, embed, checkpoint: str) -> StreamingQuery:
    """Adds rows (hash_id, content) that the Parquet store lacks; a batch that runs again adds nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates(["hash_id"])
        try:
            new = missing(new, spark.read.parquet(store_path))
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        embed(new).write.mode("append").parquet(store_path)

    return incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_store(changes: DataFrame, store_path: str, embed, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Keeps a VectorStore after a stream of changes (hash_id, content, gone): gone ids are deleted, others inserted.

    The number of the batch is a mark of the version it makes, so a batch that runs again after a restart changes nothing. In one batch
    the deletion of an id comes before its insertion.
    """

    def batch(df: DataFrame, number: int) -> None:
        store = VectorStore(df.sparkSession, store_path)
        store.delete(df.filter("gone").select("hash_id"), mark=(f"{name}-delete", number))
        store.insert(df.filter("NOT gone"), embed, mark=(f"{name}-insert", number))
        store.table.compact(most=8)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums for each event type and window; rows later than the watermark are dropped by it."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("w_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: begin, end, number of events."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def appended(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """An exactly-once file sink of everything that has arrived."""
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
