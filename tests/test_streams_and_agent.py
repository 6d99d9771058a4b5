"""Streams to completion, and the agent's rounds."""

from pyspark.sql import functions as F

from mnemospark.functions.providers import AgentGenerator, HashEmbedder, embed_column
from mnemospark.plans.agent import Memories, answer
from mnemospark.streaming import streams


def test_store_grows_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "store", "cp"))
    put = lambda rows: spark.createDataFrame(rows, "hash_id string, content string").coalesce(1).write.mode("append").parquet(src)
    embed = lambda d: d.withColumn("embedding", F.array(F.lit(1.0)))
    put([("a", "x"), ("a", "x"), ("b", "y")])
    for _ in range(2):
        streams.upsert_store(streams.folder(spark, src, "hash_id string, content string"), out, embed, cp).awaitTermination()
        put([("b", "y"), ("c", "z")])
    assert sorted(r.hash_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_last_record_and_append(spark, tmp_path):
    src = str(tmp_path / "log")
    spark.createDataFrame([("1", 1, "error"), ("1", 2, "success"), ("2", 3, "error")], "ID string, seq int, status string").write.json(src)
    stream = streams.folder(spark, src, "ID string, seq int, status string", "json")
    q = streams.latest_records(stream, "ID", "seq").writeStream.outputMode("complete").format("memory").queryName("latest_records").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.ID, r.record.status) for r in spark.table("latest_records").collect()) == [("1", "success"), ("2", "error")]
    out = str(tmp_path / "out")
    for _ in range(2):
        streams.appended(stream, out, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_windows_and_sessions(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    src = str(tmp_path / "ev")
    e.coalesce(2).write.parquet(src)
    stream = streams.folder(spark, src, "event_id long, ts timestamp, user_id long, event_type string, value double")
    for name, make in (("w_counts", lambda d: streams.windowed_counts(d, "1 hour")), ("s_counts", lambda d: streams.sessions(d, "30 minutes"))):
        q = make(stream).writeStream.outputMode("complete" if name == "w_counts" else "append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("w_counts").agg(F.sum("n")).first()[0] == e.count()
    batch = streams.sessions(e, "30 minutes")
    assert batch.agg(F.sum("n")).first()[0] == e.count()


def test_agent_sees_neither_the_future_nor_the_same_twice(spark):
    emb = HashEmbedder()
    items = spark.createDataFrame([(k, f"cup number {k} on the table", k) for k in range(12)], "item_id long, content string, ts long")
    items = items.join(embed_column(items, "item_id", "content", emb), "item_id")

    class Again(AgentGenerator):
        ORDER = ("episodic", "episodic", "semantic")

    m = Memories().register("episodic", items).register("semantic", items)
    q = spark.createDataFrame([(1, "cup on the table", 7), (2, "cup number 3", 2)], "question_id long, question string, as_of_ts long")
    got = {r.question_id: r for r in answer(q, m, emb, Again()).collect()}
    assert got[1].num_rounds == 3 and got[2].num_rounds == 3
    episodic = [x.item_id for x in got[1].retrieved if x.memory_type == "episodic"]
    assert len(episodic) == len(set(episodic)) == 6 and all(int(x) <= 7 for x in episodic)
    assert {int(x.item_id) for x in got[2].retrieved} <= {0, 1, 2} and got[1].context.count("\n\n") == len(got[1].retrieved) - 1
