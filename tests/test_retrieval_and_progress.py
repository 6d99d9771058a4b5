"""Late interaction, fuzzy matches, progress and keyed consolidation against plain versions."""

import datetime
import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import progress
from mnemospark.operators.fuzzy import nearest_texts
from mnemospark.operators.late_interaction import late_top_k
from mnemospark.streaming import consolidate, streams


def test_late_interaction_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    topics = rng.standard_normal((12, 8))
    rows = [(k, [(topics[rng.integers(12)] + 0.2 * rng.standard_normal(8)).tolist() for _ in range(rng.integers(1, 6))]) for k in range(400)] + [(400, []), (401, None)]
    keys = spark.createDataFrame(rows, "key_id long, vectors array<array<double>>")
    asks = keys.filter("key_id % 20 = 0").withColumnRenamed("key_id", "query_id")
    found = late_top_k(asks, keys, 7, query_block=6, key_block=60, skip_self=True).collect()
    got = {(r.query_id, r["rank"]): (r.key_id, r.score) for r in found}
    whole = {k: np.array(v) for k, v in rows if v}
    for q in range(0, 400, 20):
        scores = sorted((-round(float((whole[q] @ whole[k].T).max(axis=1).sum()), 6), k) for k in whole if k != q)[:7]
        assert [got[q, i + 1] for i in range(7)] == [(k, -s) for s, k in scores]
    scored = {r.query_id: r.scored for r in found}
    assert len(scored) == 20 and all(n <= 399 for n in scored.values())


def test_bounds_leave_rows_unscored(spark):
    rng = np.random.default_rng(1)
    topics = rng.standard_normal((40, 16)) * 3
    rows = [(k, [(topics[k % 40] + 0.05 * rng.standard_normal(16)).tolist() for _ in range(3)]) for k in range(6000)]
    keys = spark.createDataFrame(rows, "key_id long, vectors array<array<double>>")
    found = late_top_k(keys.filter("key_id < 30").withColumnRenamed("key_id", "query_id"), keys, 5)
    assert found.groupBy("query_id").agg(F.first("scored").alias("n")).agg(F.avg("n")).first()[0] < 0.35 * 6000


def test_fuzzy_matches_equal_difflib(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcde ()é") for _ in range(n))
    keys = sorted({word(rng.randrange(0, 14)) for _ in range(300)} | {"x" * 250, "abc", "acb"})
    asks = [word(rng.randrange(0, 14)) for _ in range(60)] + ["", "zzz", "abc", "x" * 240 + "y"]
    df = lambda rows: spark.createDataFrame([(r,) for r in rows], "text string")
    got = {r.text: r for r in nearest_texts(df([*asks, None, asks[0]]), df([*keys, None, keys[0]]), ask_block=20, block=70).collect()}
    assert set(got) == set(asks)
    for a in asks:
        assert got[a].found == difflib.get_close_matches(a, keys, n=1, cutoff=0.0)[0]
    assert sum(r.tried for r in got.values()) < 0.6 * len(got) * len(keys)
    assert nearest_texts(df(asks), df([])).collect() == []


def test_progress_of_a_batch_and_a_stream(spark, tmp_path):
    told = []
    p = progress.Progress(lambda stage, seen: told.append((stage, seen)))
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, t string")
    p.stage(p.stage(rows, "in", F.col("t") == "").filter("t IS NOT NULL"), "out").write.mode("overwrite").parquet(str(tmp_path / "o"))
    p.report()
    assert told == [("in", {"rows": 3, "nulls_k": 0, "nulls_t": 1, "failures": 1}), ("out", {"rows": 2, "nulls_k": 0, "nulls_t": 0})]

    heard = []
    stop = progress.listen(spark, ["arrivals"], lambda stage, seen: heard.append((stage, seen)))
    for part in range(2):
        rows.limit(part + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = progress.stream_stage(streams.folder(spark, str(tmp_path / "in"), "k int, t string"), "arrivals")
        streams.appended(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    import time

    for _ in range(100):
        if len(heard) >= 2:
            break
        time.sleep(0.1)
    stop()
    assert [(s, x["rows"], x["batch"]) for s, x in heard if x["rows"]] == [("arrivals", 1, 0), ("arrivals", 2, 1)]


def test_slices_of_a_topic():
    fact = lambda k, s="s", e=(): {"triple_id": k, "s": s, "p": "p", "o": "o", "evidence": list(e)}
    keep = lambda new, known: (new, [])
    known, added, removed = consolidate.apply_slice([], [fact(2), fact(1)], lambda *a: pytest.fail("nothing is known yet"))
    assert [f["triple_id"] for f in known] == [1, 2] and added == known and removed == []
    assert consolidate.apply_slice(known, [fact(3)], keep)[2] == []
    same = [fact(1, "a", ["e2"]), fact(2, "a", ["e1"]), fact(3, "b", ["e3"])]  # two copies of one value go together
    known, added, removed = consolidate.apply_slice(same, [fact(4, "n", ["e1", "e9"]), fact(5, "m")], lambda new, k: ({**new, "p": "now"}, [1, 77]))
    assert [f["triple_id"] for f in removed] == [1, 2] and [f["triple_id"] for f in known] == [3, 4, 5]
    assert [f["evidence"] for f in added] == [["e1", "e9", "e2"], ["e1", "e2"]] and all(f["p"] == "now" for f in added)


def test_a_slice_waits_until_it_is_complete(spark, tmp_path):
    kind = "topic string, ts timestamp, " + consolidate.FACT
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    arrivals = [[("a", day(1), 1, "x", "p", "o", ["e1"]), ("b", day(2), 9, "z", "p", "o", [])], [("a", day(3), 3, "w", "p", "o", []), ("a", day(4), 4, "v", "p", "o", ["e4"])], [("a", day(3), 5, "late", "p", "o", [])]]
    for rows in arrivals:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.folder(spark, str(tmp_path / "in"), kind)
        consolidate.consolidate(stream, str(tmp_path / "out"), str(tmp_path / "mark"), lambda new, known: (new, [known[-1]["triple_id"]])).awaitTermination()
    log = spark.read.schema(consolidate.LOG).parquet(str(tmp_path / "out"))
    got = sorted((r.ts.day, r.added, r.triple_id, tuple(r.evidence)) for r in log.collect())
    assert got == [(2, True, 1, ("e1",)), (3, True, 9, ()), (4, False, 1, ("e1",)), (4, True, 3, ("e1",)), (5, False, 3, ("e1",)), (5, True, 4, ("e4", "e1"))]
    held = consolidate.snapshots(log, log.select("ts"))
    assert sorted((r.ts.day, r.triple_id) for r in held.collect()) == [(2, 1), (3, 1), (3, 9), (4, 3), (4, 9), (5, 4), (5, 9)]
