"""Segmented prefix counts and interleaves against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import mixing, windows
from mnemospark.operators.segmented import prefix


def _rows(seed=3, n=4000):
    rng = random.Random(seed)  # one group holds half of the rows; some keys and values are null
    return [(rng.choice(["hot", "hot", "a", "b", None, f"g{rng.randrange(40)}"]), k % 997, rng.choice([None, 1, 2, 3]), k) for k in range(n)]


def test_prefix_against_a_walk(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, k int, v int, id int").repartition(7)
    got = prefix(df, ["g"], ["k", "id"], {"upto": F.col("v")}, size="n", rows=300)
    assert got.columns == ["g", "k", "v", "id", "position", "upto", "n"]
    have = {r.id: (r.position, r.upto, r.n) for r in got.collect()}
    assert len(have) == len(rows)
    for g in {r[0] for r in rows}:
        total, mine = None, sorted(((r[1], r[3], r[2]) for r in rows if r[0] == g))
        for place, (_, k, v) in enumerate(mine):
            total = total if v is None else (total or 0) + v
            assert have[k] == (place, total, len(mine))


def test_a_hot_group_is_many_tasks_and_one_group_works(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), "id").repartition(8)
    got = prefix(df, ["g"], [F.desc("id")], rows=500)
    assert got.agg(F.min(F.col("position") + F.col("id")), F.max(F.col("position") + F.col("id"))).first() == (4999, 4999)
    assert "GlobalLimit" not in got._jdf.queryExecution().toString()
    whole = prefix(df, [], ["id"], rows=700).filter(F.col("position") != F.col("id"))
    assert whole.count() == 0


def test_repeated_rows_and_empty_tables(spark):
    same = spark.range(1000).select(F.lit("x").alias("g"), F.lit(1).alias("k"))
    assert sorted(r.position for r in prefix(same, ["g"], ["k"], rows=100).collect()) == list(range(1000))
    assert prefix(same.limit(0), ["g"], ["k"], {"s": F.col("k")}, size="n").collect() == []


def test_group_samples_hold_over_ranges(spark, monkeypatch):
    from mnemospark.operators import segmented

    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), "id").repartition(5)
    plain = {f.__name__: sorted(map(tuple, f(df, ["id"], x, ["g"]).collect())) for f, x in ((windows.linspace_sample, 8), (windows.proportional_sample, 0.07))}
    monkeypatch.setattr(segmented.prefix, "__defaults__", (None, None, "position", 250, 10_000))
    for f, x in ((windows.linspace_sample, 8), (windows.proportional_sample, 0.07)):
        assert sorted(map(tuple, f(df, ["id"], x, ["g"]).collect())) == plain[f.__name__]
    got = {(r.g, r.id): r.group_no for r in windows.every_n(df, "id", 10, ["g"]).collect()}
    assert all(got[int(k % 3 == 0), k] == (k // 3 // 10 if k % 3 == 0 else (k - k // 3 - 1) // 10) for k in range(3000))


def _walk(sizes, seats, stop):
    """The stream one row at a time: a source that ends begins again, until any or all have ended."""
    at, ended, out = [0] * len(sizes), [False] * len(sizes), []
    for pos, s in enumerate(seats):
        if at[s] < sizes[s] or sizes[s]:
            out.append((pos, s, at[s] % sizes[s], at[s] // sizes[s]))
            at[s] += 1
            ended[s] = ended[s] or at[s] % sizes[s] == 0
        else:
            ended[s] = True
        if (all if stop == "all_exhausted" else any)(ended):
            return out
    raise AssertionError("not long enough")


@pytest.mark.parametrize("stop", ["first_exhausted", "all_exhausted"])
@pytest.mark.parametrize("weights,batch", [(None, 1), ([0.6, 0.3, 0.1], 1), ([0.6, 0.3, 0.1], 4)])
def test_interleave_against_a_walk(spark, stop, weights, batch):
    names, sizes = ["a", "b", "c"], [40, 7, 1]
    df = spark.createDataFrame([(n, k) for n, size in zip(names, sizes) for k in range(size)], "source string, k int")
    got = mixing.interleave(df, "source", ["k"], names, weights, stop, seed=5, batch=batch)
    have = sorted((r.position, names.index(r.source), r.k, r.repeat) for r in got.collect())
    if weights is None:
        seats = [k % 3 for k in range(2000)]
    else:
        seats = [r[0] for r in spark.range(20_000).orderBy("id").select(mixing.drawn_seat(F.col("id"), weights, 5, batch)).collect()]
        share = [seats.count(k) / len(seats) for k in range(3)]
        assert all(abs(a - b) < 0.03 for a, b in zip(share, weights))
        assert all(len(set(seats[k : k + batch])) == 1 for k in range(0, 400, batch))
    assert have == _walk(sizes, seats, stop)


def test_interleave_refuses_and_skips(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "source string, k int")
    got = mixing.interleave(df, "source", ["k"], ["a", "gone"], None, "all_exhausted")
    assert [(r.position, r.k) for r in got.orderBy("position").collect()] == [(0, 1), (2, 2)]
    for bad in (dict(weights=[1.0]), dict(weights=[1.0, 0.0], stop="all_exhausted"), dict(stop="never")):
        with pytest.raises(ValueError):
            mixing.interleave(df, "source", ["k"], ["a", "b"], **bad)
