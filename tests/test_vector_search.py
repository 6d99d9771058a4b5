"""The neighbour graph and the projected self-join against exact searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import graph_index, similarity_lsh
from mnemospark.operators.vector_index import recall
from mnemospark.session import written


def _frame(spark, x, ids=None):
    rows = [(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "key_id long, vector array<double>")


def _graph(keys, **kind):
    c, nodes = graph_index.build(keys, **kind)
    return c, written(nodes, "nodes")


def test_graph_finds_nine_of_ten_with_a_tenth_of_the_vectors(spark):
    x = np.random.default_rng(0).standard_normal((12_000, 64))  # the hardest case: no structure at all
    keys = _frame(spark, x)
    asks = keys.filter("key_id % 100 = 0").withColumnRenamed("key_id", "query_id")
    index = _graph(keys)
    assert index[1].select(F.explode("key_ids")).distinct().count() == len(x)
    found = written(graph_index.search(index, asks, 10, skip_self=True), "found")
    assert recall(found, asks, keys, 10, skip_self=True) >= 0.9
    assert found.groupBy("query_id").agg(F.first("compared").alias("n")).agg(F.avg("n")).first()[0] <= 0.1 * len(x)


def test_graph_of_several_shards_and_blocks(spark):
    x = np.random.default_rng(1).standard_normal((1500, 16))
    keys = _frame(spark, x)
    asks = keys.filter("key_id % 20 = 0").withColumnRenamed("key_id", "query_id")
    index = _graph(keys, shard_rows=300)
    assert index[1].select("shard").distinct().count() >= 5
    found = graph_index.search(index, asks, 5, query_block=30, skip_self=True)
    assert found.groupBy("query_id").count().filter("count <> 5").isEmpty()
    assert recall(found, asks, keys, 5, skip_self=True) >= 0.95


def test_graph_of_copies_and_few_rows(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.standard_normal(8), (400, 1)), rng.standard_normal((30, 8)), np.zeros((2, 8))])
    keys = _frame(spark, x)
    asks = keys.filter("key_id in (0, 399, 405, 431)").withColumnRenamed("key_id", "query_id")
    found = graph_index.search(_graph(keys, shard_rows=250), asks, 6, skip_self=True)
    got = {(r.query_id, r["rank"]): (r.key_id, r.score) for r in found.collect()}
    assert [got[0, k][0] for k in range(1, 7)] == [1, 2, 3, 4, 5, 6] and got[399, 1] == (0, 1.0)
    assert got[405, 1][1] <= 1.0 and got[431, 1][1] == 0.0
    one = _frame(spark, x[:1])
    assert [r.key_id for r in graph_index.search(_graph(one), one.withColumnRenamed("key_id", "query_id"), 3).collect()] == [0]
    none = one.limit(0)
    assert graph_index.search(_graph(none), one.withColumnRenamed("key_id", "query_id"), 3).collect() == []


def _clustered(n, width=32, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((max(1, n // 3), width))
    x = base[rng.integers(0, len(base), n)] + 0.12 * rng.standard_normal((n, width))
    return x, [(a, b) for a, b in zip(*np.nonzero(np.triu(np.round(_cos(x), 6) >= 0.9, 1)))]


def _cos(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def _rows(spark, x):
    return written(_frame(spark, x).withColumnRenamed("key_id", "id"), "rows")


def test_self_join_finds_the_pairs(spark):
    x, want = _clustered(1500)
    got = {(r.a, r.b) for r in similarity_lsh.similar_pairs(_rows(spark, x), 0.9, recall=0.99).collect()}
    assert got <= set(want) and len(got) >= 0.97 * len(want) > 500


def test_self_join_splits_hot_buckets(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(16) + 0.01 * rng.standard_normal((400, 16)), rng.standard_normal((200, 16))])
    want = set(zip(*map(lambda v: v.tolist(), np.nonzero(np.triu(np.round(_cos(x), 6) >= 0.9, 1)))))
    got = {(r.a, r.b) for r in similarity_lsh.similar_pairs(_rows(spark, x), 0.9, recall=0.999, hot=60).collect()}
    assert len(want) > 70_000 and got <= want and len(got) >= 0.995 * len(want)


def test_candidates_grow_with_the_rows(spark):
    n = {}
    for size in (2000, 8000):
        rows = _rows(spark, np.random.default_rng(size).standard_normal((size, 32)))
        n[size] = similarity_lsh.candidates(rows, 0.9, recall=0.95).count()
    assert n[8000] < 10 * n[2000] and n[8000] < 0.1 * 8000 * 7999 / 2  # all pairs are 16 times as many; measured: 8.1 times, 5 % of them


def test_classes_top_k_and_no_rows(spark):
    rows = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.1])], "id long, vector array<double>")
    cls = similarity_lsh.classes(rows)
    assert sorted((r.class_id, r.members) for r in cls.collect()) == [(2, 2), (4, 1)]
    distinct = written(cls.select(F.col("class_id").alias("id"), "vector"), "classes")
    assert sorted((r.src, r.dst) for r in similarity_lsh.similar_top_k(distinct, 0.9, 1, recall=0.9999).collect()) == [(2, 4), (4, 2)]
    assert similarity_lsh.similar_pairs(distinct.limit(0), 0.9).collect() == []


@pytest.mark.parametrize("rows,least", [(100, 0.8), (10**9, 0.9), (2, 1.0)])
def test_plan_of_bands(rows, least):
    bits, bands = similarity_lsh.plan(rows, least, 0.95)
    assert similarity_lsh.PROBES <= bits <= 30 and 1 <= bands <= 400
