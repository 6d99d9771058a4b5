"""The versioned store and the incremental graph against dictionaries and rebuilds."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import graph
from mnemospark.operators.graph_delta import IncrementalGraph
from mnemospark.session import shared_dir
from mnemospark.sources.versioned import Conflict, VectorStore, VersionedTable
from mnemospark.streaming import streams


@pytest.fixture
def root(spark):
    return f"{shared_dir(spark)}/versioned-{uuid.uuid4().hex}"


def _put(spark, rows):
    return spark.createDataFrame(rows, "k string, v long")


def _all(df):
    return {r.k: r.v for r in df.collect()}


def test_changes_against_a_dictionary(spark, root):
    rng, want, seen = random.Random(1), {}, []
    t = VersionedTable(spark, root, "k string, v long", ["k"])
    assert t.read().collect() == [] and t.versions() == []
    for step in range(6):
        keys = [f"k{rng.randrange(30):02d}" for _ in range(12)]
        if step % 3 == 2:
            t.delete(_put(spark, [(k, 0) for k in keys]))
            want = {k: v for k, v in want.items() if k not in keys}
        else:
            rows = {k: rng.randrange(100) for k in keys}
            t.append(_put(spark, list(rows.items())))
            want = want | rows
        seen.append(dict(want))
        assert _all(t.read()) == want
        if step == 3:
            t.compact(most=2)
            assert _all(t.read()) == want
            seen.append(dict(want))
    assert t.versions() == list(range(1, len(seen) + 1))
    assert [_all(t.read(v)) for v in t.versions()] == seen  # every version stays as it was
    some = list(want)[:3] + ["nowhere"]
    assert _all(t.look_up(some)) == {k: want[k] for k in some[:3]} == _all(t.of_keys(_put(spark, [(k, 0) for k in some])))
    t.compact()
    assert len(t.manifest()["segments"]) == 1 and t.vacuum() > 0 and _all(t.read()) == want and len(t.versions()) == 1


def test_a_write_that_dies_is_not_seen(spark, root, monkeypatch):
    t = VersionedTable(spark, root, "k string, v long", ["k"])
    t.append(_put(spark, [("a", 1)]))

    def dies(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(t, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        t.append(_put(spark, [("a", 2), ("b", 3)]))
    again = VersionedTable(spark, root, "k string, v long", ["k"])
    assert _all(again.read()) == {"a": 1} and again.vacuum(keep=9) == 1
    assert again.append(_put(spark, [("b", 3)])) == 2 and _all(again.read()) == {"a": 1, "b": 3}


def test_the_second_of_two_writers_starts_again(spark, root):
    one = VersionedTable(spark, root, "k string, v long", ["k"])
    base = one.manifest()
    VersionedTable(spark, root, "k string, v long", ["k"]).append(_put(spark, [("a", 1)]))
    with pytest.raises(Conflict):
        one._commit(base, [], {})
    one.append(_put(spark, [("b", 2)]))
    assert _all(one.read()) == {"a": 1, "b": 2}


def test_marks_ranges_and_nothing_to_do(spark, root):
    t = VersionedTable(spark, root, "k string, v long", ["k"])
    assert t.append(_put(spark, [("a", 1), ("c", 1)]), mark=("s", 0)) == 1
    assert t.append(_put(spark, [("a", 9)]), mark=("s", 0)) == 1  # ran before
    assert t.append(_put(spark, [("x", 1), ("z", 1)]), mark=("s", 1)) == 2
    assert t.append(_put(spark, [("a", 9)]).limit(0)) == 2  # no rows, no version
    assert [len(t.touching([k])) for k in ("b", "y", "d")] == [1, 1, 0]
    plan = t.look_up(["x"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(k, [x])]" in plan or "EqualTo(k,x)" in plan


def test_counts_add_up_and_zeros_go(spark, root):
    t = VersionedTable(spark, root, "k string, v long", ["k"], "sum")
    t.append(_put(spark, [("a", 2), ("a", 1), ("b", 1), ("c", 1), ("c", -1)]))
    t.append(_put(spark, [("a", -1), ("b", -1), (None, 4)]))
    assert _all(t.read()) == {"a": 2, None: 4}
    t.compact()
    assert _all(t.read()) == {"a": 2, None: 4} and t.manifest()["segments"][0]["rows"] == 2
    with pytest.raises(ValueError):
        t.delete(_put(spark, [("a", 0)]))


def test_known_texts_are_not_embedded_again(spark, root):
    store, calls = VectorStore(spark, root), []

    def embed(df):
        calls.append(sorted(r.hash_id for r in df.collect()))
        return df.withColumn("embedding", F.array(F.length("content").cast("double")))

    texts = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "hash_id string, content string")
    store.insert(texts("a", "b", "a"), embed)
    store.insert(texts("b", "c"), embed)
    store.delete(texts("a"))
    store.insert(texts("a"), embed)
    store.replace(spark.createDataFrame([("b", "new", [9.0])], VectorStore.SCHEMA))
    assert calls == [["a", "b"], ["c"], ["a"]]
    assert {r.hash_id: (r.content, r.embedding) for r in store.read().collect()} == {"a": ("text a", [6.0]), "b": ("new", [9.0]), "c": ("text c", [6.0])}
    assert [r.content for r in store.rows(["c"]).collect()] == ["text c"]


def test_a_stream_of_changes_and_a_restart(spark, root):
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0)))
    kind = "hash_id string, content string, gone boolean"
    for rows in ([("a", "x", False), ("b", "y", False)], [("a", None, True), ("c", "z", False)], [("a", "x", False), ("b", None, True)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{root}/in")
        streams.maintain_store(streams.folder(spark, f"{root}/in", kind), f"{root}/store", embed, f"{root}/mark").awaitTermination()
    store = VectorStore(spark, f"{root}/store")
    assert {r.hash_id for r in store.read().collect()} == {"a", "c"}
    versions = store.table.versions()
    streams.maintain_store(streams.folder(spark, f"{root}/in", kind), f"{root}/store", embed, f"{root}/mark").awaitTermination()
    assert store.table.versions() == versions


def _facts(spark, rows):
    return spark.createDataFrame(rows, "chunk string, s string, p string, o string")


def test_graph_equals_a_rebuild_after_every_change(spark, root):
    rng = random.Random(4)
    chunks = {f"c{k}": [tuple(rng.choice("abcdefg") for _ in range(3)) for _ in range(rng.randrange(1, 5))] for k in range(25)}
    g, here = IncrementalGraph(spark, root), set()
    for step in range(5):
        some = rng.sample(sorted(chunks), 8)
        rows = _facts(spark, [(c, *f) for c in some for f in chunks[c]])
        if step in (2, 3):
            before = {e for c in here for f in chunks[c] for e in (f[0], f[2])}
            lost = {r.entity for r in g.delete(rows.select("chunk")).collect()}
            here -= set(some)
            assert lost == before - {e for c in here for f in chunks[c] for e in (f[0], f[2])}
        else:
            g.add(rows)
            here |= set(some)
        if step == 3:
            g.compact(most=1)
        now = _facts(spark, [(c, *f) for c in here for f in chunks[c]])
        assert sorted(map(tuple, g.weights().collect())) == sorted(map(tuple, graph.fact_edges(now).select("src", "dst", "weight").collect()))
        assert {(r.entity, r.chunk) for r in g.postings.read().collect()} == {(r.entity, r.chunk) for r in graph.passage_edges(now).collect()}
        assert g.triples.read().count() == now.select("s", "p", "o").distinct().count()


def test_a_change_costs_its_own_facts(spark, root):
    g = IncrementalGraph(spark, root)
    g.add(_facts(spark, [(f"c{k}", f"s{k}", "p", "o") for k in range(500)]), mark=("load", 0))
    g.delete(spark.createDataFrame([("c7",)], "chunk string"), mark=("load", 1))
    g.delete(spark.createDataFrame([("c7",)], "chunk string"), mark=("load", 1))
    assert [[s["rows"] for s in t.manifest()["segments"]] for t in (g.facts, g.edges, g.triples)] == [[500, 1], [1000, 2], [500, 1]]
    assert g.weights().count() == 998
