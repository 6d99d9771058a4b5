"""Inputs on which queries failed, differed or did too much work before."""

import datetime
import difflib
import json

import duckdb
import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemospark import session
from mnemospark.llm import html_text
from mnemospark.operators import fuzzy, graph, graph_hubs, graph_index, postings, similarity
from mnemospark.plans import registry
from mnemospark.sources import json_ranges
from mnemospark.streaming import consolidate


def _copy(sf, tmp_path, **changed):
    """A folder of tables: those named are made by SQL over the small ones, the others are as they are."""
    con = duckdb.connect()
    for t in ("customer", "supplier", "nation", "region", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for t in ("customer", "supplier", "nation", "region", "documents", "embeddings"):
        con.execute(f"copy ({changed.get(t, f'from {t}')}) to '{tmp_path}/{t}.parquet'")
    return str(tmp_path)


def _same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "nation", "region", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = registry.queries()[name](spark, folder)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    plain = lambda v: round(v, 7) + 0.0 if isinstance(v, float) else v
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == want


def test_an_entity_of_many_chunks_is_one_row(spark, sf, tmp_path):
    """A nation in more than 4096 chunks came as several rows, each with a part of its chunks."""
    folder = _copy(sf, tmp_path, customer="select * replace (i * 100 as c_custkey) from (from customer limit 1), range(5000) r(i)")
    _same_as_sql(spark, folder, "entity_chunk_sets")
    _same_as_sql(spark, folder, "fact_documents")


def test_blocks_meet_in_order(spark):
    rows = [("k", f"i{i:03d}") for i in range(100)] + [("l", "x")]
    blocks = postings.postings(spark.createDataFrame(rows, "key string, item string"), ["key"], "item", block=7)
    got = {r.key: (r.n, r["items"]) for r in postings.whole(blocks, ["key"]).collect()}
    assert got == {"k": (100, [f"i{i:03d}" for i in range(100)]), "l": (1, ["x"])}


def _unit_scores(asks, keys):
    u = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(u(asks) @ u(keys).T, 6)


def test_equal_vectors_meet_as_one_class(spark):
    """Half a slice of facts about one topic compared itself with half of all known ones, pair by pair."""
    rng = np.random.default_rng(1)
    v = rng.integers(-1, 2, (300, 3)).astype(float)
    v[(v == 0).all(axis=1)] = 1.0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    held = similarity.classes(df, 4).collect()
    assert len(held) == len(np.unique(v, axis=0)) and max(len(r.members) for r in held) == 4
    s = _unit_scores(v, v)
    for skip in (False, True):
        got = similarity.top_k_join(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "key_id"), 7, 0.3, query_block=9, key_block=4, skip_self=skip).collect()
        want = set()
        for q in range(300):
            best = [k for k in np.lexsort((np.arange(300), -s[q])) if s[q, k] >= 0.3 and not (skip and k == q)][:7]
            want |= {(q, int(k), r + 1) for r, k in enumerate(best)}
        assert {(r.query_id, r.key_id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_wanted_ranks_are_the_first_ones(spark):
    v = np.random.default_rng(2).normal(size=(90, 6))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    ask, key = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "key_id")
    whole = {(r.query_id, r.key_id) for r in similarity.top_k_join(ask, key, 50, 0.1, skip_self=True).filter("rank <= 5").collect()}
    assert {(r.query_id, r.key_id) for r in similarity.top_k_join(ask, key, 50, 0.1, skip_self=True, wanted=5).collect()} == whole


def test_graph_hits_are_completed(spark):
    """What the beams miss is found by the scores that they reached; a query with too few hits has no floor."""
    v = np.random.default_rng(3).normal(size=(200, 8))
    keys = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "key_id long, vector array<double>")
    asks = keys.filter("key_id % 20 = 0").withColumnRenamed("key_id", "query_id")
    s = _unit_scores(v, v)
    np.fill_diagonal(s, -9)
    order = {q: np.lexsort((np.arange(200), -s[q])).tolist() for q in range(0, 200, 20)}
    bad = [(q, k, float(s[q, k])) for q in order for k in (order[q][3:9] if q else order[q][:2])]  # three of the best are missing, or nearly all
    found = spark.createDataFrame(bad, "query_id long, key_id long, score double")
    got = graph_index.completed(found, asks, keys, 6, skip_self=True).collect()
    assert {(r.query_id, r.key_id, r["rank"]) for r in got} == {(q, k, n + 1) for q in order for n, k in enumerate(order[q][:6])}


def test_twins_share_their_ranks(spark, sf, tmp_path):
    """Every leaf of a hub had its own row in every round and question."""
    edges = [("h", f"a{i}", 1.0) for i in range(30)] + [("h", "g", 2.0)] + [("g", f"b{i}", 1.0) for i in range(20)] + [("g", "a7", 1.0), ("h", "b3", 3.0), ("x", "y", 1.0)]
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    seeds = [("q", "a0", 1.0), ("q", "h", 0.5), ("r", "b4", 1.0), ("r", "none", 1.0), ("s", "x", 1.0)]
    reset = spark.createDataFrame(seeds, "query_id string, id string, weight double")
    r = graph.ranks_by_class(e, reset, 0.85, 6)
    classes = {(x["class"], x["size"]) for x in r.members.collect()}
    assert classes == {("a0", 29), ("b0", 19)} and r.inflow.count() <= 2 * 6 + 2
    names = sorted({v for x in edges for v in x[:2]})
    m = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        m[names.index(a), names.index(b)] += w
        m[names.index(b), names.index(a)] += w
    m /= m.sum(axis=1, keepdims=True)
    want = {}
    for q in "qrs":
        p = {i: w for k, i, w in seeds if k == q}
        p = {i: w / sum(p.values()) for i, w in p.items()}
        v, out = np.array([p.get(n, 0.0) for n in names]), p.get("none", 0.0)
        start = v.copy()
        for _ in range(6):
            v, out = 0.85 * v @ m + start * (0.15 + 0.85 * out), p.get("none", 0.0) * (0.15 + 0.85 * out)
        want |= {(q, n): x for n, x in zip(names, v, strict=True) if x > 0} | ({(q, "none"): out} if out else {})
    got = {(x.query_id, x.id): x["rank"] for x in graph.personalised_pagerank(e, reset, 0.85, 6).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12
    facts = spark.createDataFrame([(a, "p", b) for a, b, _ in edges] + [("a0", "is", "a0"), ("a1", "p", "a2")], "s string, p string, o string")
    found = {(x.query_id, x.s, x.p, x.o, x.score) for x in graph.best_triples(facts, r, 5).collect()}
    rows = {q: sorted((-round(want.get((q, t.s), 0) + want.get((q, t.o), 0), 8), t.s, t.p, t.o) for t in facts.collect() if (q, t.s) in want or (q, t.o) in want)[:5] for q in "qrs"}
    assert found == {(q, s, p, o, -x) for q, best in rows.items() for x, s, p, o in best}


def test_text_that_markup_swallowed():
    """Loose quotes, elements closed in their own tag, end tags left out, and a form around the page hid text of the article."""
    text = lambda page: [t for k, t in html_text.read_page(page).parts if k < 0]
    assert text('<article><p class=x">one</p><p class="y">two</p></article>') == ["one", "two"]
    assert text("<article><p title=it's>one</p><p>it's two</p></article>") == ["one", "it's two"]
    assert text('<article><p title="a > b">one</p></article>') == ["one"]
    assert text('<article><p>one <svg width="1"/> two</p><p>three <svg><path/></svg> four</p></article>') == ["one two", "three four"]
    assert text('<article><iframe src="a"/><p>one</p></article>') == ["one"]
    assert text("<article><script src='a'></script><p>one</p></article>") == ["one"]
    assert text('<article><p class="ad">buy<p>one<p>two</article>') == ["one", "two"]
    assert text('<article><ul><li class="advert">buy<li>one</ul><p>two</article>') == ["one", "two"]
    assert text("<form><nav>menu</nav><article><p>one</p></article><p>name</p></form>") == ["one"]
    assert text("<form><aside><article>one</article></aside></form>") == text("<div class=sidebar><form><article hidden>one</article></form></div>") == []


def test_a_topic_s_rows_reach_its_state_together():
    """Each fact was a call of its own to the state store, and all known facts were written again for each slice."""

    class State(list):
        def __init__(self):
            super().__init__()
            self.calls = []

        def appendList(self, rows):
            self.calls.append("append")
            self.extend(rows)

        def put(self, rows):
            self.calls.append("put")
            self[:] = rows

        def clear(self):
            self[:] = []

        get = lambda self: iter(list(self))

    class Handle:
        def getListState(self, name, kind):
            return State()

        def registerTimer(self, at):
            pass

    expired = lambda at: type("T", (), {"getExpiryTimeInMs": lambda self: at})()
    p = consolidate._Consolidate(lambda new, known: (new, []), 20)
    p.init(Handle())
    day = lambda d: datetime.datetime.fromtimestamp(d)
    rows = [Row(topic="t", ts=day(1 + k % 2), triple_id=k, s=f"s{k}", p="p", o="o", evidence=[f"e{k}"]) for k in range(500)]
    p.handleInputRows(("t",), iter(rows), None)
    assert p.waiting.calls == ["append"]
    first = list(p.handleExpiredTimer(("t",), None, expired(1000)))
    second = list(p.handleExpiredTimer(("t",), None, expired(2000)))
    assert p.known.calls == ["append", "append"] and sorted(r[0] for r in p.known) == list(range(500)) and not p.waiting
    assert {r.triple_id for r in first} == set(range(0, 500, 2)) and {r.triple_id for r in second} == set(range(1, 500, 2))


def test_ranges_of_a_large_file_are_bounded(spark, tmp_path):
    """A range of fixed length made a task for each 100 KB of a file, in each of several passes."""
    rows = [{"k": k, "t": "x" * 190 + '"],[{' * (k % 3)} for k in range(2000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    size = (tmp_path / "a.json").stat().st_size
    assert len(json_ranges.plan_ranges(spark, str(tmp_path / "a.json"), range_bytes=100)) <= 1100 < size / 100
    got = json_ranges.read_array(spark, str(tmp_path / "a.json"), "k long, t string", range_bytes=50_000)
    assert sorted((r.pos, r.k, r.t) for r in got.collect()) == [(r["k"], r["k"], r["t"]) for r in rows]


def test_fuzzy_blocks_do_not_compare_what_others_rule_out(spark):
    """Each block of candidates sought its own best, letter by letter, though another block held a better one."""
    keys = [f"(name#{n:05d}, lives in, {c})" for n in range(0, 2000) for c in ("peru",)] + ["(ab, c)", "(ba, c)"]
    asks = [f"[Name#{n:05d}; lives in;  peru]" for n in range(0, 2000, 100)] + ["zzba", "anem#"]
    df = lambda rows: spark.createDataFrame([(r,) for r in rows], "text string")
    got = {r.text: r for r in fuzzy.nearest_texts(df(asks), df(keys), ask_block=7, block=100).collect()}
    assert {a: got[a].found for a in asks} == {a: difflib.get_close_matches(a, keys, n=1, cutoff=0.0)[0] for a in asks}
    assert sum(got[a].tried for a in asks[:20]) <= 20 * 24  # 21 blocks compared at least one candidate each, most of them many


def test_members_of_a_class_come_from_many_tasks(spark, monkeypatch):
    """All members of a class met its ranks in one task, and each row looked for its seed."""
    monkeypatch.setattr(graph, "ROWS", 1000, raising=False)
    leaves = [f"a{i}" for i in range(6000)]
    e = spark.createDataFrame([("h", a, 1.0) for a in leaves] + [("h", "g", 1.0), ("g", "k", 2.0)], "src string, dst string, weight double")
    reset = spark.createDataFrame([("q", "h", 1.0), ("q", "a5", 1.0), ("r", "h", 2.0), ("s", "a5", 1.0)], "query_id string, id string, weight double")
    r = graph.personalised_pagerank(e, reset, 0.85, 4)
    rows = r.select("*", F.spark_partition_id().alias("task")).collect()
    tasks = [sum(x.task == t for x in rows if x.id in set(leaves)) for t in {x.task for x in rows}]
    assert len(rows) == 3 * 6003 and max(tasks) < 0.4 * len(rows)
    got = {(x.query_id, x.id): x["rank"] for x in rows}
    for q, p in (("q", {"h": 0.5, "a5": 0.5}), ("r", {"h": 1.0}), ("s", {"a5": 1.0})):
        v = dict(p)  # h, g, k, a5 and any other leaf
        for _ in range(4):
            v = {
                "h": 0.85 * (5999 * v.get("a", 0) + v.get("a5", 0) + v.get("g", 0) / 3) + 0.15 * p.get("h", 0),
                "g": 0.85 * (v.get("h", 0) / 6001 + v.get("k", 0)),
                "k": 0.85 * v.get("g", 0) * 2 / 3,
                "a": 0.85 * v.get("h", 0) / 6001,
                "a5": 0.85 * v.get("h", 0) / 6001 + 0.15 * p.get("a5", 0),
            }
        assert all(abs(got[q, k] - v["a" if k == "a7" else k]) < 1e-12 for k in ("h", "g", "k", "a5", "a7"))
    exact = {(x.query_id, x.id): x["rank"] for x in graph.personalised_pagerank(e, reset, 0.85, 4, digits=5).collect()}
    assert exact.keys() == got.keys() and all(abs(exact[k] - got[k]) <= 0.5e-5 + 1e-12 for k in got)


def _power_iteration(edges, reset, damping, rounds):
    """{(query, vertex): rank} row by row; rank on vertices without edges goes back to the reset."""
    weight, out = {}, {}
    for a, b, w in edges:
        for u, v in ((a, b), (b, a)):
            weight[u, v] = weight.get((u, v), 0.0) + w
    total = {}
    for (u, _), w in weight.items():
        total[u] = total.get(u, 0.0) + w
    for q in {q for q, _, _ in reset}:
        p = {}
        for a, v, w in reset:
            if a == q and w is not None and w > 0:
                p[v] = p.get(v, 0.0) + w
        p = {v: w / sum(p.values()) for v, w in p.items()}
        r = dict(p)
        for _ in range(rounds):
            lost = sum(x for v, x in r.items() if v not in total)
            new = {v: (1 - damping + damping * lost) * x for v, x in p.items()}
            for (u, v), w in weight.items():
                if u in r:
                    new[v] = new.get(v, 0.0) + damping * r[u] * w / total[u]
            r = new
        out |= {(q, v): x for v, x in r.items()}
    return out


def test_ranks_through_hubs_are_those_of_power_iteration(spark, monkeypatch):
    """Walks by parts: through hubs, leaves in double steps, vertices without edges, sets in common, components without a hub."""
    edges = [("h", f"c{i}", 1.0 + i % 2) for i in range(9)] + [("g", f"c{i}", 2.0) for i in range(4, 9)] + [(f"c{i}", f"l{i}", 1.0) for i in range(9)] + [(f"l{i}", "h", 1.0) for i in range(5)]
    edges += [("l5", "l6", 1.0), ("g", "h", 0.5), ("x", "y", 1.0), ("y", "z", 3.0), ("c1", "c2", 1.0), ("c1", "c2", 1.0)]
    edges += [(f"w{i}", v, 1.0) for i in range(3) for v in ("h", "g", "c1", "c2", "c3", "v1", "v2")] + [("v1", "v3", 1.0), ("v2", "v3", 1.0)]  # twins beside twins
    own = [("q", "c0", 1.0), ("q", "l1", 0.5), ("q", "none", 0.3), ("r", "h", 1.0), ("r", "l8", float("nan")), ("s", "x", 1.0), ("s", "x", 0.5), ("t", "none", 1.0), ("u", "c3", -1.0), ("t", "w1", 0.5), ("s", "v2", 1.0)]
    shared, sets = [("q", "A", 1.0), ("r", "A", 0.5), ("r", "B", 2.0), ("u", "B", 1.0)], [("A", "c1", 1.0), ("A", "gone", 0.2), ("A", "l2", 0.4), ("B", "g", 1.0), ("B", "c7", 0.1), ("B", "w2", 0.3), ("B", "w0", 0.1)]
    flat = own + [(q, v, w * x) for q, s, w in shared for t, v, x in sets if s == t]
    df = lambda rows, names: spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string, weight double")
    e, r, sh, st = df(edges, ("src", "dst")), df(own, ("query_id", "id")), df(shared, ("query_id", "set_id")), df(sets, ("set_id", "id"))
    for hubs, leaf, most in ((2, 2, 200), (3, 4, 1), (0, 4, 200)):
        monkeypatch.setattr(graph_hubs, "MOST_SETS", most)
        monkeypatch.setattr(graph_hubs, "BLOCK", 60)
        got = {(x.query_id, x.id): x["rank"] for x in graph_hubs.ranks_through_hubs(e, r, 0.6, 5, sh, st, hubs=hubs, leaf=leaf).collect()}
        want = _power_iteration(edges, flat, 0.6, 5)
        assert got.keys() == want.keys() and all(abs(got[k] - x) < 1e-12 for k, x in want.items())
    some = {(x.query_id, x.id) for x in graph_hubs.ranks_through_hubs(e, r, 0.6, 5, sh, st, wanted=F.col("id").startswith("l"), hubs=2).collect()}
    assert some == {k for k in want if k[1].startswith("l")}


def test_passage_ranks_hold_no_row_for_each_question_and_vertex(spark, sf, tmp_path):
    """Each round held all questions by all vertices, which 1 GB of tables had no disk for."""
    folder = _copy(
        sf,
        tmp_path,
        customer="select i as c_custkey, 'Customer#' || i as c_name, (i * 7 % 25)::INTEGER as c_nationkey, 1.0::DOUBLE as c_acctbal, 'A' as c_mktsegment from range(3000) r(i)",
        supplier="select i as s_suppkey, 'Supplier#' || i % 900 as s_name, (i * 11 % 25)::INTEGER as s_nationkey, 1.0::DOUBLE as s_acctbal from range(2400) r(i)",
    )
    since = session.mark()
    _same_as_sql(spark, folder, "ppr_weighted")
    rows = [spark.read.parquet(p).count() for p in session._WRITTEN[since:]]
    assert max(rows) < 40_000 < 120 * 3000  # questions by customers; the graph has some 25 000 edges
