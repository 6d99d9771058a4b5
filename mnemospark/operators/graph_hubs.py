"""Personalised PageRank of many questions over a graph with few busy vertices: a question's walk is followed up to those hubs, and each hub's own walk once for all.

Ranks after K rounds are sums over walks of up to K steps: r_K = sum over t of kept(K - t) * d^t * M^t p, with kept(0) = 1 and kept(k) = 1 - d + d * (the reset's share
on vertices without edges) * kept(k - 1). A walk that meets a hub is its part up to the first hub, then a walk from hub to hub, then one that leaves the last
hub for good. The first depends on the question alone, the last on the hub alone, and the middle is a matter of hubs and steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.joins import join_by_size
from mnemospark.session import written

#: Reset sets that have walks of their own; beyond, each question holds its sets' rows itself. And numbers in a block of questions or of vertices.
MOST_SETS, BLOCK = 200, 250_000

#: Rows of a task of a round. And vertices of more neighbours are not compared with others.
ROWS, MOST_NEAR = 1_000_000, 10_000

#: Rows that a join with the result broadcasts; more meet it in a shuffle.
MOST_ROWS = 200_000

_QUERY, _SET, _HUB = 0, 1, 2


def small(df: DataFrame) -> DataFrame:
    """df, broadcast where it has few rows: the result of ranks_through_hubs is better not shuffled."""
    return F.broadcast(df) if df.count() <= MOST_ROWS else df


def _clean(weight: Column) -> Column:
    return F.when(weight.isNull() | F.isnan(weight) | (weight < 0), 0.0).otherwise(weight.cast("double"))


def _kept(loose: Column, damping: float, k: int) -> Column:
    """What the reset gets of all rank in round k, of a question with so much of its reset on vertices without edges."""
    r = loose * damping
    return (1 - damping) * (1 - F.pow(r, F.lit(k))) / (1 - r) + F.pow(r, F.lit(k))


def _question_blocks(hubs: list[str], sets: list[str], between: np.ndarray, damping: float, rounds: int):
    """Rows (query_id, kind, key, c, f) of a block's questions become one row: their ids and what each hub's and each set's series weighs in their ranks."""
    at_hub, at_set, steps = {h: i for i, h in enumerate(hubs)}, {s: i for i, s in enumerate(sets)}, rounds + 1

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(df["query_id"].unique())
        place = {q: i for i, q in enumerate(ids)}
        met, own, loose = np.zeros((steps, len(ids), len(hubs))), np.zeros((len(ids), len(sets))), np.zeros(len(ids))
        for q, kind, key, c, f in zip(df["query_id"], df["kind"], df["key"], df["c"], df["f"]):
            if kind == _HUB:
                met[:, place[q], at_hub[key]] += np.asarray(f, dtype=float)
            elif kind == _SET:
                own[place[q], at_set[key]] += c
            else:
                loose[place[q]] += c
        for i in range(1, steps):
            for j in range(i):
                met[i] += met[j] @ between[i - j]
        kept = np.ones((steps, len(ids)))
        for k in range(1, steps):
            kept[k] = 1 - damping + damping * loose * kept[k - 1]
        hub = np.zeros((len(ids), len(hubs), steps))
        for t in range(steps):
            for i in range(steps - t):
                hub[:, :, t] += kept[rounds - i - t][:, None] * met[i]
        of_set = own[:, :, None] * kept[::-1].T[:, None, :]
        data = np.concatenate([hub.reshape(len(ids), -1), of_set.reshape(len(ids), -1)], axis=1)
        return pd.DataFrame({"queries": [ids], "q_data": [data.tobytes()]})

    return run


def _vertex_blocks(hubs: list[str], sets: list[str], rounds: int):
    """Rows (id, kind, key, x) of a block's vertices become one row: their ids and the series of each hub and each set there."""
    at = {(_HUB, h): i for i, h in enumerate(hubs)} | {(_SET, s): len(hubs) + i for i, s in enumerate(sets)}
    steps = rounds + 1

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(df["id"].unique())
        place = {v: i for i, v in enumerate(ids)}
        data = np.zeros((len(ids), len(at), steps))
        for v, kind, key, x in zip(df["id"], df["kind"], df["key"], df["x"]):
            if kind != _QUERY:
                data[place[v], at[kind, key]] += np.asarray(x, dtype=float)
        return pd.DataFrame({"ids": [ids], "v_data": [data.tobytes()]})

    return run


def _products(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            queries, ids = batch.column("queries")[k].values, batch.column("ids")[k].values
            q = np.frombuffer(batch.column("q_data")[k].as_buffer()).reshape(len(queries), -1)
            rank = q @ np.frombuffer(batch.column("v_data")[k].as_buffer()).reshape(len(ids), -1).T
            row, col = (pa.array(x.ravel()) for x in np.indices(rank.shape))
            yield pa.RecordBatch.from_arrays([queries.take(row), ids.take(col), pa.array(rank.ravel())], names=["query_id", "id", "rank"])


def twins(flat: DataFrame, few: int) -> tuple[DataFrame, bool]:
    """(id, class, size) of vertices of flat (src, dst, weight, both ways) with the same more than few and at most MOST_NEAR neighbours by the same weights, and whether there are any; class is the least."""
    edge = F.struct("dst", "weight")
    # Sums of hashes first: only vertices that agree in these gather their neighbours.
    mark = flat.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("dst", "weight").cast("decimal(38,0)")).alias("mark")).filter((F.col("n") > few) & (F.col("n") <= MOST_NEAR))
    mark = written(mark, "hub-marks")
    maybe = mark.join(mark.groupBy("n", "mark").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("n", "mark"), ["n", "mark"], "left_semi").select("src")
    near = written(flat.join(maybe, "src").groupBy("src").agg(F.sort_array(F.collect_list(edge)).alias("near")), "hub-near")
    alike = near.groupBy("near").agg(F.min("src").alias("class"), F.count(F.lit(1)).alias("size"), F.collect_list("src").alias("ids")).filter("size > 1")
    members = written(alike.select(F.explode("ids").alias("id"), "class", "size"), "hub-twins")
    return members, not members.isEmpty()


def ranks_through_hubs(edges: DataFrame, reset: DataFrame, damping: float, rounds: int, shared: DataFrame, sets: DataFrame, wanted: Column | None = None, hubs: int = 32, leaf: int = 4) -> DataFrame:
    """(query_id, id, rank) as graph.personalised_pagerank gives them, for vertices whose column id passes wanted (all: None).

    Besides its rows of reset (query_id, id, weight) a question has sets in common with others: shared (query_id, set_id, weight) times sets (set_id, id,
    weight). Vertices with the same neighbours by the same weights are one class. Hubs are the so many vertices of most edges. Vertices of at most leaf neighbours, none of which is such a vertex, have no state: a walk passes them in a double step between their
    neighbours. What the rounds hold grows with hubs, sets and what questions reach without a hub. The result comes from products of packed blocks of
    questions and of vertices, each pair in one task, so it is never shuffled; only questions' own parts are joined to it, as their size allows.
    """
    spark, steps = edges.sparkSession, rounds + 1
    wanted = F.lit(True) if wanted is None else wanted
    names = [r[0] for r in sets.select("set_id").distinct().limit(MOST_SETS + 1).collect()]
    if len(names) > MOST_SETS:
        each = shared.select("query_id", "set_id", _clean(F.col("weight")).alias("c")).join(sets, "set_id")
        reset = reset.select("query_id", "id", _clean(F.col("weight")).alias("weight")).unionByName(each.select("query_id", "id", (F.col("c") * _clean(F.col("weight"))).alias("weight")))
        sets, names = sets.limit(0), []
    end = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("weight").cast("double").alias("weight"))
    flat = edges.select(F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("e")).select("e.*")
    flat = written(flat.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "hub-flat")
    members, any_twins = twins(flat, leaf)
    of_class = members.select("id", "class")
    if any_twins:  # a class is one vertex with all its members' edges
        for c in ("src", "dst"):
            flat = flat.join(of_class.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("class", c)).drop("class")
        flat = written(flat.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "hub-classes")
    classes = members.select(F.col("class").alias("id"), F.col("size").alias("members")).distinct()
    degree = written(flat.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")), "hub-degree")
    top = [r[0] for r in degree.join(classes, "id", "left_anti").orderBy(F.desc("n"), "id").limit(hubs).collect()]
    is_hub = lambda c: F.col(c).isin(top) if top else F.lit(False)
    of = lambda c: degree.select(F.col("id").alias(c), F.col("total").alias(f"{c}_total"), (~is_hub("id") & (F.col("n") <= leaf)).alias(f"{c}_few"), F.col("n").alias("size"))
    edge = join_by_size(join_by_size(flat, of("src"), ["src"], "size"), of("dst"), ["dst"], "size")
    share, back = F.col("weight") / F.col("src_total"), F.col("weight") / F.col("dst_total")
    edge = written(edge.select("src", "dst", share.alias("share"), back.alias("back"), "src_few", "dst_few"), "hub-edges")
    # A leaf's edges: out by its own share, in by its neighbour's.
    leaves = edge.filter("src_few").groupBy(F.col("src").alias("leaf")).agg(F.collect_list(F.struct(F.col("dst").alias("id"), F.col("share").alias("out"), F.col("back").alias("into"))).alias("near"), F.max("dst_few").alias("bad"))
    leaves = written(leaves.filter("NOT bad").select("leaf", "near"), "hub-leaves")
    bad = edge.filter("src_few AND dst_few").select(F.col("src").alias("few")).distinct()
    mixed = edge.filter("src_few <> dst_few").withColumn("few", F.when(F.col("src_few"), F.col("src")).otherwise(F.col("dst"))).join(bad, "few", "left_semi")
    one = edge.filter("src_few = dst_few").select("src", "dst", "share").unionByName(mixed.select("src", "dst", "share"))
    two = leaves.select("near", F.explode("near").alias("a")).select("a", F.explode("near").alias("b")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), (F.col("a.into") * F.col("b.out") * damping**2).alias("two"))
    step = one.select("src", "dst", (F.col("share") * damping).alias("one"), F.lit(0.0).alias("two")).unionByName(two.select("src", "dst", F.lit(0.0).alias("one"), "two"))
    step = written(step.groupBy("src", "dst").agg(F.sum("one").alias("one"), F.sum("two").alias("two")), "hub-steps")

    own = reset.groupBy("query_id", "id").agg(F.sum(_clean(F.col("weight"))).alias("p"))
    lot = written(sets.groupBy("set_id", "id").agg(F.sum(_clean(F.col("weight"))).alias("p")), "hub-sets")
    part = shared.groupBy("query_id", "set_id").agg(F.sum(_clean(F.col("weight"))).alias("c")).filter("c > 0")
    heavy = part.join(lot.groupBy("set_id").agg(F.sum("p").alias("of")), "set_id")
    mass = own.select("query_id", F.col("p").alias("m")).unionByName(heavy.select("query_id", (F.col("c") * F.col("of")).alias("m")))
    mass = written(mass.groupBy("query_id").agg(F.sum("m").alias("mass")).filter("mass > 0"), "hub-mass")
    part = written(heavy.join(mass, "query_id").select("query_id", "set_id", (F.col("c") / F.col("mass")).alias("c")), "hub-parts")
    own = own.join(mass, "query_id").select(F.lit(_QUERY).alias("kind"), F.col("query_id").cast("string").alias("key"), "id", (F.col("p") / F.col("mass")).alias("p"))
    start = own.unionByName(lot.select(F.lit(_SET).alias("kind"), F.col("set_id").cast("string").alias("key"), "id", "p")).filter("p > 0 AND id IS NOT NULL")
    at_members = start.join(of_class.drop("class"), "id", "left_semi")
    if any_twins:
        start = start.join(of_class, "id", "left").groupBy("kind", "key", F.coalesce("class", "id").alias("id")).agg(F.sum("p").alias("p"))
    start = start.join(degree.select("id", "n"), "id", "left").join(leaves.select(F.col("leaf").alias("id"), "near"), "id", "left")
    start = written(start.select("kind", "key", "id", "p", F.col("n").isNull().alias("loose"), "near"), "hub-start")
    names = [str(n) for n in names]

    # Walks from questions and sets end at the first hub; those from hubs leave it once.
    source = ["kind", "key"]
    of_hubs = spark.createDataFrame([(_HUB, h, h) for h in top], "kind int, key string, id string")
    from_hubs = step.filter(is_hub("src") & ~is_hub("dst")).select(F.lit(_HUB).alias("kind"), F.col("src").alias("key"), F.col("dst").alias("id"), "one", "two")
    near = start.filter("near IS NOT NULL").select(*source, "p", F.explode("near").alias("e")).select(*source, F.col("e.id").alias("id"), (F.col("p") * F.col("e.out") * damping).alias("p"))
    plain = step.filter(~is_hub("src") & ~is_hub("dst")).withColumnRenamed("src", "id")
    # Small tables meet in many rows, so the tasks follow those to come.
    tasks = -(-plain.count() * (len(top) + len(names)) // ROWS) or 1
    plain = plain.repartition(tasks, "id")
    # A state has the mass of this step and of the one before, so every other one is written.
    state = start.filter(F.col("near").isNull() & ~is_hub("id")).select(*source, "id", "p", F.lit(0.0).alias("before"))
    walks = of_hubs.select(*source, "id", F.lit(1.0).alias("p"), F.lit(0.0).alias("before"), F.lit(0).alias("t")).unionByName(state.withColumn("t", F.lit(0)))
    for t in range(1, steps):
        moved = state.repartition(tasks, "id").join(plain, "id").select(*source, F.col("dst").alias("id"), (F.col("p") * F.col("one") + F.col("before") * F.col("two")).alias("p"))
        if t == 1:
            moved = moved.unionByName(near.filter(~is_hub("id")))
        if t <= 2:
            moved = moved.unionByName(from_hubs.select(*source, "id", F.col("one" if t == 1 else "two").alias("p")))
        both = moved.withColumn("before", F.lit(0.0)).unionByName(state.select(*source, "id", F.lit(0.0).alias("p"), F.col("p").alias("before")))
        state = both.groupBy(*source, "id").agg(F.sum("p").alias("p"), F.sum("before").alias("before")).filter("p > 0 OR before > 0")
        if t % 2 == 0 or t == rounds:
            state = written(state, "hub-walks")
            walks = walks.unionByName(state.withColumn("t", F.lit(t)))
    at = [F.when(F.col("t") == k, F.col("p")) if k % 2 == 0 or k == rounds else F.when(F.col("t") == k + 1, F.col("before")) for k in range(steps)]
    walks = walks.repartition(-(-walks.count() // ROWS) or 1, *source, "id")
    walks = written(walks.groupBy(*source, "id").agg(F.array(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in at]).alias("x")), "hub-series")

    # What first comes to each hub, by steps.
    x = [F.col("x")[k] for k in range(steps)]
    comes = [F.lit(0.0)] + [F.col("one") * x[k - 1] + (F.col("two") * x[k - 2] if k > 1 else F.lit(0.0)) for k in range(1, steps)]
    to_hub = step.filter(is_hub("dst")).select(F.col("src").alias("id"), F.col("dst").alias("hub"), "one", "two")
    met = walks.join(to_hub, "id").groupBy(*source, "hub").agg(F.array(*[F.sum(c) for c in comes]).alias("f"))
    first = start.filter(F.col("near").isNull() & is_hub("id")).select(*source, F.col("id").alias("hub"), "p", F.lit(0).alias("t"))
    first = first.unionByName(near.filter(is_hub("id")).select(*source, F.col("id").alias("hub"), "p", F.lit(1).alias("t")))
    by_step = lambda p, t: F.array(*[F.coalesce(F.sum(F.when(t == k, p)), F.lit(0.0)) for k in range(steps)])
    met = written(met.unionByName(first.groupBy(*source, "hub").agg(by_step(F.col("p"), F.col("t")).alias("f"))), "hub-met")
    between = np.zeros((steps, len(top), len(top)))
    place = {h: i for i, h in enumerate(top)}
    for r in met.filter(F.col("kind") == _HUB).collect():  # at most hubs by hubs
        between[:, place[r.key], place[r.hub]] += r.f

    # Questions, by hubs, sets and what has no edges.
    null = F.lit(None).cast("array<double>")
    as_row = lambda df, kind, key, c, f: df.select(F.col("query_id").cast("string").alias("query_id"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), c.alias("c"), f.alias("f"))
    mine = lambda kind, df: df.filter(F.col("kind") == kind)
    set_of = part.withColumn("key", F.col("set_id").cast("string"))
    lost = start.filter("loose")
    rows = as_row(mine(_QUERY, met).withColumnRenamed("key", "query_id"), _HUB, F.col("hub"), F.lit(0.0), F.col("f"))
    via = set_of.join(mine(_SET, met).select("key", "hub", "f"), "key").select("query_id", "hub", F.transform("f", lambda v: v * F.col("c")).alias("f"))
    rows = rows.unionByName(as_row(via, _HUB, F.col("hub"), F.lit(0.0), F.col("f"))).unionByName(as_row(set_of, _SET, F.col("key"), F.col("c"), null))
    loose = mine(_QUERY, lost).select(F.col("key").alias("query_id"), "p").unionByName(set_of.join(mine(_SET, lost).select("key", "p"), "key").select(F.col("query_id").cast("string").alias("query_id"), (F.col("c") * F.col("p")).alias("p")))
    loose = written(loose.groupBy("query_id").agg(F.sum("p").alias("loose")), "hub-loose")
    rows = rows.unionByName(as_row(loose, _QUERY, F.lit(None), F.col("loose"), null)).unionByName(as_row(mass, _QUERY, F.lit(None), F.lit(0.0), null))
    width = max(1, (len(top) + len(names)) * steps)
    blocks = lambda n: max(1, -(-n * width // BLOCK))
    n_queries = mass.count()
    dealt = lambda df, by, n: df.withColumn("block", F.pmod(F.xxhash64(by), F.lit(n))).groupBy("block")
    packed = dealt(rows, "query_id", blocks(n_queries)).applyInPandas(_question_blocks(top, names, between, damping, rounds), "queries array<string>, q_data binary")
    packed = written(packed, "hub-questions")

    # Vertices, by hubs and sets; a leaf's series is its neighbours' of a step before.
    core = walks if any_twins else walks.filter(wanted)
    asked = leaves.select(F.col("leaf").alias("id"), "near")
    asked = asked.join(classes, "id", "left").filter(wanted | F.col("members").isNotNull()).select("id", "near") if any_twins else asked.filter(wanted)
    into = asked.select(F.col("id").alias("leaf"), F.explode("near").alias("e")).select("leaf", F.col("e.id").alias("id"), F.col("e.into").alias("into"))
    later = into.join(walks, "id").groupBy(*source, F.col("leaf").alias("id")).agg(F.array(F.lit(0.0), *[F.sum(x[k] * F.col("into") * damping) for k in range(steps - 1)]).alias("x"))
    first_step = lambda df: df.select(*source, "id", F.array(F.col("p"), *[F.lit(0.0)] * (steps - 1)).alias("x"))
    seen = core.unionByName(later).unionByName(first_step(start.filter("near IS NOT NULL").filter(wanted)))
    if any_twins:  # each member has an even part of its class's inflow, and its own reset
        even = F.array(F.lit(0.0), *[x[k] / F.col("size") for k in range(1, steps)]).alias("x")
        expanded = seen.join(members.withColumnRenamed("id", "member").withColumnRenamed("class", "id"), "id").select(*source, F.col("member").alias("id"), even)
        seen = seen.join(classes, "id", "left_anti").unionByName(expanded).unionByName(first_step(at_members)).filter(wanted)
    seen = written(seen, "hub-seen")
    ids = seen.select("id").distinct().count()
    alone = mine(_QUERY, seen).select("id").distinct().select(F.lit(_QUERY).alias("kind"), F.lit(None).cast("string").alias("key"), "id", null.alias("x"))
    vertices = dealt(seen.filter(F.col("kind") != _QUERY).unionByName(alone), "id", blocks(ids))
    vertices = written(vertices.applyInPandas(_vertex_blocks(top, names, rounds), "ids array<string>, v_data binary"), "hub-vertices")
    left, right = packed.repartition(min(4, blocks(n_queries))), vertices.repartition(min(16, blocks(ids)))
    ranks = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(_products, "query_id string, id string, rank double")
    kept = [_kept(F.coalesce("loose", F.lit(0.0)), damping, k) for k in range(steps)]
    local = mine(_QUERY, seen).select(F.col("key").alias("query_id"), "id", "x").join(loose, "query_id", "left")
    local = local.select("query_id", "id", sum((x[k] * kept[rounds - k] for k in range(steps)), F.lit(0.0)).alias("own")).groupBy("query_id", "id").agg(F.sum("own").alias("own"))
    local = written(local, "hub-own")
    # Where nothing is written for a question, its rank is the product's; zeros are vertices that it does not reach.
    rank = F.col("rank") + F.coalesce("own", F.lit(0.0))
    return ranks.join(small(local), ["query_id", "id"], "left").select("query_id", "id", rank.alias("rank")).filter("rank > 0")
