"""Fact graph: edges from triples, passage and synonym edges, personalised PageRank in bulk."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.joins import join_by_size
from mnemospark.session import written


def fact_edges(facts: DataFrame) -> DataFrame:
    """(src, dst, weight): each triple of each chunk adds 1 in both directions; self loops do not count."""
    both = facts.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("o").alias("dst")), F.struct(F.col("o").alias("src"), F.col("s").alias("dst")))).alias("e"))
    return both.select("e.*").filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def passage_edges(facts: DataFrame) -> DataFrame:
    """(chunk, entity, weight 1): a chunk and each phrase of its triples, once."""
    return facts.select("chunk", F.explode(F.array("s", "o")).alias("entity")).distinct().withColumn("weight", F.lit(1.0))


def entity_chunks(facts: DataFrame) -> DataFrame:
    """(entity, chunks): in how many chunks a phrase stands."""
    return passage_edges(facts).groupBy("entity").agg(F.count(F.lit(1)).alias("chunks"))


def synonym_edges(neighbours: DataFrame, least: float = 0.8, most: int = 101) -> DataFrame:
    """(src, dst, weight) from ranked neighbours (query_id, key_id, score): at most most accepted for each phrase."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id")
    ok = neighbours.filter((F.col("score") >= least) & (F.col("query_id") != F.col("key_id")))
    return ok.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select(F.col("query_id").alias("src"), F.col("key_id").alias("dst"), F.col("score").alias("weight"))


def all_edges(facts: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Fact, passage and synonym edges of one graph; a synonym's score replaces the pair's count."""
    edges = fact_edges(facts)
    if synonyms is not None:
        syn = synonyms.select("src", "dst", F.col("weight").alias("syn"))
        edges = edges.join(syn, ["src", "dst"], "full").select("src", "dst", F.coalesce("syn", "weight").alias("weight"))
    return edges.unionByName(passage_edges(facts).select(F.col("chunk").alias("src"), F.col("entity").alias("dst"), "weight"))


def snapshot_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of one snapshot: non-empty phrases; self loops skipped, parallel edges kept."""
    some = triples.filter((F.col("s") != "") & (F.col("o") != ""))
    ends = triples.select(F.explode(F.array("s", "o")).alias("id")).filter("id <> ''").distinct()
    return ends, some.filter("s <> o").select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit(1.0).alias("weight"))


#: Vertices of at most so many neighbours are compared whole, to find those that have the same ones.
FEW = 4


class Ranks(NamedTuple):
    """Ranks by class of twins: inflow (query_id, class, flow) is what each member of a class gets from its neighbours, home (query_id, id, class, part) what
    a seed gets from the reset besides; members (id, class, size) are the classes of more than one vertex, all other classes are their vertex."""

    inflow: DataFrame
    home: DataFrame
    members: DataFrame


def twins(flat: DataFrame) -> DataFrame:
    """(id, class, size): vertices of flat (src, dst, weight, both ways) with the same few neighbours by the same weights, where there are several; class is the least."""
    near = flat.join(flat.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= FEW).select("src"), "src")
    near = written(near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("near")), "ppr-near")
    alike = near.groupBy("near").agg(F.min("src").alias("class"), F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("_n", F.col("size"))
    return written(join_by_size(near, alike, ["near"], "_n").select(F.col("src").alias("id"), "class", "size"), "ppr-twins")


def ranks_by_class(edges: DataFrame, reset: DataFrame, damping: float, rounds: int, cut: int = 10, hub: int = 100_000) -> Ranks:
    """The ranks of personalised_pagerank, whose rounds run over classes of twins; rounds: at least one.

    Vertices with the same neighbours by the same weights give and get the same, so a class counts as one vertex that holds the sum of its members' ranks
    and resets. In the end its inflow is divided by its size, and a member's own reset part is added.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    flat = written(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "ppr-edges")
    members = twins(flat)
    alone = flat.join(members.filter("id <> class").select(F.col("id").alias("src")), "src", "left_anti")  # a class goes by its least member
    to = members.select(F.col("id").alias("dst"), "class")
    flat = alone.join(to, "dst", "left").select("src", F.coalesce("class", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = flat.groupBy("src").agg(F.sum("weight").alias("total"), F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("salts"), F.count(F.lit(1)).alias("size"))
    salt = F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int")
    share = written(join_by_size(flat, total, ["src"], "size").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"), salt.alias("salt"), "salts"), "ppr-shares")
    hubs = share.filter("salts > 1").select(F.col("src").alias("id"), "salts").distinct()  # at most one of hub edges; joined as their size allows
    any_hub = not hubs.isEmpty()
    clean = reset.select("query_id", "id", F.when(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0), 0.0).otherwise(F.col("weight")).alias("weight"))
    mass = clean.groupBy("query_id").agg(F.sum("weight").alias("mass")).filter("mass > 0")
    seeds = clean.join(mass, "query_id").groupBy("query_id", "id").agg(F.sum(F.col("weight") / F.col("mass")).alias("p")).filter("p > 0")
    seeds = written(seeds.join(members.select("id", "class"), "id", "left").select("query_id", "id", F.coalesce("class", "id").alias("class"), "p"), "ppr-reset")
    p = seeds.groupBy("query_id", F.col("class").alias("id")).agg(F.sum("p").alias("p"))
    p = written(p, "ppr-class-reset")
    rank = p.select("query_id", "id", F.col("p").alias("rank"))
    # Only seeds can lack edges: rank reaches other vertices along edges alone.
    loose = written(p.join(share.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("query_id", "id"), "ppr-loose")
    any_loose = not loose.isEmpty()
    for k in range(rounds):
        if any_hub:
            seats = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
            spread = rank.join(hubs, "id", "left").select("query_id", "id", "rank", seats.alias("seat"))
            met = spread.join(share, (spread["id"] == share["src"]) & (spread["seat"] == share["salt"]))
        else:
            met = rank.join(share, rank["id"] == share["src"])
        moved = met.select("query_id", F.col("dst").alias("id"), (F.col("rank") * F.col("share") * damping).alias("part"))
        kept = F.lit(1 - damping)
        own = lambda df: df
        if any_loose:
            lost = rank.join(loose, ["query_id", "id"]).groupBy("query_id").agg(F.sum("rank").alias("lost"))
            kept = 1 - damping + damping * F.coalesce("lost", F.lit(0.0))
            own = lambda df, lost=lost: df.join(lost, "query_id", "left")
        if k == rounds - 1:
            break
        home = own(p).select("query_id", "id", (F.col("p") * kept).alias("part"))
        # One shuffle a round: both parts are summed together, in part before it.
        rank = moved.unionByName(home).groupBy("query_id", "id").agg(F.sum("part").alias("rank"))
        if k % cut == cut - 1:
            rank = written(rank, "ppr-ranks")
    flow = moved.groupBy("query_id", F.col("id").alias("class")).agg(F.sum("part").alias("flow"))
    sizes = members.filter("id = class").select("class", "size")
    inflow = flow.join(sizes, "class", "left").select("query_id", "class", (F.col("flow") / F.coalesce("size", F.lit(1))).alias("flow"))
    home = own(seeds).select("query_id", "id", "class", (F.col("p") * kept).alias("part"))
    return Ranks(written(inflow, "ppr-inflow"), written(home, "ppr-home"), members)


#: Members of a class that meet its ranks in one place, and rows of a task where they do.
SEATS, ROWS = 1000, 1_000_000


def _to_members(flows: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, id, rank) of each of members (id, class, size) by the flow of its class in flows (query_id, class, flow).

    The result may have far more rows than both, so members are dealt to seats, a class's flows go to each of its seats, and the tasks follow the rows to come.
    """
    seats = F.ceil(F.col("size") / SEATS).cast("int")
    classes = members.groupBy("class").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    of = flows.join(classes, "class")
    tasks = -(-(of.agg(F.sum("n")).first()[0] or 0) // ROWS) or 1
    left = of.select("query_id", "class", F.col("flow").alias("rank"), F.explode(F.sequence(F.lit(0), seats - 1)).alias("seat")).repartition(tasks, "class", "seat")
    right = members.select("id", "class", F.pmod(F.xxhash64("id"), seats).cast("int").alias("seat")).repartition(tasks, "class", "seat")
    return left.join(right, ["class", "seat"]).select("query_id", "id", "rank")


def personalised_pagerank(edges: DataFrame, reset: DataFrame, damping: float, rounds: int, cut: int = 10, hub: int = 100_000, digits: int | None = None) -> DataFrame:
    """(query_id, id, rank) after a fixed number (one or more) of power iterations, for all queries at once.

    edges (src, dst, weight) are undirected: each row counts both ways, parallel rows add up. reset (query_id, id,
    weight): negative and NaN weights are 0, each query's weights are scaled to sum 1. A vertex without edges gives its
    rank back to the reset. Rounds run over classes of twins (ranks_by_class), and only the result has a row for each vertex. Shares are computed once;
    every ``cut`` rounds the ranks are written to the shared folder. The edges of a vertex with more than hub of them are dealt to several salts, and its rank goes to each.
    digits: ranks are rounded, once a class where its members share them.
    """
    r = ranks_by_class(edges, reset, damping, rounds, cut, hub)
    rounded = lambda c: c if digits is None else F.round(c, digits)
    asked = r.home.select("id").distinct()
    flat = r.inflow.select("query_id", "class", rounded(F.col("flow")).alias("flow"))
    one = flat.join(r.members.select("class").distinct(), "class", "left_anti").select("query_id", F.col("class").alias("id"), F.col("flow").alias("rank"))
    # Only vertices that some query has in its reset can be among the seeds; all other members, by far the most, pass without a look at them.
    some = one.unionByName(_to_members(flat, r.members.join(asked, "id", "left_semi")))
    plain = some.join(r.home.select("query_id", "id"), ["query_id", "id"], "left_anti")
    seeds = r.home.join(r.inflow, ["query_id", "class"], "left").select("query_id", "id", rounded(F.col("part") + F.coalesce("flow", F.lit(0.0))).alias("rank"))
    return plain.unionByName(seeds).unionByName(_to_members(flat, r.members.join(asked, "id", "left_anti")))


def best_triples(triples: DataFrame, r: Ranks, most: int, digits: int = 8) -> DataFrame:
    """(query_id, s, p, o, score) of each query's most best triples (s, p, o) by rank of subject plus rank of object, rounded; of equals the first by s, p, o.

    Triples whose ends are of the same two classes score alike, but for seeds that have twins. So the first most of such a group suffice, and
    the triples of those seeds are scored one by one.
    """
    ends = ["s", "p", "o"]
    of = lambda c: r.members.select(F.col("id").alias(c), F.col("class").alias(f"_{c}"))
    known = triples.select(*ends).distinct().join(of("s"), "s", "left").join(of("o"), "o", "left")
    known = written(known.select(*ends, F.coalesce("_s", "s").alias("cs"), F.coalesce("_o", "o").alias("co")), "triple-classes")
    first = Window.partitionBy("cs", "co").orderBy(*ends)
    few = known.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most).drop("_r")  # a limit of a rank: each task keeps most a group
    seeds = r.home.join(r.members.select("id", "size"), "id", "left")
    own = seeds.filter("size IS NULL").select("query_id", "class", F.col("part").alias("flow"))
    rank = written(r.inflow.unionByName(own).groupBy("query_id", "class").agg(F.sum("flow").alias("rank")), "class-ranks")
    by_class = F.explode(F.array_distinct(F.array("cs", "co"))).alias("class")
    score = lambda rows, keys: rows.select(*keys, by_class, F.when(F.col("cs") == F.col("co"), 2.0).otherwise(1.0).alias("times"))
    plain = score(few, ends).join(rank, "class").groupBy("query_id", *ends).agg(F.sum(F.col("rank") * F.col("times")).alias("score"))
    with_twins = seeds.filter("size IS NOT NULL").select("query_id", "id", "part")
    at_seed = known.withColumn("id", F.explode(F.array_distinct(F.array("s", "o")))).join(with_twins, "id")
    at_seed = at_seed.groupBy("query_id", *ends, "cs", "co").agg(F.sum(F.when(F.col("s") == F.col("o"), 2.0).otherwise(1.0) * F.col("part")).alias("part"))
    flow = score(at_seed, ["query_id", *ends, "part"]).join(rank, ["query_id", "class"], "left")
    special = flow.groupBy("query_id", *ends, "part").agg(F.sum(F.coalesce("rank", F.lit(0.0)) * F.col("times")).alias("flow")).select("query_id", *ends, (F.col("flow") + F.col("part")).alias("score"))
    all_ = plain.unionByName(special).groupBy("query_id", *ends).agg(F.round(F.max("score"), digits).alias("score"))  # a seed's part is never negative
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), *ends)
    return all_.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most).drop("_r")


def triple_scores(triples: DataFrame, rank: DataFrame) -> DataFrame:
    """(query_id, triple_id, s, p, o, score): rank of subject plus rank of object."""
    ends = triples.select("triple_id", F.explode(F.array_distinct(F.array("s", "o"))).alias("id"), F.when(F.col("s") == F.col("o"), 2.0).otherwise(1.0).alias("times"))
    sums = ends.join(rank, "id").groupBy("query_id", "triple_id").agg(F.sum(F.col("rank") * F.col("times")).alias("score"))
    return sums.join(triples, "triple_id")


def phrase_weights(fact_scores: DataFrame, facts: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, entity, weight) from fact_scores (query_id, s, o, score).

    A phrase gets the mean over its selected facts of score / chunks of the phrase; unknown phrases drop out. top: only
    the best phrases of a query keep a weight.
    """
    chunks = entity_chunks(facts)
    each = fact_scores.select("query_id", "score", F.explode(F.array("s", "o")).alias("entity"))
    w = each.join(chunks, "entity").groupBy("query_id", "entity").agg((F.sum(F.col("score") / F.col("chunks")) / F.count(F.lit(1))).alias("weight"))
    if top is None:
        return w
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 6)), "entity")
    return w.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")


def graph_info(facts: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """One row of counts over the graph."""
    one = facts.agg(F.countDistinct("chunk").alias("passage_nodes"), F.countDistinct("s", "p", "o").alias("facts"))
    phrases = facts.select(F.explode(F.array("s", "o")).alias("e")).agg(F.countDistinct("e").alias("phrase_nodes"))
    passages = passage_edges(facts).agg(F.count(F.lit(1)).alias("passage_triples"))
    pairs = fact_edges(facts).agg(F.count(F.lit(1)).alias("fact_pairs"))
    syn = [] if synonyms is None else [synonyms.agg(F.count(F.lit(1)).alias("synonym_triples"))]
    return reduce(lambda a, b: a.crossJoin(b), [one, phrases, passages, pairs, *syn])  # rows: one each
