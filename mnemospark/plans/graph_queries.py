"""Queries over the fact graph, the content store, consolidation and mixing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.operators import gates, graph, lsh, mixing, store
from mnemospark.operators.graph_hubs import ranks_through_hubs, small
from mnemospark.plans.registry import query
from mnemospark.plans.tables import EVENTS_SQL, FACTS_SQL, clock_events, star_facts, table
from mnemospark.session import written

_FACT_EDGES = "fe AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT s AS src, o AS dst FROM facts WHERE s <> o UNION ALL SELECT o, s FROM facts WHERE s <> o) GROUP BY ALL)"
_PASSAGES = "pe AS (SELECT DISTINCT chunk, unnest([s, o]) AS entity FROM facts)"


@query("fact_edges", f"WITH {FACTS_SQL}, {_FACT_EDGES} SELECT * FROM fe")
def fact_edges(spark, sf_dir):
    return graph.fact_edges(star_facts(spark, sf_dir))


@query("passage_edges", f"WITH {FACTS_SQL}, {_PASSAGES} SELECT chunk, entity, 1.0::DOUBLE AS weight FROM pe")
def passage_edges(spark, sf_dir):
    return graph.passage_edges(star_facts(spark, sf_dir))


@query("entity_chunk_counts", f"WITH {FACTS_SQL}, {_PASSAGES} SELECT entity, count(*) AS chunks FROM pe GROUP BY entity")
def entity_chunk_counts(spark, sf_dir):
    return graph.entity_chunks(star_facts(spark, sf_dir))


@query("graph_info", f"WITH {FACTS_SQL}, {_FACT_EDGES}, {_PASSAGES} SELECT (SELECT count(DISTINCT chunk) FROM facts) AS passage_nodes, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM facts)) AS facts, (SELECT count(DISTINCT entity) FROM pe) AS phrase_nodes, (SELECT count(*) FROM pe) AS passage_triples, (SELECT count(*) FROM fe) AS fact_pairs")
def graph_info(spark, sf_dir):
    return graph.graph_info(star_facts(spark, sf_dir))


@query("phrase_weights", f"WITH {FACTS_SQL}, {_PASSAGES}, c AS (SELECT entity, count(*) AS chunks FROM pe GROUP BY 1), sel AS (SELECT chunk AS query_id, s, o, length(s) % 7 / 7.0 AS score FROM facts), e AS (SELECT query_id, score, unnest([s, o]) AS entity FROM sel), w AS (SELECT query_id, entity, sum(score / chunks) / count(*) AS weight FROM e JOIN c USING (entity) GROUP BY ALL) SELECT query_id, entity, round(weight, 6) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 6) DESC, entity) <= 5")
def phrase_weights(spark, sf_dir):
    facts = star_facts(spark, sf_dir)
    sel = facts.select(F.col("chunk").alias("query_id"), "s", "o", (F.length("s") % 7 / 7.0).alias("score"))
    return graph.phrase_weights(sel, facts, top=5).select("query_id", "entity", F.round("weight", 6).alias("weight"))


def _ppr_sql(edges: str, reset: str, d: float, rounds: int) -> str:
    """Unrolled power iteration over edges (src, dst, weight) and reset (query_id, id, weight)."""
    out = [f"b AS (SELECT src, dst, sum(weight) AS w FROM (SELECT src, dst, weight FROM {edges} UNION ALL SELECT dst, src, weight FROM {edges}) GROUP BY 1, 2)", "sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM b)", f"p AS MATERIALIZED (SELECT query_id, id, sum(weight) / any_value(m) AS p FROM (SELECT *, sum(weight) OVER (PARTITION BY query_id) AS m FROM {reset}) GROUP BY 1, 2)", "r0 AS MATERIALIZED (SELECT query_id, id, p AS rank FROM p)"]
    for k in range(1, rounds + 1):
        out.append(f"r{k} AS MATERIALIZED (SELECT query_id, id, sum(part) AS rank FROM (SELECT query_id, dst AS id, {d} * rank * share AS part FROM r{k - 1} JOIN sh ON id = src UNION ALL SELECT query_id, id, (1 - {d}) * p FROM p) GROUP BY 1, 2)")
    return ", ".join(out)


# Questions: every supplier whose key is divisible by 20, asked about itself and, by half the weight, its nation.
_SEEDS = "seeds AS (SELECT 'q' || s_suppkey AS query_id, unnest([lower(s_name), lower(n_name)]) AS id, unnest([1.0, 0.5]) AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 20 = 0)"


def _seeds(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    asked = table(spark, sf_dir, "supplier").filter("s_suppkey % 20 = 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    each = F.explode(F.array(F.struct(F.lower("s_name").alias("id"), F.lit(1.0).alias("weight")), F.struct(F.lower("n_name").alias("id"), F.lit(0.5).alias("weight"))))
    return asked.select(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("query_id"), each.alias("e")).select("query_id", "e.id", "e.weight")


_SNAPSHOT = "se AS (SELECT s AS src, o AS dst, 1.0 AS weight FROM facts WHERE s <> o AND s <> '' AND o <> '')"


@query("ppr_uniform", f"WITH {FACTS_SQL}, {_SNAPSHOT}, {_SEEDS}, {_ppr_sql('se', 'seeds', 0.85, 20)} SELECT query_id, id, round(rank, 8) AS rank FROM r20")
def ppr_uniform(spark, sf_dir):
    _, edges = graph.snapshot_graph(star_facts(spark, sf_dir))
    return graph.personalised_pagerank(edges, _seeds(spark, sf_dir), 0.85, 20, digits=8)


_ALL_EDGES = "ae AS (SELECT src, dst, weight FROM fe UNION ALL SELECT chunk, entity, 1.0 FROM pe)"


@query("ppr_weighted", f"WITH {FACTS_SQL}, {_FACT_EDGES}, {_PASSAGES}, {_ALL_EDGES}, {_SEEDS}, resets AS (SELECT query_id, id, weight FROM seeds UNION ALL SELECT DISTINCT query_id, chunk, 0.05 * (length(chunk) % 3) FROM pe JOIN seeds ON entity = id), {_ppr_sql('ae', 'resets', 0.5, 12)} SELECT query_id, id, round(rank, 8) AS rank FROM r12 WHERE starts_with(id, 'chunk-')")
def ppr_weighted(spark, sf_dir):
    """Passages by weighted ranks; reset weights are phrase seeds and, for passages that hold one of them, a twentieth of their score.

    Suppliers of one nation have its passages in common, so these are a set; passages of another seed that are not among them are a question's own. Questions with the same seeds are asked once.
    """
    facts = star_facts(spark, sf_dir)
    seeds = _seeds(spark, sf_dir)
    each = seeds.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", "weight"))).alias("asked"), F.min(F.when(F.col("weight") == 0.5, F.col("id"))).alias("set_id"))
    asked = written(each.withColumn("first", F.min("query_id").over(Window.partitionBy("asked"))), "ppr-asked")
    one = asked.filter("query_id = first").select("query_id", "set_id", F.explode("asked").alias("e")).select("query_id", "set_id", "e.id", "e.weight")
    entities = written(one.select(F.col("id").alias("entity")).distinct(), "ppr-entities")
    held = facts.select("chunk", F.explode(F.array("s", "o")).alias("entity")).join(small(entities), "entity").distinct()
    held = written(held.select("entity", F.col("chunk").alias("id"), (F.lit(0.05) * (F.length("chunk") % 3)).alias("weight")), "ppr-held")
    common = one.select("query_id", "set_id").distinct().filter("set_id IS NOT NULL")
    sets = held.join(common.select(F.col("set_id").alias("entity")).distinct(), "entity", "left_semi").select(F.col("entity").alias("set_id"), "id", "weight")
    rest = one.filter("set_id IS NULL OR id <> set_id").select("query_id", "set_id", F.col("id").alias("entity")).join(held, "entity").select("query_id", "set_id", "id", "weight").distinct()
    rest = rest.join(sets.select("set_id", "id"), ["set_id", "id"], "left_anti").select("query_id", "id", "weight")
    reset = one.select("query_id", "id", "weight").unionByName(rest)
    r = ranks_through_hubs(graph.all_edges(facts), reset, 0.5, 12, common.withColumn("weight", F.lit(1.0)), sets, wanted=F.col("id").startswith("chunk-"))
    to = asked.select(F.col("first").alias("query_id"), F.col("query_id").alias("to"))
    return r.join(small(to), "query_id").select(F.col("to").alias("query_id"), "id", F.round("rank", 8).alias("rank"))


@query("semantic_retrieve", f"WITH {FACTS_SQL}, {_SNAPSHOT}, {_SEEDS}, {_ppr_sql('se', 'seeds', 0.85, 20)}, t AS (SELECT DISTINCT s, p, o FROM facts), sc AS (SELECT query_id, s, p, o, sum(rank * times) AS score FROM (SELECT s, p, o, unnest(list_distinct([s, o])) AS id, CASE WHEN s = o THEN 2 ELSE 1 END AS times FROM t) JOIN r20 USING (id) GROUP BY ALL) SELECT query_id, s, p, o, round(score, 8) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, s, p, o) <= 10")
def semantic_retrieve(spark, sf_dir):
    facts = star_facts(spark, sf_dir)
    _, edges = graph.snapshot_graph(facts)
    ranks = graph.ranks_by_class(edges, _seeds(spark, sf_dir), 0.85, 20)
    return graph.best_triples(facts, ranks, 10).select("query_id", "s", "p", "o", "score")


@query("delete_refcount", f"WITH {FACTS_SQL}, gone AS (SELECT * FROM facts WHERE chunk IN ('chunk-c1', 'chunk-s0')), stay AS (SELECT * FROM facts WHERE chunk NOT IN ('chunk-c1', 'chunk-s0')) SELECT entity FROM (SELECT DISTINCT unnest([s, o]) AS entity FROM gone) WHERE entity NOT IN (SELECT unnest([s, o]) FROM stay)")
def delete_refcount(spark, sf_dir):
    facts = star_facts(spark, sf_dir)
    gone = facts.filter(F.col("chunk").isin("chunk-c1", "chunk-s0")).select("chunk").distinct()
    return store.delete_documents(facts, gone)["lost_entities"]


@query("content_hash_dedup", "SELECT 'chunk-' || md5(text) AS hash_id, any_value(length(text)) AS n_chars, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy(tx.chunk_id(F.col("text")).alias("hash_id")).agg(F.first(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query("missing_hashes", "SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents WHERE text IS NOT NULL EXCEPT SELECT 'chunk-' || md5(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL")
def missing_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return store.missing(store.keyed(d), store.keyed(d.filter("lang = 'en'"))).select("hash_id")


@query("store_first_row", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1")
def store_first_row(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("less", -F.col("n_chars"))
    return store.first_rows(d, ["lang", "source"], ["less", "doc_id"]).select("doc_id", "lang", "source")


@query("coverage_gap", "WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels) SELECT (SELECT count(*) FROM a) AS expected, (SELECT count(*) FROM a JOIN b USING (doc_id)) AS covered, (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS missing, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS unexpected")
def coverage_gap(spark, sf_dir):
    return gates.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("artifact_gaps", "WITH need AS (SELECT conv_id AS unit_id, unnest(['system', 'user', 'assistant', 'tool']) AS kind FROM (SELECT DISTINCT conv_id FROM conversations)), have AS (SELECT conv_id AS unit_id, role AS kind, max(length(text)) AS size FROM conversations GROUP BY ALL) SELECT unit_id, kind, CASE WHEN size IS NULL THEN 'missing' ELSE 'empty' END AS problem FROM need LEFT JOIN have USING (unit_id, kind) WHERE size IS NULL OR size = 0")
def artifact_gaps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit_id"), F.col("role").alias("kind"), F.length("text").alias("size"))
    return gates.artifact_gaps(c, c, ["system", "user", "assistant", "tool"])


@query("round_robin_interleave", "WITH x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn, dense_rank() OVER (ORDER BY source) - 1 AS seat FROM documents) SELECT doc_id, source, turn, seat::INT AS seat FROM x")
def round_robin_interleave(spark, sf_dir):
    return mixing.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"])


@query("weighted_interleave", "SELECT doc_id, round(row_number() OVER (PARTITION BY lang ORDER BY doc_id) / CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 ELSE 1.0 END, 6)::DOUBLE AS position_key FROM documents")
def weighted_interleave(spark, sf_dir):
    x = mixing.weighted_interleave(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], {"en": 4, "de": 2})
    return x.select("doc_id", F.round("position_key", 6).alias("position_key"))


_MIX = {"en": 0.5, "de": 0.3, "fr": 0.2}


def _interleave_sql(stop: str, drawn: bool, reach: int = 60) -> str:
    """The stream replayed place by place: draws by MD5, each source's rows by their number modulo its size."""
    names, upto = list(_MIX), [sum(list(_MIX.values())[: k + 1]) for k in range(len(_MIX))]
    share = "(('0x' || substr(md5('7:' || pos), 1, 8))::BIGINT / 4294967296.0)"
    seat = f"CASE WHEN {share} < {upto[0]} THEN 0 WHEN {share} < {upto[1]} THEN 1 ELSE 2 END" if drawn else f"pos % {len(names)}"
    which = "min" if stop == "first_exhausted" else "max"
    at = " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(names))
    return f"""WITH d AS (SELECT doc_id, CASE lang {at} END AS seat, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn FROM documents WHERE lang IN {tuple(names)}),
    size AS (SELECT seat, count(*) AS n FROM d GROUP BY seat),
    p AS (SELECT pos, {seat} AS seat FROM (SELECT unnest(range({reach} * (SELECT count(*) FROM d))) AS pos)),
    o AS (SELECT pos, seat, row_number() OVER (PARTITION BY seat ORDER BY pos) - 1 AS nth FROM p),
    e AS (SELECT {which}(pos) AS last FROM o JOIN size USING (seat) WHERE nth = n - 1)
    SELECT pos AS position, doc_id, (nth // n)::BIGINT AS repeat FROM o JOIN size USING (seat) JOIN d ON d.seat = o.seat AND d.turn = nth % n WHERE pos <= (SELECT last FROM e)"""


def _interleaved(stop: str, drawn: bool):
    @query(f"interleave_{'drawn' if drawn else 'cycled'}_{stop}", _interleave_sql(stop, drawn))
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
        x = mixing.interleave(docs, "lang", ["doc_id"], list(_MIX), list(_MIX.values()) if drawn else None, stop, seed=7)
        return x.select("position", "doc_id", "repeat")


for _stop in ("first_exhausted", "all_exhausted"):
    for _drawn in (False, True):
        _interleaved(_stop, _drawn)


@query("hard_negatives", f"WITH {EVENTS_SQL}, q AS (SELECT user_id, max(value) AS pos FROM ev GROUP BY 1), n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS r FROM ev) SELECT user_id, count(*) AS kept, sum(event_id)::BIGINT AS ids FROM n JOIN q USING (user_id) WHERE r >= 1 AND r < 20 AND value > 1 AND value < pos - 0.5 AND value < pos * 0.95 GROUP BY user_id")
def hard_negatives(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    best = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    few = e.withColumn("r", F.row_number().over(best)).filter("r <= 20")  # a limit of a rank: each task keeps 20 a user
    n = few.groupBy("user_id").agg(F.max("value").alias("pos"), F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("less"), F.col("event_id").alias("id"), F.col("value").alias("score")))).alias("neg"))
    kept = mixing.hard_negatives(F.col("neg"), F.col("pos"), above=1, margin=0.5, ratio=0.95, ranks=(1, 20))
    x = n.select("user_id", F.explode(kept).alias("k"))
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("k.id").alias("ids"))


@query(
    "hard_negative_chain",
    f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, event_id, value, (event_id % 50) || '-' || event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk FROM ev),
    pos AS (SELECT user_id, split_part(id, '-', 1) AS doc, value AS pos FROM r WHERE rk = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pr FROM r WHERE rk BETWEEN 2 AND 40),
    lead AS (SELECT user_id, coalesce(min(pr) FILTER (event_id % 10 <= 4), 40) AS low FROM n GROUP BY user_id),
    k AS (SELECT n.*, row_number() OVER (PARTITION BY user_id ORDER BY rk) - 1 AS i FROM n JOIN pos USING (user_id) JOIN lead USING (user_id)
          WHERE NOT starts_with(id, doc) AND NOT (pr >= 2 AND pr < 6) AND pr >= low AND value < pos - 0.1 AND value < pos * 0.95)
    SELECT user_id, count(*) AS kept, sum(event_id)::BIGINT AS ids FROM k WHERE i >= 1 AND i < 9 GROUP BY user_id HAVING count(*) >= 6.4""",
)
def hard_negative_chain(spark, sf_dir):
    """Users as queries: their largest event is the positive, the next 39 the negatives, events by id the positive's ranking."""
    e = clock_events(spark, sf_dir)
    best = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    few = e.withColumn("r", F.row_number().over(best)).filter("r <= 40").withColumn("id", F.concat((F.col("event_id") % 50).cast("string"), F.lit("-"), F.col("event_id").cast("string")))
    rest = lambda order: F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct(order, "id", "value", (F.col("event_id") % 10).cast("double").alias("near")))))
    each = few.groupBy("user_id").agg(F.max_by("id", -F.col("r")).alias("positive_id"), F.max("value").alias("positive_score"), rest("r").alias("n"), rest("event_id").alias("p"))
    pairs = lambda c, score: F.transform(c, lambda x: F.struct(x["id"].alias("id"), x[score].alias("score")))
    rows = each.select("user_id", "positive_id", "positive_score", pairs("n", "value").alias("negatives"), pairs("p", "near").alias("by_positive"), F.lit(None).cast("array<struct<id: string, score: double>>").alias("earlier"))
    kept = mixing.hard_negative_chain(rows, 8, same_document=True, positive_ranks=(2, 6), positive_above=4, margin=0.1, ratio=0.95, ranks=(1, 9))
    x = kept.select("user_id", F.explode("negatives").alias("k"))
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.substring_index("k.id", "-", -1).cast("long")).alias("ids"))


@query("corpus_entity_stats", "WITH e AS (SELECT unnest(string_split(text, ' ')) AS e FROM benchmark) SELECT round(avg(length(e)), 4) AS avg_ent_chars, round(avg(len(regexp_split_to_array(e, '\\s+'))), 4) AS avg_ent_words FROM e")
def corpus_entity_stats(spark, sf_dir):
    from mnemospark.sources.sinks import corpus_statistics

    return corpus_statistics(table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("extracted_entities")))


@query("semantic_snapshots", "WITH x AS (SELECT c_nationkey AS ts, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, c_name FROM customer) SELECT ts::BIGINT AS snapshot_ts, 'semantic_' || ts || '_' || idx AS id, c_name AS subject, 'in' AS predicate, ts::VARCHAR AS object FROM x")
def semantic_snapshots(spark, sf_dir):
    """Snapshots round-trip through their JSON map; short triples and further elements do not matter."""
    from mnemospark.sources.captions import snapshot_triples

    c = table(spark, sf_dir, "customer")
    each = c.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", F.col("c_nationkey").alias("n")))), lambda r: F.array(r["c_name"], F.lit("in"), r["n"].cast("string"), F.lit("more"))).alias("t"))
    bad = F.array(F.array(F.lit("short"), F.lit("triple")))
    raw = each.select(F.to_json(F.map_from_arrays(F.array(F.col("c_nationkey").cast("string")), F.array(F.struct(F.concat("t", bad).alias("consolidated_semantic_triples"))))).alias("value"))
    return snapshot_triples(raw).select("snapshot_ts", "id", "subject", "predicate", "object")


def _minhash_sql() -> str:
    """Signatures by wide integers, buckets by the minima themselves, clusters by reachability."""
    a, b = lsh.permutation_numbers()
    bands, rows = lsh.band_shape()
    listed = lambda x: "[" + ", ".join(map(str, x.tolist())) + "]"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[^A-Za-z_0-9]') AS t FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM w WHERE len(t) >= 5)),
    s AS (SELECT doc_id, sha1(gram) AS x FROM g),
    h AS (SELECT doc_id, ('0x' || x[7:8] || x[5:6] || x[3:4] || x[1:2])::BIGINT::HUGEINT AS h FROM s),
    p AS (SELECT unnest(range({bands * rows})) AS k, unnest({listed(a[: bands * rows])}::HUGEINT[]) AS a, unnest({listed(b[: bands * rows])}::HUGEINT[]) AS b),
    m AS (SELECT doc_id, k, min(((h * a + b) % 18446744073709551616::HUGEINT % {lsh.MERSENNE})::UBIGINT & {lsh.LOW32}::UBIGINT) AS low FROM h, p GROUP BY ALL),
    bucket AS (SELECT doc_id, k // {rows} AS band, list(low ORDER BY k) AS key FROM m GROUP BY ALL),
    e AS (SELECT DISTINCT doc_id AS a, min(doc_id) OVER (PARTITION BY band, key) AS b FROM bucket),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
    least AS (SELECT a, min(b) AS cluster FROM reach GROUP BY a)
    SELECT d.doc_id AS id, coalesce(cluster, d.doc_id) AS cluster, coalesce(cluster, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN least ON a = d.doc_id"""


@query("minhash_clusters", _minhash_sql())
def minhash_clusters(spark, sf_dir):
    return lsh.clusters(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


def _fold_sql(slices: int) -> str:
    """The fold step by step: the least known id with a new fact's object goes, and its evidence moves on."""
    out = ["c AS (SELECT c_nationkey % 5 AS ts, c_custkey AS triple_id, lower(c_name) AS s, c_mktsegment AS o, ['c' || c_custkey] AS evidence FROM customer)", "k0 AS (SELECT triple_id, s, o, evidence FROM c WHERE ts = 0)"]
    for k in range(1, slices):
        out.append(f"g{k} AS (SELECT k{k - 1}.* FROM k{k - 1} JOIN (SELECT o, min(triple_id) AS triple_id FROM k{k - 1} GROUP BY o) USING (o, triple_id) WHERE o IN (SELECT o FROM c WHERE ts = {k}))")
        out.append(f"k{k} AS (SELECT * FROM k{k - 1} WHERE triple_id NOT IN (SELECT triple_id FROM g{k}) UNION ALL SELECT c.triple_id, c.s, c.o, c.evidence || coalesce(list_sort(g.evidence), []) FROM c LEFT JOIN g{k} g ON c.o = g.o WHERE c.ts = {k})")
    each = " UNION ALL ".join(f"SELECT {k}::BIGINT AS snapshot_ts, triple_id, s, 'buys as' AS p, o, array_to_string(evidence, ',') AS evidence FROM k{k}" for k in range(slices))
    return f"WITH {', '.join(out)} {each}"


@query("consolidation_fold", _fold_sql(5))
def consolidation_fold(spark, sf_dir):
    """Customers' facts in five slices; a new fact replaces the first known one about the same market segment."""
    from mnemospark.operators.consolidation import fold

    c = table(spark, sf_dir, "customer")
    slices = c.select((F.col("c_nationkey") % 5).cast("long").alias("snapshot_ts"), F.col("c_custkey").cast("long").alias("triple_id"), F.lower("c_name").alias("s"), F.lit("buys as").alias("p"), F.col("c_mktsegment").alias("o"), F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("evidence"))
    segments = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # five of them
    embed = lambda df: df.select("id", F.array(*[F.when(F.col("o") == x, 1.0).otherwise(0.0) for x in segments]).alias("vector"))
    decide = lambda df: df.select("triple_id", "s", "p", "o", F.array(F.get("related", F.lit(0))["triple_id"]).alias("removed"))
    return fold(slices, embed, decide).select("snapshot_ts", "triple_id", "s", "p", "o", F.array_join("evidence", ",").alias("evidence"))


@query("consolidation_stream", _fold_sql(5))
def consolidation_stream(spark, sf_dir):
    """The same fold as keyed state of a stream: five slices arrive in three runs, each going on from the checkpoint of the one before."""
    import uuid

    from mnemospark.session import shared_dir
    from mnemospark.streaming import consolidate as keyed
    from mnemospark.streaming.streams import folder

    c = table(spark, sf_dir, "customer")
    day = F.col("c_nationkey").cast("long") % 5
    at = F.timestamp_seconds((day + 1) * 86_400)  # a watermark begins at the epoch, and what is not after it is late
    facts = c.select(F.col("c_mktsegment").alias("topic"), at.alias("ts"), F.col("c_custkey").cast("long").alias("triple_id"), F.lower("c_name").alias("s"), F.lit("buys as").alias("p"), F.col("c_mktsegment").alias("o"), F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("evidence"))
    root = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"
    decide = lambda new, known: (new, [known[0]["triple_id"]])
    for first, last in ((0, 1), (2, 2), (3, 4)):
        facts.filter(F.unix_timestamp("ts").between((first + 1) * 86_400, (last + 1) * 86_400)).write.mode("append").parquet(f"{root}/in")
        keyed.consolidate(folder(spark, f"{root}/in", "topic string, ts timestamp, " + keyed.FACT), f"{root}/log", f"{root}/mark", decide).awaitTermination()
    log = spark.read.schema(keyed.LOG).parquet(f"{root}/log")
    held = keyed.snapshots(log, facts.select("ts"))
    return held.select((F.unix_timestamp("ts") / 86_400 - 1).cast("long").alias("snapshot_ts"), "triple_id", "s", "p", "o", F.array_join("evidence", ",").alias("evidence"))


_LETTERS = lambda t: "[" + ", ".join(f"(length(lower({t})) - length(replace(lower({t}), '{c}', '')))::DOUBLE" for c in "abcdefghilmnorst") + "]"


@query(
    "agent_rounds",
    f"""WITH q AS (SELECT item_id AS question_id, (item_id + 1) * (SELECT max(doc_id) FROM documents) // (SELECT count(*) FROM benchmark) AS as_of, {_LETTERS("text")} AS v FROM benchmark),
    d AS (SELECT doc_id, coalesce(text, '') AS content, doc_id % 3 AS m, {_LETTERS("coalesce(text, '')")} AS v FROM documents),
    x AS (SELECT question_id, doc_id, m, content, CASE WHEN list_sum(q.v) = 0 OR list_sum(d.v) = 0 THEN 0 ELSE round(list_cosine_similarity(q.v, d.v), 6) END AS score FROM q JOIN d ON doc_id <= as_of),
    r AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY question_id, m ORDER BY score DESC, doc_id) <= CASE m WHEN 1 THEN 10 ELSE 3 END)
    SELECT question_id, 3 AS num_rounds, count(*) AS n_items, sha256(string_agg(content, chr(10) || chr(10) ORDER BY m, score DESC, doc_id)) AS context_sha FROM r GROUP BY question_id""",
)
def agent_rounds(spark, sf_dir):
    """Benchmark passages as questions, their times spread over all documents, answered in rounds over three memories by the scripted provider."""
    from mnemospark.functions.providers import AgentGenerator, LetterEmbedder, embed_column
    from mnemospark.plans.agent import Memories, answer

    emb = LetterEmbedder()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").alias("ts"))
    with_vec = lambda df: df.join(embed_column(df, "item_id", "content", emb), "item_id")
    m = Memories()
    for k, name in enumerate(("episodic", "semantic", "visual")):
        m.register(name, with_vec(docs.filter(F.col("item_id") % 3 == k)))
    asked = table(spark, sf_dir, "benchmark")
    last, n = docs.agg(F.max("ts")).first()[0] or 0, asked.count()
    line = F.regexp_replace("text", r"\s+", " ")  # the scripted provider reads one line
    q = asked.select(F.col("item_id").alias("question_id"), line.alias("question"), F.expr(f"((item_id + 1) * {last}L) div {max(1, n)}L").alias("as_of_ts"))
    found = answer(q, m, emb, AgentGenerator())
    return found.select("question_id", "num_rounds", F.size("retrieved").cast("long").alias("n_items"), F.sha2(F.col("context").cast("binary"), 256).alias("context_sha"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LABELLED = lambda x, labels: f"CASE WHEN contains({x}, ':') AND lower(trim(split_part({x}, ':', 1), {_BLANK})) IN ({labels}) THEN trim(substr({x}, strpos({x}, ':') + 1), {_BLANK}) ELSE {x} END"


@query(
    "prediction_repair",
    rf"""WITH c AS (SELECT conv_id, turn, trim(coalesce(text, ''), {_BLANK}) AS t, coalesce(text, '') AS raw FROM conversations),
    a AS (SELECT *, {_LABELLED("t", "'answer', 'response', 'prediction'")} AS u FROM c),
    b AS (SELECT *, {_LABELLED("u", "'next action'")} AS act, {_LABELLED("u", "'summary', 'description'")} AS prose FROM a)
    SELECT conv_id, turn,
      CASE turn % 4 WHEN 0 THEN CASE WHEN turn <= 9.5 THEN turn::VARCHAR || '-9.5 seconds.' END
        WHEN 1 THEN nullif(trim(rtrim(trim(split_part(act, chr(10), 1), {_BLANK} || '`"' || chr(39)), '.'), {_BLANK}), '')
        WHEN 2 THEN nullif(trim(regexp_replace(prose, '\s+', ' ', 'g'), {_BLANK}), '')
        ELSE nullif(u, '') END AS prediction,
      '{{"a": ["' || regexp_replace(raw, '[\\"\n\r\t]', ' ', 'g') || '"]}}' AS json
    FROM b""",
)
def prediction_repair(spark, sf_dir):
    from mnemospark.functions.repair import repair_json, repair_prediction

    c = table(spark, sf_dir, "conversations")
    kind = F.get(F.array(*[F.lit(k) for k in ("tal", "next_action", "video_summary_gpt", "other")]), (F.col("turn") % 4).cast("int"))
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("at "), F.col("turn").cast("string"), F.lit(" - 9.5 seconds"))).otherwise(F.col("text"))
    broken = F.concat(F.lit('{"a": ["'), F.regexp_replace(F.coalesce("text", F.lit("")), r'[\\"\n\r\t]', " "), F.lit('", "b"'))
    return c.select("conv_id", "turn", repair_prediction(kind, text).alias("prediction"), repair_json(broken).alias("json"))


@query("subtitle_parse", f"WITH {EVENTS_SQL} SELECT user_id::VARCHAR AS path, count(*) AS cues, sum(sec)::DOUBLE AS start_sum FROM ev GROUP BY user_id")
def subtitle_parse(spark, sf_dir):
    """Events of a user as one subtitle file, parsed back."""
    from mnemospark.functions.timecode import human_clock
    from mnemospark.sources.captions import parse_subtitles

    e = clock_events(spark, sf_dir)
    cue = F.concat(F.col("event_id").cast("string"), F.lit("\n"), human_clock(F.col("sec"), True), F.lit(" --> "), human_clock(F.col("sec") + 2, True), F.lit("\n"), F.col("event_type"), F.lit("\n"))
    files = e.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.array_join(F.sort_array(F.collect_list(cue)), "\n").alias("value"))
    return parse_subtitles(files).groupBy("path").agg(F.count(F.lit(1)).alias("cues"), F.sum("start_seconds").alias("start_sum"))


@query("windowed_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    from mnemospark.streaming.streams import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))
