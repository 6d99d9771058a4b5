"""Queries over records: lookups, alignment, candidates, contexts, text helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.operators import records
from mnemospark.plans.registry import query
from mnemospark.plans.tables import EVENTS_SQL, FACTS_SQL, clock_events, star_facts, table
from mnemospark.sources.files import frame_indices, frame_times, kept_ids, segment_seconds


@query("lookup_or_empty", f"WITH {FACTS_SQL}, t AS (SELECT chunk, count(*) AS n FROM facts WHERE chunk LIKE 'chunk-c%' GROUP BY 1) SELECT DISTINCT f.chunk, coalesce(t.n, 0) AS n FROM facts f LEFT JOIN t USING (chunk)")
def lookup_or_empty(spark, sf_dir):
    facts = star_facts(spark, sf_dir)
    t = facts.filter(F.col("chunk").startswith("chunk-c")).groupBy("chunk").agg(F.collect_list(F.array("s", "p", "o")).alias("triples"))
    x = records.lookup_or_empty(facts.select("chunk").distinct(), t, "chunk")
    return x.select("chunk", F.size("triples").cast("long").alias("n"))


@query("seeded_documents", "WITH c AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN '10sec' ELSE '30sec' END AS granularity, text FROM documents WHERE text IS NOT NULL) SELECT granularity, 'chunk-' || md5(text) AS idx, CASE WHEN granularity = '10sec' THEN 1 ELSE 0 END AS n_entities FROM c")
def seeded_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    c = d.select(F.when(F.col("doc_id") % 2 == 0, "10sec").otherwise("30sec").alias("granularity"), "text")
    e = d.select(tx.chunk_id(F.col("text")).alias("chunk")).distinct().withColumn("entities", F.array(F.lit("x")))
    t = e.select("chunk", F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("triples"))
    return records.seeded_documents(c, e, t).select("granularity", "idx", F.size("extracted_entities").alias("n_entities"))


@query("candidate_lists", f"WITH {EVENTS_SQL} SELECT user_id AS query_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY value DESC, event_id) AS docs FROM ev GROUP BY 1")
def candidate_lists(spark, sf_dir):
    e = clock_events(spark, sf_dir).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), F.col("value").alias("score"))
    x = records.candidate_lists(e.select("query_id").distinct(), e)
    return x.select("query_id", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda c: c["doc_id"].cast("string")), ",").alias("docs"))


@query("gold_rank_lookup", "WITH r AS (SELECT source AS query_id, lang AS name, min(doc_id) AS first FROM documents GROUP BY ALL), k AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM r), q AS (SELECT DISTINCT query_id FROM r) SELECT q.query_id, min(rank) AS rank FROM q LEFT JOIN k ON q.query_id = k.query_id AND k.name = 'de' GROUP BY 1")
def gold_rank_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("query_id"), F.col("lang").alias("name")).agg(F.min("doc_id").alias("first"))
    k = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("long"))
    return records.gold_ranks(k, d.select("query_id").distinct().withColumn("label", F.lit("de")))


@query("distinct_candidates", "WITH a AS (SELECT text AS name, item_id AS ordinal, 0 AS o FROM benchmark UNION ALL SELECT text, doc_id, 1 FROM documents WHERE text IS NOT NULL) SELECT md5(name) AS name_md5, ordinal FROM a QUALIFY row_number() OVER (PARTITION BY name ORDER BY o, ordinal) = 1")
def distinct_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "benchmark").select(F.col("text").alias("name"), F.col("item_id").alias("ordinal"))
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("text").alias("name"), F.col("doc_id").alias("ordinal"))
    return records.distinct_candidates(c, d).select(F.md5(F.col("name").cast("binary")).alias("name_md5"), "ordinal")


@query("mean_of_tasks", f"WITH {EVENTS_SQL} SELECT event_type AS task, round(avg(value), 6) AS score, round(sum(sec)::DOUBLE, 6) AS seconds FROM ev GROUP BY 1")
def mean_of_tasks(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    return records.mean_of_tasks(e.select(F.col("event_type").alias("task"), F.col("value").alias("score"), F.col("sec").cast("double").alias("seconds")))


@query("label_accuracy", f"WITH {EVENTS_SQL} SELECT event_type AS qa_type, count(*) AS n, round(avg((event_id % 3 <> 0)::INT::DOUBLE), 6) AS accuracy FROM ev WHERE event_type IN ('purchase', 'click') GROUP BY 1")
def label_accuracy(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    x = e.select(F.col("event_type").alias("qa_type"), F.when(F.col("event_id") % 3 == 0, "cutting").otherwise("  Grasping  tissue ").alias("prediction"), F.lit("grasping tissue").alias("gold"))
    return records.label_accuracy(x, ["purchase", "click"])


@query("fill_to_k", f"WITH {EVENTS_SQL}, r AS (SELECT user_id, event_id, value, event_type FROM ev), p AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS pr, CASE WHEN event_type = 'purchase' THEN event_id::DOUBLE ELSE -value END AS o FROM r) SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY pr, o, event_id) AS rank FROM p) WHERE rank <= 5")
def fill_to_k(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    selected = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("place"))
    out = records.fill_to_k(selected, e.select("user_id", "event_id", F.col("value").alias("score")), "user_id", "event_id", 5)
    return out.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("merged_passages", r"""WITH p AS (SELECT conv_id AS query_id, turn AS ordinal, role || chr(10) || text AS text FROM conversations WHERE text IS NOT NULL) SELECT query_id, min(ordinal) AS ordinal, md5(string_split(text, chr(10))[1] || chr(10) || string_agg(substring(text, instr(text, chr(10)) + 1), chr(10) ORDER BY ordinal, substring(text, instr(text, chr(10)) + 1)) FILTER (substring(text, instr(text, chr(10)) + 1) <> '')) AS text_md5 FROM p GROUP BY query_id, string_split(text, chr(10))[1]""")
def merged_passages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    p = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ordinal"), F.concat_ws("\n", "role", "text").alias("text"))
    return records.merged_passages(p).select("query_id", "ordinal", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("context_format", f"WITH {EVENTS_SQL} SELECT d, md5(string_agg(event_type || ' ' || event_id, chr(10) || chr(10) ORDER BY sec, event_id)) AS context_md5 FROM ev GROUP BY d")
def context_format(spark, sf_dir):
    e = clock_events(spark, sf_dir).withColumn("t", F.concat_ws(" ", "event_type", "event_id"))
    return records.context_text(e, "d", ["sec", "event_id"], "t").select("d", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query("graph_repair", f"WITH {FACTS_SQL}, v AS (SELECT DISTINCT s AS id FROM facts), e AS (SELECT s AS src, o AS dst FROM facts WHERE s <> o) SELECT (SELECT count(*) FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)) AS valid, (SELECT count(*) FROM e WHERE dst NOT IN (SELECT id FROM v)) AS unknown")
def graph_repair(spark, sf_dir):
    f = star_facts(spark, sf_dir)
    valid, unknown, _ = records.added_vertices(f.select(F.col("s").alias("id")).distinct(), f.select(F.col("s").alias("src"), F.col("o").alias("dst")))
    return valid.agg(F.count(F.lit(1)).alias("valid")).join(F.broadcast(unknown.agg(F.count(F.lit(1)).alias("unknown"))))


@query("kept_ids", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def scan_kept_ids(spark, sf_dir):
    return kept_ids(table(spark, sf_dir, "events").withColumnRenamed("event_type", "duration"), "user_id", "purchase")


@query("global_sort_top", f"WITH {EVENTS_SQL} SELECT event_id, d, sec FROM ev ORDER BY d, sec, event_id LIMIT 100")
def global_sort_top(spark, sf_dir):
    return clock_events(spark, sf_dir).select("event_id", "d", "sec").orderBy("d", "sec", "event_id").limit(100)


@query("distinct_facts", f"WITH {FACTS_SQL} SELECT DISTINCT s, p, o, 'fact-' || md5('[\"' || s || '\",\"' || p || '\",\"' || o || '\"]') AS fact_id FROM facts")
def distinct_facts(spark, sf_dir):
    return star_facts(spark, sf_dir).select("s", "p", "o").distinct().withColumn("fact_id", tx.fact_id(F.col("s"), F.col("p"), F.col("o")))


@query("distinct_entities", f"WITH {FACTS_SQL} SELECT DISTINCT unnest([s, o]) AS entity FROM facts")
def distinct_entities(spark, sf_dir):
    return star_facts(spark, sf_dir).select(F.explode(F.array("s", "o")).alias("entity")).distinct()


@query("inline_choices", "SELECT conv_id * 1000 + turn AS id, 'one ' || conv_id AS a, 'four' AS d FROM conversations WHERE turn % 2 = 0")
def inline_choices(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Which is it? (A) one "), F.col("conv_id").cast("string"), F.lit(" (B) two (C) three (D) four"))).otherwise("Which? (A) one (C) three (B) two")
    x = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tx.inline_choices(q).alias("m")).filter("m is not null")
    return x.select("id", F.element_at("m", "A").alias("a"), F.element_at("m", "D").alias("d"))


@query("task_buckets", f"WITH {EVENTS_SQL} SELECT CASE WHEN starts_with(event_type, 'p') THEN 'P' WHEN starts_with(event_type, 'c') THEN 'C' ELSE 'other' END AS bucket, count(*) AS n FROM ev GROUP BY 1")
def task_buckets(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    return e.groupBy(tx.task_bucket(F.col("event_type"), {"p": "P", "c": "C"}).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("frame_sampling", f"WITH {EVENTS_SQL} SELECT event_id, len(list_distinct(list_transform(range(n), lambda i: floor(i * (total - 1) / (n - 1))::BIGINT))) AS frames, ceil((30 + event_id % 40) / 7.0)::BIGINT AS seconds, least(64, floor((30 + event_id % 40) * 2.0)::BIGINT + 1) AS times FROM (SELECT event_id, 300 + event_id % 500 AS total, greatest(2, least(32, floor((300 + event_id % 500) / 25.0 * 1.0)::INT)) AS n FROM ev)")
def frame_sampling(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    total, length = 300 + F.col("event_id") % 500, (30 + F.col("event_id") % 40).cast("double")
    return e.select("event_id", F.size(frame_indices(total, F.lit(25.0), 1.0, 32)).cast("long").alias("frames"), F.size(segment_seconds(F.lit(0.0), length, 7.0)).cast("long").alias("seconds"), F.size(frame_times(F.lit(0.0), length, F.lit(500.0), 2.0, 64)).cast("long").alias("times"))


@query("last_assistant_turn", "SELECT conv_id, max_by(md5(text), turn) FILTER (role = 'assistant') AS text_md5 FROM conversations GROUP BY conv_id")
def last_assistant_turn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text"))).alias("turns"))
    return t.select("conv_id", F.md5(tx.last_turn(F.col("turns"), "assistant").cast("binary")).alias("text_md5"))


@query("consolidation_reduction", f"WITH {FACTS_SQL} SELECT (SELECT count(*) FROM facts) AS n_before, (SELECT count(*) FROM (SELECT DISTINCT s, o FROM facts)) AS n_after, round(1 - (SELECT count(*) FROM (SELECT DISTINCT s, o FROM facts)) / (SELECT count(*) FROM facts)::DOUBLE, 6) AS removed")
def consolidation_reduction(spark, sf_dir):
    f = star_facts(spark, sf_dir)
    return records.reduction(f, f.select("s", "o").distinct())


_LETTERS = lambda t: "[" + ", ".join(f"(length(lower({t})) - length(replace(lower({t}), '{c}', '')))::DOUBLE" for c in "abcdefghilmnorst") + "]"


@query(
    "dense_retrieval",
    f"""WITH q AS (SELECT item_id AS query_id, {_LETTERS("coalesce(text, '')")} AS v FROM benchmark), p AS (SELECT doc_id AS key_id, {_LETTERS("coalesce(text, '')")} AS v FROM documents),
    x AS (SELECT query_id, key_id, CASE WHEN list_sum(q.v) = 0 OR list_sum(p.v) = 0 THEN 0 ELSE round(list_cosine_similarity(q.v, p.v), 6) END AS score FROM q, p),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM x QUALIFY rank <= 5)
    SELECT query_id, key_id, rank, score, CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 4) ELSE 1 END AS norm FROM r WINDOW w AS (PARTITION BY query_id)""",
)
def dense_retrieval(spark, sf_dir):
    from mnemospark.functions.providers import LetterEmbedder
    from mnemospark.plans.extraction import dense_retrieve

    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.coalesce("text", F.lit("")).alias("content"))
    found = dense_retrieve(q, p, LetterEmbedder(), 5)
    return found.select("query_id", "key_id", F.col("rank").cast("long").alias("rank"), "score", F.round("norm", 4).alias("norm"))
