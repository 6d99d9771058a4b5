"""Queries over evaluation logs, answers, rankings and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.functions import vectors as vec
from mnemospark.operators import evallog, metrics
from mnemospark.operators.segmented import prefix
from mnemospark.operators.similarity import top_k_join
from mnemospark.plans.registry import query
from mnemospark.plans.tables import EVENTS_SQL, clock_events, table

# events as a log: the key is the user, the sequence the event; purchases are successes, errors have no answer.
_LOG = f"""{EVENTS_SQL}, log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'error' END AS status,
  CASE WHEN event_id % 11 = 0 THEN 'Unable to generate answer' WHEN event_id % 13 = 0 THEN ' ' ELSE chr((65 + event_id % 4)::INT) END AS answer, value FROM ev),
last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"""
_OK = "(status = 'success' AND trim(answer) <> '' AND trim(answer) <> 'Unable to generate answer')"
_QUESTIONS = "questions AS (SELECT c_custkey AS key FROM customer)"


def _log(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    answer = F.when(F.col("event_id") % 11 == 0, tx.NO_ANSWER).when(F.col("event_id") % 13 == 0, " ").otherwise(F.chr(65 + F.col("event_id") % 4))
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "success").otherwise("error").alias("status"), answer.alias("answer"), "value")


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))


def _ok():
    return evallog.successful(F.col("status"), F.col("answer"))


@query("latest_record_wins", f"WITH {_LOG} SELECT key, seq, status, answer, round(value, 6) AS value FROM last")
def latest_record_wins(spark, sf_dir):
    return evallog.latest(_log(spark, sf_dir), "key", "seq").select("key", "seq", "status", "answer", F.round("value", 6).alias("value"))


@query("pending_questions", f"WITH {_LOG}, {_QUESTIONS} SELECT key FROM questions WHERE key NOT IN (SELECT key FROM last WHERE {_OK})")
def pending_questions(spark, sf_dir):
    return evallog.pending(_questions(spark, sf_dir), _log(spark, sf_dir), "key", "seq", _ok())


@query("merge_with_missing", f"WITH {_LOG}, {_QUESTIONS} SELECT q.key, coalesce(status, 'missing') AS status, answer FROM questions q LEFT JOIN last USING (key)")
def merge_with_missing(spark, sf_dir):
    return evallog.merged(_questions(spark, sf_dir), _log(spark, sf_dir), "key", "seq").select("key", "status", "answer")


@query("completion_counts", f"WITH {_LOG}, {_QUESTIONS}, m AS (SELECT q.key, coalesce(status, 'missing') AS status, coalesce({_OK}, false) AS ok FROM questions q LEFT JOIN last USING (key)) SELECT count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok AND status <> 'missing') AS error, count(*) FILTER (status = 'missing') AS missing, count(*) AS total FROM m")
def completion_counts(spark, sf_dir):
    return evallog.completion_counts(evallog.merged(_questions(spark, sf_dir), _log(spark, sf_dir), "key", "seq"), _ok())


@query(
    "report_rollup",
    f"""WITH {EVENTS_SQL}, r AS (SELECT event_type AS task, event_id % 3 = 0 AS evaluate, event_id % 5 <> 0 AS completed, event_id % 4 AS num_rounds, user_id AS total_tokens, (event_id % 7)::DOUBLE AS elapsed_seconds FROM ev)
    SELECT coalesce(task, 'Overall') AS task, sum(completed::INT)::BIGINT::VARCHAR || '/' || count(*)::VARCHAR AS completed, round(100 * avg(evaluate::INT), 1) AS accuracy, round(avg(num_rounds), 1) AS avg_rounds, round(avg(total_tokens), 1) AS avg_tokens, round(avg(elapsed_seconds), 1) AS avg_seconds FROM r GROUP BY ROLLUP (task)""",
)
def report_rollup(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    r = e.select(F.col("event_type").alias("task"), (F.col("event_id") % 3 == 0).alias("evaluate"), (F.col("event_id") % 5 != 0).alias("completed"), (F.col("event_id") % 4).alias("num_rounds"), F.col("user_id").alias("total_tokens"), (F.col("event_id") % 7).cast("double").alias("elapsed_seconds"))
    return evallog.report(r)


@query("multivalue_accuracy", "WITH x AS (SELECT unnest(string_split(lang || ';' || source, ';')) AS type, quality FROM documents JOIN labels USING (doc_id)) SELECT type, count(*) AS n, round(avg(quality::DOUBLE), 6) AS accuracy FROM x GROUP BY type")
def multivalue_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(";", "lang", "source").alias("types"))
    return evallog.multi_value_accuracy(d.join(table(spark, sf_dir, "labels"), "doc_id"), "types", "quality")


@query("token_usage_totals", f"WITH {EVENTS_SQL}, x AS (SELECT event_type, event_id % 100 AS before, user_id AS after, d <= 10 AS indexing FROM ev) SELECT event_type, indexing, sum(greatest(0, after - before))::BIGINT AS tokens, sum(after)::BIGINT AS total FROM x GROUP BY ALL")
def token_usage_totals(spark, sf_dir):
    x = clock_events(spark, sf_dir).select("event_type", (F.col("event_id") % 100).alias("before"), F.col("user_id").alias("after"), (F.col("d") <= 10).alias("indexing"))
    return x.groupBy("event_type", "indexing").agg(F.sum(F.greatest(F.lit(0), F.col("after") - F.col("before"))).alias("tokens"), F.sum("after").alias("total"))


@query("questions_by_video", f"WITH {EVENTS_SQL} SELECT user_id, count(*) AS questions, max(d * 100000 + sec) AS last_time FROM ev GROUP BY user_id")
def questions_by_video(spark, sf_dir):
    return clock_events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("questions"), F.max(F.col("d") * 100000 + F.col("sec")).alias("last_time"))


@query("manifest_select", "WITH m AS (SELECT row_number() OVER (ORDER BY item_id DESC) AS ordinal, item_id AS doc_id FROM benchmark) SELECT ordinal, doc_id, lang FROM m JOIN documents USING (doc_id)")
def manifest_select(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    m = prefix(b, [], [F.desc("item_id")]).select((F.col("position") + 1).alias("ordinal"), F.col("item_id").alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return evallog.select_manifest(d, m.join(d.select("doc_id"), "doc_id", "left_semi"), "doc_id").select("ordinal", "doc_id", "lang")


_QA_NORM = lambda c: f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
_TURNS = "t AS (SELECT conv_id * 1000 + turn AS id, text AS pred, lead(text) OVER w AS g1, lag(text) OVER w AS g2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))"


def _turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("pred"), F.lead("text").over(w).alias("g1"), F.lag("text").over(w).alias("g2"))


@query("qa_exact_match", f"WITH {_TURNS} SELECT id, pred_n, coalesce(max((pred_n = gold)::INT), 0) AS em FROM (SELECT id, {_QA_NORM('pred')} AS pred_n, {_QA_NORM('g')} AS gold FROM (SELECT id, pred, unnest([coalesce(g1, ''), coalesce(g2, pred)]) AS g FROM t)) GROUP BY id, pred_n")
def qa_exact_match(spark, sf_dir):
    t = _turns(spark, sf_dir)
    gold = F.array(F.coalesce("g1", F.lit("")), F.coalesce("g2", "pred"))
    return t.select("id", tx.qa_normalise(F.col("pred")).alias("pred_n"), metrics.exact_match(F.col("pred"), gold).alias("em")).groupBy("id", "pred_n").agg(F.max("em").alias("em"))


@query(
    "qa_token_f1",
    f"""WITH {_TURNS}, g AS (SELECT id, 1 AS k, {_QA_NORM('pred')} AS p, {_QA_NORM("coalesce(g1, '')")} AS g FROM t WHERE pred IS NOT NULL UNION ALL SELECT id, 2, {_QA_NORM('pred')}, {_QA_NORM('coalesce(g2, pred)')} FROM t WHERE pred IS NOT NULL),
    s AS (SELECT id, k, list_filter(string_split(p, ' '), lambda x: x <> '') AS p, list_filter(string_split(g, ' '), lambda x: x <> '') AS g FROM g),
    f AS (SELECT id, len(p) + len(g) AS both_n, coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS same FROM s)
    SELECT id, round(max(CASE WHEN same = 0 THEN 0 ELSE 2.0 * same / both_n END), 6)::DOUBLE AS f1 FROM f GROUP BY id""",
)
def qa_token_f1(spark, sf_dir):
    t = _turns(spark, sf_dir).filter("pred is not null").withColumn("gold", F.array(F.coalesce("g1", F.lit("")), F.coalesce("g2", "pred")))
    return metrics.token_f1(t, "id", "pred", "gold").select("id", F.round("f1", 6).alias("f1"))


@query("kg_text_normalise", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^A-Za-z0-9 ]', ' ', 'g'), ' ')) AS norm_md5, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) > 2 AS long_enough FROM documents")
def kg_text_normalise(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(tx.kg_normalise(F.col("text")).cast("binary")).alias("norm_md5"), (tx.alphanumerics(F.col("text")) > 2).alias("long_enough"))


@query(
    "choice_letter_extract",
    r"""WITH x AS (SELECT conv_id * 1000 + turn AS id, CASE turn % 4 WHEN 0 THEN 'The answer is (' || chr((65 + conv_id % 4)::INT) || ').' WHEN 1 THEN chr((65 + conv_id % 4)::INT) || '. because' WHEN 2 THEN 'answer: A, no, answer: D' ELSE text END AS r FROM conversations),
    y AS (SELECT id, regexp_extract_all(r, '(?i)answer\s*(?:is|:)?\s*:?\s*\(?([A-D])\b', 1) AS marked, regexp_extract(r, '^\s*\(?([A-Da-d])(?:[).:,\s]|$)', 1) AS first, regexp_replace(lower(trim(r)), '[.,)]+$', '') AS normal, regexp_replace(r, '^\s*[A-Z][.)]\s*', '') AS bare FROM x)
    SELECT id, upper(CASE WHEN len(marked) > 0 THEN marked[len(marked)] WHEN first <> '' THEN first END) AS letter, md5(normal) AS normal_md5, md5(bare) AS bare_md5 FROM y""",
)
def choice_letter_extract(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    letter = F.chr(65 + F.col("conv_id") % 4)
    r = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("The answer is ("), letter, F.lit(")."))).when(F.col("turn") % 4 == 1, F.concat(letter, F.lit(". because"))).when(F.col("turn") % 4 == 2, "answer: A, no, answer: D").otherwise(F.col("text"))
    x = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), r.alias("r"))
    return x.select("id", tx.leading_letter(F.col("r")).alias("letter"), F.md5(tx.answer_normalise(F.col("r")).cast("binary")).alias("normal_md5"), F.md5(tx.strip_option(F.col("r")).cast("binary")).alias("bare_md5"))


@query("percentile_by_index", "WITH x AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL) SELECT p::DOUBLE AS p, min(v) AS value FROM x, (SELECT unnest([0.0, 0.25, 0.5, 0.9, 1.0]) AS p) WHERE i = floor(p * (n - 1)) GROUP BY p")
def percentile_by_index(spark, sf_dir):
    return metrics.percentile_by_index(table(spark, sf_dir, "documents"), "n_chars", [0.0, 0.25, 0.5, 0.9, 1.0])


@query("frequency_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def frequency_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("duration_buckets", f"WITH {EVENTS_SQL} SELECT CASE WHEN value < 30 THEN 'short' WHEN value <= 300 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY 1")
def duration_buckets(spark, sf_dir):
    return clock_events(spark, sf_dir).groupBy(tx.duration_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("segment_keys", "SELECT page_id, substring(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 80) || '-' || substring(sha1(CASE WHEN page_id % 2 = 0 THEN url || '#rc:[1.0, 2.5]' ELSE url END), 1, 8) AS key FROM pages")
def segment_keys(spark, sf_dir):
    box = tx.box_signature(F.when(F.col("page_id") % 2 == 0, "f1.jpg"), F.array(F.lit(1.0), F.lit(2.5)))
    return table(spark, sf_dir, "pages").select("page_id", tx.segment_key(F.col("url"), box).alias("key"))


@query("score_pivot", f"WITH {EVENTS_SQL}, s AS (SELECT d % 10 AS dataset, event_type, value FROM ev) SELECT dataset, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase, round(avg(value) FILTER (event_type = 'click'), 6) AS click FROM s GROUP BY dataset")
def score_pivot(spark, sf_dir):
    from mnemospark.sources.sinks import score_matrix

    s = clock_events(spark, sf_dir).select((F.col("d") % 10).alias("dataset"), F.col("event_type").alias("experiment"), F.col("value").alias("score"))
    return score_matrix(s, ["purchase", "click"])


@query("decision_parse", """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok {"decision": "Search", "memory_type": "Episodic", "search_query": "q' || user_id || '"} end' WHEN 1 THEN '{"decision": "answer"}' WHEN 2 THEN 'no json' ELSE '{"memory_type": "visual"}' END AS raw FROM events), y AS (SELECT event_id, nullif(regexp_extract(raw, '(?s)(\\{.*\\})', 1), '') AS j FROM x)
    SELECT event_id, CASE WHEN lower(coalesce(json_extract_string(j, '$.decision'), 'answer')) = 'search' THEN 'search' ELSE 'answer' END AS decision, lower(json_extract_string(j, '$.memory_type')) AS memory_type, json_extract_string(j, '$.search_query') AS search_query FROM y""")
def decision_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('ok {"decision": "Search", "memory_type": "Episodic", "search_query": "q'), F.col("user_id").cast("string"), F.lit('"} end'))).when(k == 1, '{"decision": "answer"}').when(k == 2, "no json").otherwise('{"memory_type": "visual"}')
    return e.select("event_id", tx.decision(raw).alias("d")).select("event_id", "d.*")


# Rankings: every vector id divisible by 20 asks all vectors; those of its label are relevant.
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
_RANKED = f"""e AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings),
ranked AS (SELECT q.vec_id AS query_id, k.vec_id AS doc_id, round(list_cosine_similarity(q.v, k.v), 6) AS score, q.label = k.label AS hit,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, k.v), 6) DESC, k.vec_id) AS rank FROM e q JOIN e k ON q.vec_id <> k.vec_id WHERE q.vec_id % 20 = 0),
n AS (SELECT query_id, count(*) FILTER (hit) AS n_rel FROM ranked GROUP BY 1)"""


def _ranked(spark, sf_dir, most):
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), v.alias("vector"))
    k = e.select(F.col("vec_id").alias("key_id"), v.alias("vector"))
    r = top_k_join(q, k, most, skip_self=True).withColumnRenamed("key_id", "doc_id")
    lab = e.select("vec_id", "label")
    labels = lab.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(lab.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("query_id <> doc_id").select("query_id", "doc_id", F.lit(1.0).alias("rel"))
    return r, labels


@query("retrieval_recall_at_k", f"WITH {_RANKED}, ks AS (SELECT unnest([1, 2, 5, 10, 20]) AS k), r AS (SELECT query_id, k, CASE WHEN n_rel = 0 THEN 1.0 ELSE count(*) FILTER (hit AND rank <= k) / n_rel::DOUBLE END AS recall FROM ranked JOIN n USING (query_id), ks GROUP BY query_id, k, n_rel) SELECT k, round(avg(recall), 4) AS recall FROM r GROUP BY k")
def retrieval_recall_at_k(spark, sf_dir):
    r, labels = _ranked(spark, sf_dir, 20)
    m = metrics.cut_metrics(r, labels, [1, 2, 5, 10, 20])
    return m.groupBy("k").agg(F.round(F.avg("recall"), 4).alias("recall"))


@query(
    "ranking_precision_recall_hit_f1",
    f"""WITH {_RANKED}, ks AS (SELECT unnest([1, 5, 10]) AS k), x AS (SELECT query_id, k, n_rel, count(*) FILTER (hit AND rank <= k) AS f FROM ranked JOIN n USING (query_id), ks GROUP BY ALL), y AS (SELECT query_id, k, f / k::DOUBLE AS p, CASE WHEN n_rel = 0 THEN 1.0 ELSE f / n_rel::DOUBLE END AS r, (f > 0)::INT::DOUBLE AS hit FROM x)
    SELECT query_id, k, round(p, 6) AS "precision", round(r, 6)::DOUBLE AS recall, hit, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM y""",
)
def ranking_precision_recall_hit_f1(spark, sf_dir):
    r, labels = _ranked(spark, sf_dir, 10)
    m = metrics.cut_metrics(r, labels, [1, 5, 10])
    return m.select("query_id", "k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "hit", F.round("f1", 6).alias("f1"))


@query(
    "ranking_map_mrr",
    f"""WITH {_RANKED}, c AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM ranked), ks AS (SELECT unnest([1, 5, 10]) AS k)
    SELECT query_id, k, round(CASE WHEN n_rel = 0 THEN 0 ELSE coalesce(sum(hits / rank::DOUBLE) FILTER (hit AND rank <= k), 0) / least(n_rel, k) END, 6)::DOUBLE AS ap, round(coalesce(1.0 / min(rank) FILTER (hit AND rank <= k), 0), 6)::DOUBLE AS mrr FROM c JOIN n USING (query_id), ks GROUP BY query_id, k, n_rel""",
)
def ranking_map_mrr(spark, sf_dir):
    r, labels = _ranked(spark, sf_dir, 10)
    return metrics.cut_metrics(r, labels, [1, 5, 10]).select("query_id", "k", F.round("ap", 6).alias("ap"), F.round("mrr", 6).alias("mrr"))


@query(
    "ranking_ndcg",
    f"""WITH {_RANKED}, ks AS (SELECT unnest([1, 5, 10]) AS k), x AS (SELECT query_id, k, n_rel, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= k), 0) AS dcg FROM ranked JOIN n USING (query_id), ks GROUP BY ALL)
    SELECT query_id, k, round(CASE WHEN n_rel = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(n_rel, k)::BIGINT + 1), lambda i: 1 / log2(i + 1))) END, 6)::DOUBLE AS ndcg FROM x""",
)
def ranking_ndcg(spark, sf_dir):
    r, labels = _ranked(spark, sf_dir, 10)
    return metrics.cut_metrics(r, labels, [1, 5, 10]).select("query_id", "k", F.round("ndcg", 6).alias("ndcg"))


@query("qrels_max_positive", "WITH q AS (SELECT doc_id % 50 AS query_id, doc_id // 3 AS doc_id, (quality + toxic - 0.5 * (doc_id % 3))::DOUBLE AS score FROM documents JOIN labels USING (doc_id)) SELECT query_id, doc_id, max(score) AS score FROM q WHERE score > 0 GROUP BY ALL")
def qrels_max_positive(spark, sf_dir):
    q = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    q = q.select((F.col("doc_id") % 50).alias("query_id"), F.floor(F.col("doc_id") / 3).alias("key"), (F.col("quality") + F.col("toxic") - 0.5 * (F.col("doc_id") % 3)).cast("double").alias("score")).withColumnRenamed("key", "doc_id")
    return metrics.max_positive(q)


@query("vector_topk_cosine", f"WITH {_RANKED} SELECT query_id, doc_id AS vec_id, label, score FROM ranked JOIN embeddings ON vec_id = doc_id WHERE rank <= 10")
def vector_topk_cosine(spark, sf_dir):
    """The ten vectors most like each asked one, and the same for the first of them by the search for one vector."""
    from mnemospark.operators.similarity import top_k

    e = table(spark, sf_dir, "embeddings")
    near = _ranked(spark, sf_dir, 10)[0].join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    found = near.select("query_id", F.col("doc_id").alias("vec_id"), "label", "score")
    first = e.filter("vec_id % 20 = 0").select("embedding", "vec_id").orderBy("vec_id").first()
    one = top_k(e.filter(F.col("vec_id") != first.vec_id), list(first.embedding), 10).select(F.lit(first.vec_id).alias("query_id"), "vec_id", "label", "score")
    return found.filter(F.col("query_id") != first.vec_id).unionByName(one)


@query("vector_minmax_dense", f"WITH {_RANKED} SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 5) ELSE 1 END AS norm FROM (SELECT * FROM ranked WHERE rank <= 50) WINDOW w AS (PARTITION BY query_id)")
def vector_minmax_dense(spark, sf_dir):
    r, _ = _ranked(spark, sf_dir, 50)
    return vec.min_max(r, "score", ["query_id"], "norm").select("query_id", "doc_id", F.round("norm", 5).alias("norm"))


@query("similarity_join_top20", f"WITH e AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), x AS (SELECT q.vec_id AS query_id, k.vec_id AS key_id, round(list_cosine_similarity(q.v, k.v), 6) AS score FROM e q JOIN e k ON k.label >= 5 AND q.label < 5), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM x WHERE score >= 0.2) SELECT query_id, key_id, score, rank FROM y WHERE rank <= 20")
def similarity_join_top20(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    return top_k_join(e.filter("label < 5").select(F.col("vec_id").alias("query_id"), v), e.filter("label >= 5").select(F.col("vec_id").alias("key_id"), v), 20, 0.2).select("query_id", "key_id", "score", F.col("rank").cast("long").alias("rank"))


@query("knn_threshold_edges", f"WITH e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), x AS (SELECT q.vec_id AS src, k.vec_id AS dst, round(list_cosine_similarity(q.v, k.v), 6) AS weight FROM e q JOIN e k ON q.vec_id <> k.vec_id) SELECT src, dst, weight FROM x WHERE weight >= 0.25 QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 101")
def knn_threshold_edges(spark, sf_dir):
    from mnemospark.operators.graph import synonym_edges

    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    near = top_k_join(e.select(F.col("vec_id").alias("query_id"), v), e.select(F.col("vec_id").alias("key_id"), v), 2047, 0.25, skip_self=True, wanted=101)  # synonym_edges keeps the first 101
    return synonym_edges(near, 0.25)
