"""Ranking and answer metrics as aggregates over ranked and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import qa_normalise


def judged(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """ranked (query_id, doc_id, rank) with rel (0 where not labelled) from labels (query_id, doc_id, rel)."""
    return ranked.join(labels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))


def cut_metrics(ranked: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """For each query and k: precision, recall (1 without labels), hit, f1, ap, mrr, ndcg linear and exponential.

    One pass: k is a small array exploded over ranked rows up to the largest k; running hits come from one window.
    """
    good = labels.filter("rel > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = good.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= max(ks)).groupBy("query_id").agg(F.sort_array(F.collect_list("rel"), asc=False).alias("ideal"))
    n = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel")).join(ideal, "query_id")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = judged(ranked.filter(F.col("rank") <= max(ks)), labels).withColumn("hit", (F.col("rel") > 0).cast("int"))
    j = j.withColumn("hits", F.sum("hit").over(w)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    log = F.log2(F.col("rank") + 1)
    per = j.groupBy("query_id", "k").agg(
        F.sum("hit").alias("found"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.col("rel") / log).alias("dcg"),
        F.sum((F.pow(F.lit(2.0), F.col("rel")) - 1) / log).alias("dcg_exp"),
    )
    x = per.join(n, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    gain = lambda f: F.aggregate(F.transform(F.slice("ideal", F.lit(1), F.col("k")), lambda r, i: f(r) / F.log2(i + 2)), F.lit(0.0), lambda a, b: a + b)
    p, r = F.col("found") / F.col("k"), F.when(F.col("n_rel") == 0, 1.0).otherwise(F.col("found") / F.col("n_rel"))
    some = lambda c: F.when(F.col("n_rel") > 0, c).otherwise(0.0)
    return x.select(
        "query_id",
        "k",
        p.alias("precision"),
        r.alias("recall"),
        (F.col("found") > 0).cast("double").alias("hit"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        some(F.col("ap_sum") / F.least("n_rel", "k")).alias("ap"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        some(F.col("dcg") / gain(lambda v: v)).alias("ndcg"),
        some(F.col("dcg_exp") / gain(lambda v: F.pow(F.lit(2.0), v) - 1)).alias("ndcg_exp"),
    )


def max_positive(qrels: DataFrame) -> DataFrame:
    """qrels without duplicates and non-positive scores; the highest score of a pair stays."""
    return qrels.filter("score > 0").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def exact_match(pred: Column, gold: Column) -> Column:
    """1 where the normalised prediction equals any normalised gold answer (an array)."""
    return F.exists(gold, lambda g: qa_normalise(g) == qa_normalise(pred)).cast("int")


def token_f1(rows: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """(key, f1): best multiset token overlap of pred with any of the gold answers (an array)."""
    each = rows.select(key, F.split(qa_normalise(F.col(pred)), " ").alias("p"), F.posexplode(gold).alias("g_no", "g")).withColumn("g", F.split(qa_normalise(F.col("g")), " "))
    each = each.withColumns({c: F.filter(c, lambda t: t != "") for c in ("p", "g")})
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    same = F.aggregate(F.array_intersect("p", "g"), F.lit(0), lambda s, t: s + F.least(count(F.col("p"), t), count(F.col("g"), t)))
    each = each.withColumn("same", same)
    f1 = F.when(F.col("same") == 0, 0.0).otherwise(2.0 * F.col("same") / (F.size("p") + F.size("g")))
    return each.groupBy(key).agg(F.max(f1).alias("f1"))


def percentile_by_index(df: DataFrame, value: str, ps: list[float], buckets: int = 1024) -> DataFrame:
    """(p, value): the element int(p * (n - 1)) of the sorted values, not interpolated.

    Equal values are counted first; counts of value ranges, a fixed number of rows, tell which range holds each place, and
    only those ranges are sorted, apart from each other.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("n"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / buckets).otherwise(1.0)
    placed = counts.join(F.broadcast(ends)).withColumn("b", F.floor((F.col("v") - F.col("low")) / width))  # ends: one row
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.groupBy("b", "n").agg(F.sum("c").alias("own")).withColumn("upto", F.sum("own").over(w))
    asked = ranges.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("at", F.floor(F.col("p") * (F.col("n") - 1)))
    here = asked.filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("own") <= F.col("at"))).select("p", "b", "at", (F.col("upto") - F.col("own")).alias("before"))
    inside = placed.select("b", "v", "c").join(F.broadcast(here), "b")  # here: one row for each p
    run = inside.withColumn("run", F.col("before") + F.sum("c").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter(F.col("run") > F.col("at")).groupBy("p").agg(F.min("v").alias("value"))
