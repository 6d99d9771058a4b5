"""Consolidation of facts over time slices: a fold whose steps are set-based joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.similarity import top_k_join
from mnemospark.session import shared_dir, written

#: How many known triples a new one is shown, and how alike they must be.
TOP, LEAST = 20, 0.6

TRIPLES = ["triple_id", "s", "p", "o", "evidence"]


def step(known: DataFrame, new: DataFrame, embed: Callable[[DataFrame], DataFrame], decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """known after one slice: new triples are matched against known ones only, never each other.

    known, new: TRIPLES. embed: (id, s, p, o) -> (id, vector). decide: rows (triple_id, s, p, o, related
    array<struct<triple_id, s, p, o>>) -> (triple_id, s, p, o, removed array<long>): the updated triple and the related
    ones that it replaces; ids that are not among the related do not count. Removal is by value: all copies of a
    removed triple go, and their evidence moves to the new one.
    """
    vec = lambda df, name: embed(df.select(F.col("triple_id").alias("id"), "s", "p", "o")).select(F.col("id").alias(name), "vector")
    near = top_k_join(vec(new, "query_id"), vec(known, "key_id"), TOP, LEAST)
    told = known.select(F.col("triple_id").alias("key_id"), F.struct(*TRIPLES[:4]).alias("t"), "evidence")
    related = near.join(told, "key_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "t"))).alias("r"))
    asked = written(new.join(related, new["triple_id"] == related["query_id"]).select(*TRIPLES[:4], F.transform("r", lambda x: x["t"]).alias("related")), "asked")
    decided = written(decide(asked), "decisions")
    valid = decided.join(asked.select("triple_id", "related"), "triple_id").select("triple_id", F.explode(F.filter("related", lambda t: F.array_contains(F.col("removed"), t["triple_id"]))).alias("t"))
    gone = valid.select("triple_id", "t.s", "t.p", "t.o").distinct()
    moved = known.join(gone.withColumnRenamed("triple_id", "by"), ["s", "p", "o"]).groupBy("by").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("more"))
    stay = known.join(gone.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")
    updated = new.join(decided.select("triple_id", *[F.col(c).alias(f"new_{c}") for c in "spo"]), "triple_id", "left").join(moved, new["triple_id"] == moved["by"], "left")
    fresh = updated.select(
        "triple_id",
        *[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) for c in "spo"],
        F.array_union("evidence", F.coalesce("more", F.array().cast("array<string>"))).alias("evidence"),
    )
    return stay.select(*TRIPLES).unionByName(fresh)


def fold(slices: DataFrame, embed, decide) -> DataFrame:
    """(snapshot_ts, TRIPLES) after every slice of slices (snapshot_ts, TRIPLES).

    Slices follow each other in time, so the driver steps through them; each step is a distributed job over its slice
    and the state. Slices are written by time first, so a step reads its own only, and each state is written to a folder of its time;
    the result is one scan of those folders.
    """
    spark = slices.sparkSession
    root = f"{shared_dir(spark)}/fold-{uuid.uuid4().hex}"
    slices.select("snapshot_ts", *TRIPLES).write.partitionBy("snapshot_ts").parquet(f"{root}/in")
    whole = spark.read.schema(slices.select(*TRIPLES, "snapshot_ts").schema).parquet(f"{root}/in")
    known = None
    for (ts,) in whole.select("snapshot_ts").distinct().orderBy("snapshot_ts").collect():
        new = whole.filter(F.col("snapshot_ts") == ts).select(*TRIPLES)
        path = f"{root}/out/snapshot_ts={ts}"
        (new if known is None else step(known, new, embed, decide)).select(*TRIPLES).write.parquet(path)
        known = spark.read.schema(new.schema).parquet(path)
    if known is None:
        return slices.select(*TRIPLES, "snapshot_ts")
    return spark.read.schema(whole.schema).parquet(f"{root}/out")
