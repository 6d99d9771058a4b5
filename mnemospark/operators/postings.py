"""Inverted indexes: for each key the set of items that it occurs in, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.joins import join_by_size


def postings(pairs: DataFrame, keys: list[str], item: str, block: int = 4096) -> DataFrame:
    """(keys, n, block, items): the distinct items of each key, sorted, with their number over all blocks.

    A key of more than block items has several rows, its items dealt to them by hash, so no row and no task holds an unbounded set.
    """
    once = pairs.select(*keys, F.col(item).alias("item")).distinct()
    sizes = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dealt = join_by_size(once, sizes.withColumn("size", F.col("n")), keys, "size").withColumn("block", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / block)))
    return dealt.groupBy(*keys, "n", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))


def whole(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, items): the blocks of each key as one sorted list, for readers that want a row a key; such a row is as long as its set."""
    return blocks.groupBy(*keys, "n").agg(F.sort_array(F.flatten(F.collect_list("items"))).alias("items"))


def entity_chunk_sets(facts: DataFrame, **how) -> DataFrame:
    """The chunks of each phrase of facts (chunk, s, p, o)."""
    return postings(facts.select("chunk", F.explode(F.array("s", "o")).alias("entity")), ["entity"], "chunk", **how)


def fact_documents(facts: DataFrame, **how) -> DataFrame:
    """The chunks that state each fact."""
    return postings(facts, ["s", "p", "o"], "chunk", **how)
