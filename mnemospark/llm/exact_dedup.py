"""Exact dedup by a tree merge of sorted digest runs, DataFrame functions only.

Every document becomes one digest row (SHA-256, byte length, an independent 64-bit check). Each input partition belongs
to one of ``runs`` leaf runs: its rows are sorted by key and merged in order before anything moves, so one row leaves it
for each of its texts. Then come binomial rounds: run 2i+1 goes to run 2i, the pair's rows are sorted together and
merged in order by a sort aggregate, which keeps the winning identifier and the number of copies of each key. After
log2(runs) rounds the root run is left, and each document reads its group there.

A run lies in ``slices`` slices of the digest range, and partners meet slice by slice: tasks of a round are pairs of a run
and a slice, and the root is a sorted run in so many tasks, not one. The text never moves: a shuffle carries
about 60 bytes a row, and a text that a third of all rows share is one row of each leaf run. Verification is part of the
key: rows agree only if digest, length and check all do, at every level. Groups of very many copies are broadcast to
their documents at the end, a bounded number at any scale; the others meet theirs in a shuffle.

Defined results: null text counts as empty, so null and empty texts form one group. Repeated rows of one doc_id
share one decision. A null doc_id never wins against an id; a group with null ids only keeps all of them
(keep_id null). An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import join_by_size, text_of, written

KEY = ["digest", "n_bytes", "check64"]


def digest_rows(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(
        F.col("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check64"),
    )


def slice_of(slices: int) -> Column:
    """The slice of the digest range (its first 28 bits) that a key lies in."""
    return F.floor(F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("long") * slices / (1 << 28)).cast("int")


def tree_merge(leaves: DataFrame, runs: int, slices: int, keep) -> DataFrame:
    """One row for each key of leaves (doc_id, *KEY): keep_id, group_size."""
    # A struct as the winner's state: Spark then merges in sorted order (sort aggregate) instead of by a hash table.
    winner = lambda c: keep(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("id"))))
    by = ["run", "slice", *KEY]
    dealt = leaves.withColumns({"run": F.pmod(F.spark_partition_id(), F.lit(runs)), "slice": slice_of(slices)})
    level = dealt.groupBy(*by).agg(winner("doc_id")["id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    while runs > 1:
        met = level.withColumn("run", F.floor(F.col("run") / 2).cast("int")).repartition("run", "slice").sortWithinPartitions(*by)
        level = met.groupBy(*by).agg(winner("keep_id")["id"].alias("keep_id"), F.sum("group_size").alias("group_size"))
        runs = -(-runs // 2)
    return level.select(*KEY, "keep_id", "group_size")


def exact_dedup(docs: DataFrame, keep: str = "largest", runs: int = 16, slices: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    keep: 'largest' or 'smallest' doc_id of equal texts stays.
    """
    leaves = written(digest_rows(docs), "digests")
    root = written(tree_merge(leaves, runs, slices, {"largest": F.max, "smallest": F.min}[keep]), "digest-root")
    return join_by_size(leaves, root.withColumn("rows", F.col("group_size")), KEY, "rows").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
