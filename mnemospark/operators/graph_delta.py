"""A fact graph that follows its documents by signed counts: a change costs its own facts, not the graph.

Facts are kept by chunk. What a set of chunks adds or takes away is a table of counts, positive or negative, over edges,
postings (which chunk names which phrase) and triples; it is appended to the count tables, whose reads add up and leave out what came to
nought. So an edge, a phrase or a triple goes with the last chunk that holds it, as a count of references would have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import written
from mnemospark.sources.versioned import VersionedTable


def signed(facts: DataFrame, sign: int | Column) -> dict[str, DataFrame]:
    """Counts that facts (chunk, s, p, o) bring (1) or take (-1)."""
    n = (F.lit(sign) if isinstance(sign, int) else sign).cast("long").alias("n")
    other = facts.filter("s <> o")
    edges = other.select(F.col("s").alias("src"), F.col("o").alias("dst"), n).unionByName(other.select(F.col("o").alias("src"), F.col("s").alias("dst"), n))
    return {
        "edges": edges,
        "postings": facts.select(F.explode(F.array("s", "o")).alias("entity"), "chunk", n),
        "triples": facts.select("s", "p", "o", n),
    }


class IncrementalGraph:
    """Tables facts, edges, postings and triples under one path; chunks are content-addressed, so one that is there is not added again."""

    def __init__(self, spark: SparkSession, path: str):
        self.facts = VersionedTable(spark, f"{path}/facts", "chunk string, s string, p string, o string, n bigint", ["chunk", "s", "p", "o"], "sum")
        self.edges = VersionedTable(spark, f"{path}/edges", "src string, dst string, n bigint", ["src", "dst"], "sum")
        self.postings = VersionedTable(spark, f"{path}/postings", "entity string, chunk string, n bigint", ["entity", "chunk"], "sum")
        self.triples = VersionedTable(spark, f"{path}/triples", "s string, p string, o string, n bigint", ["s", "p", "o"], "sum")

    def _apply(self, facts: DataFrame, sign: int, mark: tuple[str, int] | None) -> None:
        """facts (chunk, s, p, o, n). The count tables come first: where a run dies between them, the same mark makes up for what is missing."""
        each = facts.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("_i", "n")
        for name, delta in signed(each, sign).items():
            getattr(self, name).append(delta, mark=mark)
        self.facts.append(facts.withColumn("n", F.col("n") * sign), mark=mark)

    def add(self, facts: DataFrame, mark: tuple[str, int] | None = None) -> None:
        """Adds chunks with all their facts (chunk, s, p, o); chunks that are there already stay as they are."""
        counted = facts.groupBy("chunk", "s", "p", "o").agg(F.count(F.lit(1)).alias("n"))
        known = self.facts.of_keys(counted).select("chunk").distinct()
        self._apply(written(counted.join(known, "chunk", "left_anti"), "added-facts"), 1, mark)

    def delete(self, chunks: DataFrame, mark: tuple[str, int] | None = None) -> DataFrame:
        """Takes chunks out; returns the phrases that no other chunk names: (entity)."""
        gone = written(self.facts.of_keys(chunks), "gone-facts")
        self._apply(gone, -1, mark)
        touched = gone.select(F.explode(F.array("s", "o")).alias("entity")).distinct()
        return touched.join(self.postings.of_keys(touched).select("entity").distinct(), "entity", "left_anti")

    def weights(self) -> DataFrame:
        """(src, dst, weight) of the graph as it stands."""
        return self.edges.read().select("src", "dst", F.col("n").cast("double").alias("weight"))

    def compact(self, most: int = 8) -> None:
        for t in (self.facts, self.edges, self.postings, self.triples):
            t.compact(most)
