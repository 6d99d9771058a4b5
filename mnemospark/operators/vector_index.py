"""An approximate vector index: cells around centroids of a sample; every vector is in a cell, searches probe a few.

Centroids come from at most ``sample`` vectors, picked by a hash of the id, so building them is bounded; all vectors are
then dealt to the nearest centroid's cell in one pass. A search sends each query to its nearest cells and compares
exactly inside them, a block of a cell at a time, so a large cell is several tasks. ``recall`` compares with the exact search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.similarity import best_pairs, top_k_join


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def centroids(keys: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most cells unit vectors, by spherical k-means over a bounded sample of keys (key_id, vector)."""
    few = keys.orderBy(F.xxhash64("key_id", F.lit(seed)), "key_id").limit(sample).select("vector").collect()
    if not few:
        return np.zeros((0, 0))
    x = _unit(np.array([r.vector for r in few], np.float64))
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def dealt_to_cells(rows: DataFrame, key: str, c: np.ndarray, probes: int) -> DataFrame:
    """(key, vector, cell): each row once for each of its probes nearest cells."""
    packed = rows.sparkSession.sparkContext.broadcast(c)  # cells by dimensions

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
            near = np.argsort(-(x @ packed.value.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[key, "vector", "cells"])

    return rows.select(key, "vector").mapInArrow(run, f"{key} long, vector array<double>, cells array<int>").select(key, "vector", F.explode("cells").alias("cell"))


def build(keys: DataFrame, cells: int = 64, sample: int = 20_000) -> tuple[np.ndarray, DataFrame]:
    """(centroids, rows of all keys with their cell)."""
    c = centroids(keys, cells, sample)
    return c, dealt_to_cells(keys, "key_id", c, 1)


def search(index: tuple[np.ndarray, DataFrame], queries: DataFrame, k: int, probes: int = 8, block: int = 20_000, skip_self: bool = False) -> DataFrame:
    """(query_id, key_id, score, rank) like top_k_join, over the probes nearest cells of each query."""
    c, indexed = index
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = indexed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("key_id"), F.col("blocks")).cast("int"))  # sizes: one row a cell
    asks = dealt_to_cells(queries, "query_id", c, min(probes, max(1, len(c)))).join(F.broadcast(sizes), "cell")
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda df, n, key: df.select("cell", "block", F.lit(n).alias("side"), F.col(key).alias("id"), "vector")
    both = side(asks, 0, "query_id").unionByName(side(dealt, 1, "key_id"))
    partial = both.groupBy("cell", "block").applyInArrow(best_pairs(k, None, skip_self), "query_id long, key_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, queries: DataFrame, keys: DataFrame, k: int, skip_self: bool = False) -> float:
    """The share of the exact k best that found holds."""
    exact = top_k_join(queries, keys, k, skip_self=skip_self).select("query_id", "key_id")
    hit, n = exact.join(found.select("query_id", "key_id").withColumn("hit", F.lit(1)), ["query_id", "key_id"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return hit / n if n else 1.0
