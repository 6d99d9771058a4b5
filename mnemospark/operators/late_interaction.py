"""Late-interaction retrieval: rows are lists of vectors, a query's score is the sum of its vectors' best dot products in a row.

Queries and rows are dealt to blocks; a task holds one block of each. In it the rows' vectors get centroids, and a vector's dot product is at
most that of its centroid plus the query vector's length times the distance to the centroid. So each row has an upper
bound from one small table of products, rows are scored exactly in the order of their bounds, and a query stops when
the next bound cannot reach its k best. What leaves a task is k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SLACK = 1e-5  # scores are rounded to six places; a bound must not lose by that


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, first vector of each row)."""
    rows = column.to_pylist()
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return np.array([v for r in rows for v in r], np.float64), first


def _centroids(x: np.ndarray, n: int, rounds: int = 4, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    few = x[rng.choice(len(x), min(len(x), 64 * n), replace=False)]
    c = few[rng.choice(len(few), min(n, len(few)), replace=False)]
    for _ in range(rounds):
        near = ((few**2).sum(1)[:, None] - 2 * few @ c.T + (c**2).sum(1)).argmin(1)
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))[:, None]
        np.add.at(sums, near, few)
        c = np.where(counts > 0, sums / np.maximum(1, counts), c)
    return c


def _best(k: int, skip_self: bool, chunk: int = 64):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        asks, keys = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)).sort_by("id")
        out: list[list] = [[], [], [], []]
        if len(asks) and len(keys):
            x, first = _flat(keys["vectors"])
            q, q_first = _flat(asks["vectors"])
            ids, asked = np.asarray(keys["id"]), np.asarray(asks["id"])
            c = _centroids(x, max(1, int(len(x) ** 0.5)))
            near = np.concatenate([((b**2).sum(1)[:, None] - 2 * b @ c.T + (c**2).sum(1)).argmin(1) for b in np.array_split(x, max(1, len(x) // 4096))])
            away = np.linalg.norm(x - c[near], axis=1)
            for i, ask in enumerate(asked.tolist()):
                mine = q[q_first[i] : q_first[i + 1]]
                tops = (mine @ c.T)[:, near] + np.linalg.norm(mine, axis=1)[:, None] * away
                bound = np.maximum.reduceat(tops, first[:-1], axis=1).sum(axis=0)
                if skip_self:
                    bound[ids == ask] = -np.inf
                order = np.argsort(-bound, kind="stable")
                order = order[bound[order] > -np.inf]
                scores, rows, at = np.zeros(0), np.zeros(0, np.int64), 0
                while at < len(order):
                    kth = np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf
                    some = order[at : at + chunk]
                    some = some[bound[some] >= kth - _SLACK]
                    if not len(some):
                        break
                    spans = [np.arange(first[r], first[r + 1]) for r in some]
                    dots = mine @ x[np.concatenate(spans)].T
                    cuts = np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]])
                    scores = np.concatenate([scores, np.round(np.maximum.reduceat(dots, cuts, axis=1).sum(axis=0), 6)])
                    rows, at = np.concatenate([rows, some]), at + chunk
                top = np.lexsort((ids[rows], -scores))[:k]
                for j, t in enumerate(top.tolist()):
                    for col, v in zip(out, (ask, int(ids[rows[t]]), float(scores[t]), len(rows) if j == 0 else 0), strict=True):
                        col.append(v)
        return pa.table(dict(zip(("query_id", "key_id", "score", "scored"), (pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)), strict=True)))

    return run


def late_top_k(queries: DataFrame, keys: DataFrame, k: int, query_block: int = 2000, key_block: int = 20_000, skip_self: bool = False) -> DataFrame:
    """(query_id, key_id, score, rank, scored): each query's k best rows, exact; ties go to the smaller key id.

    queries (query_id, vectors) and keys (key_id, vectors), vectors array<array<double>>; rows without a vector match nothing. scored is how
    many rows the query scored exactly in all blocks.
    """
    some = lambda df: df.filter(F.size("vectors") > 0)
    queries, keys = some(queries), some(keys)
    q_blocks, k_blocks = max(1, -(-queries.count() // query_block)), max(8, -(-keys.count() // key_block))
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(k_blocks - 1))).alias("kb"), F.lit(0).alias("side"), F.col("query_id").alias("id"), "vectors")
    right = keys.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("key_id"), F.lit(k_blocks)).cast("int").alias("kb"), F.lit(1).alias("side"), F.col("key_id").alias("id"), "vectors")
    partial = left.unionByName(right).groupBy("qb", "kb").applyInArrow(_best(k, skip_self), "query_id long, key_id long, score double, scored long")
    each = Window.partitionBy("query_id")
    ranked = partial.withColumn("rank", F.row_number().over(each.orderBy(F.desc("score"), "key_id"))).withColumn("scored", F.sum("scored").over(each))
    return ranked.filter(F.col("rank") <= k).select("query_id", "key_id", "score", "rank", "scored")
