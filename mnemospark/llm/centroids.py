"""Centroid clustering with Elkan's bounds over integer vectors, exact to the last unit.

A vector carries its cluster, an upper bound of the distance to that cluster's centroid and a lower bound of the distance to each of the k
centroids. After centroids move, bounds move by as much (upper ones up, lower ones down), every float step rounded away from
the true value. A centroid is skipped only where a bound proves it *strictly* farther than the vector's own: its lower bound is
above the upper bound, or half its distance from the own centroid is. What is left is decided by exact integer distances, so
a tie is never pruned and goes to the smaller number. The distances between centroids are made once a round.

A round is one pass over a written table (vectors with bounds), an aggregate of k rows of integer sums, and the new
centroids, k rows that are broadcast. The old table is dropped once the next one is written, so a lost executor costs its
tasks alone. Nothing but k rows reaches the driver.

Defined results: vectors without exactly ``width`` components, or with a null or non-finite one, are left out, also null ones.
With fewer than k vectors each is a centroid. Equal first hashes (repeated ids) are ordered by the vector's components. Repeated rows are
clustered each. A null id hashes as an empty one. An empty table gives an empty one. Components beyond 2^26 after
scaling would leave the range of exact distances and raise an error. Columns other than the id and the vector stay behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import written
from mnemospark.session import finished, mark

WIDEST = 1 << 26
_STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>, computed long"


def integer_vectors(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x as a double; vectors of another width or with a gap are left out."""
    x = F.col("embedding").cast("array<double>")
    scaled = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    narrow = F.forall(x, lambda e: F.abs(e * F.lit(float(scale))) < WIDEST)
    checked = F.when(narrow, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component beyond {WIDEST} after scaling has no exact distance")))
    return vectors.filter((F.size("embedding") == width) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to c (one row, or one for each)."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down."""
    d = np.stack([_squares(centroids, c) for c in centroids])
    return _down(np.sqrt(d.astype(np.float64)) * 0.5)


def assign(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, half: np.ndarray) -> np.ndarray:
    """One exact assignment in place; returns how many distances each vector needed.

    Bounds hold for these centroids. ``upper`` may be loose; a vector's own distance is made exact only once
    some centroid is not pruned.
    """
    n, k = lower.shape
    computed = np.zeros(n, np.int64)
    nearest = np.where(np.eye(k, dtype=bool), np.inf, half).min(axis=1) if k > 1 else np.full(k, np.inf)
    open_ = np.flatnonzero(~(upper < nearest[cluster]))
    mask = ~((lower[open_] > upper[open_, None]) | (half[cluster[open_]] > upper[open_, None]))
    mask[np.arange(len(open_)), cluster[open_]] = False
    some = mask.any(axis=1)
    at = open_[some]
    if not len(at):
        return computed
    own = _squares(v[at], centroids[cluster[at]])
    computed[at] += 1
    root = np.sqrt(own.astype(np.float64))
    upper[at], lower[at, cluster[at]] = _up(root), _down(root)
    for c in range(k):
        need = ~((lower[at, c] > upper[at]) | (half[cluster[at], c] > upper[at])) & (cluster[at] != c)
        rows = at[need]
        if not len(rows):
            continue
        d = _squares(v[rows], centroids[c])
        computed[rows] += 1
        root = np.sqrt(d.astype(np.float64))
        lower[rows, c] = _down(root)
        mine = own[need]
        better = (d < mine) | ((d == mine) & (c < cluster[rows]))
        moved = rows[better]
        cluster[moved], upper[moved] = c, _up(root[better])
        own[np.flatnonzero(need)[better]] = d[better]
    return computed


def _frame(state: pd.DataFrame, v, cluster, upper, lower, computed) -> pd.DataFrame:
    return pd.DataFrame({"vec_id": state["vec_id"], "v": list(v.astype(np.int32)), "cluster": cluster.astype(np.int32), "upper": upper, "lower": list(lower), "computed": computed})


def _first_round(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    half = between(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["v"]).astype(np.int64)
            cluster, lower = np.zeros(len(b), np.int64), np.zeros((len(b), len(centroids)))
            upper = np.full(len(b), np.inf)  # nothing is known of the first centroid yet, so it is made exact
            computed = assign(v, centroids, cluster, upper, lower, half) if len(centroids) > 1 else np.zeros(len(b), np.int64)
            yield _frame(b, v, cluster, upper, lower, computed)

    return vectors.mapInPandas(run, _STATE)


def _next_round(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    half, moved = between(new), _up(np.sqrt(_squares(old, new).astype(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v, cluster = np.stack(b["v"]).astype(np.int64), b["cluster"].to_numpy(np.int64).copy()
            upper = _up(b["upper"].to_numpy() + moved[cluster])
            lower = _down(np.stack(b["lower"]) - moved)
            computed = assign(v, new, cluster, upper, lower, half)
            yield _frame(b, v, cluster, upper, lower, b["computed"].to_numpy() + computed)

    return state.mapInPandas(run, _STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid with vectors becomes their componentwise floor(sum / count); sums are exact longs, added up before they are shuffled."""
    width = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(width)]).alias("s"))
    out = centroids.copy()
    for r in sums.collect():  # at most k rows
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed) of every vector kept.

    ``computed`` is how many exact distances the vector needed in all rounds; without bounds it would be k * (rounds + 1).
    """
    spark = vectors.sparkSession
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed long"
    before = mark()
    kept = integer_vectors(vectors, width, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], empty)
    state = written(_first_round(kept, centroids), "elkan")
    for _ in range(rounds):
        moved = _moved(state, centroids)
        state = finished(_next_round(state, centroids, moved), "elkan", before)
        centroids = moved

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _squares(np.stack(b["v"]).astype(np.int64), centroids[b["cluster"].to_numpy(np.int64)])
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": b["cluster"], "distance": d, "computed": b["computed"]})

    out = finished(state.select("vec_id", "v", "cluster", "computed").mapInPandas(measure, "vec_id long, cluster int, distance long, computed long"), "clusters", before)
    per = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, per.get(c), sum(per.values()), _digest(x)) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")
