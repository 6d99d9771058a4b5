"""MinHash near-duplicate clusters of the retrieval corpus: 5-grams, 256 permutations, banded, smallest id wins."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.components import components
from mnemospark.operators.joins import join_by_size
from mnemospark.session import written

#: Fixed values of the signature scheme.
MERSENNE, LOW32, SEED, NGRAM, PERMUTATIONS, THRESHOLD = (1 << 61) - 1, (1 << 32) - 1, 42, 5, 256, 0.7
_SPLIT = re.compile(r"[^A-Za-z_0-9]")


@functools.lru_cache(maxsize=8)
def band_shape(threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, steps: int = 400) -> tuple[int, int]:
    """(bands, rows) with the least sum of false positive and false negative area, by the midpoint rule."""
    s = (np.arange(steps) + 0.5) / steps
    low, high = s * threshold, threshold + s * (1 - threshold)
    best = (np.inf, 0, 0)
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            fp = (1 - (1 - low**r) ** b).mean() * threshold
            fn = ((1 - high**r) ** b).mean() * (1 - threshold)
            best = min(best, (0.5 * fp + 0.5 * fn, b, r))
    return best[1], best[2]


def permutation_numbers(permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of the permutations."""
    rng = np.random.RandomState(SEED)
    return rng.randint(1, MERSENNE, permutations, dtype=np.uint64), rng.randint(0, MERSENNE, permutations, dtype=np.uint64)


def band_hashes(docs: DataFrame, permutations: int = PERMUTATIONS, threshold: float = THRESHOLD, ngram: int = NGRAM) -> DataFrame:
    """(id, band, key) of documents (id, content) with at least ngram tokens."""
    bands, rows = band_shape(threshold, permutations)
    a, b = permutation_numbers(permutations)

    prime = np.uint64(MERSENNE)

    def least(h: np.ndarray) -> np.ndarray:
        """The least permuted hash of each permutation; the remainder by the Mersenne prime is a shift and an addition."""
        low = np.full(permutations, LOW32, np.uint64)
        for at in range(0, len(h), 1024):
            x = h[at : at + 1024, None] * a + b
            x = (x & prime) + (x >> np.uint64(61))
            np.subtract(x, prime, out=x, where=x >= prime)
            np.minimum(low, (x & np.uint64(LOW32)).min(axis=0), out=low)
        return low

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _SPLIT.split(text.as_py() or "")
                if len(words) < ngram:
                    continue  # short texts would all look alike; equal ones are found by content keys
                grams = {" ".join(g) for g in zip(*(words[i:] for i in range(ngram)), strict=False)}
                h = np.frombuffer(b"".join(hashlib.sha1(g.encode()).digest()[:4] for g in grams), "<u4").astype(np.uint64)
                low = least(h)
                ids.append(k)
                keys.append([hashlib.md5(low[j : j + rows].tobytes()).digest() for j in range(0, bands * rows, rows)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.binary()))], names=["id", "keys"])

    return docs.select("id", "content").mapInArrow(run, "id long, keys array<binary>").select("id", F.posexplode("keys").alias("band", "key"))


def clusters(docs: DataFrame) -> DataFrame:
    """(id, cluster, kept): documents that share a band's key are one cluster, its smallest id stays.

    In a bucket each member is joined to the bucket's smallest id only, so a large bucket gives as many edges as members.
    """
    hashed = written(band_hashes(docs), "band-hashes")
    heads = written(hashed.groupBy("band", "key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket-heads")
    edges = join_by_size(hashed, heads, ["band", "key"], "n").select("a", F.col("id").alias("b")).filter("a <> b").distinct()
    labels = components(edges)
    return docs.select("id").join(labels, docs["id"] == labels["node"], "left").select("id", F.coalesce("label", "id").alias("cluster"), F.coalesce(F.col("label") == F.col("id"), F.lit(True)).alias("kept"))
