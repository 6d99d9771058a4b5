"""A navigable neighbour graph as vector index: every vector is a node, a search walks from layer to layer with a bounded beam.

Vectors are dealt to shards: cells around centroids of a bounded sample (about ``shard_rows`` each; a larger cell is
several shards by hash). Inside a shard equal vectors are one node. A node's top layer follows from a hash of its id, each layer
holding 1/``degree`` of the one below. In a layer a node's nearest ones come from blocks of matrix products over the shard, whose bounded size keeps the
whole work in proportion to the rows; then neighbours that lie nearer to a kept one than to the node give way to others, links are made
mutual, and a few random ones tie far parts together. (Growing the graph by rounds of neighbours of neighbours instead found 47 % of the links of
10 256 random vectors and took five times as long.) A node's links per layer are a column of its row, so the index is a table that can be
written, read, pruned by shard and joined.

A search sends a query to the shards of its ``probes`` nearest cells, in blocks of queries, and merges each shard's k best. Work per
query is about beam x degree comparisons a shard instead of its rows; ``compared`` says how many there were. Memory of a
task is a shard and a block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.similarity import top_k_join
from mnemospark.operators.vector_index import centroids, dealt_to_cells

SHARD_ROWS = 20_000
DEGREE = 16
_NODES = "shard long, node int, key_ids array<long>, vector array<double>, links array<array<int>>"


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best distinct ids, best first; -1 and -inf fill up."""
    order = np.lexsort((-scores, ids), axis=1)
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1).copy()
    scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    return np.where(scores > -np.inf, ids, -1), scores


def _reverse(links: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """For each node up to most nodes that link to it, nearest first."""
    n, k = links.shape
    src, dst, s = np.repeat(np.arange(n), k), links.ravel(), scores.ravel()
    src, dst, s = src[dst >= 0], dst[dst >= 0], s[dst >= 0]
    order = np.lexsort((src, -s, dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    out = np.full((n, most), -1, np.int64)
    few = place < most
    out[dst[few], place[few]] = src[few]
    return out


def neighbour_graph(x: np.ndarray, degree: int, rng: np.random.Generator, block: int = 1024) -> np.ndarray:
    """(nodes, 2 * degree) links over unit vectors, -1 for none: spread neighbours, links back, and two random ones."""
    n, k = len(x), 2 * degree
    links, scores = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, x.dtype)
    near = min(k, n - 1)
    if near < 1:
        return links
    for at in range(0, n, block):
        s = x[at : at + block] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        ids = np.argpartition(-s, near - 1, axis=1)[:, :near]
        links[at : at + block, :near], scores[at : at + block, :near] = _best(ids, np.take_along_axis(s, ids, 1), near)
    kept = _spread(x, links, scores, degree, block)
    back = _reverse(kept, np.where(kept >= 0, 1.0, -np.inf), k)
    far = rng.integers(0, n, (n, 2))
    far[far == np.arange(n)[:, None]] = -1
    both, rank = np.concatenate([kept, far, back], 1), -np.arange(degree + 2 + k, dtype=np.float64)
    return _best(both, np.where(both >= 0, rank, -np.inf), k)[0]


def _spread(x: np.ndarray, links: np.ndarray, scores: np.ndarray, degree: int, block: int) -> np.ndarray:
    """degree links of each node: first those that are nearer to it than to any link kept before, then the nearest others."""
    out = np.full((len(x), degree), -1, np.int64)
    for at in range(0, len(x), block):
        ids, s = links[at : at + block], scores[at : at + block]
        pair = np.einsum("rid,rjd->rij", x[ids], x[ids])
        kept = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            shadowed = (kept & (pair[:, j] >= s[:, j, None])).any(axis=1)
            kept[:, j] = ~shadowed & (ids[:, j] >= 0)
        rank = np.where(kept, 2.0, 0.0) + np.where(ids >= 0, s, -np.inf)
        out[at : at + block] = _best(ids, rank, degree)[0]
    return out


def _layer(ids: np.ndarray, degree: int) -> np.ndarray:
    """The top layer of each id: layer l with a chance of degree^-l, by a fixed mix of the id's bits."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    share = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(8, (-np.log(share) / np.log(degree)).astype(np.int64))


def _built(degree: int):
    def build(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["key_id"])
        x = np.stack(table["vector"].to_numpy(zero_copy_only=False)).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        rows, inverse = np.unique(x, axis=0, return_inverse=True)
        first = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(first, inverse, ids)
        by = np.argsort(inverse, kind="stable")
        members = np.split(ids[by], np.cumsum(np.bincount(inverse, minlength=len(rows)))[:-1])
        unit, layer = _unit(rows).astype(np.float32), _layer(first, degree)
        links: list[list[list[int]]] = [[] for _ in range(len(rows))]
        for level in range(int(layer.max()) + 1):
            here = np.flatnonzero(layer >= level)
            graph = neighbour_graph(unit[here], degree, np.random.default_rng(level))
            for node, near in zip(here.tolist(), graph, strict=True):
                links[node].append(here[near[near >= 0]].tolist())
        shard = table["shard"][0].as_py()
        return pa.table({"shard": pa.array([shard] * len(rows), pa.int64()), "node": pa.array(range(len(rows)), pa.int32()), "key_ids": pa.array([m.tolist() for m in members], pa.list_(pa.int64())), "vector": pa.array(list(rows), pa.list_(pa.float64())), "links": pa.array(links, pa.list_(pa.list_(pa.int32())))})

    return build


def build(keys: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, sample: int = 20_000) -> tuple[np.ndarray, DataFrame]:
    """(centroids, nodes) over keys (key_id, vector): every vector is in a node of one shard. Write nodes before searching."""
    c = centroids(keys, max(1, -(-keys.count() // shard_rows)), sample)
    placed = dealt_to_cells(keys, "key_id", c, 1)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("parts"))  # one row a cell
    part = F.pmod(F.xxhash64("key_id"), F.col("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").select((F.col("cell").cast("long") * (1 << 32) + part).alias("shard"), "key_id", "vector")
    return c, dealt.groupBy("shard").applyInArrow(_built(degree), _NODES)


class _Shard:
    """Links of a shard's layers as arrays, and beam searches over them."""

    def __init__(self, vectors: np.ndarray, links: list[list[list[int]]]):
        self.x = _unit(vectors).astype(np.float32)
        tops = np.array([len(layers) for layers in links])
        self.layers = []
        for level in range(int(tops.max())):
            widest = max(len(layers[level]) for layers in links if len(layers) > level)
            near = np.full((len(links), max(1, widest)), -1, np.int64)
            for node, layers in enumerate(links):
                if len(layers) > level:
                    near[node, : len(layers[level])] = layers[level]
            self.layers.append(near)
        top = np.flatnonzero(tops == tops.max())
        self.entry = top[:64]

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, scores, compared) of unit queries; beam best of each, -1 fills up."""
        n = len(q)
        compared = np.full(n, len(self.entry))
        s = q @ self.x[self.entry].T
        ids, s = _best(np.broadcast_to(self.entry, s.shape).copy(), s, 8)
        for level in range(len(self.layers) - 1, -1, -1):
            ids, s = self._walk(level, q, ids, s, beam if level == 0 else 8, compared)
        return ids, s, compared

    def _walk(self, level, q, ids, s, beam, compared):
        near, n = self.layers[level], len(q)
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last place takes the -1 of empty ones
        np.put_along_axis(seen, ids, True, 1)
        fill = max(0, beam - ids.shape[1])
        ids = np.pad(ids, ((0, 0), (0, fill)), constant_values=-1)[:, : max(beam, ids.shape[1])]
        s = np.pad(s, ((0, 0), (0, fill)), constant_values=-np.inf)
        todo = ids >= 0
        while True:
            open_ = np.where(todo, s, -np.inf)
            at = open_.argmax(axis=1)
            going = np.flatnonzero(open_[np.arange(n), at] > -np.inf)
            if not len(going):
                return ids, s
            at = at[going]
            todo[going, at] = False
            new = near[ids[going, at]]
            fresh = (new >= 0) & ~seen[going[:, None], new]
            seen[going[:, None], new] = True
            compared[going] += fresh.sum(axis=1)
            found = np.where(fresh, np.einsum("qd,qcd->qc", q[going], self.x[new]), -np.inf)
            all_ids, all_s = np.concatenate([ids[going], new], 1), np.concatenate([s[going], found], 1)
            all_todo = np.concatenate([todo[going], fresh], 1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, : ids.shape[1]] if all_s.shape[1] > beam else np.argsort(-all_s, axis=1)
            ids[going], s[going], todo[going] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_s, all_todo))


def _searched(k: int, beam: int, skip_self: bool, rows: int = 256):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        asks, nodes = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)).sort_by("node")
        out: list[list] = [[], [], [], []]
        if len(asks) and len(nodes):
            x = np.stack(nodes["vector"].to_numpy(zero_copy_only=False)).astype(np.float64)
            shard, exact = _Shard(x, nodes["links"].to_pylist()), _unit(x)
            members, ids = nodes["key_ids"].to_pylist(), np.asarray(asks["id"])
            q = _unit(np.stack(asks["vector"].to_numpy(zero_copy_only=False)).astype(np.float64))
            for at in range(0, len(q), rows):
                found, _, compared = shard.search(q[at : at + rows].astype(np.float32), max(beam, k + 1))
                for i, (hits, n) in enumerate(zip(found, compared.tolist(), strict=True), at):
                    hits = hits[hits >= 0]
                    scores = np.round(exact[hits] @ q[i], 6)
                    pairs = []
                    for h, score in sorted(zip(hits.tolist(), scores.tolist(), strict=True), key=lambda p: -p[1]):
                        if len(pairs) >= k and -pairs[k - 1][0] > score:
                            break
                        pairs += [(-score, m) for m in members[h][: k + 1] if not (skip_self and m == ids[i])]
                        pairs.sort()
                    for j, (score, m) in enumerate(pairs[:k]):
                        for col, v in zip(out, (int(ids[i]), m, -score, n if j == 0 else 0), strict=True):
                            col.append(v)
        return pa.table(dict(zip(("query_id", "key_id", "score", "compared"), (pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)), strict=True)))

    return run


def search(index: tuple[np.ndarray, DataFrame], queries: DataFrame, k: int, beam: int = 48, probes: int = 16, query_block: int = 20_000, skip_self: bool = False) -> DataFrame:
    """(query_id, key_id, score, rank, compared) of queries (query_id, vector): each one's k best by cosine among what the beams found.

    Ties go to the smaller key id, on scores rounded to six places. compared is the number of vectors that the query met in all its shards.
    """
    c, nodes = index
    shards = nodes.select("shard").distinct().withColumn("cell", F.floor(F.col("shard") / (1 << 32)).cast("int"))
    blocks = max(1, -(-queries.count() // query_block))
    asks = dealt_to_cells(queries, "query_id", c, min(probes, max(1, len(c)))).join(F.broadcast(shards), "cell")  # one row a shard
    asks = asks.select("shard", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), F.col("query_id").alias("id"), "vector")
    held = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))
    both = asks.unionByName(held, allowMissingColumns=True)
    partial = both.groupBy("shard", "block").applyInArrow(_searched(k, beam, skip_self), "query_id long, key_id long, score double, compared long")
    each = Window.partitionBy("query_id")
    ranked = partial.withColumn("rank", F.row_number().over(each.orderBy(F.desc("score"), "key_id"))).withColumn("compared", F.sum("compared").over(each))
    return ranked.filter(F.col("rank") <= k).select("query_id", "key_id", "score", "rank", "compared")


def completed(found: DataFrame, queries: DataFrame, keys: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(query_id, key_id, score, rank): the exact k best, from what search found.

    The k-th score found is a floor: every key is compared with each query by matrix product, and only those that reach the floor are held. A query for which fewer
    than k were found has no floor. The work is all pairs of queries and keys.
    """
    floors = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    return top_k_join(queries.join(floors, "query_id", "left"), keys, k, skip_self=skip_self)
