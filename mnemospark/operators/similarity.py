"""Top-k and threshold similarity, by blocks of both sides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.vectors import cosine
from mnemospark.session import written


def top_k(df: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows most like one query vector: each partition keeps its best k, then one small merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("score", F.round(cosine(F.col(vector), q), 6)).orderBy(F.desc("score"), key).limit(k)


def best_pairs(k: int, least: float | None, skip_self: bool, rows: int = 256):
    """For a table (side, id, vector) with queries on side 0 and keys on side 1: each query's k best keys by cosine.

    Queries are taken rows at a time and only the k best of a row are sorted, so memory is a slice of scores.
    """

    def best(table: pa.Table) -> pa.Table:
        side, ids = np.asarray(table["side"]), np.asarray(table["id"])
        x = np.stack(table["vector"].to_numpy(zero_copy_only=False)).astype(np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        a, b, qi, ki = x[side == 0], x[side == 1], ids[side == 0], ids[side == 1]
        order = np.argsort(ki, kind="stable")  # equal scores then go to the smaller id
        b, ki = b[order], ki[order]
        out = [[], [], []]
        for at in range(0, len(a) if len(b) else 0, rows):
            s = np.round(a[at : at + rows] @ b.T, 6)
            if skip_self:
                s[qi[at : at + rows, None] == ki[None]] = -np.inf
            if least is not None:
                s[s < least] = -np.inf
            cut = np.partition(s, len(ki) - k, axis=1)[:, len(ki) - k] if k < len(ki) else np.full(len(s), -np.inf)
            for row, q, c in zip(s, qi[at : at + rows], cut, strict=True):
                near = np.flatnonzero((row >= c) & (row > -np.inf))
                near = near[np.argsort(-row[near], kind="stable")[:k]]
                out[0].append(np.full(len(near), q))
                out[1].append(ki[near])
                out[2].append(row[near])
        whole = [np.concatenate([np.zeros(0, t), *o]).astype(t) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("query_id", "key_id", "score"), whole, strict=True)))

    return best


PACK = 4096  # vectors of one packed row
_MICRO = 1_000_000  # scores have six places


def classes(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(seat, vector, members) of rows (id, vector): equal vectors are one class with its most smallest ids; without most, members is empty and the least floor is kept."""
    if most is None:
        one = rows.groupBy("vector").agg(F.min("floor").alias("floor")).withColumn("members", F.array().cast("array<long>"))
    else:
        w = Window.partitionBy("vector").orderBy("id")
        few = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)  # a limit of a rank: each task keeps most a vector
        one = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return written(one.select(F.monotonically_increasing_id().alias("seat"), *one.columns), "vector-classes")


def packed(rows: DataFrame, parts: int, size: int = PACK) -> DataFrame:
    """(seats, first, data) of rows (seat, first, vector): size unit vectors a row as bytes, in parts partitions."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= size:
                t = pa.Table.from_batches(held)
                yield _pack(t.slice(0, size))
                held, n = t.slice(size).to_batches(), n - size
        if n:
            yield _pack(pa.Table.from_batches(held))

    return rows.select("seat", "first", "vector").repartition(parts).mapInArrow(run, "seats binary, first binary, data binary").repartition(parts)


def _pack(t: pa.Table) -> pa.RecordBatch:
    x = np.stack(t["vector"].to_numpy(zero_copy_only=False)).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    whole = lambda c: np.asarray(t[c]).astype(np.int64).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (whole("seat"), whole("first"), x.tobytes())], names=["seats", "first", "data"])


def _best_of_packs(k: int, least: float | None, rows: int = 256):
    """For rows of one pack of queries and one of keys each: each query's k best key seats over the packs that follow each other.

    The k best so far of a pack of queries are held and only keys that reach the k-th of them are sorted, so a task's memory is a slice of scores and what
    leaves it is k rows a query, whatever the number of its packs of keys.
    """

    def merged(best, s, seats, first, floor):
        cut = np.maximum(best[0][:, -1], floor)  # -inf while there are fewer than k
        if least is not None:
            cut = np.maximum(cut, least)
        if k < s.shape[1] and (cut == -np.inf).any() or k < s.shape[1] // 8 and np.count_nonzero(s >= cut[:, None]) > 4 * k * len(s):
            cut = np.maximum(cut, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        r, c = np.nonzero(s >= cut[:, None])
        have = np.nonzero(best[0] > -np.inf)
        row = np.concatenate([have[0], r])
        score = np.concatenate([best[0][have], s[r, c]])
        tie = np.concatenate([best[1][have], first[c]])
        seat = np.concatenate([best[2][have], seats[c]])
        order = np.lexsort((tie, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        few = place < k
        row, place, order = row[few], place[few], order[few]
        for held, value, none in zip(best, (score, tie, seat), (-np.inf, 0, 0), strict=True):
            held[:] = none
            held[row, place] = value[order]

    def out(ids, best):
        at = np.nonzero(best[0] > -np.inf)
        for lo in range(0, len(at[0]), 50_000):
            r, c = at[0][lo : lo + 50_000], at[1][lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(best[2][r, c]), pa.array(best[1][r, c]), pa.array(best[0][r, c])], names=["query", "key", "first", "score"])

    def run(batches):
        raw = x = ids = best = floors = None
        for b in batches:
            for asked, ask, floor, seats, first, data in zip(*(b.column(c) for c in ("q_seats", "q_data", "q_floors", "seats", "first", "data")), strict=True):
                if asked.as_py() != raw:
                    if raw is not None:
                        yield from out(ids, best)
                    raw = asked.as_py()
                    ids = np.frombuffer(raw, np.int64)
                    floors = np.where((m := np.frombuffer(floor.as_py(), np.int64)) > -_MICRO - 1, m / _MICRO - 1e-9, -np.inf)
                    x = np.frombuffer(ask.as_py(), np.float64).reshape(len(ids), -1)
                    best = [np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)]
                seats, first = np.frombuffer(seats.as_py(), np.int64), np.frombuffer(first.as_py(), np.int64)
                keys = np.frombuffer(data.as_py(), np.float64).reshape(len(seats), -1)
                for at in range(0, len(ids), rows):
                    s = np.round(x[at : at + rows] @ keys.T, 6)
                    merged([c[at : at + rows] for c in best], s, seats, first, floors[at : at + rows])
        if raw is not None:
            yield from out(ids, best)

    return run


def top_k_join(queries: DataFrame, keys: DataFrame, k: int, least: float | None = None, blocks: int | None = None, query_block: int = 2000, key_block: int = 20_000, skip_self: bool = False, wanted: int | None = None) -> DataFrame:
    """For each query (query_id, vector) its k best keys (key_id, vector) by cosine: query_id, key_id, score, rank.

    Equal vectors are one class on either side, of which the k smallest ids suffice. Classes are packed to rows of some thousand vectors and
    packs meet packs in a Cartesian product, so vectors are shuffled once and never copied for their partners; a task goes through a share of the keys
    (at most about 64 MB of them) and keeps each query's k best so far by matrix product, so what is shuffled is k rows a query and share.
    Ties go to the smaller key id, on scores rounded to six places. wanted: the caller reads the first ranks only, so no others are made. Queries may have
    a floor, a score that k of their keys are known to reach: then no key below it is held.
    """
    k = min(k, wanted or k)
    some = k + 1 if skip_self else k  # a query may find itself
    floor = F.col("floor") if "floor" in queries.columns else F.lit(None).cast("double")
    asks = queries.select(F.col("query_id").alias("id"), "vector", floor.alias("floor"))
    known = classes(keys.select(F.col("key_id").alias("id"), "vector"), some)
    asked = classes(asks)
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("w")).first()
    shares = blocks or max(1, min(8, -(-sizes.n // key_block)), -(-sizes.n * (sizes.w or 0) * 8 // (64 << 20)))
    micro = F.coalesce(F.round(F.col("floor") * _MICRO).cast("long"), F.lit(-_MICRO - 1))
    left = packed(asked.withColumn("first", micro), max(1, -(-asked.count() // query_block)), query_block).select(F.col("seats").alias("q_seats"), F.col("data").alias("q_data"), F.col("first").alias("q_floors"))
    right = packed(known.withColumn("first", F.col("members")[0]), shares, min(PACK, key_block))
    met = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(_best_of_packs(some, least), "query long, key long, first long, score double")
    best = met.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))).filter(F.col("_r") <= some)
    hits = best.join(known.select(F.col("seat").alias("key"), "members"), "key").select("query", "score", F.explode("members").alias("key_id"))
    hits = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key_id"))).filter(F.col("_r") <= some)
    few = written(hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_r", "key_id", "score"))).alias("hits")), "hits")  # some of a query at most
    own = asks.join(asked.select("vector", F.col("seat").alias("query")), "vector").select(F.col("id").alias("query_id"), "query")
    if skip_self:
        others = F.filter("hits", lambda h: h["key_id"] != F.col("query_id"))
        own = own.join(few, "query").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("_p", "h"))
    else:
        own = own.join(few, "query").select("query_id", F.posexplode("hits").alias("_p", "h"))
    return own.select("query_id", "h.key_id", "h.score", (F.col("_p") + 1).alias("rank"))
