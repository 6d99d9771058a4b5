"""The most alike candidate by difflib's ratio, for whole tables of texts and candidates.

The ratio is twice the matched letters over both lengths, and no match has more letters than the letters' counts have in common. Candidates of
the same letters share that bound, so it comes once for them, and for a block of texts and a block of candidates as one matrix product.
A first pass finds each text's highest bound among all blocks, a second compares the candidates that reach it letter by letter, and a third,
where a text's best ratio is below that bound, those whose bound is between. So no block compares what another block has ruled out. Equal texts and candidates
count once. What leaves a task is one row a text.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import written

#: Numbers of one matrix in a task: of letter counts, and of bounds.
CELLS = 4_000_000


def _counts(texts: list[str], alphabet: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(alphabet)), np.int32)
    for i, t in enumerate(texts):
        for c in t:
            at = alphabet.get(c)
            if at is not None:
                out[i, at] += 1
    return out


def _bounds(asks: list[str], keys: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, bounds) of pieces of asks from i by pieces of keys from j.

    min(a, b) is the number of levels n with a >= n and b >= n, so the letters in common are a product of matrices of noughts and ones, exact in floats.
    """
    alphabet = {c: i for i, c in enumerate(sorted({c for t in asks for c in t}))}  # letters of candidates alone match nothing
    own, have = _counts(asks, alphabet), _counts(keys, alphabet)
    tops = np.minimum(own.max(axis=0, initial=0), have.max(axis=0, initial=0))
    letter = np.repeat(np.arange(len(alphabet)), tops)
    level = np.concatenate([np.arange(1, n + 1) for n in tops] or [np.zeros(0)])
    levels = lambda counts: (counts[:, letter] >= level).astype(np.float32)
    a_size, k_size = (np.array([len(t) for t in x], np.int64) for x in (asks, keys))
    wide = max(1, 4 * CELLS // max(1, len(letter)))
    for j in range(0, len(keys), wide):
        right = levels(have[j : j + wide]).T
        high = max(1, min(wide, CELLS // right.shape[1]))
        for i in range(0, len(asks), high):
            whole = a_size[i : i + high, None] + k_size[None, j : j + wide]
            bound = (levels(own[i : i + high]) @ right).astype(np.float64)
            bound *= 2.0
            bound /= np.maximum(1, whole)
            bound[whole == 0] = 1.0
            yield i, j, bound


def _sides(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, dict[str, list[str]]]:
    """Texts with their low and high, and the candidates by their sorted letters, the last by code points first."""
    side = np.asarray(table["side"])
    asks = table.filter(pa.array(side == 0))
    alike: dict[str, list[str]] = {}
    for t in sorted(table["text"].filter(pa.array(side == 1)).to_pylist(), reverse=True):
        alike.setdefault("".join(sorted(t)), []).append(t)
    return asks["text"].to_pylist(), np.asarray(asks["low"]), np.asarray(asks["high"]), alike


def _highest_bounds(table: pa.Table) -> pa.Table:
    asks, _, _, alike = _sides(table)
    top = np.full(len(asks), -1.0)
    for i, _, bound in _bounds(asks, list(alike)):
        top[i : i + len(bound)] = np.maximum(top[i : i + len(bound)], bound.max(axis=1))
    return pa.table({"text": pa.array(asks if alike else [], pa.string()), "low": pa.array(top if alike else [], pa.float64())})


def _best_of_block(table: pa.Table) -> pa.Table:
    """The best candidate of each text among those with a bound from low up to, but without, high; below a high of at most 1, low is a ratio already reached."""
    asks, low, high, alike = _sides(table)
    groups = list(alike.values())
    best, tried = [(-1.0, "") if above > 1 else (floor, "") for floor, above in zip(low.tolist(), high.tolist(), strict=True)], [0] * len(asks)
    for i, j, bound in _bounds(asks, list(alike)):
        rows, cols = np.nonzero((bound >= low[i : i + len(bound), None]) & (bound < high[i : i + len(bound), None]))
        starts = np.searchsorted(rows, np.arange(len(bound) + 1))
        for r in np.unique(rows).tolist():
            at, match = i + r, difflib.SequenceMatcher()
            match.set_seq2(asks[at])
            of = cols[starts[r] : starts[r + 1]]
            for c in of[np.argsort(-bound[r, of], kind="stable")].tolist():
                if bound[r, c] < best[at][0]:
                    break
                for key in groups[j + c]:
                    if best[at] > (bound[r, c], key):
                        break
                    match.set_seq1(key)
                    tried[at] += 1
                    best[at] = max(best[at], (match.ratio(), key))
    found = [k for k, n in enumerate(tried) if n]
    out = {"text": [asks[k] for k in found], "found": [best[k][1] for k in found], "ratio": [best[k][0] for k in found], "tried": [tried[k] for k in found]}
    return pa.table({n: pa.array(x, kind) for (n, x), kind in zip(out.items(), (pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)})


def _dealt(candidates: DataFrame, b: int, block: int) -> DataFrame:
    """(text, kb): candidates of the same letters go to one of b blocks, unless they are more than a tenth of a block."""
    most = max(1, block // 10)
    rows = candidates.select("text", F.xxhash64(F.array_sort(F.split("text", ""))).alias("letters"))
    many = rows.groupBy("letters").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)  # at most ten a block
    seat = F.pmod(F.xxhash64("text"), F.coalesce(F.ceil(F.col("n") / most), F.lit(1)))
    return rows.join(F.broadcast(many), "letters", "left").select("text", F.pmod(F.xxhash64("letters", seat), F.lit(b)).cast("int").alias("kb"))


def nearest_texts(asks: DataFrame, candidates: DataFrame, ask_block: int = 10_000, block: int = 50_000) -> DataFrame:
    """(text, found, ratio, tried) of each distinct text of asks: the candidate (text) of the highest ratio, of equals the last by code points.

    tried is how many candidates were compared letter by letter. Nulls are neither asked nor found; without candidates there are no rows.
    """
    distinct = lambda df, name: written(df.filter("text IS NOT NULL").select("text").distinct(), name)
    asks, candidates = distinct(asks, "fuzzy-asks"), distinct(candidates, "fuzzy-candidates")
    b = max(1, -(-candidates.count() // block))
    keys = written(_dealt(candidates, b, block), "fuzzy-keys")

    def met(rows: DataFrame):
        a = max(1, -(-rows.count() // ask_block))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.select(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(a)).cast("int").alias("qb"), each(b).alias("kb"), F.lit(0).alias("side"), "text", "low", "high")
        right = keys.select(each(a).alias("qb"), "kb", F.lit(1).alias("side"), "text", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
        return left.unionByName(right).repartition(2 * a * b, "qb", "kb").groupBy("qb", "kb")

    shape = "text string, found string, ratio double, tried long"
    of_text = lambda df: df.groupBy("text").agg(F.max(F.struct("ratio", "found")).alias("m"), F.sum("tried").alias("tried")).select("text", "m.found", "m.ratio", "tried")
    tops = met(asks.select("text", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))).applyInArrow(_highest_bounds, "text string, low double")
    tops = written(tops.groupBy("text").agg(F.max("low").alias("low")), "fuzzy-bounds")
    # A ratio is at most 1, so no bound reaches 2.
    first = written(of_text(met(tops.withColumn("high", F.lit(2.0))).applyInArrow(_best_of_block, shape)), "fuzzy-first")
    open_ = written(first.join(tops, "text").filter("ratio < low").select("text", F.col("ratio").alias("low"), F.col("low").alias("high")), "fuzzy-open")
    if open_.isEmpty():
        return first
    return of_text(first.unionByName(met(open_).applyInArrow(_best_of_block, shape)))
