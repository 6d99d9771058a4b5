"""Best-fit packing by a grouping genetic algorithm on distributed islands.

Documents become token pieces (only those over the capacity are cut); the piece table is written once, about 45
bytes a row. Pieces are dealt to shards of bounded size, and ``islands`` tasks evolve each shard apart. A population
begins with groupings of pieces in random order, next fit with a few open bins, so no member is a finished packing;
crossover injects the well-filled bins of one parent whole into the other, removes bins with pieces that would then be
there twice, dissolves the other's least filled bins, and puts the displaced pieces back by best-fit decreasing. A child
replaces the worst member unless it is worse. After an epoch each island sends its elite, the bin of each piece, to the
next island of the shard's ring, where it joins a new population. The best packing of each shard stays; bins filled
under ``weak`` of the capacity, from all shards, are dealt out again and packed by the same algorithm, until that saves
no bin or they fit one shard.

All pieces of a run are placed exactly once. A shard's size is bounded, so tasks do not grow with the input.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import texts_of, written
from mnemospark.llm.tokens import CACHE_BOUND, words

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, cache: int = CACHE_BOUND) -> DataFrame:
    """One row for each piece of each document. cache: words whose ids a worker keeps (memory for time, not results)."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = words(tokenizer, cache)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    return texts_of(docs).mapInArrow(cut, PIECES)


class Packing:
    """Bins of piece numbers. Open room is indexed by residual capacity, so best fit is one bit scan."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def scatter(self, pieces, open_bins: int = 8) -> None:
        """Pieces in the given order into the first of the last open_bins bins that has room, else a new bin."""
        cap, sizes, bins, fill = self.capacity, self.sizes, self.bins, self.fill
        for p in pieces:
            need = sizes[p]
            for k in range(max(0, len(bins) - open_bins), len(bins)):
                if fill[k] + need <= cap:
                    bins[k].append(p)
                    fill[k] += need
                    break
            else:
                bins.append([p])
                fill.append(need)

    def put(self, pieces) -> None:
        """Best fit of pieces, in the given order."""
        cap, sizes, bins, fill = self.capacity, self.sizes, self.bins, self.fill
        room: list[list[int]] = [[] for _ in range(cap + 1)]
        mask = 0
        for k, f in enumerate(fill):
            if f < cap:
                room[cap - f].append(k)
                mask |= 1 << (cap - f)
        for p in pieces:
            need = sizes[p]
            fits = mask >> need
            if fits:
                r = need + (fits & -fits).bit_length() - 1
                k = room[r].pop()
                if not room[r]:
                    mask ^= 1 << r
                bins[k].append(p)
                fill[k] += need
                left = r - need
            else:
                k = len(bins)
                bins.append([p])
                fill.append(need)
                left = cap - need
            if left:
                room[left].append(k)
                mask |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first; then fuller ones (mean squared fill)."""
        return -len(self.bins), sum((f / self.capacity) ** 2 for f in self.fill) / max(1, len(self.bins))

    def labels(self) -> np.ndarray:
        out = np.empty(len(self.sizes), np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out

    @classmethod
    def of(cls, sizes: list[int], capacity: int, labels) -> "Packing":
        out = cls(sizes, capacity)
        out.bins = [[] for _ in range(max(labels, default=-1) + 1)]
        for p, k in enumerate(labels):
            out.bins[k].append(p)
        out.fill = [sum(sizes[p] for p in b) for b in out.bins]
        return out


def crossover(a: Packing, b: Packing, rng, share: float = 0.5, dissolved: float = 0.1) -> Packing:
    """Injects a share of b's bins, the best filled ones likelier, whole into a; displaced pieces go back by best-fit decreasing.

    Bins of a that hold an injected piece are removed, and so are the dissolved share of a's least filled bins: their
    other pieces are displaced.
    """
    filled = np.array(b.fill)
    good = np.argsort(-(filled + rng.uniform(0, 0.02 * a.capacity, len(filled))), kind="stable")[: max(1, int(share * len(filled)))]
    child = Packing(a.sizes, a.capacity)
    child.bins = [list(b.bins[k]) for k in good]
    child.fill = [b.fill[k] for k in good]
    taken = np.zeros(len(a.sizes), bool)
    taken[[p for x in child.bins for p in x]] = True
    weakest = sorted(a.fill)[int(dissolved * len(a.fill))] if a.fill else 0
    displaced = []
    owner = a.labels()
    hit = np.zeros(len(a.bins), bool)
    hit[owner[taken]] = True
    for k, (x, f) in enumerate(zip(a.bins, a.fill, strict=True)):
        if hit[k] or f <= weakest and f < a.capacity:
            displaced += [p for p in x if not taken[p]]
        else:
            child.bins.append(list(x))
            child.fill.append(f)
    child.put(sorted(displaced, key=lambda p: -a.sizes[p]))
    return child


def evolve(sizes: list[int], capacity: int, seed: int, elite=None, population: int = 4, generations: int = 8) -> Packing:
    """One island's epoch. elite: the bin of each piece in a packing that migrated here."""
    rng = np.random.default_rng(seed)
    pop = []
    for _ in range(population):
        one = Packing(sizes, capacity)
        one.scatter(rng.permutation(len(sizes)).tolist())
        pop.append(one)
    if elite is not None:
        pop.append(Packing.of(sizes, capacity, elite))
    floor = -(-sum(sizes) // capacity)
    for _ in range(generations):
        pop.sort(key=Packing.fitness, reverse=True)
        if len(pop[0].bins) <= floor:
            break
        i = int(rng.integers(1, len(pop)))
        child = max(crossover(pop[0], pop[i], rng), crossover(pop[i], pop[0], rng), key=Packing.fitness)
        pop[-1] = max(child, pop[-1], key=Packing.fitness)
    return max(pop, key=Packing.fitness)


def _islands(pieces: DataFrame, shards: int, capacity: int, islands: int, epochs: int, seed: int, round_no: int) -> DataFrame:
    """PLACED rows: the best packing of each shard after all epochs."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    dealt = pieces.select(*names, F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"))
    with_island = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("bin", F.lit(None).cast("int"))
    state, width = f"{PIECES}, shard int, island int, bin int, bins int, fitness double", islands

    def ordered(pdf):
        return pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)

    def epoch(number: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            shard, island = int(key[0]), int(key[1])
            pdf = ordered(pdf)
            elite = None if pdf["bin"].isna().any() else pdf["bin"].astype(int).tolist()
            best = evolve(pdf["length"].tolist(), capacity, seed * 1009 + shard * 31 + number * 7 + island, elite)
            pdf["bin"] = best.labels()
            pdf["bins"], pdf["fitness"] = len(best.bins), best.fitness()[1]
            return pdf[[x.split()[0] for x in state.split(", ")]]

        return run

    level = with_island
    for number in range(epochs):
        if number:  # the elite moves to the next island of its ring
            level = level.withColumn("island", F.pmod(F.col("island") + 1, F.lit(width)).cast("int")).drop("bins", "fitness")
        level = level.groupBy("shard", "island").applyInPandas(epoch(number), state)
    level = written(level, "islands")
    best = level.groupBy("shard").agg(F.min_by("island", F.struct("bins", -F.col("fitness"), "island")).alias("island"))
    chosen = level.join(best, ["shard", "island"])

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = (round_no << 56) + (int(key[0]) << 24) + pdf["bin"].astype("int64")
        return pdf[[x.split()[0] for x in PLACED.split(", ")]]

    return chosen.groupBy("shard").applyInPandas(place, PLACED)


def pack(pieces: DataFrame, capacity: int, shard_rows: int = 16_384, islands: int = 2, epochs: int = 2, weak: float = 0.98) -> DataFrame:
    """Places every row of pieces (PIECES columns); returns PLACED rows.

    Defined results: an empty table gives an empty result; rows that are alike are placed each; lengths lie
    between 1 and capacity.
    """
    done, left, before, last = None, written(pieces, "pieces"), None, None
    for number in itertools.count():
        n = left.count()
        shards = max(1, -(-n // shard_rows))
        placed = written(_islands(left, shards, capacity, islands if n > 1 else 1, epochs, number + 1, number), "placed")
        whole = placed if done is None else done.unionByName(placed)
        fill = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        if last is not None and fill.count() >= before:
            return last  # dealing the weak bins out again saved nothing
        if shards == 1:
            return whole
        last, loose = whole, fill.filter(F.col("fill") < weak * capacity).select("sequence_id")
        firm = placed.join(loose, "sequence_id", "left_anti")
        done = firm if done is None else done.unionByName(firm)
        left = placed.join(loose, "sequence_id", "left_semi").select(*[x.split()[0] for x in PIECES.split(", ")])
        before = loose.count()


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, cache: int = CACHE_BOUND, **how) -> DataFrame:
    """Tokenises and packs every row of docs (doc_id, text).

    Defined results: null and empty text is the end id alone, one piece of length 1. Rows that share a doc_id are
    packed each. Further columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer, end_id, capacity, cache), capacity, **how)
