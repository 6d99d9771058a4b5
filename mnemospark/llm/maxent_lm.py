"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

Tokens are words (A-Z lower-cased) and one end for each text. The probability of a token is that of its class in
context times its share of the class:

* Classes come from the exact counts of all training tokens: the most frequent tokens have a class each, the most
  frequent word endings share one each, other endings share the rest by hash. They only factor the softmax.
* P(class | context) is a softmax over groups of classes times one over the classes of the group. The first has
  features of the words themselves: the word before (n-gram), the word two before (skip), and both together (trigram
  with the outcome), hashed into buckets; and, like the second, features of their classes: the class before, the class
  two before, both together. The number of buckets follows the training tokens (``buckets_for``): a power of two of
  about four times the root of their number, so the model grows with the corpus, and the weights that are summed and
  sent around grow far slower than the data.
* Inside a class a token has (c + 0.1) / (N_class + 0.1 * (V_class + 1)), unseen tokens sharing the last part; a
  class of one token gives 1. So the probabilities of a class sum to one as the baseline's do over all tokens.

One pass over the texts turns all of them into arrays of 64-bit token keys, which the later passes read instead. The
training texts' arrays give exact token counts. The class features are trained first, on
the counts of (class two before, class before, class); then the word features, on all positions of all training texts.
A round of either is distributed: tasks send slices of observed and expected counts by (feature, outcome), for words only of the
buckets that they met, slices of all tasks are summed on the executors, and a gradient step is made: observed minus
expected, scaled by the expected. Scoring is one pass over the arrays, in batches, with sparse gathers of the active
features' weights.

Counts of at most ``head`` of the most frequent tokens go to the workers (a bounded table); every other token of a document
meets its exact count in a shuffle join of 64-bit token hashes, one row for each distinct token of a document.

Defined results: null and empty text is one end token. Without training texts all counts are 0 and the base score is
0. Rows that share a doc_id are scored each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import itertools
import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import hold, text_of, written

CACHE_BOUND = 300_000
GROUP_TOKENS, POSITIONS, COUNTED = 100_000, 100_000, 1_000_000
SUFFIXES = 4096
GROUPS, PER_GROUP = 8, 16
CLASSES = GROUPS * PER_GROUP  # class c is in group c % GROUPS, so the most frequent tokens lie in different groups
OWN, ENDINGS = 60, 60  # classes of single tokens and of single endings; the others share the rest
END = b""


def words_of(text: str) -> list[bytes]:
    """The tokens of a text: ASCII lower case, split at ASCII white space, then the end."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


class Lexicon:
    """Numbers for the words that a worker meets, and arrays of their properties by number; bounded.

    properties: arrays of one value for each of some words.
    """

    def __init__(self, properties, dtypes: list):
        self.properties, self.index = properties, {}
        self.columns = [np.zeros(1 << 16, t) for t in dtypes]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        n = np.fromiter(map(index.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(n < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(words[i] for i in unknown))
            a, z = len(index), len(index) + len(new)
            index.update(zip(new, range(a, z), strict=True))
            for k, values in enumerate(self.properties(new)):
                while z > len(self.columns[k]):
                    self.columns[k] = np.concatenate([self.columns[k], np.zeros_like(self.columns[k])])
                self.columns[k][a:z] = values
            n[unknown] = [index[words[i]] for i in unknown]
        return n

    def values(self, k: int) -> np.ndarray:
        return self.columns[k][: len(self.index)]

    def trim(self) -> None:
        if len(self.index) > CACHE_BOUND:
            self.clear()

    def clear(self) -> None:
        self.index.clear()


def keys_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit key of each word: 52 bits of its hash, and in the last 12 the number of its ending."""
    import xxhash
    import zlib

    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    endings = np.fromiter((zlib.crc32(w[-3:]) for w in words), np.uint64, len(words)) % np.uint64(SUFFIXES)
    return hashes & ~np.uint64(SUFFIXES - 1) | endings


def _groups(texts):
    """Lists of token lists, about GROUP_TOKENS tokens each."""
    held, size = [], 0
    for t in texts:
        w = words_of(t)
        held.append(w)
        size += len(w)
        if size >= GROUP_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


ENCODED = "doc_id long, learn boolean, n_tokens long, keys binary"

_LEXICON = Lexicon(lambda words: (keys_of(words),), [np.uint64])


def _lexicon() -> Lexicon:
    """The worker's own, from task to task: keys are the same whatever the corpus."""
    hold("language model", _LEXICON.clear)
    return _LEXICON


def encode(docs: DataFrame, training: Column) -> DataFrame:
    """ENCODED rows of every text: the keys of its tokens, which all later passes read."""

    def run(batches):
        lexicon = _lexicon()
        for b in batches:
            done = 0
            for group in _groups(t.as_py() for t in b.column(2)):  # a group of texts is a batch, so keys of many texts are never held
                n = lexicon.numbers([w for ws in group for w in ws])
                k = lexicon.values(0)[n]
                sizes = [len(ws) for ws in group]
                ends = np.cumsum(sizes).tolist()
                keys = [k[z - size : z].tobytes() for z, size in zip(ends, sizes, strict=True)]
                ids, learn = (b.column(i).slice(done, len(sizes)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, learn, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], names=[x.split()[0] for x in ENCODED.split(", ")])
                done += len(sizes)
                lexicon.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("learn"), text_of().alias("text")).mapInArrow(run, ENCODED)


def _without_lexicon() -> None:
    """Later passes read keys: the worker's words go, and their memory with them."""
    hold("language model keys", dict)


def _each(column: pa.Array):
    """The values of a column one by one: a list would hold a batch's keys a second time."""
    return (x.as_py() for x in column)


BATCH_ROWS = 1000  # texts that pass between Spark and a worker at once


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """While it holds, jobs pass at most so many rows at once to Python: their buffers, on both sides, hold whole texts or their keys."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def count_tokens(encoded: DataFrame) -> DataFrame:
    """(hash, c) of every token key of encoded texts; partial counts are summed before the shuffle."""

    def run(batches):
        _without_lexicon()
        held, size = [], 0

        def flush():
            k, c = np.unique(np.frombuffer(b"".join(held), np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["hash", "c"])

        for b in batches:
            for k in _each(b.column(0)):
                held.append(k)
                size += len(k) // 8
                if size >= COUNTED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return encoded.select("keys").mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


class Classes:
    """Classes of tokens, from the tokens (as signed keys) and endings that have one of their own."""

    def __init__(self, own: list[int], endings: list[int]):
        self.own = {h: k for k, h in enumerate(own)}
        self.sorted = np.sort(np.array(own, np.int64).view(np.uint64))
        self.own_class = np.array([self.own[h] for h in self.sorted.view(np.int64).tolist()], np.int64)
        self.endings = np.array([OWN + ENDINGS + k % (CLASSES - OWN - ENDINGS) for k in range(SUFFIXES)])
        self.endings[endings] = OWN + np.arange(len(endings))

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        out = self.endings[(keys & np.uint64(SUFFIXES - 1)).astype(np.int64)]
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            own = self.sorted[at] == keys
            out[own] = self.own_class[at[own]]
        return out

    def of(self, w: bytes) -> int:
        return int(self.of_keys(keys_of([w]))[0])

    def column(self) -> Column:
        """The class of rows (hash)."""
        table, ending = F.array(*[F.lit(int(x)) for x in self.endings]), _ending()
        if not self.own:
            return F.element_at(table, ending + 1)
        own = F.create_map(*[F.lit(x) for h, k in self.own.items() for x in (h, k)])
        return F.coalesce(F.element_at(own, F.col("hash")), F.element_at(table, ending + 1))


def _ending() -> Column:
    return F.col("hash").bitwiseAND(F.lit(SUFFIXES - 1)).cast("int")


def positions(batch_keys, classes: Classes):
    """Arrays over all positions of some texts, about POSITIONS at a time: text sizes, keys, class, class context, word hashes before."""
    end_class, held, size = classes.of(END), [], 0

    def made():
        sizes = np.array([len(k) // 8 for k in held])
        keys = np.frombuffer(b"".join(held), np.uint64)
        c = classes.of_keys(keys)
        begins = np.cumsum(sizes)[:-1]
        one, two = before(c, begins, end_class)
        return sizes, keys, c, two * CLASSES + one, before((keys >> np.uint64(32)).astype(np.uint32), begins, np.uint32(0))

    for k in batch_keys:
        held.append(k)
        size += len(k) // 8
        if size >= POSITIONS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def class_trigrams(encoded: DataFrame, classes: Classes) -> DataFrame:
    """(cell, n): how often each (class two before, class before, class) occurs in training texts."""

    def run(batches):
        _without_lexicon()
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for _, _, c, ctx, _ in positions(_each(b.column(0)), classes):
                np.add.at(total, ctx * CLASSES + c, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    return encoded.filter("learn").select("keys").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def before(x: np.ndarray, begins: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The values one and two places before each; end stands before every text."""
    one, two = np.empty_like(x), np.empty_like(x)
    one[1:], two[2:] = x[:-1], x[:-2]
    one[:1], two[:2] = end, end
    one[begins] = end
    two[begins] = end
    after = begins + 1
    two[after[after < len(x)]] = end
    return one, two


class MaxEnt:
    """Weights by feature row and outcome; outcomes are the groups and, in their group, the classes."""

    ACTIVE = 4

    def __init__(self, pairs: int = 2048):
        self.pairs = pairs
        self.rows = 1 + 2 * CLASSES + pairs
        self.w = np.zeros((self.rows, GROUPS + CLASSES))

    def features(self, ctx: np.ndarray) -> np.ndarray:
        """Feature rows of contexts (two * CLASSES + one)."""
        one, two = ctx % CLASSES, ctx // CLASSES
        pair = ((one * 40503 + two * 30011 + 7) * 2654435761 >> 12) % self.pairs
        return np.stack([np.zeros_like(ctx), 1 + one, 1 + CLASSES + two, 1 + 2 * CLASSES + pair], axis=1)

    def log_outcomes(self, ctx: np.ndarray) -> np.ndarray:
        """log P(group | context) and log P(class | group, context), side by side."""
        z = self.w[self.features(ctx)].sum(axis=1)
        g, k = z[:, :GROUPS], z[:, GROUPS:].reshape(-1, PER_GROUP, GROUPS)
        norm = lambda v: v - v.max(axis=1, keepdims=True) - np.log(np.exp(v - v.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
        return np.hstack([norm(g), norm(k).reshape(len(ctx), CLASSES)])

    def log_classes(self, ctx: np.ndarray) -> np.ndarray:
        out = self.log_outcomes(ctx)
        return np.tile(out[:, :GROUPS], PER_GROUP) + out[:, GROUPS:]

    def group_logits(self) -> np.ndarray:
        """What the class features give to each group, for every context of two classes."""
        ctx = np.arange(CLASSES**2)
        return sum(self.w[f][:, :GROUPS] for f in self.features(ctx).T).astype(np.float32)

    def log_in_group(self) -> np.ndarray:
        """log P(class | its group, context) for every context of two classes."""
        return np.vstack([self.log_outcomes(np.arange(a, a + 2048))[:, GROUPS:] for a in range(0, CLASSES**2, 2048)])

    def observed_expected(self, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Observed and expected counts of (feature row, outcome), and -log likelihood in the last place."""
        ctx, at = np.unique(cells // CLASSES, return_inverse=True)
        c = cells % CLASSES
        feats, log_p = self.features(ctx), self.log_outcomes(ctx)
        seen = np.zeros((len(ctx), GROUPS + CLASSES))
        np.add.at(seen, (at, c % GROUPS), n)
        np.add.at(seen, (at, GROUPS + c), n)
        p = np.exp(log_p)
        want = np.hstack([p[:, :GROUPS] * seen[:, :GROUPS].sum(axis=1, keepdims=True), p[:, GROUPS:] * np.tile(seen[:, :GROUPS], PER_GROUP)])
        both = np.zeros((2, self.rows, GROUPS + CLASSES))
        for k in range(self.ACTIVE):
            np.add.at(both[0], feats[:, k], seen)
            np.add.at(both[1], feats[:, k], want)
        loss = -float((n * (log_p[at, c % GROUPS] + log_p[at, GROUPS + c])).sum())
        return np.append(both.ravel(), loss)

    def step(self, total: np.ndarray, rate: float, prior: float = 2.0) -> None:
        """A gradient step, each weight scaled by its expected count; rate: of the share that each active feature takes.

        Every context has ACTIVE features, whose steps add up: at rate 1 the sum moves as far as one feature alone would.
        """
        seen, want = total[:-1].reshape(2, self.rows, -1)
        self.w += rate / self.ACTIVE * np.clip((seen - want) / (want + prior), -0.9, 4.0) - 0.0002 * self.w


def summed(parts: DataFrame, vector, length: int, tasks: int | None = None, near: int = 32) -> np.ndarray | None:
    """The sum over all tasks of vector(batches of a task), a float array of some length or None, added on the executors.

    Each task sends slices of its vector. Slices of one number meet in a shuffle, first those of ``near`` neighbouring
    tasks, then the rest, so no task reads more with more tasks, but for one slice of each group; the driver takes one vector.
    tasks: their number, where known; few of them need no first meeting.
    """
    slices = min(1024, max(4, length // 65_536))
    step = -(-length // slices)

    def run(batches):
        v = vector(batches)
        if v is not None:
            cut = [v[a : a + step].astype(np.float32).tobytes() for a in range(0, length, step)]
            group = np.full(len(cut), TaskContext.get().partitionId() // near, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array(group), pa.array(cut, pa.binary())], names=["slice", "near", "v"])

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                v = np.frombuffer(v.as_py(), np.float32).astype(float)
                total[k, g] = total[k, g] + v if (k, g) in total else v
        if total:
            keys = np.array(list(total), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["slice", "near", "v"])

    kind = "slice int, near int, v binary"
    first = parts.mapInArrow(run, kind)
    if tasks is None or tasks > near:
        first = first.repartition("slice", "near").mapInArrow(add, kind)
    whole = first.withColumn("near", F.lit(0)).repartition(slices, "slice").mapInArrow(add, kind)
    got = {r.slice: np.frombuffer(r.v, np.float32).astype(float) for r in whole.collect()}
    return np.concatenate([got[k] for k in sorted(got)]) if got else None


def train(trigrams: DataFrame, rounds: int = 14, cells_a_task: int = 100_000) -> MaxEnt:
    """Gradient rounds of the class features over (cell, n) rows."""
    model = MaxEnt()
    held = written(trigrams, "class-trigrams")
    parts = max(1, -(-held.count() // cells_a_task))
    held = written(held.repartition(parts, F.floor(F.col("cell") / CLASSES)), "class-trigrams")
    sc = held.sparkSession.sparkContext

    for _ in range(rounds):
        now = sc.broadcast(pickle.dumps(model))

        def gradient(batches):
            got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
            if got:
                cells, n = (np.concatenate(x) for x in zip(*got, strict=True))
                return pickle.loads(now.value).observed_expected(cells.astype(np.int64), n.astype(float))

        total = summed(held.select("cell", "n"), gradient, 2 * model.w.size + 1, parts)
        if total is None:
            break
        model.step(total, 1.0)
        now.unpersist()
    return model


def buckets_for(tokens: int) -> int:
    """Buckets of word features: a power of two, about four times the root of the training tokens."""
    return 1 << max(10, int(np.ceil(np.log2(4 * max(1, tokens) ** 0.5))))


class WordFeatures:
    """Weights by bucket and group of hashed words before: n-gram, skip, and both together."""

    ACTIVE = 3

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.w = np.zeros((buckets, GROUPS), np.float32)

    def rows(self, words: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """The active buckets, from the hashes of the words one and two before."""
        one, two = (x.astype(np.uint64) for x in words)
        keys = (one * np.uint64(0x9E3779B97F4A7C15), two * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1), (one * np.uint64(0xD6E8FEB86659FD93) ^ two) * np.uint64(0xA0761D6478BD642F) + np.uint64(2))
        shift = np.uint64(64 - self.buckets.bit_length() + 1)
        return [(k >> shift).astype(np.int64) for k in keys]

    def log_groups(self, z: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """log P(group | context); z: what the class features give."""
        for r in rows:
            z = z + self.w[r]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    @staticmethod
    def moved(seen: np.ndarray, want: np.ndarray, rate: float = 1.0, prior: float = 4.0) -> np.ndarray:
        """What a gradient step adds to the weights of buckets with these observed and expected counts."""
        return (rate / WordFeatures.ACTIVE * np.clip((seen - want) / (want + prior), -0.9, 4.0)).astype(np.float32)


TOUCHED, SLICE = 250_000, 4096  # buckets that a worker holds sums of before it hands them on, and buckets of a slice


class TouchedSums:
    """Observed and expected counts by group of the buckets met so far: memory follows them, whatever the size of the model."""

    def __init__(self, buckets: int):
        self.place = np.full(buckets, -1, np.int32)
        self._empty()

    def _empty(self) -> None:
        self.met, self.sums = np.zeros(0, np.int64), np.zeros((2 * GROUPS, 0))

    def add(self, rows: list[np.ndarray], group: np.ndarray, p: np.ndarray) -> None:
        """Positions with their active buckets, their group, and each group's probability (groups x positions)."""
        fresh = np.unique(np.concatenate([r[self.place[r] < 0] for r in rows]))
        if len(fresh):
            self.place[fresh] = np.arange(len(self.met), len(self.met) + len(fresh))
            self.met = np.concatenate([self.met, fresh])
            self.sums = np.hstack([self.sums, np.zeros((2 * GROUPS, len(fresh)))])
        n = len(self.met)
        for r in rows:
            at = self.place[r].astype(np.int64)
            self.sums[:GROUPS] += np.bincount(group * n + at, minlength=GROUPS * n).reshape(GROUPS, n)
            for g in range(GROUPS):
                self.sums[GROUPS + g] += np.bincount(at, p[g], n)

    def drained(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(slice, buckets in it, their sums) of all that was met, which is forgotten."""
        order = np.argsort(self.met)
        met, sums = self.met[order], self.sums[:, order].T.astype(np.float32)
        self.place[met] = -1
        self._empty()
        cuts = np.append(np.flatnonzero(np.diff(met // SLICE, prepend=-1)), len(met))
        return [(int(met[i] // SLICE), (met[i:j] % SLICE).astype(np.int32), sums[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


SLICED = "slice int, near int, at binary, v binary"


def _sliced(parts: list[tuple[int, np.ndarray, np.ndarray]], near: int) -> pa.RecordBatch:
    columns = [pa.array([k for k, _, _ in parts], pa.int32()), pa.array([near] * len(parts), pa.int32()), pa.array([at.tobytes() for _, at, _ in parts], pa.binary()), pa.array([v.tobytes() for _, _, v in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "near", "at", "v"])


def merged(parts: DataFrame, finish) -> DataFrame:
    """SLICED rows added up by (slice, near), which parts are sorted by: one slice at a time is held. finish: what a slice's sums become."""

    def whole(key, total):
        at = np.flatnonzero(total.any(axis=1))
        return _sliced([(key[0], at.astype(np.int32), finish(total[at]).astype(np.float32))], key[1])

    def run(batches):
        key, total = None, None
        for b in batches:
            for k, g, at, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if key != (k, g):
                    if key is not None:
                        yield whole(key, total)
                    key, total = (k, g), np.zeros((SLICE, 2 * GROUPS))
                at = np.frombuffer(at.as_py(), np.int32)
                total[at] += np.frombuffer(v.as_py(), np.float32).reshape(len(at), -1)
        if key is not None:
            yield whole(key, total)

    return parts.mapInArrow(run, SLICED)


def train_words(encoded: DataFrame, model: MaxEnt, classes: Classes, tokens: int, rounds: int = 2, near: int = 32, touched: int = TOUCHED) -> WordFeatures:
    """Gradient rounds of the word features over all positions of the training texts; the class features stand.

    A task hands on sums of the buckets that it met, sorted into slices of the model, and does so whenever it holds more than touched of them. Slices meet in
    a shuffle, first those of ``near`` neighbouring tasks, then the rest; the step is made where a slice's sum is, and the driver takes
    what it adds to the weights.
    """
    words = WordFeatures(buckets_for(tokens))
    z = model.group_logits()
    sc = encoded.sparkSession.sparkContext
    learn = encoded.filter("learn").select("keys")
    slices = -(-words.buckets // SLICE)
    for _ in range(rounds):
        now = sc.broadcast(pickle.dumps((words, z)))

        def gradient(batches):
            _without_lexicon()
            words, z = pickle.loads(now.value)
            sums, group = TouchedSums(words.buckets), TaskContext.get().partitionId() // near
            for b in batches:
                for _, _, c, ctx, before_ in positions(_each(b.column(0)), classes):
                    rows = words.rows(before_)
                    sums.add(rows, c % GROUPS, np.exp(words.log_groups(z[ctx], rows)).T.copy())
                    if len(sums.met) > touched:
                        yield _sliced(sums.drained(), group)
            if len(sums.met):
                yield _sliced(sums.drained(), group)

        first = learn.mapInArrow(gradient, SLICED).repartition("slice", "near").sortWithinPartitions("slice", "near")
        second = merged(first, lambda v: v).withColumn("near", F.lit(0)).repartition(slices, "slice").sortWithinPartitions("slice")
        steps = merged(second, lambda v: WordFeatures.moved(v[:, :GROUPS], v[:, GROUPS:])).select("slice", "at", "v").collect()  # of the weights' own size
        for r in steps:
            words.w[r.slice * SLICE + np.frombuffer(r.at, np.int32)] += np.frombuffer(r.v, np.float32).reshape(-1, GROUPS)
        now.unpersist()
        if not steps:
            break
    return words


class Scorer:
    """All that scoring takes but for the counts of rare tokens: the model, and the counts of the most frequent tokens."""

    def __init__(self, classes: Classes, model: MaxEnt, words: WordFeatures, denominators: np.ndarray, head: np.ndarray, head_c: np.ndarray):
        self.classes, self.words = classes, words
        self.group_z = model.group_logits()
        self.in_group = model.log_in_group().astype(np.float32)
        self.log_denominators = np.log10(denominators)
        keys = head.astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.head, self.head_c = keys[order], head_c[order]

    def log10_classes(self, c: np.ndarray, ctx: np.ndarray, before_: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 P(class | context) at each position."""
        groups = self.words.log_groups(self.group_z[ctx], self.words.rows(before_))
        return (groups[np.arange(len(c)), c % GROUPS] + self.in_group[ctx, c]) / np.log(10)

    def head_counts(self, keys: np.ndarray) -> np.ndarray:
        """The training count of each token; -1: not a head token."""
        if not len(self.head):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.head, keys), len(self.head) - 1)
        return np.where(self.head[at] == keys, self.head_c[at], -1)


SCORED = "row long, doc_id long, n_tokens long, head_log double, head_known long, tail array<struct<hash long, k long>>, class_log double"


def score_rows(encoded: DataFrame, scorer: Scorer) -> DataFrame:
    """SCORED rows: what the model and the head counts give to each text, and its other tokens with their numbers."""
    packed = encoded.sparkSession.sparkContext.broadcast(pickle.dumps(scorer))
    tail_type = pa.list_(pa.struct([("hash", pa.int64()), ("k", pa.int64())]))

    def run(batches):
        _without_lexicon()
        s = pickle.loads(packed.value)
        for b in batches:
            logs, known, class_log, tails = [], [], [], []
            for sizes, keys, c, ctx, before_ in positions(_each(b.column(3)), s.classes):
                stop = np.cumsum(sizes)
                begin = stop - sizes
                count = s.head_counts(keys)
                head = count >= 0
                logs += np.add.reduceat(np.where(head, np.log10(np.maximum(count, 0) + 0.1), 0.0), begin).tolist()
                known += np.add.reduceat((count > 0).astype(np.int64), begin).tolist()
                class_log += np.add.reduceat(s.log10_classes(c, ctx, before_) - s.log_denominators[c], begin).tolist()
                rare, of = keys[~head].view(np.int64), np.searchsorted(stop, np.flatnonzero(~head), "right")
                cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
                tails += [np.unique(rare[p:q], return_counts=True) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
            flat = [np.concatenate([np.zeros(0, np.int64), *(t[k] for t in tails)]) for k in (0, 1)]
            ends = np.cumsum([0, *(len(t[0]) for t in tails)]).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], ["hash", "k"])).cast(tail_type)
            made = [*b.columns[:3], pa.array(logs, pa.float64()), pa.array(known, pa.int64()), tail, pa.array(class_log, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "n_tokens", "head_log", "head_known", "tail", "class_log"])

    return encoded.select("row", "doc_id", "n_tokens", "keys").mapInArrow(run, SCORED)


def head_threshold(counts: DataFrame, head: int) -> int:
    """The least count such that at most head tokens reach it, from a histogram of fixed size (sixteenths of an octave)."""
    step = F.floor(F.log2("c") * 16).cast("int")
    seen, out = 0, 1 << 62
    for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("k")).collect():
        seen += r.n
        if seen > head:
            break
        out = r.least
    return out


class Fitted(NamedTuple):
    """All that training gives: exact counts (a table), their sum and number, and the model."""

    counts: DataFrame
    n: int
    v: int
    least: int  # head tokens have this count or more
    encoded: DataFrame
    classes: Classes
    scorer: Scorer


def fit(docs: DataFrame, training: Column, head: int = 200_000, rounds: int = 14, word_rounds: int = 2) -> Fitted:
    """Learns from the rows of docs (doc_id, text) where training holds; all rows are encoded."""
    encoded = written(encode(docs, training).withColumn("row", F.monotonically_increasing_id()), "encoded-texts")
    counts = written(count_tokens(encoded.filter("learn")), "token-counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    own = [r.hash for r in counts.orderBy(F.desc("c"), "hash").limit(OWN).collect()]
    rest = counts.filter(~F.col("hash").isin(own)) if own else counts
    endings = [r.ending for r in rest.groupBy(_ending().alias("ending")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "ending").limit(ENDINGS).collect()]
    classes = Classes(own, endings)
    denominators = np.full(CLASSES, 0.1)
    for r in counts.groupBy(classes.column().alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        denominators[r.k] = r.n + 0.1 if r.k < OWN else r.n + 0.1 * (r.v + 1)
    least = head_threshold(counts, head)
    top = counts.filter(F.col("c") >= least).select("hash", "c").toPandas()  # at most head rows of two numbers
    model = train(class_trigrams(encoded, classes), rounds)
    words = train_words(encoded, model, classes, n, word_rounds)
    scorer = Scorer(classes, model, words, denominators, top["hash"].to_numpy(np.int64), top["c"].to_numpy(np.int64))
    return Fitted(counts, n, v, least, encoded, classes, scorer)


def score_documents(docs: DataFrame, training: Column, **how) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text of docs; learns where training holds."""
    with small_batches(docs.sparkSession):
        fitted = fit(docs, training, **how)
        rows = written(score_rows(fitted.encoded, fitted.scorer), "scored-rows")
    n, v = fitted.n, fitted.v
    rare = fitted.counts.filter(F.col("c") < fitted.least).select("hash", "c")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.hash", "t.k").join(rare, "hash", "left")
    of_row = tail.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("tail_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("tail_known"))
    s1 = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    return rows.join(of_row, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (s1 - F.col("n_tokens") * F.lit(float(np.log10(n + 0.1 * (v + 1))))).alias("base_score"),
        (s1 + F.col("class_log")).alias("score"),
    )
