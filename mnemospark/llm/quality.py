"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gives a fixed list of numeric features. Each feature is cut into bins at quantiles of the training rows.
Boosting is cyclic: features take turns, each adds a shallow tree over its own bins (at most ``leaves`` leaves) fitted
to the gradient of the logistic loss, and the trees of a feature add up to one lookup table. Then pairs of features,
ranked by how much of the remaining gradient a coarse two-way table explains, get lookup tables in the same way. A
score is the intercept plus one addition from each table, for whole batches at once.

The model is fitted on the driver on at most ``bound`` labelled rows (a documented bound, picked by a hash of the
id), of which only the features are fetched. Scoring is one pass over all whole texts, without a shuffle.

Defined results: null text counts as empty; empty text has a row of zero features and a score as any other. Without
labelled rows every score is 0.5. Where a doc_id repeats, each row is scored; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import hold, text_of, texts_of

FEATURES = [
    "log_chars", "log_words", "mean_word", "long_words", "upper", "digit", "punct", "symbol", "space", "non_ascii",
    "distinct_words", "top_word", "symbol_words", "line_chars", "line_repeats", "end_marks",
    "upper_words", "comma_rate", "stop_rate", "short_lines", "longest_word", "pair_repeats",
]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_HIGH = np.arange(256) >= 128


def features(text: str) -> list[float]:
    """The features of one whole text; all zeros for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(data, minlength=256)
    chars, words, lines = len(text), text.split(), [x for x in text.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    many = list(counts.items())
    share = lambda test: sum(c for w, c in many if test(w)) / n
    top = sum(sorted(counts.values(), reverse=True)[:8]) / n
    pairs = len(set(zip(words, words[1:], strict=False)))
    rate = lambda mask: float(hist[mask].sum()) / len(data)
    return [
        np.log1p(chars), np.log1p(len(words)), sum(map(len, words)) / n, share(lambda w: len(w) > 12),
        rate(_UPPER), rate(_DIGIT), rate(_PUNCT), rate(_SYMBOL), rate(_SPACE), rate(_HIGH),
        len(counts) / n, top, share(lambda w: not w[0].isalnum() and not w[-1].isalnum()),
        np.log1p(chars / m), 1 - len(set(lines)) / m, sum(x[-1] in ".!?" for x in lines) / m,
        share(str.isupper), hist[44] / n, sum(c for w, c in many if len(w) <= 3) / n,
        sum(len(x) < 30 for x in lines) / m, float(min(64, max(map(len, words), default=0))), 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int, penalty: float, least: float) -> np.ndarray:
    """A value for each bin: a tree of at most leaves intervals of bins, grown by best gain."""
    cg, ch = np.append(0, np.cumsum(grad)), np.append(0, np.cumsum(hess))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + penalty)

    def best(a: int, b: int):
        cut = np.arange(a + 1, b)
        ok = (ch[cut] - ch[a] >= least) & (ch[b] - ch[cut] >= least)
        cut = cut[ok]
        if not len(cut):
            return 0.0, a, b, -1
        gains = gain(a, cut) + gain(cut, b) - gain(a, b)
        k = int(gains.argmax())
        return float(gains[k]), a, b, int(cut[k])

    done, open_ = [], [best(0, len(grad))]
    while open_ and len(done) + len(open_) < leaves:
        open_.sort()
        g, a, b, cut = open_.pop()
        if cut < 0 or g <= 1e-9:
            done.append((g, a, b, cut))
            continue
        open_ += [best(a, cut), best(cut, b)]
    out = np.zeros(len(grad))
    for _, a, b, _ in done + open_:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + penalty)
    return out


class AdditiveModel:
    """Lookup tables of features and pairs of features."""

    def __init__(self, bins: int = 64, coarse: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.15, leaves: int = 4, penalty: float = 1.0, least: float = 2.0):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs = bins, coarse, rounds, pair_rounds, pairs
        self.rate, self.leaves, self.penalty, self.least = rate, leaves, penalty, least
        self.intercept, self.edges, self.tables, self.pairs, self.pair_tables = 0.0, [], [], [], []

    def _edges(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        if not len(y):
            return self
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(share / (1 - share)))
        n = x.shape[1]
        self.edges = [self._edges(x[:, j], self.bins) for j in range(n)]
        self.wide = [self._edges(x[:, j], self.coarse) for j in range(n)]
        fine = [np.searchsorted(self.edges[j], x[:, j], "right") for j in range(n)]
        wide = [np.searchsorted(self.wide[j], x[:, j], "right") for j in range(n)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for j in range(n):
                p = 1 / (1 + np.exp(-f))
                k = len(self.tables[j])
                step = self.rate * shallow_tree(np.bincount(fine[j], p - y, k), np.bincount(fine[j], p * (1 - p), k), self.leaves, self.penalty, self.least)
                self.tables[j] += step
                f += step[fine[j]]
        p = 1 / (1 + np.exp(-f))
        ranked = []
        for a, b in itertools.combinations(range(n), 2):
            cell = wide[a] * (len(self.wide[b]) + 1) + wide[b]
            g, h = np.bincount(cell, p - y), np.bincount(cell, p * (1 - p))
            ranked.append((float((g**2 / (h + 10 * self.penalty)).sum()), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(ranked, reverse=True)[: self.n_pairs]]
        cells = [wide[a] * (len(self.wide[b]) + 1) + wide[b] for a, b in self.pairs]
        self.pair_tables = [np.zeros((len(self.wide[a]) + 1) * (len(self.wide[b]) + 1)) for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for table, cell in zip(self.pair_tables, cells, strict=True):
                p = 1 / (1 + np.exp(-f))
                order = np.argsort(table, kind="stable")  # a shallow tree over cells, in the order of their values
                g, h = np.bincount(cell, p - y, len(table)), np.bincount(cell, p * (1 - p), len(table))
                order = np.argsort(-g / (h + self.penalty), kind="stable")
                step = np.zeros(len(table))
                step[order] = self.rate * shallow_tree(g[order], h[order], self.leaves, self.penalty, self.least)
                table += step
                f += step[cell]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.wide[a], x[:, a], "right") * (len(self.wide[b]) + 1) + np.searchsorted(self.wide[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, x: the features of every whole text."""

    def run(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return texts_of(docs).mapInArrow(run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train: Column, bound: int = 20_000, salt: int = 11, **how) -> AdditiveModel:
    """Fits on labelled rows (labels: doc_id, quality 0 or 1) where train holds, about bound of them and never more than twice as many.

    A doc_id with both labels counts with each; equal labels and equal rows of one doc_id count once. Where one doc_id has
    very many texts, a draw by row hash keeps 2 * bound rows in all.
    """
    known = labels.filter(train & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_003)) / 1_000_003
    chosen = known.filter(draw < bound / max(1, n))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # about bound rows of two numbers
    texts = texts.withColumn("h", F.xxhash64("doc_id", "text", F.lit(salt))).dropDuplicates(["doc_id", "quality", "h"])

    def run(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "h", "x"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "h", "text").mapInArrow(run, "doc_id long, quality int, h long, x array<double>")
    got = sorted(rows.orderBy("h").limit(2 * bound).collect(), key=lambda r: (r.doc_id, r.quality, r.h))
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    return AdditiveModel(**how).fit(x, np.array([r.quality for r in got], float))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score of every whole text of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hold("quality", dict)
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)]).reshape(len(b), len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")
