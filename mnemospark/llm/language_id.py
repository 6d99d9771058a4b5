"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A text's likelihood in a language is
that of its letter runs, and a run's likelihood is the sum over all ways to cut it into pieces, which a forward
recursion over its letters gives, however long the run. Probabilities come from expectation maximisation: forward and backward sums give
the expected count of each piece in the training words, and the counts give the next probabilities. In scoring, one run in a hundred may come from any language.

Training reads a bounded sample, ``sample`` documents of each language, picked by a hash of the id; its words are
counted by Spark, one task for each language runs the expectation maximisation, and the driver receives one table
of pieces by languages, whose size the vocabulary bounds. Scoring is one pass over all whole texts without a shuffle:
words are scored once for each worker, many at once, and looked up after.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned.
Ties go to the language that sorts first. Rows that share a doc_id each give a row; further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import hold, join_by_size, text_groups, text_of, texts_of, written

UNDETERMINED = "und"
STEPS = 24  # letters between two rescalings of the forward sums
LONG = 2048  # longer runs are scored in blocks side by side
FLOOR = 1e-7
FOREIGN = 0.01
CACHE_BOUND = 400_000
GROUP_CHARS = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Lower-case letter pieces of a sentencepiece model, found in words by rolling hashes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        seen = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k).lower()
            body = piece.lstrip("▁")
            if model.is_control(k) or model.is_byte(k) or model.is_unknown(k) or not (body.isalpha() or piece == "▁"):
                continue
            seen.setdefault("▁" * (piece[0] == "▁") + body)
        self.pieces = list(seen)
        self.size = len(self.pieces)
        self.by_length = []
        for m in range(1, max(map(len, self.pieces)) + 1):
            own = [(k, p) for k, p in enumerate(self.pieces) if len(p) == m]
            codes = np.array([[ord(c) for c in p] for _, p in own], np.uint64).reshape(len(own), m)
            h = np.zeros(len(own), np.uint64)
            for j in range(m):
                h = (h ^ codes[:, j]) * _P
                h ^= h >> np.uint64(29)
            order = np.argsort(h)
            self.by_length.append((h[order], np.array([k for k, _ in own], np.int64)[order] if own else np.zeros(0, np.int64)))

    def spans(self, words: list[str]):
        """words of one length n: for each span length m, ids of the pieces at each start (size: none), rows by words."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)
        out, h = [], np.zeros((len(words), n), np.uint64)
        for m in range(1, min(n, len(self.by_length)) + 1):
            h = (h[:, : n - m + 1] ^ codes[:, m - 1 :]) * _P
            h ^= h >> np.uint64(29)
            keys, ids = self.by_length[m - 1]
            if not len(keys):
                out.append(None)
                continue
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out.append(np.where(keys[at] == h, ids[at], self.size))
        return out


def forward(spans, n: int, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[position, word, language]: the summed probability of all segmentations of the first letters.

    It comes with the logarithm of its scale: every STEPS letters the sums that later ones need are divided by the
    greatest of them, so runs of any length keep their precision.
    """
    count, langs = spans[0].shape[0], prob.shape[1]
    alpha = np.zeros((n + 1, count, langs))
    scale = np.zeros((n + 1, count, langs) if n > STEPS else (1, 1, 1))
    alpha[0] = 1
    for j in range(1, n + 1):
        for m in range(1, min(j, len(spans)) + 1):
            if spans[m - 1] is not None:
                p = prob[spans[m - 1][:, j - m]]
                alpha[j] += alpha[j - m] * (np.maximum(p, FLOOR) if m == 1 else p)
        if n > STEPS:
            scale[j] = scale[j - 1]
            if j % STEPS == 0:
                near = slice(max(0, j - len(spans) + 1), j + 1)
                top = alpha[near].max(axis=0)
                alpha[near] /= top
                scale[near] += np.log(top)
    return alpha, scale


def log_of_long(spans, n: int, prob: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations of one long run, by language.

    The recursion is linear in its last sums, so a block of letters is a matrix between them. All blocks are run side by
    side, from each unit vector, and their matrices are then chained: the same sum, in about sqrt(n) steps.
    """
    reach, langs = len(spans), prob.shape[1]
    size = max(reach, int(n**0.5))
    begin = n - n // size * size
    head, head_scale = forward([None if x is None else x[:, : max(1, begin)] for x in spans], begin, prob) if begin else (np.ones((1, 1, langs)), np.zeros((1, 1, langs)))
    state = np.zeros((reach, langs))
    for k in range(min(reach, begin + 1)):
        state[k] = head[begin - k, 0] * np.exp((head_scale[begin - k] - head_scale[begin])[0] if begin > STEPS else 0.0)
    log_sum = head_scale[-1, 0].copy()
    starts = np.arange(begin, n, size)
    window = [np.repeat(np.eye(reach)[k][None, :, None], langs, 2) * np.ones((len(starts), 1, 1)) for k in range(reach)]  # [k]: sums k letters back
    scale = np.zeros((len(starts), langs))
    for j in range(1, size + 1):
        new = np.zeros_like(window[0])
        for m, ids in enumerate(spans, 1):
            if ids is not None:
                at = starts + j - m
                p = prob[ids[0, np.maximum(at, 0)]]
                new += window[m - 1] * np.where(at[:, None] >= 0, np.maximum(p, FLOOR) if m == 1 else p, 0.0)[:, None, :]
        window = [new, *window[:-1]]
        if j % STEPS == 0 or j == size:
            top = np.max([w.max(axis=1) for w in window], axis=0)
            window = [w / top[:, None, :] for w in window]
            scale += np.log(top)
    for k in range(len(starts)):
        state = np.array([(w[k] * state).sum(axis=0) for w in window])
        top = state.max(axis=0)
        state, log_sum = state / top, log_sum + scale[k] + np.log(top)
    return np.log(state[0]) + log_sum


def by_length(words):
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for n, ks in groups.items():
        step = max(1, min(4096, 200_000 // n))
        for a in range(0, len(ks), step):
            part = ks[a : a + step]
            yield part, [words[k] for k in part]


def log_likelihood(pieces: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """log of each word's marginal in each language; prob has a last row of zeros."""
    out = np.empty((len(words), prob.shape[1]))
    for ks, same in by_length(words):
        n = len(same[0])
        if n > LONG:
            out[ks] = [log_of_long(pieces.spans([w]), n, prob) for w in same]
        else:
            alpha, scale = forward(pieces.spans(same), n, prob)
            out[ks] = np.log(alpha[-1]) + scale[-1]
    return out


def tolerant(ll: np.ndarray) -> np.ndarray:
    """Each run's likelihood where a share FOREIGN of a text's runs may come from any language.

    So a run moves the odds of two languages by a bounded factor, and a quoted passage does not outvote its text.
    """
    top = ll.max(axis=1, keepdims=True)
    any_ = top + np.log(np.exp(ll - top).mean(axis=1, keepdims=True))
    return np.logaddexp(ll + np.log(1 - FOREIGN), any_ + np.log(FOREIGN))


def expectation_maximisation(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int, smooth: float) -> np.ndarray:
    """Piece probabilities of one language."""
    prob = np.full(pieces.size, 1.0 / pieces.size)
    groups = [(np.array(ks), pieces.spans(same), len(same[0])) for ks, same in by_length(words)]
    for _ in range(rounds):
        table, expected = np.append(prob, 0.0)[:, None], np.zeros(pieces.size + 1)
        for ks, spans, n in groups:
            alpha, up = (x[..., 0] for x in forward(spans, n, table))
            beta, down = (x[::-1, ..., 0] for x in forward([None if x is None else x[:, ::-1] for x in spans], n, table))
            weight = counts[ks] / alpha[n]
            for m, ids in enumerate(spans, 1):
                if ids is not None:
                    p = table[ids, 0]
                    post = alpha[: n - m + 1].T * (np.maximum(p, FLOOR) if m == 1 else p) * beta[m:].T * weight[:, None]
                    if n > STEPS:
                        post *= np.exp((up[: n - m + 1] + down[m:] - up[n]).T)
                    expected += np.bincount(ids.ravel(), post.ravel(), pieces.size + 1)
        prob = (expected[:-1] + smooth) / (expected[:-1].sum() + smooth * pieces.size)
    return prob


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Model:
    """Languages and log-likelihood tables; scores words through a bounded cache."""

    def __init__(self, path: str, langs: list[str], prob: np.ndarray):
        self.path, self.langs = path, langs
        self.prob = np.vstack([prob, np.zeros((1, len(langs)))])
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(langs) + 1))

    def __getstate__(self):
        return self.path, self.langs, self.prob[:-1]

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, chunks: list[str]) -> None:
        import regex

        runs, owner = [], []
        for k, c in enumerate(chunks):
            for r in regex.findall(r"\p{L}+", c.lower()):
                runs.append("▁" + r)
                owner.append(k)
        rows = np.zeros((len(chunks), len(self.langs) + 1))
        if runs:
            names = list(dict.fromkeys(runs))
            at = {r: k for k, r in enumerate(names)}
            ll = tolerant(log_likelihood(pieces_of(self.path), names, self.prob))[[at[r] for r in runs]]
            np.add.at(rows[:, :-1], owner, ll)
            np.add.at(rows[:, -1], owner, 1)
        begin = len(self.index)
        while begin + len(chunks) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[begin : begin + len(chunks)] = rows
        self.index.update((c, begin + k) for k, c in enumerate(chunks))

    def sums(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text in each language, and its number of letter runs."""
        words = [t.split() for t in texts]
        missing = set().union(*words) - self.index.keys()
        if len(self.index) + len(missing) > CACHE_BOUND:
            self.index.clear()
            missing = set().union(*words)
        if missing:
            self._learn(list(missing))
        out = np.zeros((len(texts), self.table.shape[1]))
        for k, w in enumerate(words):
            if w:
                out[k] = self.table[np.fromiter(map(self.index.__getitem__, w), np.int64, len(w))].sum(axis=0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        sums = self.sums(texts)
        ll, letters = sums[:, :-1], sums[:, -1]
        best = ll.argmax(axis=1)
        score = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
        known = letters > 0
        return [self.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(docs: DataFrame, train: Column, path: str, sample: int = 1500, rounds: int = 4, smooth: float = 0.05, salt: int = 7) -> Model:
    """Learns from the rows of docs (doc_id, text, lang) where train holds; at most about sample documents a language.

    Rows are drawn by a hash of id and text, so rows that share an id, or have none, are drawn one by one; equal rows count once.
    """
    known = docs.filter(train & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    share = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", "n", (F.lit(float(sample)) / F.col("n")).alias("share"))
    row = F.xxhash64("doc_id", "text", F.lit(salt))
    chosen = join_by_size(known.withColumn("h", row), share, ["lang"], "n").filter(F.pmod("h", F.lit(1_000_003)) / 1_000_003 < F.col("share"))
    chosen = chosen.dropDuplicates(["lang", "h"])
    words = (
        chosen.select("lang", F.explode(F.split(F.lower(text_of()), r"[^\p{L}]+")).alias("word"))
        .filter(F.col("word") != "")
        .groupBy("lang", "word")
        .count()
    )

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces_of(path)
        totals: dict[str, float] = {}
        for w, c in zip(pdf["word"], pdf["count"], strict=True):
            for a in range(0, len(w), LONG - 1):  # in training alone, a longer run is counted in parts
                part = "▁" * (a == 0) + w[a : a + LONG - 1]
                totals[part] = totals.get(part, 0) + c
        prob = expectation_maximisation(pieces, list(totals), np.array(list(totals.values()), float), rounds, smooth)
        return pd.DataFrame({"lang": key[0], "prob": [prob.tolist()]})

    learned = written(words.groupBy("lang").applyInPandas(learn, "lang string, prob array<double>"), "language-pieces")
    rows = learned.orderBy("lang").collect()  # languages by pieces of the vocabulary
    prob = np.array([r.prob for r in rows]).T if rows else np.zeros((pieces_of(path).size, 0))
    return Model(path, [r.lang for r in rows], prob)


_LIVE: dict[bytes, Model] = {}


def live(packed: bytes) -> Model:
    """The worker's own copy, whose cache stays from task to task."""
    import hashlib
    import pickle

    hold("language", _LIVE.clear)
    key = hashlib.sha256(packed).digest()
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = pickle.loads(packed)
    return _LIVE[key]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text of docs."""
    import pickle

    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = live(packed.value)
        for b in batches:
            langs, scores = [], []
            for part in text_groups((t.as_py() for t in b.column(1)), GROUP_CHARS):
                lang, score = m.predict(part)
                langs += lang
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
