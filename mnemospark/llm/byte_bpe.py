"""Byte-level BPE encoding and decoding without regex.

A batch of texts becomes one array of code points, and a lookup table gives each its class: letter, number, space,
other white space, other. The split pattern of the vocabulary needs a few code points of context, which shifted
comparisons turn into one symbol for each position (the last of a white space run, the start of a contraction).
Over these symbols a finite automaton decides where a token starts. Each symbol is a function from state to state,
and functions compose associatively: the array is cut into blocks, the blocks' functions are composed side by side,
a logarithmic scan over the blocks gives the state that enters each, and one more pass yields the boundaries.

The slices between boundaries go through a cache to pair merging, which runs over all words of a batch that the
cache lacks at once: rows of part ids, in each step the adjacent pair of lowest rank of every row is merged. Where each slice
begins in its text, and how many tokens it has, is kept (``offsets``): with it a span of a text is decoded from the tokens
of the slices that it touches, and nothing else. A batch is decoded as one run of ids, cut by byte offsets.

Defined results: null and empty text gives no ids, so 0 tokens and the digest of nothing. Further columns are
ignored; rows that share a doc_id each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemospark.llm.common import hold, text_groups, texts_of

CACHE_BOUND = 600_000
LONGEST = 64  # longer slices are not kept
MATRIX_LONGEST = 48  # bytes; longer slices are merged one at a time
BLOCK = 256

# Classes of code points.
LETTER, NUMBER, SPACE, WHITE, OTHER = range(5)
# Symbols: classes with their context. *_LAST: of its run, before something else. END: the gap between texts.
S_LETTER, S_NUMBER, S_SPACE, S_SPACE_LAST, S_WHITE, S_WHITE_LAST, S_OTHER, S_CONTR1, S_CONTR2, S_END, N_SYMBOLS = range(11)
# States: what the last position was. FRESH: a token has just ended. OWED1, OWED2: positions that a contraction still takes.
FRESH, IN_LETTERS, IN_NUMBERS, ATTACHING, IN_WHITE, IN_OTHER, OWED1, OWED2, N_STATES = range(9)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next state and whether a token starts, by symbol and state."""
    step, starts = np.zeros((N_SYMBOLS, N_STATES), np.uint8), np.ones((N_SYMBOLS, N_STATES), bool)
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER}
    for s, state in run.items():
        step[s] = state
        starts[s, [state, ATTACHING]] = False
    for s in (S_SPACE, S_WHITE):
        step[s] = IN_WHITE
        starts[s, IN_WHITE] = False
    step[S_SPACE_LAST] = ATTACHING
    step[S_WHITE_LAST] = FRESH
    # An apostrophe joins a run of others, or the space before it; only elsewhere it begins a contraction.
    step[S_CONTR1], step[S_CONTR2] = OWED1, OWED2
    for s in (S_CONTR1, S_CONTR2):
        step[s, [IN_OTHER, ATTACHING]] = IN_OTHER
        starts[s, [IN_OTHER, ATTACHING]] = False
    for s in range(N_SYMBOLS):  # letters of a contraction, whatever they are
        step[s, OWED2], step[s, OWED1] = OWED1, FRESH
        starts[s, [OWED1, OWED2]] = False
    step[S_END] = FRESH
    starts[S_END] = True
    return step, starts


STEP, STARTS = _automaton()


@functools.lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, from Unicode's general categories."""
    import regex

    text = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[codes[m.start() : m.end()]] = kind
    table[ord(" ")] = SPACE
    return table


def symbols(codes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """One symbol a code point; gaps: positions that stand between texts."""
    kind = class_table()[codes]
    kind[gaps] = 255
    nxt = np.append(kind[1:], 255)
    out = np.array([S_LETTER, S_NUMBER, S_SPACE, S_WHITE, S_OTHER] + [S_END] * 251, np.uint8)[kind]
    white = (kind == SPACE) | (kind == WHITE)
    last = white & (nxt != SPACE) & (nxt != WHITE) & (nxt != 255)
    out[last & (kind == SPACE)] = S_SPACE_LAST
    out[last & (kind == WHITE)] = S_WHITE_LAST
    at = np.flatnonzero(codes == ord("'"))
    if len(at):
        padded = np.append(codes, [0, 0])
        a, b = padded[at + 1], padded[at + 2]
        is_gap = np.append(kind == 255, [True, True])
        a, b = np.where(is_gap[at + 1], 0, a), np.where(is_gap[at + 1] | is_gap[at + 2], 0, b)
        out[at[np.isin(a, [ord(c) for c in "stmd"])]] = S_CONTR1
        for x, y in ("re", "ve", "ll"):
            out[at[(a == ord(x)) & (b == ord(y))]] = S_CONTR2
    return out


def token_starts(sym: np.ndarray) -> np.ndarray:
    """Whether a token starts at each position, by composing the symbols' transition functions."""
    n = len(sym)
    blocks = -(-n // BLOCK)
    rows = np.full(blocks * BLOCK, S_END, np.uint8)
    rows[:n] = sym
    rows = np.ascontiguousarray(rows.reshape(blocks, BLOCK).T).astype(np.uint16) * N_STATES
    flat, mark = STEP.ravel(), STARTS.ravel()
    function = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], blocks, axis=1)
    for r in rows:  # the function of each block, all blocks side by side
        function = flat[r + function]
    shift = 1
    while shift < blocks:  # inclusive scan of compositions: the later block's function after the earlier one's
        function[:, shift:] = np.take_along_axis(function[:, shift:], function[:, :-shift], axis=0)
        shift *= 2
    state = np.append(np.uint8(FRESH), function[FRESH, :-1])
    out = np.empty((BLOCK, blocks), bool)
    for k, r in enumerate(rows):
        at = r + state
        out[k] = mark[at]
        state = flat[at]
    return np.ascontiguousarray(out.T).ravel()[:n]


class Vocabulary:
    """Ranks of a vocabulary, its pair table, and the cache of merged slices."""

    def __init__(self, path: str, bound: int = CACHE_BOUND):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.bytes = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.size, self.bound, self.names = size, bound, [str(i) for i in range(size)]
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        pairs = [(self.ranks[t[:k]] * size + self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        pairs.sort()
        self.pair_keys, self.pair_ranks = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        self.cache: dict[str, tuple[int, ...]] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make; size where they make none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.size)

    def merge_rows(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Pair merging of words of one length, all at once."""
        parts = self.single[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        out: list = [None] * len(words)
        rows = np.arange(len(words))
        ranks = self.pair_rank(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if parts.shape[1] == 1:
                best = np.full(len(rows), self.size)
                at = np.zeros(len(rows), int)
            else:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
            over = best == self.size
            for k in np.flatnonzero(over):
                out[rows[k]] = tuple(parts[k].tolist())
            go = ~over
            rows, parts, at, best = rows[go], parts[go], at[go], best[go]
            if not len(rows):
                break
            width = parts.shape[1]
            col = np.arange(width - 1)
            parts[np.arange(len(rows)), at] = best
            parts = np.take_along_axis(parts, col[None, :] + (col[None, :] > at[:, None]), axis=1)
            ranks = ranks[go]
            if width > 2:
                # The pair is gone; only the ranks on its two sides change.
                ranks = np.take_along_axis(ranks, col[None, :-1] + (col[None, :-1] >= at[:, None]), axis=1)
                row = np.arange(len(rows))
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < width - 2)
                    r, s = row[ok], side[ok]
                    ranks[r, s] = self.pair_rank(parts[r, s], parts[r, s + 1])
        return out

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """Pair merging of one long slice by a heap of pairs over a linked list: n log n."""
        import heapq

        ids = self.single[np.frombuffer(word, np.uint8)]
        first = self.pair_rank(ids[:-1], ids[1:])
        ids, nxt, prev = ids.tolist(), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        n, alive = len(ids), [True] * len(ids)
        heap = [(int(r), k, ids[k], ids[k + 1]) for k, r in enumerate(first) if r < self.size]
        heapq.heapify(heap)

        def push(k: int) -> None:
            j = nxt[k]
            if j < n and (r := self.ranks.get(self.bytes[ids[k]] + self.bytes[ids[j]])) is not None:
                heapq.heappush(heap, (r, k, ids[k], ids[j]))

        while heap:
            r, k, a, b = heapq.heappop(heap)
            if not alive[k] or ids[k] != a or nxt[k] >= n or ids[nxt[k]] != b:
                continue
            j = nxt[k]
            ids[k], alive[j], nxt[k] = r, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = k
            push(k)
            if prev[k] >= 0:
                push(prev[k])
        return tuple(x for x, a in zip(ids, alive, strict=True) if a)

    def merge_all(self, slices) -> dict[str, tuple[int, ...]]:
        out, by_length = {}, {}
        for s in slices:
            b = s.encode("utf-8", "surrogatepass")
            if len(b) > MATRIX_LONGEST:
                out[s] = self.merge_long(b)
            else:
                by_length.setdefault(len(b), ([], []))
                by_length[len(b)][0].append(s)
                by_length[len(b)][1].append(b)
        for names, words in by_length.values():
            out.update(zip(names, self.merge_rows(words), strict=True))
        return out

    def encode_slices(self, slices: list[str]) -> list[tuple[int, ...]]:
        missing = {s for s in slices if s not in self.cache}
        if not missing:
            return [self.cache[s] for s in slices]
        fresh = self.merge_all(missing)
        for s, ids in fresh.items():
            if len(self.cache) >= self.bound:
                break
            if len(s) <= LONGEST:
                self.cache[s] = ids
        cache = self.cache
        return [fresh[s] if s in fresh else cache[s] for s in slices]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [ids for ids, _, _ in self.encode_slices_of(texts)]

    def encode_slices_of(self, texts: list[str], offsets: bool = False):
        """(ids, starts, counts) of each text; with offsets, where each slice begins (code points) and its tokens."""
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        gaps = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.flatnonzero(token_starts(symbols(codes, gaps)))
        first_gap = np.searchsorted(starts, gaps)  # each gap is a start, so that texts end there
        at = starts.tolist()
        slices = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)], strict=True)]
        out, begin, base = [], 0, 0
        for g in first_gap.tolist():
            slices[g] = ""
        ids = self.encode_slices(slices)
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) if offsets else None
        for g, t in zip(first_gap.tolist(), texts, strict=True):
            flat = list(chain.from_iterable(ids[begin:g]))
            out.append((flat, starts[begin:g] - base, counts[begin:g]) if offsets else (flat, None, None))
            begin, base = g + 1, base + len(t) + 1
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_batch(self, rows: list[list[int]]) -> list[bytes]:
        """The bytes of each row: all ids are mapped at once, and the rows are cut by their byte offsets."""
        flat = list(chain.from_iterable(rows))
        sizes = np.cumsum([0, *map(len, map(self.bytes.__getitem__, flat))])
        data, ends = self.decode(flat), sizes[np.cumsum([0, *map(len, rows)])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def decode_span(self, ids: list[int], starts, counts, begin: int, end: int) -> bytes:
        """The bytes of the slices that touch code points begin to end, from their tokens alone."""
        a = max(0, int(np.searchsorted(starts, begin, "right")) - 1)
        b = int(np.searchsorted(starts, end, "left"))
        token = np.cumsum([0, *counts])
        return self.decode(ids[token[a] : token[max(a, b)]])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process, whatever the number of its tasks."""
    out = Vocabulary(path)
    out.cache[""] = ()
    return out


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
BATCH_CHARS = 1_000_000


def _vocabulary(path: str) -> Vocabulary:
    hold("byte bpe", vocabulary.cache_clear)
    return vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, starts, counts: the token ids of every text, where its slices begin and how many tokens each has."""

    def run(batches):
        vocab = _vocabulary(path)
        for b in batches:
            rows = [x for part in text_groups((t.as_py() for t in b.column(1)), BATCH_CHARS) for x in vocab.encode_slices_of(part, offsets=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), pa.list_(pa.int32())) for c in cols]], names=["doc_id", "ids", "starts", "counts"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, counts array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes: what the ids of (doc_id, ids) stand for."""

    def run(batches):
        vocab = _vocabulary(path)
        for b in batches:
            data = vocab.decode_batch([x or [] for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns counts and digests of both, in one pass without shuffles."""

    def run(batches):
        vocab = _vocabulary(path)
        names = vocab.names
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for part in text_groups((t.as_py() for t in b.column(1)), BATCH_CHARS):
                rows = vocab.encode_batch(part)
                for ids, data in zip(rows, vocab.decode_batch(rows), strict=True):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, DIGESTS)
