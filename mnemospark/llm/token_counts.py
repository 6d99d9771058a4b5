"""Token counts by a compiled finite-state tokenizer: no token is ever made, only counted.

Two deterministic transducers stand in for the vocabulary file (BPE with an end-of-word suffix, byte level):

* the *word* transducer has seven states over symbols of code points and marks on its transitions where a word begins;
* the *token* transducer reads the words' bytes. The tokens of a prefix are those of a shorter prefix and one more, and
  that last token is the only one among the vocabulary's suffixes of the prefix whose pair with the token before it is
  stable under the merges. So a state is the longest suffix that a token may still grow from, with the last token at each
  of its places and how many tokens fewer were counted there; a transition is annotated with the change of the count.
  States are finite in number and compiled when first met; a worker holds at most ``STATES`` and starts again beyond.

Texts of a batch run as one stream, cut into chunks of equal length that advance together. A chunk of the word transducer
is its whole state map (state in -> state out); maps compose by a prefix scan in log2(chunks) steps, which gives the state that
enters each chunk. The token transducer returns to its start at every word's end, so a chunk's map is one run from the
start and, for a state that enters in the midst of a word, a run up to the first end, where both meet; chunks without
any end hand their state on, and that is composed in order.

Defined results: a null text has no bytes and no tokens; so has an empty one. Texts of any length are read whole: a
long one is counted in pieces cut at a space, where no word goes on. Repeated rows are counted each; an empty table gives an empty one; columns other than
doc_id and text stay behind whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import hold, text_groups, texts_of

STATES = 250_000  # compiled states that a worker holds
GROUP = 2_000_000  # code points that run together
CHUNK = 128

# Symbols of the word transducer: white space, letter, number, other, apostrophe of a short form of 2 and of 3 code points.
SPACE, LETTER, NUMBER, OTHER, SHORT2, SHORT3 = range(6)
# Its states: between words, in letters, in others, 2 and 1 code points of a short form to come (a number or a short form ends between).
_BETWEEN, _LETTERS, _OTHERS, _TWO, _ONE = range(5)
_NEXT = np.array(
    [
        [_BETWEEN, _LETTERS, _BETWEEN, _OTHERS, _ONE, _TWO],
        [_BETWEEN, _LETTERS, _BETWEEN, _OTHERS, _ONE, _TWO],
        [_BETWEEN, _LETTERS, _BETWEEN, _OTHERS, _OTHERS, _OTHERS],
        [_ONE] * 6,
        [_BETWEEN] * 6,
    ],
    np.uint8,
)
#: Whether a transition begins a word.
_BEGINS = np.array([[0, 1, 1, 1, 1, 1], [0, 0, 1, 1, 1, 1], [0, 1, 1, 0, 0, 0], [0] * 6, [0] * 6], bool)
# The vocabulary's short forms: fixed values of its pattern.
_AFTER_2 = "stmd"
_AFTER_3 = ("re", "ve", "ll")


def state_maps(symbols: np.ndarray) -> np.ndarray:
    """(chunks, states): the state that each chunk (a row of symbols) leaves each state in."""
    maps = np.broadcast_to(np.arange(len(_NEXT), dtype=np.uint8), (len(symbols), len(_NEXT)))
    for column in np.ascontiguousarray(symbols.T):
        maps = _NEXT[maps, column[:, None]]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Each row's map composed after those of all rows before it, in log2(rows) steps of whole arrays."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def word_starts(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a word begins at each place of a stream of symbols."""
    n = len(symbols)
    rows = np.concatenate([symbols, np.full(-n % chunk, SPACE, np.uint8)]).reshape(-1, chunk)
    if not len(rows):
        return np.zeros(0, bool)
    state = np.concatenate([np.array([_BETWEEN], np.uint8), prefix_scan(state_maps(rows))[:-1, _BETWEEN]])
    out = np.empty((chunk, len(rows)), bool)
    for i, column in enumerate(np.ascontiguousarray(rows.T)):
        out[i] = _BEGINS[state, column]
        state = _NEXT[state, column]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


class TokenTransducer:
    """Symbols 0 to 255 are bytes within a word, 256 to 511 bytes that end one; state 0 is the start of a word."""

    def __init__(self, merges: list[tuple[tuple[int, ...], tuple[int, ...]]]):
        self.rank = {(i,): -1 for i in range(512)}  # token -> rank of the merge that makes it
        self.parts: dict[tuple, tuple[tuple, tuple]] = {}
        self.merged: dict[tuple[tuple, tuple], int] = {}
        for k, (a, b) in enumerate(merges):
            self.rank[a + b], self.parts[a + b], self.merged[a, b] = k, (a, b), k
        self.growing = {t[:i] for t in self.rank for i in range(1, len(t))}
        self._stable = functools.lru_cache(maxsize=200_000)(self._pair)
        self.restart()

    def restart(self) -> None:
        """Forgets all compiled states but the start."""
        # a state: the suffix that may still grow; for each place from its end back to its start, the last token there and the count there less the count here
        start = ((), ((None, 0),))
        self.states, self.number = [start], {start: 0}
        self.bits = 16
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)  # state << 8 | change + 128
        self.filled = 0
        self.walked: dict[int, int] = {}

    def _pair(self, left: tuple, right: tuple) -> bool:
        """Whether two tokens stay apart: no merge across their border comes before those that make them.

        Merges apply in the order of their ranks and, for one rank, from the left. The pieces at the border are the left
        token's last parts and the right one's first parts, each from its own merge up to that of the piece around it.
        """
        until, piece = len(self.merged), left
        while True:
            limit, other = len(self.merged), right
            while True:
                k = self.merged.get((piece, other))
                if k is not None and k < until and k <= limit:
                    return False
                if other not in self.parts:
                    break
                limit, other = self.rank[other], self.parts[other][0]
            if piece not in self.parts:
                return True
            until, piece = self.rank[piece], self.parts[piece][1]

    def compile(self, state: int, symbol: int) -> int:
        """The transition's value: next state and change of the count."""
        grown, places = self.states[state]
        text = (*grown, symbol)
        for size in range(len(text), 0, -1):
            token = text[-size:]
            before, count = places[size - 1]
            if token in self.rank and (before is None or self._stable(before, token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = count + 1  # against the count at the state
        if symbol >= 256:
            return change + 128
        keep = len(text)
        while text[len(text) - keep :] not in self.growing and keep:
            keep -= 1
        after = (text[len(text) - keep :], ((token, 0), *((t, c - change) for t, c in places[:keep])))
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
        return to << 8 | change + 128

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        if (self.filled + len(keys)) * 2 > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            while len(keys) * 3 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.filled = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
        self.filled += len(keys)
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last stays
            own = self.keys[slots] == keys
            self.values[slots[own]] = values[own]
            keys, values, slots = keys[~own], values[~own], (slots[~own] + 1) & mask

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Values of transitions state << 9 | symbol; those not met before are compiled."""
        slots = self._slots(keys)
        found = self.keys[slots]
        if (found == keys).all():
            return self.values[slots]
        mask, left = (1 << self.bits) - 1, np.flatnonzero(found != keys)
        while len(left):
            at = self.keys[slots[left]]
            left = left[(at != keys[left]) & (at >= 0)]
            slots[left] = (slots[left] + 1) & mask
        missing = np.unique(keys[self.keys[slots] < 0])
        if not len(missing):
            return self.values[slots]
        self._place(missing, np.array([self.compile(k >> 9, k & 511) for k in missing.tolist()], np.int64))
        return self.look_up(keys)

    def changes(self, symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The change of the count at each place of a stream of whole words."""
        if len(self.states) > STATES:
            self.restart()
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int16)
        rows = np.concatenate([symbols, np.full(-n % chunk, 256, symbols.dtype)]).reshape(-1, chunk)
        out = np.empty((chunk, len(rows)), np.int16)
        state = np.zeros(len(rows), np.int64)  # each chunk's run from the start
        for i, column in enumerate(np.ascontiguousarray(rows.T)):
            value = self.look_up(state << 9 | column)
            out[i] = (value & 255) - 128
            state = value >> 8
        ends = rows >= 256
        whole = ~ends.any(axis=1)  # chunks without an end: their map is not constant
        todo = np.flatnonzero(np.concatenate([[False], state[:-1] != 0]))
        simple = todo[~whole[todo] & ~whole[todo - 1]]
        self._heads(rows, ends, out, simple, state[simple - 1])
        for k in np.setdiff1d(todo, simple, assume_unique=True).tolist():  # in order: what leaves a chunk may come from the one before
            state[k] = self._walk(rows[k], out[:, k], int(state[k - 1]), int(state[k]))
        return np.ascontiguousarray(out.T).reshape(-1)[:n]

    def _heads(self, rows: np.ndarray, ends: np.ndarray, out: np.ndarray, at: np.ndarray, state: np.ndarray) -> None:
        """The places up to the first end, from the states that enter."""
        for i in range(rows.shape[1]):
            if not len(at):
                return
            value = self.look_up(state << 9 | rows[at, i])
            out[i, at] = (value & 255) - 128
            going = ~ends[at, i]
            at, state = at[going], value[going] >> 8

    def _walk(self, row: np.ndarray, out: np.ndarray, state: int, left: int) -> int:
        """One chunk from the state that enters; returns the state that leaves."""
        for i, s in enumerate(row.tolist()):
            key = state << 9 | s
            if (value := self.walked.get(key)) is None:
                value = self.walked[key] = int(self.look_up(np.array([key]))[0])
            out[i], state = (value & 255) - 128, value >> 8
            if s >= 256:
                return left
        return state


class TokenCounter:
    """Counts the tokens of texts as the tokenizers library loads the file: NFC, white space, lower case, words, merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        lib = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = lib.normalizer, lib.pre_tokenizer
        special = [re.escape(t.content) for t in lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        byte = {c: b for b, c in _byte_letters().items()}

        def symbols(token: str) -> tuple[int, ...]:
            whole = token.removesuffix(suffix)
            out = [byte[c] for c in whole]
            if whole != token:
                out[-1] += 256
            return tuple(out)

        self.tokens = TokenTransducer([(symbols(a), symbols(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])])
        self.classes = np.full(0x110000, 255, np.uint8)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        """Each code point's symbol, as the library's own word pattern sees it; asked once for each that occurs."""
        out = self.classes[points]
        new = np.unique(points[out == 255])
        for p in new.tolist():
            words = [x[1][1] - x[1][0] for x in self.pre_tokenizer.pre_tokenize_str(f"a{chr(p)}!")]
            self.classes[p] = {(1, 1): SPACE, (2, 1): LETTER, (1, 1, 1): NUMBER, (1, 2): OTHER}[tuple(words)]
        return self.classes[points] if len(new) else out

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        out = self._classes(points).copy()
        at = np.flatnonzero(points[:-1] == 0x27)
        one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        out[at[np.isin(one, [ord(c) for c in _AFTER_2])]] = SHORT2
        for a, b in _AFTER_3:
            out[at[(one == ord(a)) & (two == ord(b))]] = SHORT3
        return points, out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, special tokens) of each text; a batch should hold about GROUP code points."""
        ready, special = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self.special and "<|" in t:
                t, special[i] = self.special.subn(" ", t)
            ready.append(t.lower() if t.isascii() else self.normalizer.normalize_str(t))
        points, symbols = self._symbols(" ".join(ready) + " ")
        begins = word_starts(symbols)
        kept = symbols != SPACE
        sizes = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        sizes[~kept] = 0
        data = np.frombuffer(points[kept].astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8).astype(np.int64)
        places = np.cumsum(sizes)  # bytes up to and with each code point
        first = (places - sizes)[begins]
        if len(data):
            data[np.append(first[1:], len(data)) - 1] += 256
        total = np.concatenate([[0], np.cumsum(self.tokens.changes(data), dtype=np.int64)])
        ends = np.cumsum([len(t) + 1 for t in ready])
        upto = total[places[ends - 1]]
        return np.diff(upto, prepend=0) + special, special


def pieces(text: str, size: int = GROUP) -> Iterator[str]:
    """A text in pieces of at most size code points, or up to the first space after them: no word, mark or short form crosses one."""
    while len(text) > size:
        cut = text.rfind(" ", 0, size)
        if cut < 0 and (cut := text.find(" ", size)) < 0:
            break
        yield text[:cut]
        text = text[cut:].lstrip(" ")
    yield text


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def counter(path: str) -> TokenCounter:
    """One for each worker process."""
    hold("token counter", _counter.cache_clear)
    return _counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_special, over_limit) of every document; no shuffle, a batch at a time."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(vocabulary)
        for batch in batches:
            of, parts = [], []
            for i, text in enumerate(batch["text"]):
                for piece in pieces(text):
                    of.append(i)
                    parts.append(piece)
            done = [c.counts(group) for group in text_groups(parts, GROUP)]
            n, special = (np.bincount(of, np.concatenate(x), len(batch)).astype(np.int64) if of else np.zeros(0, np.int64) for x in (zip(*done) if done else ((), ())))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": n, "n_special": special})

    texts = texts_of(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = texts.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, n_special long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
