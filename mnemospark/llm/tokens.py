"""Cached use of public tokenizers: documents become id bytes, whitespace chunk by whitespace chunk.

Both vocabularies used here never merge across white space, so a text's ids are the ids of its chunks. A chunk is
encoded once by the tokenizers library and kept as packed little-endian ids; the cache stops growing at ``bound``
entries (words beyond it are encoded each time), which bounds a worker's memory.

Strings of special tokens in a text are ordinary text, as the vocabularies' own description loads them; with
``special=True`` they become their ids, as the library does when it is loaded without that setting.
"""

from __future__ import annotations

import array
import functools
import os
import re
import sys

import numpy as np

from mnemospark.llm.common import hold

CACHE_BOUND = 1_000_000  # chunks that a worker keeps, up to about 0.6 GB
LONGEST = 64  # longer chunks are not kept


def _library(path: str, special: bool = False):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    return t


def _special(lib):
    """Finds special tokens' strings, in any case, since a vocabulary may fold it; None: there are none."""
    names = [re.escape(t.content) for t in lib.get_added_tokens_decoder().values()]
    return re.compile("|".join(names), re.I) if names else None


#: ASCII marks but the apostrophe: both vocabularies split between a letter and a run of them.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Chunks(dict):
    """chunk -> packed ids; prefix stands before each chunk when it is encoded.

    Marks that close a chunk after a letter are looked up apart (in tails, by default here), and where the vocabulary folds
    case an ASCII chunk is looked up in lower case, so far fewer chunks go through the library.
    """

    def __init__(self, tokenizer, dtype: str, prefix: str, bound: int, tails: "_Chunks | None" = None, folds: bool = False):
        super().__init__()
        self.tokenizer, self.dtype, self.prefix, self.bound = tokenizer, dtype, prefix, bound
        self.tails, self.folds = self if tails is None else tails, folds

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        low = chunk.lower() if self.folds and chunk.isascii() else chunk
        body = low.rstrip(_MARKS)
        if body and len(body) < len(low) and body[-1].isalpha() and body[-1].lower().isalpha():
            out = self[body] + self.tails[low[len(body) :]]
        elif low != chunk:
            out = self[low]
        else:
            out = self.whole(self.prefix + chunk)
        if len(self) < self.bound and len(chunk) <= LONGEST:
            self[chunk] = out
        return out


class WordEncoder:
    """For vocabularies that drop white space (word BPE)."""

    def __init__(self, path: str, dtype: str = "<u4", bound: int = CACHE_BOUND, special: bool = False):
        lib = _library(path, special)
        self.chunks = _Chunks(lib, dtype, "", bound, folds=True)
        self.chunks[""] = b""
        self.special = _special(lib) if special else None

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return self.chunks.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return dict(zip([*sorted(plain), *(b for b in range(256) if b not in plain)], [*map(chr, sorted(plain)), *map(chr, range(256, 512 - len(plain)))], strict=True))


class _Letters(_Chunks):
    """_Chunks of a byte-level vocabulary: a chunk of letters alone is one piece, so the library's model takes it without a search for pieces.

    Only below U+0250, where all letters are such in every Unicode version.
    """

    def __init__(self, tokenizer, dtype: str, prefix: str, bound: int, tails: "_Chunks | None" = None):
        super().__init__(tokenizer, dtype, prefix, bound, tails)
        self.model, self.letters = tokenizer.model, _byte_letters()
        self.before = prefix.translate(self.letters)
        self.code = {"<u2": "H", "<u4": "I"}[dtype] if sys.byteorder == "little" else None
        if any(t.content.isalpha() for t in tokenizer.get_added_tokens_decoder().values()):  # such a token is found inside a chunk
            self.code = None

    def whole(self, text: str) -> bytes:
        word = text[len(self.prefix) :]
        if self.code is None or not text.startswith(self.prefix) or not word.isalpha() or max(word) >= "\u0250":
            return super().whole(text)
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array.array(self.code, [t.id for t in self.model.tokenize(self.before + piece)]).tobytes()


#: A run of white space with the word after it. U+001C to U+001F are white space to Python alone.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


class ByteEncoder:
    """For byte-level vocabularies, where a single space belongs to the word after it."""

    def __init__(self, path: str, dtype: str = "<u2", bound: int = CACHE_BOUND, special: bool = False):
        lib = _library(path, special)
        self.special = _special(lib) if special else None
        self.bare = _Letters(lib, dtype, "", bound)
        self.spaced = _Letters(lib, dtype, " ", bound, tails=self.bare)
        self.newline = self.bare["\n"]

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special and self.special.search(text):
            return self.bare.whole(text)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1].isspace():
            return self._by_runs(text)
        lines = text.split("\n")
        if any(line[0].isspace() for line in lines[1:]):
            return self._by_runs(text)
        return self.newline.join(map(self._line, lines))

    def _by_runs(self, text: str) -> bytes:
        """For texts with longer runs of white space, which the vocabulary may merge."""
        return b"".join(map(self.bare.__getitem__, _CHUNK.findall(text)))


@functools.lru_cache(maxsize=4)
def word_encoder(path: str, bound: int = CACHE_BOUND) -> WordEncoder:
    """One for each worker process, whatever the number of its tasks."""
    return WordEncoder(path, bound=bound)


def words(path: str, bound: int = CACHE_BOUND) -> WordEncoder:
    hold("words", word_encoder.cache_clear)
    return word_encoder(path, bound)


@functools.lru_cache(maxsize=4)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def byte_words(path: str) -> ByteEncoder:
    hold("byte words", byte_encoder.cache_clear)
    return byte_encoder(path)
