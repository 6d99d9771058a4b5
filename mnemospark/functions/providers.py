"""Replaceable language-model and embedding providers, with deterministic offline ones.

A provider is a plain class; embed_column and generate run it in Arrow batches, one instance for each worker process.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """Feature hashing of lower-case words and their pairs, unit length: equal texts are equal, common words are near."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts, strict=True):
            words = re.findall(r"\w+", (t or "").lower())
            for w in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]:
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


class LetterEmbedder:
    """How often each of some letters occurs, whatever its case: a vector that SQL can make as well."""

    def __init__(self, letters: str = "abcdefghilmnorst"):
        self.letters, self.dimension = letters, len(letters)

    def embed(self, texts: list[str]) -> np.ndarray:
        low = [(t or "").lower() for t in texts]
        return np.array([[t.count(c) for c in self.letters] for t in low], np.float64).reshape(len(texts), self.dimension)


class ScriptedGenerator:
    """Answers by rules (pattern, reply); the reply may use the match's groups. Others get a fixed answer."""

    def __init__(self, rules: list[tuple[str, str]] = (), default: str = "Unable to generate answer"):
        self.rules, self.default = list(rules), default

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            found = ((re.search(pattern, p, re.S), reply) for pattern, reply in self.rules)
            out.append(next((m.expand(reply) for m, reply in found if m), self.default))
        return out


class AgentGenerator:
    """Searches the memories in turn for the question's words, then answers; for tests of the agent loop."""

    ORDER = ("episodic", "semantic", "visual")

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            question = re.search(r"Question: (.*)", p)
            rounds = len(re.findall(r"^Round ", p, re.M))
            if rounds >= len(self.ORDER):
                out.append(json.dumps({"decision": "answer"}))
            else:
                out.append(json.dumps({"decision": "search", "memory_type": self.ORDER[rounds], "search_query": question[1] if question else ""}))
        return out


class Router:
    """Providers by name pattern: the first pattern that a model's name matches gives the provider."""

    def __init__(self, rules: list[tuple[str, object]]):
        self.rules = rules

    def provider(self, model: str):
        for pattern, made in self.rules:
            if re.search(pattern, model, re.I):
                return made() if isinstance(made, type) else made
        raise ValueError(f"no provider for model {model!r}")


class ModalityEmbedder:
    """An embedder for each kind of input; a prompt template may stand before a kind's texts."""

    def __init__(self, by_kind: dict[str, Embedder], templates: dict[str, str] | None = None):
        self.by_kind, self.templates = by_kind, templates or {}

    def embed_kind(self, kind: str, inputs: list[str]) -> np.ndarray:
        if kind not in self.by_kind:
            raise ValueError(f"no embedder for {kind!r}; known: {sorted(self.by_kind)}")
        template = self.templates.get(kind, "{}")
        return self.by_kind[kind].embed([template.format(x or "") for x in inputs])


def embed_by_kind(df: DataFrame, key: str, kind: str, value: str, embedder: ModalityEmbedder) -> DataFrame:
    """(key, vector) of df's rows, each by the embedder of its kind."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            kinds, values = np.array(b.column(1).to_pylist(), object), b.column(2).to_pylist()
            out = [None] * b.num_rows
            for k in dict.fromkeys(kinds):
                at = np.flatnonzero(kinds == k)
                for i, v in zip(at, embedder.embed_kind(k, [values[i] for i in at]), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "vector"])

    return df.select(key, kind, value).mapInArrow(run, f"{key} {key_type}, vector array<double>")


def embed_column(df: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """(key, vector) of df's rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            v = embedder.embed([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=[key, "vector"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<double>")


def generate(df: DataFrame, key: str, prompt: str, generator: Generator, tries: int = 2, wait: float = 0.0, longest: float = 60.0) -> DataFrame:
    """(key, response); a batch that fails is tried again, then answered one by one, failures become null.

    wait: seconds before the second try; each further try waits twice as long, at most longest.
    """
    kind = df.schema[key].dataType.simpleString()

    def ask(prompts):
        for n in range(tries):
            try:
                return generator.generate(prompts)
            except Exception:
                if wait and n + 1 < tries:
                    time.sleep(min(longest, wait * 2**n))
        return [None] if len(prompts) == 1 else [r for p in prompts for r in ask([p])]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ask(b.column(1).to_pylist()) if b.num_rows else [], pa.string())], names=[key, "response"])

    return df.select(key, prompt).mapInArrow(run, f"{key} {kind}, response string")


def generate_as(df: DataFrame, key: str, prompt: str, generator: Generator, schema: str, **how) -> DataFrame:
    """(key, parsed): the replies' JSON by a schema; null where a reply has none."""
    from pyspark.sql import functions as F

    from mnemospark.functions.repair import json_payload, repair_json

    return generate(df, key, prompt, generator, **how).select(key, F.from_json(repair_json(json_payload(F.col("response"))), schema).alias("parsed"))
