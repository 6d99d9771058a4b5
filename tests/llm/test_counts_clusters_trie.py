"""Token counts, centroid clusters and the prefix trie against plain versions."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import centroids, prefix_trie, token_counts
from mnemospark.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(WORDS)


def _texts(n=1500):
    rng = random.Random(11)
    some = "abcdetinrs'  !?.0123é中文ßİ\n\t<|>"
    out = ["", " ", "'", "it's'll!! 'Re x'", "<|endoftext|>a<|startoftext|>'s <|ENDOFTEXT|>", "a" * 700, "\x1c\u0085 b ſ's İ ΑΣ é", "中" * 300]
    out += ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(n)]
    out += ["".join(rng.choice("abcehinorst") for _ in range(rng.randrange(900))) for _ in range(100)]
    return out + ["".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(150)) for _ in range(200)]


def test_counts_equal_the_library(counter, library):
    texts = _texts()
    assert counter.counts(texts)[0].tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_after_a_restart_and_in_small_chunks(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    texts = _texts(200)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts)[0].tolist() == want
    points, symbols = counter._symbols(" ".join(t.lower() for t in texts if t.isascii()) + " ")
    assert (token_counts.word_starts(symbols, 3) == token_counts.word_starts(symbols, 1000)).all()
    data = np.frombuffer(b"internationalisation", np.uint8).astype(np.int64)
    data = np.tile(np.append(data[:-1], data[-1] + 256), 40)
    assert (counter.tokens.changes(data, 3) == counter.tokens.changes(data, 1000)).all()


def test_state_maps_compose(counter):
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 6, (37, 5)).astype(np.uint8)
    scanned = token_counts.prefix_scan(token_counts.state_maps(rows))
    assert (scanned[-1] == token_counts.state_maps(rows.reshape(1, -1))[0]).all()


def test_long_texts_are_cut_at_spaces(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 50)
    for text in ("it's <|endoftext|> a  b" * 40, "x" * 400, "x" * 120 + " y" * 90, " " * 200):
        parts = list(token_counts.pieces(text, 50))
        assert sum(counter.counts(parts)[0]) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_of_tables(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op11_token_counts"](spark, sf).collect()}
    want = {}
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id] = (len((r.text or "").encode()), n, n > 2048)
    assert got == want


def test_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "a b", 3), (2, "a b", 3)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, WORDS).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 3, 2), (2, 3, 2)]
    assert token_counts.token_counts(df.limit(0), WORDS).collect() == []


def _lloyd(rows, k, rounds):
    """Plain rounds over (vec_id, integer vector)."""
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(r[1]) for r in rows[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in rows:
            mine[near(v)[1]].append(v)
        for i, vs in mine.items():
            cents[i] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(r[0], near(r[1])) for r in rows]
    return sorted(((i, c, d) for i, (d, c) in out), key=repr), cents


@pytest.mark.parametrize("spread,k", [(2, 6), (40, 9), (1000, 1)])
def test_clusters_equal_plain_rounds(spark, spread, k):
    rng = random.Random(spread)  # a small spread makes many ties
    rows = [(n, [rng.randrange(-spread, spread) for _ in range(4)]) for n in range(300)]
    rows += [(7, rows[7][1]), (None, [0, 0, 0, 1])]
    df = spark.createDataFrame([(i, [x / 256 for x in v], "no") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    got = centroids.cluster_vectors(df, k, rounds=4, width=4)
    have = sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr)
    want, cents = _lloyd(rows, k, 4)
    assert have == want
    r = got.filter("vec_id = 7").first()
    assert r.inertia == sum(x[2] for x in want) and r.cluster_inertia == sum(x[2] for x in want if x[1] == r.cluster)
    assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_bounds_save_distances_and_hold(spark, sf):
    got = centroids.cluster_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), k=40)
    n, computed = got.agg(F.count(F.lit(1)), F.sum("computed")).first()
    assert computed < 0.8 * n * 40 * 6


def test_clusters_of_odd_rows(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(1, [0.5, 1.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-0.001, 0.0]), (8, [])]
    got = {r.vec_id: r.distance for r in centroids.cluster_vectors(spark.createDataFrame(rows, kind), 40, width=2).collect()}
    assert got == {1: 0, 7: 0}  # fewer vectors than centroids
    assert centroids.cluster_vectors(spark.createDataFrame(rows[1:3], kind), 3, width=2).collect() == []
    with pytest.raises(Exception, match="no exact distance"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9, 0.0])], kind), 1, width=2).collect()


def _plain_trie(rows, base=5, modulus=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % modulus
        first = sorted(own.get(c - int(np.fmod(c, base)), []))[:h]
        seqs[c] = tuple((x[3], x[4]) for x in first + sorted(own[c])[h:])
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha([c for c in m if seqs[c] == p])) for p, m in nodes.items()), key=repr)


def _have(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


_KIND = "conv_id long, turn long, role string, text string, depth string"


def _talks(seed, convs=120, words=("a", "é", "", None)):
    rng, rows = random.Random(seed), []
    for c in range(-10, convs):
        if rng.random() < 0.1:
            continue
        n = rng.choice([1, 2, 3, 4, 9, 12])
        same = c % 3 == 0  # a third are one and the same conversation
        for t in range(n if not same else 11):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]) if not same else "user", rng.choice(words) if not same else f"t{t}", "x"))
    rows += [(None, 0, "user", "nobody", "x"), (5, 3, "user", "tie", "x"), (5, 3, "user", "tie", "x"), (5, 3, "tool", "tie", "x")]
    return rows


@pytest.mark.parametrize("local,short", [(4096, 20_000), (6, 3), (0, 20_000)])
def test_trie_equals_a_walk(spark, monkeypatch, local, short):
    monkeypatch.setattr(prefix_trie, "SHORT", short)
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = _talks(local)
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, _KIND).repartition(5), local=local)
    assert _have(got) == _plain_trie([r[:4] for r in rows])


def test_trie_of_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _have(QUERIES["op13_prefix_trie"](spark, sf)) == _plain_trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], _KIND)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "x")], _KIND)).collect() == []
    lonely = [(c, 0, "user", "x" * 50, "x") for c in range(2001, 2004) if zlib.crc32(str(c).encode()) % 9 > 0]  # nothing of their own is left
    assert _have(prefix_trie.conversation_trie(spark.createDataFrame(lonely, _KIND))) == _plain_trie([r[:4] for r in lonely])


def test_multikey_quicksort_of_a_bucket():
    nodes = prefix_trie.quicksorted([[1, 2], [1], [1, 2, 3], [1, 0]], [9, 4, 7, 8], [1, 2, 1, 1], [[5, 6], [5], [5, 6, 7], [5, 1]], 3)
    assert sorted(tuple(n) for n in nodes if n[2] is not None) == [(7, 4, 4, 2, 1, 1, 6, 9, 1), (7, 5, 7, 1, 0, 1, 0, 7, 1), (8, 4, 4, 1, 0, 1, 0, 8, 1)]
    assert nodes[0] == [4, 3, None, 5, 2, 2, 26, 4, 2]
