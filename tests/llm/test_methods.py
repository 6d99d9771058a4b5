"""The methods against brute force, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import byte_bpe, html_text, language_id, maxent_lm, near_dedup, packing, quality, syncmers
from mnemospark.llm.queries import QUERIES
from mnemospark.llm.token_output import Reader, Writer


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id", ignore_index=True)


def test_byte_bpe_equals_library():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'", '"', " ", "  ", "\n", "\t", "\r\n", "　", "\xa0", "\x85", "\x1c", "a", "the", "Ünï", "漢字", "1", "²", "½", "!?", "…", "́", "😀", "\0", "'x", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["", "x" * 300, "漢" * 120, " " * 70 + "\n" * 4]
    vocab = byte_bpe.vocabulary(path)
    got = vocab.encode_batch(texts)
    assert got == [lib.encode_ordinary(t) for t in texts]
    assert [vocab.decode(g) for g in got] == [t.encode() for t in texts]


def test_transition_scan_equals_one_step_at_a_time():
    rng = np.random.default_rng(1)
    sym = rng.integers(0, byte_bpe.N_SYMBOLS, 5000).astype(np.uint8)
    state, out = byte_bpe.FRESH, []
    for s in sym:
        out.append(bool(byte_bpe.STARTS[s, state]))
        state = byte_bpe.STEP[s, state]
    assert byte_bpe.token_starts(sym).tolist() == out


def _tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op5_equals_library_on_the_table(spark, sf, docs):
    lib = _tiktoken()
    got = {r.doc_id: r for r in QUERIES["op5_byte_bpe"](spark, sf).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = lib.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_spans_decode_from_their_slices_alone(spark):
    texts = ["Hello  world, it's 42 Ünïts of 漢字!\n\n end ", "", "x" * 90, " a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = byte_bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken"))
    for r in encoded.collect():
        t = texts[r.doc_id]
        assert sum(r.counts) == len(r.ids) and list(r.starts) == sorted(r.starts)
        ends = [*r.starts[1:], len(t)]
        for begin in range(len(t)):
            end = min(len(t), begin + 7)
            touched = [(a, z) for a, z in zip(r.starts, ends, strict=True) if a < end and z > begin]
            assert vocab.decode_span(r.ids, r.starts, r.counts, begin, end) == t[touched[0][0] : touched[-1][1]].encode()
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded, P.path("byte_bpe_50k.tiktoken")).collect()} == {k: t.encode() for k, t in enumerate(texts)}


def _library_ids(name, texts, special=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    if not special:  # as the vocabularies' description loads them
        t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_op9_files_hold_the_library_ids(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op9_token_output"](spark, sf).collect()}
    start = 0
    for i, ids in zip(docs.doc_id, _library_ids("byte_bpe_50k.json", docs.text), strict=True):
        ids = np.array([*ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_chunked_encoding_equals_library():
    from mnemospark.llm.tokens import ByteEncoder, WordEncoder

    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x1c", "Ünï", "1", "!?", "'s", "́", "漢", "😀", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "Word", "dog's", "x,", "%%%", "...", "'", "_", "-", "ΣΑΣ", "İ", "a\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for special, (name, encoder, dtype) in itertools.product((False, True), (("byte_bpe_50k.json", ByteEncoder, "<u2"), ("word_bpe_49k.json", WordEncoder, "<u4"))):
        e = encoder(P.path(name), special=special)
        for t, want in zip(texts, _library_ids(name, texts, special), strict=True):
            assert np.frombuffer(e.encode(t), dtype).tolist() == want, repr(t)


def test_files_are_bounded_and_reads_touch_one_document(spark, tmp_path, monkeypatch):
    from mnemospark.llm import token_output

    rng = random.Random(1)
    rows = [(rng.choice([None, 5, k]), " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 30)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_output.write_tokens(df, P.path("byte_bpe_50k.json"), 2, folder=f"file://{tmp_path}/t", parts=3)
    read = token_output.read_tokens(manifest).orderBy("start").collect()
    tie = {r.text: r.t for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], tie[r[1]]))
    ids = [np.array([*x, 2], "<u4") for x in _library_ids("byte_bpe_50k.json", [t for _, t in order])]
    starts = np.cumsum([0, *map(len, ids)])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read] == [(i, s, len(x), zlib.crc32(x.tobytes())) for (i, _), s, x in zip(order, starts, ids, strict=False)]
    one = manifest.orderBy("part").first()
    frames = []
    with open(one.path.replace("file://", ""), "rb") as f:
        r = Reader(f, one.n_bytes)
        monkeypatch.setattr(r, "frame", lambda k, real=r.frame: frames.append(k) or real(k))
        assert r.tokens(4).tolist() == ids[4].tolist() and frames == [4]


def test_seek_table_reads_single_documents(tmp_path):
    rng = np.random.default_rng(0)
    lengths = [0, 5, 200_000, 1, 70_000, 0, 3]
    data = [rng.integers(0, 50_000, n).astype("<u2") for n in lengths]
    w = Writer()
    for k, d in enumerate(data):
        w.add(k if k else None, d.tobytes())
    (tmp_path / "x").write_bytes(w.close())
    with open(tmp_path / "x", "rb") as f:
        r = Reader(f, (tmp_path / "x").stat().st_size)
        assert all((r.tokens(k) == d).all() for k, d in enumerate(data)) and r.null[0]
        assert dict(r.scan()) == {k: zlib.crc32(d.astype("<u4").tobytes()) for k, d in enumerate(data)}
        broken = bytearray((tmp_path / "x").read_bytes())
    broken[40] ^= 1
    (tmp_path / "y").write_bytes(broken)
    with open(tmp_path / "y", "rb") as f, pytest.raises(Exception):  # noqa: B017
        list(Reader(f, len(broken)).scan())


def test_op7_packs_every_piece_once(spark, sf, docs):
    got = QUERIES["op7_best_fit_packing"](spark, sf).toPandas()
    want = {}
    for i, ids in zip(docs.doc_id, _library_ids("word_bpe_49k.json", docs.text), strict=True):
        ids = [*ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            p = np.array(ids[at : at + 4096], "<u4")
            want[i, k] = (at, len(p), zlib.crc32(p.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    x = got.sort_values(["sequence_id", "offset"])
    assert ((x.groupby("sequence_id").length.cumsum() - x.length) == x.offset).all()
    assert x.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) + 2


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 400).tolist()
    best = packing.evolve(sizes, 128, 3, elite=list(range(400)))
    assert sorted(itertools.chain(*best.bins)) == list(range(400)) and max(best.fill) <= 128
    assert all(f == sum(sizes[p] for p in b) for f, b in zip(best.fill, best.bins, strict=True))
    assert len(best.bins) <= math.ceil(sum(sizes) / 128) + 1


def _triplets(n, capacity, rng):
    """Sizes that fill n bins exactly, three a bin."""
    out = []
    for _ in range(n):
        a = int(rng.integers(capacity * 0.38, capacity * 0.49))
        b = int(rng.integers(capacity // 4, (capacity - a) // 2))
        out += [a, b, capacity - a - b]
    return out


def test_evolution_beats_best_fit_decreasing():
    for seed in range(4):
        sizes = _triplets(10, 1000, np.random.default_rng(seed))
        plain = packing.Packing(sizes, 1000)
        plain.put(sorted(range(len(sizes)), key=lambda p: -sizes[p]))
        assert len(packing.evolve(sizes, 1000, seed).bins) < len(plain.bins)


def test_packing_comes_from_crossover(monkeypatch):
    """First groupings are far from the bound; with crossover off they stay there."""
    sizes = np.random.default_rng(5).integers(1, 3000, 2000).tolist()
    floor, calls, real = -(-sum(sizes) // 4096), [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or real(*a))
    assert len(packing.evolve(sizes, 4096, 1).bins) <= floor + 1 and calls
    monkeypatch.setattr(packing, "crossover", lambda a, b, rng: a)
    assert len(packing.evolve(sizes, 4096, 1).bins) > 1.02 * floor


def _sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([" ".join(w)]) if w else frozenset()))
    return out


def test_op6_equals_brute_force(spark, sf, docs):
    sets, ids = _sets(docs.text), docs.doc_id.tolist()
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        both = len(a & b)
        if both and 100 * both >= 85 * (len(a) + len(b) - both):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    got = {r.doc_id: r for r in QUERIES["op6_minhash_near_dedup"](spark, sf).collect()}
    assert all(got[i].component_id == find(i) and got[i].n_shingles == len(s) and got[i].kept == (find(i) == i) for i, s in zip(ids, sets, strict=True))


def test_group_of_near_copies_with_small_blocks(spark):
    """A chain of edits over blocks of a few members: links between different texts must all survive."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(0, 8)):
            w[at] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    texts += texts[:5]
    sets = _sets(texts)
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        both = len(a & b)
        if 100 * both >= 80 * (len(a) + len(b) - both):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(df, 80, block=7, elements=900).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_repeated_rows_of_a_document_reach_a_group_once(spark, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    rows = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(" ".join(words)).alias("text"))
    docs = rows.unionByName(spark.createDataFrame([(9, " ".join([*words[:-1], "last"])), (8, "quite another text of more than five words")], "doc_id long, text string"))
    seen = []
    plain = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda sets, *a: (seen.append(sets.count()), plain(sets, *a))[1])
    got = near_dedup.near_dedup(docs.repartition(6), 85).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {(r.doc_id, r.component_id, r.kept, r["count"]) for r in got} == {(7, 7, True, 30_000), (9, 7, False, 1), (8, 8, True, 1)}
    assert seen == [2]


def test_large_families_that_fall_apart(spark):
    """Two chains and loose members that look alike by signature, over many small blocks: leftovers meet all members."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
    texts = []
    for chain in range(3):
        words = [f"c{chain}x{j}" if j % 5 == chain else w for j, w in enumerate(base)]
        for k in range(25):
            words = list(words)
            words[rng.randrange(100)] = f"y{chain}k{k}"
            texts.append(" ".join(words))
    sets = _sets(texts)
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        both = len(a & b)
        if 100 * both >= 85 * (len(a) + len(b) - both):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    rows = [("one", 9, k, near_dedup.shingles(t).view(np.int64).tolist()) for k, t in enumerate(texts)]
    edges = near_dedup.confirmed(spark.createDataFrame(rows, "family string, blocks long, node long, shingles array<long>"), 85).collect()
    own = list(range(len(texts)))
    top = lambda x: x if own[x] == x else top(own[x])
    for e in edges:
        p, q = sorted((top(e.a), top(e.b)))
        own[q] = p
    assert [top(i) for i in range(len(texts))] == [find(i) for i in range(len(texts))] and len({find(i) for i in range(len(texts))}) > 2


def test_pairs_at_the_threshold_share_a_band():
    scheme = near_dedup.scheme_for(80)
    for k in range(12_000):
        words = [f"w{k}x{j}" for j in range(12)]
        one, two = (near_dedup.shingles(" ".join([*words, last])) for last in ("left", "right"))
        assert len(np.intersect1d(one, two)) == 8 and len(np.union1d(one, two)) == 10
        assert (scheme.band_keys(scheme.minima(one)) == scheme.band_keys(scheme.minima(two))).any()
    same = near_dedup.scheme_for(85)
    assert (same.bands, same.rows) == (20, 5)


def test_bit_estimate_is_unbiased():
    scheme, rng = near_dedup.Scheme(), np.random.default_rng(8)
    errors = []
    for share in (0.3, 0.6, 0.85):
        for _ in range(40):
            n = 600
            both = int(n * share)
            pool = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.append(pool[:both], pool[n:]))
            got = scheme.estimate(scheme.pack(scheme.minima(a)), scheme.pack(scheme.minima(b))[None])[0]
            errors.append(got - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_forward_sums_all_segmentations():
    pieces = language_id.pieces_of(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    prob = rng.random((pieces.size, 2)) / pieces.size
    table = np.vstack([prob, np.zeros((1, 2))])
    at = {p: k for k, p in enumerate(pieces.pieces)}
    words = ["▁there", "▁house", "▁zqxj"]
    got = language_id.log_likelihood(pieces, words, table)
    for w, row in zip(words, got, strict=True):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, begin = [], 0
            for k, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(w[begin:k])
                    begin = k
            value = np.ones(2)
            for p in parts:
                known = table[at[p]] if p in at else np.zeros(2)
                value = value * (np.maximum(known, language_id.FLOOR) if len(p) == 1 else known)
            total += value
        assert np.allclose(np.exp(row), total)


def _log_sum_of_cuts(pieces, word, prob):
    """Plain forward sum in logarithms, one letter at a time."""
    at = {p: k for k, p in enumerate(pieces.pieces)}
    longest = max(map(len, pieces.pieces))
    out = [np.zeros(prob.shape[1])]
    for j in range(1, len(word) + 1):
        terms = [np.full(prob.shape[1], -np.inf)]
        for m in range(1, min(j, longest) + 1):
            p = prob[at.get(word[j - m : j], pieces.size)]
            terms.append(out[j - m] + np.log(np.maximum(p, language_id.FLOOR if m == 1 else 1e-300)))
        out.append(np.logaddexp.reduce(terms))
    return out[-1]


def test_forward_sums_runs_of_any_length():
    pieces = language_id.pieces_of(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    prob = rng.random((pieces.size, 2)) ** 3 / pieces.size
    table = np.vstack([prob, np.zeros((1, 2))])
    letters = "etaoinshrdluqzxß漢字"
    words = ["▁" + "".join(rng.choice(list(letters), n)) for n in (23, 24, 30, 100, 2047, 2048, 5000)]
    got = language_id.log_likelihood(pieces, words, table)
    assert np.allclose(got, [_log_sum_of_cuts(pieces, w, table) for w in words], rtol=1e-9)


def test_expected_counts_of_a_long_run():
    """A run of 60 letters twice as one word: expected counts are those of the gradient of its log sum."""
    pieces = language_id.pieces_of(P.path("piece_bpe_32k.model"))
    word = "▁" + "thereandhouse" * 5
    got = language_id.expectation_maximisation(pieces, [word], np.array([2.0]), 1, 0.0)
    flat = np.append(np.full(pieces.size, 1.0 / pieces.size), 0.0)[:, None]
    used = [p for p in pieces.pieces if p in word]
    for p in used[:12]:
        k = pieces.pieces.index(p)
        up = flat.copy()
        up[k] *= 1 + 1e-5
        slope = (_log_sum_of_cuts(pieces, word, up) - _log_sum_of_cuts(pieces, word, flat))[0] / np.log1p(1e-5)
        share = got[k] * 1.0
        assert math.isclose(share, slope / _total_pieces(pieces, word, flat), rel_tol=1e-3, abs_tol=1e-9)


def _total_pieces(pieces, word, flat):
    """Expected number of pieces in a segmentation of word."""
    total = 0.0
    for p in {word[i:j] for i in range(len(word)) for j in range(i + 1, len(word) + 1)} & set(pieces.pieces):
        up = flat.copy()
        up[pieces.pieces.index(p)] *= 1 + 1e-5
        total += (_log_sum_of_cuts(pieces, word, up) - _log_sum_of_cuts(pieces, word, flat))[0] / np.log1p(1e-5)
    return total


def test_op2_equals_its_model_on_every_document(spark, sf, docs):
    """The query against the model's rule, word by word without caches or batches."""
    import regex

    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(table, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, sf).collect()}
    pieces = language_id.pieces_of(P.path("piece_bpe_32k.model"))
    for i, t in list(zip(docs.doc_id, docs.text, strict=True))[::4]:
        runs = ["▁" + r for w in (t or "").split() for r in regex.findall(r"\p{L}+", w.lower())]
        if not runs:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        ll = language_id.tolerant(language_id.log_likelihood(pieces, runs, model.prob)).sum(axis=0)
        p = np.exp(ll - ll.max())
        assert got[i].lang_pred == model.langs[int(p.argmax())] and math.isclose(got[i].score, p.max() / p.sum(), rel_tol=1e-6)


def test_op2_held_out(spark, sf, docs):
    lang = dict(zip(docs.doc_id, docs.lang, strict=True))
    got = [r for r in QUERIES["op2_language_id"](spark, sf).collect() if r.held_out]
    assert got and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_op1_held_out(spark, sf):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op1_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in got]) > 0.85


def test_op1_equals_a_plain_scorer(spark, sf, docs):
    """Every score as an intercept and one table entry for each feature and pair, found by counting edges."""
    table, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(table, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    place = lambda edges, v: sum(1 for e in edges if e <= v)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        x = quality.features(t or "")
        z = model.intercept + sum(t_[place(e, v)] for t_, e, v in zip(model.tables, model.edges, x, strict=True))
        for (a, b), t_ in zip(model.pairs, model.pair_tables, strict=True):
            z += t_[place(model.wide[a], x[a]) * (len(model.wide[b]) + 1) + place(model.wide[b], x[b])]
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and got[i].predicted == (got[i].score >= 0.7)


def test_additive_model_finds_a_pair_effect():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(pairs=2).fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_suffix_ranks_group_equal_prefixes():
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 3, 400)
    rank = html_text.suffix_ranks(ids, 8)
    keys = [tuple(ids[i : i + 8]) for i in range(400)]
    assert all((rank[i] == rank[j]) == (keys[i] == keys[j]) for i, j in itertools.combinations(range(400), 2) if len(keys[i]) == len(keys[j]) == 8)
    assert rank[:392].argmin() == min(range(392), key=lambda i: keys[i])


def test_suffix_array_removes_repeated_blocks_without_markup_hints():
    shared = "please read our terms of use and the privacy rules that hold for every page of this site today"
    pages = [f"<div><p>own words of page {k} number {k * 7} and {k * 13}</p></div><div><p>{shared}</p></div>" for k in range(5)]
    assert html_text.main_texts(pages) == [f"own words of page {k} number {k * 7} and {k * 13}" for k in range(5)]
    assert html_text.main_texts(pages[:2])[0].endswith(shared)  # on two pages it is not repeated enough


def test_no_element_of_an_article_goes_by_part_of_its_class():
    page = '<article><h1 class="article-header">Title</h1><p class="search-note">kept words</p><div class="comments"><p>me too</p></div><nav>up</nav></article>'
    assert html_text.main_texts([page]) == ["Title\nkept words"]


def test_formulas_objects_and_scripts_inside_a_paragraph():
    page = "<article><p>energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> rules</p><p>see <object data='x'>the figure</object> and <canvas>a chart</canvas></p><p>one <script>var x = '</p>';</script>line<style>p{}</style>s</p></article>"
    assert html_text.main_texts([page]) == ["energy E=m rules\nsee the figure and a chart\none lines"]
    assert html_text.main_texts(["<article><p>before <svg><path></p><p>after</p></article><footer>x</footer>"]) == ["before\nafter"]
    assert html_text.main_texts(["<article><p>before <script>never ends"]) == ["before"]


def test_the_array_decides_containers_that_it_has_seen(spark):
    """Adverts of a few texts, some of them rare, and a box whose texts are all unique, on 150 pages and on 20."""
    rng = random.Random(7)
    adverts = [" ".join(f"buy{k}x{j}" for j in range(6)) for k in range(12)]

    def page(k):
        own = " ".join(f"own{k}x{j}" for j in range(rng.randint(3, 40)))
        advert = f"rare{k} offer{k} today{k}" if k % 9 == 0 else rng.choice(adverts)
        return own, f'<nav><a>home</a></nav><div class="ad">{advert}</div><div class="widget box">box{k} of{k} words{k}</div><article><p>{own}</p></article>'

    for n, with_box in ((150, True), (20, False)):
        made = [page(k) for k in range(n)]
        want = [f"box{k} of{k} words{k}\n{own}" if with_box else own for k, (own, _) in enumerate(made)]
        df = spark.createDataFrame([(k, f"http://a.x/{k}", h) for k, (_, h) in enumerate(made)], "page_id long, url string, html string")
        assert html_text.main_texts([h for _, h in made]) == want
        for chunk_bytes in (2_000_000, 500):
            assert [r.text for r in html_text.extract(df, chunk_bytes=chunk_bytes).orderBy("page_id").collect()] == want


def test_many_rulings_meet_their_rows_in_a_shuffle(spark, monkeypatch):
    shared = " ".join(f"terms{j}" for j in range(24))
    rows = [(k, f"http://big.x/{k}", _plain_page(k, shared)[1]) for k in range(12)] + [(k, "http://b.x/", f"<p>only {k}</p>") for k in range(12, 15)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = sorted(map(tuple, html_text.extract(df).collect()))
    monkeypatch.setattr(html_text, "MOST_BROADCAST", 3)
    assert sorted(map(tuple, html_text.extract(df).collect())) == few and not any(shared in r[2] for r in few)


def test_without_the_array_adverts_stay(monkeypatch):
    made = [f'<div class="ad">buy this now from us {k % 5}</div><article><p>own words {k}</p></article>' for k in range(140)]
    assert html_text.main_texts(made) == [f"own words {k}" for k in range(140)]
    monkeypatch.setattr(html_text, "spread", lambda starts, depth, size: np.zeros(size, bool))
    assert all("buy" in t for t in html_text.main_texts(made))


def _plain_page(k, shared):
    own = " ".join(f"own{k}x{j}" for j in range(30))
    return own, f"<div><p>{own}</p></div><div><p>{shared}</p></div>"


def test_repeats_count_over_all_chunks_of_a_host(spark):
    shared = " ".join(f"terms{j}" for j in range(24))
    rows = [(k, f"http://big.x/{k}", _plain_page(k, shared if k % 10 == 0 else f"end of page {k}")[1]) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = dict(zip(range(60), html_text.main_texts([h for _, _, h in rows]), strict=True))
    assert all(shared not in x for x in want.values())
    for chunk_bytes in (4_000_000, 600, 1):
        assert {r.page_id: r.text for r in html_text.extract(df, chunk_bytes=chunk_bytes).collect()} == want


def test_rows_of_one_page_do_not_cover_each_other(spark):
    pages = [_plain_page(k, f"last words of {k}") for k in range(4)]
    text = [f"{own}\nlast words of {k}" for k, (own, _) in enumerate(pages)]
    source = [h for _, h in pages]
    later = [source[2].replace("last words of 2", f"edit {j} of 2") for j in range(3)]
    rows = [(1, "http://a.x/1", source[0])] * 3 + [(10 + j, f"http://a.x/copy{j}", source[1]) for j in range(3)]
    rows += [(20, f"http://a.x/version{j}", h) for j, h in enumerate(later)] + [(21, "http://a.x/21", later[0]), (22, "http://a.x/22", later[1]), (30, "http://a.x/30", source[3])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.url, r.text) for r in html_text.extract(df).collect())
    edit = [f"{pages[2][0]}\nedit {j} of 2" for j in range(3)]
    want = [(1, "http://a.x/1", text[0])] * 3 + [(10 + j, f"http://a.x/copy{j}", text[1]) for j in range(3)]
    want += [(20, f"http://a.x/version{j}", edit[j]) for j in range(3)] + [(21, "http://a.x/21", edit[0]), (22, "http://a.x/22", edit[1]), (30, "http://a.x/30", text[3])]
    assert got == collections.Counter(want)


def test_op3_text_of_articles(spark, sf):
    import html

    got = {r.page_id: r for r in QUERIES["op3_html_suffix_array"](spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert got[p.page_id].text == "\n".join(x for x in lines if x)


def test_syncmers_equal_a_plain_loop(spark):
    text = " ".join(f"w{k % 37}" for k in range(200))
    got = spark.createDataFrame([(text,)], "text string").select(syncmers.syncmers(F.col("text")).alias("s")).first().s
    hashes = spark.createDataFrame([(k, w) for k, w in enumerate(text.split())], "k int, w string").select("k", F.xxhash64("w").alias("h")).orderBy("k").collect()
    h = [0, 0, 0, 0] + [r.h for r in hashes]
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(h, h[1:], strict=False))], "k int, a long, b long").select("k", F.xxhash64("a", "b").alias("s")).orderBy("k").collect()
    s = [r.s for r in pairs]
    places = [i for i in range(len(s) - 3) if min(s[i : i + 4]) in (s[i], s[i + 3])]
    assert [x.place for x in got] == places


def test_likenesses_are_exact_on_long_texts(spark):
    rng = random.Random(4)
    passage = [f"shared{j}" for j in range(20)]
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(6000)] + passage) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edited = [t[: len(t) - len(t) // 4] + texts[(k + 1) % 3][: len(t) // 4] for k, t in enumerate(texts)]
    sets = [[{x.hash & 0xFFFFFFFF for x in r.s} for r in spark.createDataFrame(list(enumerate(x)), "k int, t string").select("k", syncmers.syncmers(F.col("t")).alias("s")).orderBy("k").collect()] for x in (texts, edited)]
    share = lambda a, b: len(a & b) / len(a | b)
    for r in syncmers.edited_fingerprints(df).collect():
        k = r.doc_id
        assert r.near_edited == share(sets[0][k], sets[1][k])
        assert r.near_next == share(sets[0][k], sets[0][(k + 1) % 3]) > 0


def test_next_row_with_outliers_nulls_and_repeats(spark):
    """Small buckets over ids with an outlier, null ids, an id that repeats, and rows that are alike."""
    rng = random.Random(6)
    ids = [*range(60), 10**15, *[None] * 20, *[30] * 25]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)] + [(7, "twin"), (7, "twin"), (7, "twin")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    tie = {r.text: r.tie for r in df.collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], tie[r[1]]))
    want = collections.Counter((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    for per_bucket in (4, 1000):
        got = syncmers.with_next(df, ["text"], {}, per_bucket=per_bucket)
        assert collections.Counter((r.doc_id, r.text, r.next_text) for r in got.collect()) == want
    keys = df.select(F.struct("doc_id", "tie").alias("key"))
    firsts = syncmers.bucket_firsts(keys, 4)
    sizes = keys.groupBy(syncmers.place(F.col("key"), firsts, syncmers.KEY)).count().agg(F.max("count")).first()[0]
    assert len(firsts) > 10 and sizes <= 24


def test_op8_edits_and_neighbours(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op8_syncmer_fingerprints"](spark, sf).collect()}
    t = [x or "" for x in docs.text]
    near = []
    for k, (i, x) in enumerate(zip(docs.doc_id, t, strict=True)):
        cut = len(x) // 4
        edited = x[: len(x) - cut] + t[(k + 1) % len(t)][:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(x)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if len(x.split()) > 100:
            near.append(got[i].near_edited)
    assert 0.5 < np.mean(near) < 0.7
    # likenesses and fingerprints from the plain sets of places and hashes
    edited = [x[: len(x) - len(x) // 4] + t[(k + 1) % len(t)][: len(x) // 4] for k, x in enumerate(t)]
    of = lambda texts: [{h.hash & 0xFFFFFFFF for h in r.s} for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", syncmers.syncmers(F.col("t")).alias("s")).orderBy("k").collect()]
    share = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    own, other = of(t), of(edited)
    shown = lambda s: "".join(f"{h:08x}" for h in sorted(s))
    for k, i in enumerate(docs.doc_id):
        assert got[i].near_edited == share(own[k], other[k]) and got[i].near_next == share(own[k], own[(k + 1) % len(t)])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(own[k]), shown(other[k]))
        a, b, c = ({f[j : j + 8] for j in range(0, len(f), 8)} for f in (got[i].fingerprint, got[i].edited_fingerprint, got[docs.doc_id[(k + 1) % len(t)]].fingerprint))
        assert (got[i].near_edited, got[i].near_next) == (share(a, b), share(a, c))  # from the returned columns alone
    same = collections.defaultdict(set)
    for i, x in zip(docs.doc_id, t, strict=True):
        same[x].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_op10_counts_and_base(spark, sf, docs):
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    words = {i: tok(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    c = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n = sum(c.values())
    norm = math.log10(n + 0.1 * (len(c) + 1))
    got = {r.doc_id: r for r in QUERIES["op10_maxent_lm"](spark, sf).collect()}
    for i, ws in words.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(got[i].base_score, sum(math.log10(c[w] + 0.1) - norm for w in ws), rel_tol=1e-9, abs_tol=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tail_counts_come_from_the_join(spark):
    """With a head of a few tokens nearly all counts go through the shuffle."""
    rows = [(k, " ".join(f"w{(k * j) % 50}" for j in range(30))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = {r.doc_id: r for r in maxent_lm.score_documents(df, F.col("doc_id") > 4, head=3, rounds=2).collect()}
    all_ = {r.doc_id: r for r in maxent_lm.score_documents(df, F.col("doc_id") > 4, rounds=2).collect()}
    assert all(math.isclose(few[k].base_score, all_[k].base_score) and few[k].n_known == all_[k].n_known for k in few)


def test_class_model_is_a_distribution():
    model = maxent_lm.MaxEnt()
    model.w[:] = np.random.default_rng(0).normal(size=model.w.shape)
    p = np.exp(model.log_classes(np.arange(50)))
    assert np.allclose(p.sum(axis=1), 1)


def test_language_model_equals_a_plain_scorer(spark):
    """Every score by loops over tokens, classes and features; and the probabilities of all tokens sum to one."""
    rng = random.Random(9)
    words = [f"W{k}{rng.choice(['ing', 'ed', 'os', 'en'])}" for k in range(150)]
    texts = [" ".join(words[min(int(rng.expovariate(0.03)), 149)] for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "never seen words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = maxent_lm.fit(df, F.col("doc_id") < 50, head=20)
    got = {r.doc_id: r.score for r in maxent_lm.score_documents(df, F.col("doc_id") < 50, head=20).collect()}
    tok = lambda t: [w.lower().encode() for w in (t or "").split()] + [maxent_lm.END]
    count = collections.Counter(w for t in texts[:50] for w in tok(t))
    of = fitted.classes.of
    sums, kinds = collections.Counter(), collections.Counter()
    for w, c in count.items():
        sums[of(w)] += c
        kinds[of(w)] += 1
    s = fitted.scorer

    def class_odds(one, two):
        """P(class) after the words one and two before, feature by feature."""
        h = [np.array([int(maxent_lm.keys_of([w])[0]) >> 32 if w is not None else 0], np.uint32) for w in (one, two)]
        c1, c2 = (of(maxent_lm.END if w is None else w) for w in (one, two))
        ctx = c2 * maxent_lm.CLASSES + c1
        z = np.array(s.group_z[ctx], float)
        for bucket in s.words.rows(tuple(h)):
            z = z + s.words.w[bucket[0]]
        groups = np.exp(z) / np.exp(z).sum()
        return [groups[k % maxent_lm.GROUPS] * math.exp(s.in_group[ctx, k]) for k in range(maxent_lm.CLASSES)]

    def share(w):
        k = of(w)
        return (count[w] + 0.1) / (sums[k] + (0.1 if k < maxent_lm.OWN else 0.1 * (kinds[k] + 1)))

    for i, t in enumerate(texts):
        total, one, two = 0.0, None, None
        for w in tok(t):
            total += math.log10(class_odds(one, two)[of(w)] * share(w))
            one, two = w, one
        assert math.isclose(got[i], total, rel_tol=1e-4, abs_tol=1e-4)
    odds = class_odds(tok(texts[3])[0], None)
    unseen = sum(p * 0.1 / (sums[k] + 0.1 * (kinds[k] + 1)) for k, p in enumerate(odds) if k >= maxent_lm.OWN)
    empty = sum(p for k, p in enumerate(odds) if k < maxent_lm.OWN and not sums[k])
    assert math.isclose(sum(odds[of(w)] * share(w) for w in count) + unseen + empty, 1, rel_tol=1e-4)


def test_word_features_grow_with_the_corpus():
    assert [maxent_lm.buckets_for(n) for n in (0, 10**5, 10**7, 10**9)] == [1024, 2048, 16384, 131072]


def test_word_features_learn_what_classes_cannot(spark):
    """The word before tells the next group, whatever the classes: held-out texts gain by the word features."""
    rng = random.Random(2)
    firsts = [f"q{k}xyz" for k in range(150)]  # most are of one class: they share an ending
    texts = [" ".join(f"{firsts[j]} {'aa' if j % 2 else 'bb'}" for j in rng.choices(range(150), k=40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = lambda n: sum(r.score for r in maxent_lm.score_documents(df, F.col("doc_id") < 160, word_rounds=n).collect() if r.doc_id >= 160)
    assert total(6) > total(0) + 40


def test_op4_sql_twin(spark, sf):
    import duckdb

    from mnemospark.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cur = con.execute(ORACLE_SQL["op4_exact_dedup"])
    names = [d[0] for d in cur.description]
    got = QUERIES["op4_exact_dedup"](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_touched_sums_equal_dense_sums():
    """Sums of the buckets met, handed on in pieces, are the dense sums."""
    import numpy as np

    from mnemospark.llm import maxent_lm as m

    rng = np.random.default_rng(5)
    buckets, n = 1 << 15, 3000
    dense = np.zeros((buckets, 2 * m.GROUPS))
    got = np.zeros_like(dense)
    sums = m.TouchedSums(buckets)
    for k in range(7):
        rows = [rng.integers(0, buckets, n) if k % 2 else rng.integers(0, 50, n) for _ in range(3)]
        group, p = rng.integers(0, m.GROUPS, n), rng.random((m.GROUPS, n))
        sums.add(rows, group, p)
        for r in rows:
            np.add.at(dense, (r, group), 1)
            for g in range(m.GROUPS):
                np.add.at(dense, (r, m.GROUPS + g), p[g])
        if k % 3 == 2 or k == 6:
            for s, at, v in sums.drained():
                got[s * m.SLICE + at] += v
            assert len(sums.met) == 0 and (sums.place == -1).all() and sums.drained() == []
    assert np.allclose(got, dense, atol=1e-2, rtol=1e-4)


def test_word_training_does_not_depend_on_pieces(spark, sf):
    """The weights are the same however often a task hands its sums on and however few neighbours meet first."""
    import numpy as np
    from pyspark.sql import functions as F

    from mnemospark.llm import maxent_lm as m

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    encoded = m.encode(docs, F.lit(True)).cache()
    classes = m.Classes([], [])
    model = m.train(m.class_trigrams(encoded, classes), 2)
    one = m.train_words(encoded, model, classes, 4_000_000)
    two = m.train_words(encoded.repartition(5), model, classes, 4_000_000, near=2, touched=100)
    assert one.w.any() and np.allclose(one.w, two.w, atol=1e-4)
    assert not m.train_words(encoded.limit(0), model, classes, 0).w.any()
    encoded.unpersist()
