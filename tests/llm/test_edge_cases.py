"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import byte_bpe, language_id, quality
from mnemospark.llm.common import fold
from mnemospark.llm.exact_dedup import exact_dedup
from mnemospark.llm.html_text import extract
from mnemospark.llm.maxent_lm import score_documents
from mnemospark.llm.near_dedup import near_dedup
from mnemospark.llm.packing import best_fit_packing
from mnemospark.llm.syncmers import edited_fingerprints
from mnemospark.llm.token_output import token_output

LONG = "the quick brown fox jumps over the lazy dog " * 12_000
ROWS = [
    (1, "a plain text of seven words here", "en"),
    (2, "a plain text of seven words here", "en"),
    (2, "a plain text of seven words here", "en"),
    (3, "", "en"),
    (4, None, None),
    (5, LONG, "en"),
    (None, "nobody knows the id of this text", "de"),
    (7, "  \t\n ", "fr"),
    (8, "!!! ??? 123", None),
]
#: Columns of the inputs that carry the names of outputs.
CLASHES = ["score", "kept", "keep_id", "group_size", "component_id", "n_tokens", "start", "piece", "held_out", "bucket", "digest", "node", "lang_pred", "sequence_id", "length", "row", "hash", "x"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (3, 0), (None, 1), (2, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    train = fold(4) != 2
    pieces, bytes_, words = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
    return {
        "quality": lambda d: quality.score(d, quality.fit(d, labels, train, rounds=5, pair_rounds=2)),
        "language": lambda d: language_id.predict(d, language_id.fit(d, train, pieces, rounds=2)),
        "exact": lambda d: exact_dedup(d),
        "bpe": lambda d: byte_bpe.round_trip_digests(d, P.path("byte_bpe_50k.tiktoken")),
        "near": lambda d: near_dedup(d, 85),
        "packing": lambda d: best_fit_packing(d, words, shard_rows=8),
        "syncmers": lambda d: edited_fingerprints(d),
        "tokens": lambda d: token_output(d, bytes_, 2, parts=3),
        "lm": lambda d: score_documents(d, fold(10) != 0, rounds=2),
    }


NAMES = ["quality", "language", "exact", "bpe", "near", "packing", "syncmers", "tokens", "lm"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_gets_a_result(spark, name):
    got = operators(spark)[name](frame(spark, ROWS)).collect()
    ids = sorted((r.doc_id for r in got if name != "packing" or r.piece == 0), key=str)
    assert ids == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_one_row_and_only_nulls(spark, name):
    assert len(operators(spark)[name](frame(spark, [(9, None, None)])).collect()) == 1


def test_exact_groups(spark):
    got = exact_dedup(frame(spark, ROWS)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.kept for r in by[2]] == [True, True] and not by[1][0].kept and by[1][0].keep_id == 2 and by[1][0].group_size == 3
    assert by[3][0].keep_id == by[4][0].keep_id == 4 and by[4][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[None][0].kept and by[None][0].keep_id is None


def test_near_groups(spark):
    by = {r.doc_id: r for r in near_dedup(frame(spark, ROWS), 85).collect()}
    assert by[1].component_id == by[2].component_id == 1 and by[1].kept and not by[2].kept
    assert by[3].n_shingles == by[4].n_shingles == by[7].n_shingles == 0 and by[3].component_id == 3 and by[7].kept
    assert by[8].n_shingles == 1 and by[5].n_shingles == 9


def test_language_of_textless(spark):
    model = language_id.fit(frame(spark, ROWS), F.lit(True), P.path("piece_bpe_32k.model"), rounds=2)
    by = {r.doc_id: r for r in language_id.predict(frame(spark, ROWS), model).collect()}
    assert {by[k].lang_pred for k in (3, 4, 7, 8)} == {"und"} and by[4].score == 0
    assert by[5].lang_pred == "en" and 0 < by[5].score <= 1


def test_pages(spark):
    rows = [
        (1, "http://a.x/1", "<html><nav>menu words</nav><article><h1>Head</h1><p>One &amp; two<br>three</p></article><footer>foot</footer>"),
        (1, "http://a.x/1", "<html><nav>menu words</nav><article><h1>Head</h1><p>One &amp; two<br>three</p></article><footer>foot</footer>"),
        (2, None, None),
        (3, "http://b.x/", ""),
        (None, "no url at all", "<p>plain   text<p>second<script>var a='<p>no</p>'</script><!-- <p>no</p> --><div class='ad'>buy</div><p"),
        (5, "//c.x", "<main><p>kept</p><section id=comments><p>reader</p></section><aside>side</aside><form><p>f</p></form></main>" + "<p>x" * 20_000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "chunk", "text", "n_chars", "chunks")})
    got = extract(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 6 and text[1] == "Head\nOne & two three" and text[2] == text[3] == ""
    assert text[None] == "plain text\nsecond" and text[5] == "kept"
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(df.limit(0)).collect() == []


def test_very_long_text_without_white_space(spark):
    """A run of 60 000 letters, one of odd characters, and a long number, beside a plain text."""
    import random

    import numpy as np
    import zlib
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(60_000)), "漢字%s" % ("ö" * 20_000), "7" * 30_000, "just some plain words that stand here"]
    d = frame(spark, [(k, t, "en") for k, t in enumerate(texts)])
    made = operators(spark)
    assert {r.lang_pred for r in made["language"](d).collect()} <= {"en", "und"}
    assert {r.doc_id: r.n_shingles for r in made["near"](d).collect()} == {0: 1, 1: 1, 2: 1, 3: 3}
    ids = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        lib = Tokenizer.from_file(P.path(name))
        ids[name] = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = {r.doc_id: r for r in made["tokens"](d).collect()}
    assert all(got[k].ids_crc32 == crc([*x, 2]) for k, x in enumerate(ids["byte_bpe_50k.json"]))
    pieces = {}
    for r in made["packing"](d).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for k, x in enumerate(ids["word_bpe_49k.json"]):
        x = [*x, 1]
        assert sorted(pieces[k]) == [(a, len(x[a : a + 4096]), crc(x[a : a + 4096])) for a in range(0, len(x), 4096)]
    bpe = {r.doc_id: r for r in made["bpe"](d).collect()}
    assert all(bpe[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in made["lm"](d).collect()} == {0: 2, 1: 2, 2: 2, 3: 8}
    prints = {r.doc_id: r for r in made["syncmers"](d).collect()}
    assert all(prints[k].n_chars == len(t) and prints[k].fingerprint for k, t in enumerate(texts))


def test_ties_and_repeated_labels(spark):
    """Equal evidence: the language that sorts first; a text whose labels disagree scores one half or near it."""
    rows = [(k, "mama papa mama", lang) for k, lang in enumerate(["zz", "aa", "zz", "aa"])]
    model = language_id.fit(frame(spark, rows), F.lit(True), P.path("piece_bpe_32k.model"), rounds=2)
    got = language_id.predict(frame(spark, rows), model).collect()
    assert {r.lang_pred for r in got} == {"aa"} and all(abs(r.score - 0.5) < 1e-9 for r in got)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 0)], "doc_id long, quality int")
    fitted = quality.fit(frame(spark, rows), labels, F.lit(True), rounds=5, pair_rounds=2)
    assert all(abs(r.score - 0.5) < 1e-6 for r in quality.score(frame(spark, rows), fitted).collect())


def test_filters_on_empty_tables_with_clashing_names(spark):
    from mnemospark.llm import stages

    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for rows in ([], ROWS):
        d = frame(spark, rows)
        known = stages.keep_known_language(d, P.path("piece_bpe_32k.model"))
        good = stages.keep_good_quality(d, labels)
        assert known.schema == good.schema == d.schema
        assert known.count() <= len(rows) and good.count() <= len(rows)
        assert not known.filter(F.coalesce("text", F.lit("")) == "").collect()


def test_html_over_many_chunks_is_one_host(spark):
    rows = [(k, "http://a.x/", f"<div class='promo'>take {k % 3} of our offers now</div><article><p>own {k} {'word ' * 50}</p></article>") for k in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, extract(df).collect()))
    assert sorted(map(tuple, extract(df, chunk_bytes=1).collect())) == whole and not any("offers" in r[2] for r in whole)


def test_fits_stay_bounded_when_one_id_has_most_rows(spark, monkeypatch):
    """50 000 rows of one id, equal ones and different ones, labelled over and over: the fit sees a bounded number of distinct rows."""
    hot = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("the same words again")).otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    some = spark.range(100, 200).select(F.col("id").alias("doc_id"), F.concat(F.lit("other words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = hot.unionByName(some)
    labels = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("quality")).unionByName(some.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    seen = []
    plain = quality.AdditiveModel.fit
    monkeypatch.setattr(quality.AdditiveModel, "fit", lambda self, x, y: (seen.append(len(x)), plain(self, x, y))[1])
    quality.fit(docs, labels, F.lit(True), bound=400, rounds=2, pair_rounds=1)
    assert 100 < seen[0] <= 800
    assert language_id.fit(docs, F.lit(True), P.path("piece_bpe_32k.model"), sample=60, rounds=1).langs == ["en"]
