"""Stages on a small table: what goes, what stays, and that columns pass unchanged."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.llm import stages


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "exact_dedup", "near_dedup", "packing"]


def test_filters_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(1) for c in ("score", "kept", "text_sha256", "kept_id")})
    once = stages.drop_exact_copies(docs)
    assert once.columns == docs.columns
    rows = docs.collect()
    last = {}
    for r in rows:
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(last.values())
    kept = stages.drop_near_copies(docs, 80)
    assert kept.columns == docs.columns
    ids, sets = [], []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
        ids.append(r.doc_id)
        sets.append({" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set()))
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in ids if find(i) == i)


def test_repeated_rows_and_nulls_in_stages(spark, sf):
    rows = [(1, "same text", None), (1, "same text", None), (2, "same text", "x"), (None, "other text here", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.text) for r in stages.drop_exact_copies(docs).collect()), key=str)
    assert got == sorted([(2, "same text"), (None, "other text here"), (5, "")], key=str)
    assert stages.drop_exact_copies(docs.limit(0)).collect() == []
    assert stages.drop_near_copies(docs.limit(0)).collect() == []


def test_rows_pass_language_and_quality_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    import public_tokenizers

    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "!!! 12", "en", "s", 6)], docs.schema)
    left = stages.keep_known_language(docs.unionByName(odd), vocabulary)
    assert left.schema == docs.schema and not left.filter(F.col("doc_id") >= 10**6).collect()
    assert left.count() == docs.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = stages.keep_good_quality(docs, labels).join(labels, "doc_id", "left").collect()
    clean = labels.filter("quality = 1").count()
    assert sum(r.quality == 1 for r in good) >= 0.95 * clean
    junk = labels.filter("quality = 0").count()
    assert sum(r.quality == 0 for r in good) <= 0.3 * junk


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
