"""Joins and reshaping of records: required and defaulted lookups, alignment, candidates, passages, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import chunk_id, label_normalise, seeded_hash, valid_triples

_NONE = "array<array<string>>"


def entries_of_texts(found: DataFrame, captions: DataFrame) -> DataFrame:
    """Retrieved texts (granularity, content, score) with their captions: by granularity and content key, last loaded wins."""
    keyed = captions.withColumn("_k", chunk_id(F.col("text")))
    last = keyed.groupBy("granularity", "_k").agg(F.max_by(F.struct(*captions.columns), F.col("idx")).alias("_c"))
    hits = found.withColumn("_k", chunk_id(F.col("content"))).join(last, ["granularity", "_k"])
    return hits.select("score", "_c.*")


def required_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join that fails where table lacks a key."""
    if lacking := rows.join(table.select(key), key, "left_anti").select(key).head(3):
        raise ValueError(f"no {key} for {[r[0] for r in lacking]}")
    return rows.join(table, key)


def lookup_or_empty(rows: DataFrame, triples: DataFrame, key: str, column: str = "triples") -> DataFrame:
    """Left join; a missing key gives an empty list."""
    return rows.join(triples, key, "left").withColumn(column, F.coalesce(column, F.array().cast(_NONE)))


def seeded_documents(captions: DataFrame, entities: DataFrame, triples: DataFrame, base: str = "10sec") -> DataFrame:
    """One extraction document for each distinct text of a granularity; only the base granularity has real values."""
    docs = captions.select("granularity", chunk_id(F.col("text")).alias("chunk"), F.col("text").alias("passage")).dropDuplicates(["granularity", "chunk"])
    x = docs.join(entities, "chunk", "left").join(triples, "chunk", "left")
    real = F.col("granularity") == base
    return x.select("granularity", F.col("chunk").alias("idx"), "passage", F.when(real, F.coalesce("entities", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("extracted_entities"), F.when(real, F.coalesce("triples", F.array().cast(_NONE))).otherwise(F.array().cast(_NONE)).alias("extracted_triples"))


def missing_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (hash_id, content) that extraction documents (passage) lack; ids are made again from the passages."""
    return chunks.join(docs.select(chunk_id(F.col("passage")).alias("hash_id")).distinct(), "hash_id", "left_anti")


def merged_documents(docs: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Documents with extraction results by idx; sorted distinct entities, valid triples, empty where a call failed."""
    x = docs.join(entities.withColumnRenamed("chunk", "idx"), "idx", "left").join(triples.withColumnRenamed("chunk", "idx"), "idx", "left")
    return x.select(*docs.columns, F.array_sort(F.array_distinct(F.coalesce("entities", F.array().cast("array<string>")))).alias("extracted_entities"), valid_triples(F.coalesce("triples", F.array().cast(_NONE))).alias("extracted_triples"))


def valid_with_evidence(triples: Column, evidence: Column) -> Column:
    """array<struct<triple, evidence>> without malformed triples; evidence stays aligned, lacking lists are empty."""
    pairs = F.transform(triples, lambda t, i: F.struct(t.alias("triple"), F.coalesce(F.get(evidence, i), F.array().cast("array<int>")).alias("evidence")))
    return F.filter(pairs, lambda p: F.size(p["triple"]) == 3)


def valid_decision(updated: Column, removed: Column, related: Column) -> Column:
    """Whether a consolidation answer can be used: a whole triple and indices inside the related list."""
    return F.coalesce((F.size(updated) == 3) & F.forall(removed, lambda i: (i >= 0) & (i < F.size(related))), F.lit(False))


def head_rows(df: DataFrame, order: list[str], n: int | str | None) -> DataFrame:
    """The first n rows; a numeric string counts, anything else keeps all (a sampling operator)."""
    if isinstance(n, str):
        n = int(n) if n.strip().isdigit() else None
    return df if not n or n < 0 else df.orderBy(*order).limit(n)


def in_languages(df: DataFrame, column: str, languages: list[str]) -> DataFrame:
    return df.filter(F.col(column).isin(languages))


def new_in_round(found: DataFrame, by: str, key: str, round_: str, k: int) -> DataFrame:
    """The first k new keys of each round: a key counts in the first round that finds it only."""
    first = found.groupBy(by, key).agg(F.min(round_).alias(round_))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by, round_).orderBy(key))).filter(F.col("place") <= k)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash of key: the same on every run and partitioning (a sampling operator)."""
    return df.orderBy(seeded_hash(seed, F.col(key)), key).limit(n)


def aligned(left: DataFrame, right: DataFrame, ordinal: str, check: list[str]) -> DataFrame:
    """Rows of both sides by position; a row that only one side has, or whose check columns differ, is an error."""
    r = right.select(ordinal, *[F.col(c).alias(f"r_{c}") for c in right.columns if c != ordinal])
    x = left.withColumn("_l", F.lit(1)).join(r.withColumn("_r", F.lit(1)), ordinal, "full")
    differs = F.col("_l").isNull() | F.col("_r").isNull()
    for c in check:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"r_{c}"))
    if bad := x.filter(differs).select(ordinal).head(3):
        raise ValueError(f"rows do not agree at {[b[0] for b in bad]}")
    return x.drop("_l", "_r")


def candidate_lists(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries (query_id) with array<struct<score, doc_id>> of their judged documents, best first."""
    c = qrels.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "doc_id", "score"))), lambda e: F.struct(e["score"].alias("score"), e["doc_id"].alias("doc_id"))).alias("candidates"))
    return queries.join(c, "query_id", "left")


def gold_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank) of each query's gold text in its ranked list (query_id, name, rank); null where it is not there."""
    hit = gold.join(ranked, (gold["query_id"] == ranked["query_id"]) & (gold["label"] == ranked["name"]), "left")
    return hit.groupBy(gold["query_id"]).agg(F.min("rank").alias("rank"))


def distinct_candidates(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidates and corpus together, the first of each name (candidates before corpus)."""
    both = candidates.withColumn("_o", F.lit(0)).unionByName(corpus.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("name").agg(F.min_by(F.struct(*[c for c in both.columns if c not in ("name", "_o")]), F.struct("_o", "ordinal")).alias("_c")).select("name", "_c.*")


def mean_of_tasks(scores: DataFrame) -> DataFrame:
    """(task, score, seconds): scores of sub-tasks averaged, times added."""
    return scores.groupBy("task").agg(F.round(F.avg("score"), 6).alias("score"), F.round(F.sum("seconds"), 6).alias("seconds"))


def label_accuracy(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Accuracy of exact labels (white space and case apart) over tasks of the given kinds."""
    x = rows.filter(F.col("qa_type").isin(kinds))
    return x.groupBy("qa_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((label_normalise(F.col("prediction")) == label_normalise(F.col("gold"))).cast("double")), 6).alias("accuracy"))


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: counts before and after consolidation, and the share removed."""
    b = before.agg(F.count(F.lit(1)).alias("n_before"))
    return b.join(F.broadcast(after.agg(F.count(F.lit(1)).alias("n_after")))).withColumn("removed", F.round(F.when(F.col("n_before") > 0, 1 - F.col("n_after") / F.col("n_before")).otherwise(0.0), 6))


def fill_to_k(selected: DataFrame, ranked: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """Selected rows first (by place), then the best other ranked rows, k for each group."""
    first = selected.select(by, key, F.lit(0).alias("_p"), F.col("place").cast("double").alias("_o"))
    rest = ranked.join(selected.select(by, key), [by, key], "left_anti").select(by, key, F.lit(1).alias("_p"), (-F.col("score")).alias("_o"))
    w = Window.partitionBy(by).orderBy("_p", "_o", key)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(by, key, "rank")


def merged_passages(passages: DataFrame) -> DataFrame:
    """Passages (query_id, ordinal, text) that share a first line as one: the line, then the bodies in order."""
    head = F.substring_index("text", "\n", 1)
    body = F.when(F.col("text").contains("\n"), F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("")
    x = passages.select("query_id", "ordinal", head.alias("head"), body.alias("body"))
    g = x.groupBy("query_id", "head").agg(F.min("ordinal").alias("ordinal"), F.array_sort(F.collect_list(F.struct("ordinal", "body"))).alias("b"))
    return g.select("query_id", "ordinal", F.array_join(F.filter(F.concat(F.array("head"), F.transform("b", lambda e: e["body"])), lambda t: t != ""), "\n").alias("text"))


def context_text(items: DataFrame, by: str, order: list[str], text: str, joiner: str = "\n\n") -> DataFrame:
    """(by, context): texts in order, joined."""
    return items.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda e: e["_t"]), joiner).alias("context"))


def added_vertices(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid edges, edges with unknown ends, isolated vertices): self loops go, unknown nodes are reported."""
    ids = vertices.select("id").distinct()
    known = lambda e, c: e.join(ids.withColumnRenamed("id", c), c, "left_semi")
    real = edges.filter("src <> dst")
    valid = known(known(real, "src"), "dst").select(*edges.columns)
    ends = valid.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    unknown = real.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns).unionByName(known(real, "src").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns))
    return valid, unknown, vertices.join(ends, "id", "left_anti")
