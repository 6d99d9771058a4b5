"""Provider steps: extraction of facts, inference, summaries, reranking, dense retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.providers import Embedder, Generator, embed_column, generate
from mnemospark.functions.text import NO_ANSWER, extracted_entities, extracted_triples, final_answer, id_list, kg_normalise, render, triple_line
from mnemospark.functions.vectors import min_max
from mnemospark.operators.records import context_text, fill_to_k
from mnemospark.operators.similarity import top_k_join
from mnemospark.operators.windows import anchored_windows, every_n

#: Prompt families by name; register more as needed.
PROMPTS = {
    "entities": 'List the named entities as {"named_entities": [...]}.\nPassage: ${passage}',
    "triples": 'Give facts about the entities as {"triples": [[subject, predicate, object], ...]}.\nPassage: ${passage}\nEntities: ${entities}',
    "inference": 'What do these facts suggest? Answer as {"triples": [[subject, predicate, object], ...]}.\n${facts}',
    "summary": "Summarise what happens.\n${text}",
    "rerank": "Which captions help with: ${query}? Answer with a list of ids.\n${candidates}",
    "answer": "Use the passages.\n${context}\nQuestion: ${question}\nThought:",
}


def extract_facts(passages: DataFrame, generator: Generator) -> DataFrame:
    """(chunk, entities, triples) of passages (chunk, passage): entities first, then triples that know them.

    A call that fails leaves empty lists.
    """
    first = passages.withColumn("prompt", render(PROMPTS["entities"], passage=F.col("passage")))
    ner = generate(first, "chunk", "prompt", generator).select("chunk", extracted_entities(F.coalesce("response", F.lit(""))).alias("entities"))
    second = passages.join(ner, "chunk").withColumn("prompt", render(PROMPTS["triples"], passage=F.col("passage"), entities=F.to_json("entities")))
    triples = generate(second, "chunk", "prompt", generator).select("chunk", extracted_triples(F.coalesce("response", F.lit(""))).alias("triples"))
    return ner.join(triples, "chunk")


def facts_table(extracted: DataFrame) -> DataFrame:
    """(chunk, s, p, o): normalised triples, one row each."""
    each = extracted.select("chunk", F.explode("triples").alias("t"))
    return each.select("chunk", *[kg_normalise(F.get("t", F.lit(k))).alias(c) for k, c in enumerate("spo")]).filter("s <> '' and o <> ''")


def infer_semantics(rows: DataFrame, generator: Generator, period: int = 10) -> DataFrame:
    """(key, triples) for each period rows of (by, ordinal, code, triples): numbered facts go to the provider."""
    g = every_n(rows, "ordinal", period, ["by"])
    t = g.groupBy("by", "group_no").agg(F.max_by("code", "ordinal").alias("key"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "triples"))), lambda e: e["triples"])).alias("t"))
    line = F.transform("t", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), triple_line(F.get(x, F.lit(0)), F.get(x, F.lit(1)), F.get(x, F.lit(2)))))
    asked = t.withColumn("prompt", render(PROMPTS["inference"], facts=F.array_join(line, "\n")))
    return generate(asked, "key", "prompt", generator).select("key", extracted_triples(F.coalesce("response", F.lit(""))).alias("triples"))


def summarised_windows(captions: DataFrame, width: int, generator: Generator) -> DataFrame:
    """One caption a window: (d, w_start, w_end, text) of (d, start, ordinal, text); a window without an answer keeps its texts."""
    w = anchored_windows(captions, "start", width, ["d"])
    t = w.groupBy("d", "w_start", "w_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "ordinal", "text"))), lambda e: e["text"]), "\n").alias("all"))
    t = t.withColumn("key", F.concat_ws("_", "d", "w_start")).withColumn("prompt", render(PROMPTS["summary"], text=F.col("all")))
    got = generate(t, "key", "prompt", generator)
    answer = F.when(F.coalesce("response", F.lit(NO_ANSWER)) != NO_ANSWER, F.col("response"))
    return t.join(got, "key").select("d", "w_start", "w_end", F.coalesce(answer, "all").alias("text"))


def rerank(ranked: DataFrame, queries: DataFrame, generator: Generator, k: int) -> DataFrame:
    """(query_id, item_id, rank): the provider's choice among ranked (query_id, item_id, content, score), filled to k.

    Queries with at most k candidates are not sent.
    """
    n = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("item_id")).alias("ids"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "item_id", "content"))), lambda e: F.concat(e["item_id"], F.lit(": "), e["content"])), "\n").alias("listed"))
    sent = n.filter(F.col("n") > k).join(queries, "query_id").withColumn("prompt", render(PROMPTS["rerank"], query=F.col("question"), candidates=F.col("listed")))
    reply = generate(sent, "query_id", "prompt", generator)
    picked = sent.join(reply, "query_id").select("query_id", F.posexplode(id_list(F.coalesce("response", F.lit("")), F.col("ids"))).alias("place", "item_id"))
    return fill_to_k(picked, ranked, "query_id", "item_id", k)


def dense_retrieve(queries: DataFrame, passages: DataFrame, embedder: Embedder, k: int) -> DataFrame:
    """(query_id, key_id, rank, score, norm): the k passages most like each query, scores also scaled to 0..1."""
    q = embed_column(queries, "query_id", "question", embedder)
    p = embed_column(passages.withColumnRenamed("passage_id", "key_id"), "key_id", "content", embedder)
    return min_max(top_k_join(q, p, k), "score", ["query_id"], "norm")


def answer_from_passages(queries: DataFrame, found: DataFrame, passages: DataFrame, generator: Generator) -> DataFrame:
    """(query_id, answer): the provider's answer with the found passages as context."""
    told = found.join(passages.withColumnRenamed("passage_id", "key_id"), "key_id")
    ctx = context_text(told, "query_id", ["rank"], "content")
    asked = queries.join(ctx, "query_id", "left").withColumn("prompt", render(PROMPTS["answer"], context=F.col("context"), question=F.col("question")))
    return generate(asked, "query_id", "prompt", generator).select("query_id", final_answer(F.coalesce("response", F.lit(NO_ANSWER))).alias("answer"))
