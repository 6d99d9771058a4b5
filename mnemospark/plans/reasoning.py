"""Provider steps of retrieval: filtering facts, reasoning over passages, instructions for queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.providers import Generator, generate
from mnemospark.functions.repair import nearest, sections
from mnemospark.functions.text import render, triple_line
from mnemospark.operators.records import context_text, merged_passages

#: What a query is to retrieve, by linking method; any other method is as query_to_passage.
INSTRUCTIONS = {
    "ner_to_node": "Given a phrase, retrieve synonymous or relevant phrases that best match this phrase.",
    "query_to_node": "Given a question, retrieve relevant phrases that are mentioned in this question.",
    "query_to_fact": "Given a question, retrieve relevant triplet facts that matches this question.",
    "query_to_sentence": "Given a question, retrieve relevant sentences that best answer the question.",
    "query_to_passage": "Given a question, retrieve relevant documents that best answer the question.",
}

FACT_PROMPT = "[[ ## question ## ]]\n${question}\n\n[[ ## fact_before_filter ## ]]\n${facts}\n\nGive the useful facts as [[ ## fact_after_filter ## ]], then [[ ## completed ## ]]."
REASON_PROMPT = "${passages}Question: ${question}\nThought:${thoughts}"


def query_instruction(method: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in INSTRUCTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, method), F.lit(INSTRUCTIONS["query_to_passage"]))


def filter_facts(queries: DataFrame, candidates: DataFrame, generator: Generator, k: int) -> DataFrame:
    """(query_id, fact_id, rank): the facts of candidates (query_id, rank, fact_id, s, p, o) that the provider keeps, at most k.

    The reply's facts are matched to the nearest candidates, whatever their likeness; a fact that is named twice counts
    twice, as it does in the reply, and a reply without facts keeps none.
    """
    line = triple_line(F.col("s"), F.col("p"), F.col("o"))
    listed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "fact_id", F.array("s", "p", "o").alias("t"), line.alias("line")))).alias("c"))  # a top k for each query
    facts = F.to_json(F.struct(F.transform("c", lambda x: x["t"]).alias("fact")))
    asked = listed.join(queries, "query_id").withColumn("prompt", render(FACT_PROMPT, question=F.col("question"), facts=facts))
    reply = generate(asked, "query_id", "prompt", generator)
    told = F.from_json(F.try_element_at(sections(F.coalesce("response", F.lit(""))), F.lit("fact_after_filter")), "fact array<array<string>>")["fact"]
    named = asked.join(reply, "query_id").select("query_id", "c", F.posexplode(told).alias("place", "t"))
    named = named.withColumn("line", nearest(triple_line(F.get("t", F.lit(0)), F.get("t", F.lit(1)), F.get("t", F.lit(2))), F.transform("c", lambda x: x["line"])))
    hit = F.get(F.filter("c", lambda x: x["line"] == F.col("line")), F.lit(0))["fact_id"]
    w = Window.partitionBy("query_id").orderBy("place")
    return named.select("query_id", hit.alias("fact_id"), F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


def next_thought(queries: DataFrame, passages: DataFrame, thoughts: DataFrame, generator: Generator, merge: bool = False) -> DataFrame:
    """(query_id, thought): the provider's next thought on queries (query_id, question).

    passages (query_id, ordinal, text) come first, merged by first line where asked; thoughts (query_id, ordinal, text)
    so far stand after the question. A failed call gives the empty thought.
    """
    told = context_text(merged_passages(passages) if merge else passages, "query_id", ["ordinal"], "text", "\n\n").withColumn("passages", F.concat("context", F.lit("\n\n"))).drop("context")
    so_far = context_text(thoughts, "query_id", ["ordinal"], "text", " ").withColumnRenamed("context", "thoughts")
    asked = queries.join(told, "query_id", "left").join(so_far, "query_id", "left")
    asked = asked.withColumn("prompt", render(REASON_PROMPT, passages=F.col("passages"), question=F.col("question"), thoughts=F.col("thoughts")))
    return generate(asked, "query_id", "prompt", generator).select("query_id", F.coalesce("response", F.lit("")).alias("thought"))
