"""Question answering in rounds: each round is one job for all open questions.

The driver loops over rounds, never over questions: open questions are joined to the memories in bulk, with as-of
filters for each question, and what a question has seen before is left out before the limit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.providers import Embedder, Generator, embed_column, generate
from mnemospark.functions.text import decision
from mnemospark.session import written

#: Results a round by memory, and most rounds.
TOP_K = {"episodic": 3, "semantic": 10, "visual": 3}
MOST_ROUNDS = 5


@dataclass
class Memories:
    """Named tables: each has (item_id, content, ts, vector)."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    top_k: dict[str, int] = field(default_factory=lambda: dict(TOP_K))

    def register(self, name: str, df: DataFrame) -> "Memories":
        self.tables[name] = df.select("item_id", "content", "ts", "vector")
        return self

    def indexed_time(self, name: str) -> DataFrame:
        return self.tables[name].agg(F.max("ts").alias("ts"))

    def counts(self) -> dict[str, int]:
        return {name: df.count() for name, df in self.tables.items()}

    def update(self, name: str, more: DataFrame) -> "Memories":
        """The memory with more items; of an item that comes again the new row stays."""
        new = more.select("item_id", "content", "ts", "vector")
        old = self.tables[name].join(new.select("item_id"), "item_id", "left_anti") if name in self.tables else None
        return self.register(name, new if old is None else old.unionByName(new))

    def reset_index(self) -> "Memories":
        """Nothing is indexed; what k is for each memory stays."""
        self.release()
        self.tables.clear()
        return self

    def reset(self) -> "Memories":
        self.top_k = dict(TOP_K)
        return self.reset_index()

    def release(self) -> "Memories":
        """Gives back what the tables hold in the cluster's memory."""
        for df in self.tables.values():
            df.unpersist()
        return self


def best_visible(k: int, rows: int = 256):
    """For a table (side, id, ts, vector, seen) with questions on side 0 and items on side 1: each question's k best items.

    A question sees items up to its own time that it has not seen before.
    """

    def best(table: pa.Table) -> pa.Table:
        side, ids, ts = (np.asarray(table[c]) for c in ("side", "id", "ts"))
        x = np.stack(table["vector"].to_numpy(zero_copy_only=False)).astype(np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        asks, items = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        items = items[np.argsort(ids[items], kind="stable")]
        seen = table["seen"].to_pylist()
        out = [[], [], []]
        for at in range(0, len(asks) if len(items) else 0, rows):
            some = asks[at : at + rows]
            s = np.round(x[some] @ x[items].T, 6)
            s[ts[items][None] > ts[some, None]] = -np.inf
            for row, q in zip(s, some, strict=True):
                if seen[q]:
                    row[np.isin(ids[items], seen[q])] = -np.inf
                near = np.flatnonzero(row > -np.inf)
                near = near[np.argsort(-row[near], kind="stable")[:k]]
                out[0] += [ids[q]] * len(near)
                out[1] += ids[items[near]].tolist()
                out[2] += row[near].tolist()
        return pa.table({"question_id": pa.array(out[0], pa.int64()), "item_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return best


def retrieve(asks: DataFrame, memories: Memories, seen: DataFrame | None, item_block: int = 20_000, ask_block: int = 2_000) -> DataFrame:
    """(question_id, memory_type, item_id, content, score) for asks (question_id, as_of_ts, memory_type, vector).

    Items after a question's time and items it has seen are removed before the limit. Both sides are dealt to blocks; a
    block of questions meets a block of items in a matrix product, and k rows a question leave it; contents join what stays.
    """
    out = None
    for name, items in memories.tables.items():
        k = memories.top_k.get(name, 3)
        mine = asks.filter(F.col("memory_type") == name)
        before = F.array().cast("array<long>")
        if seen is not None:  # what a question has seen: k items a round at most
            had = seen.filter(F.col("memory_type") == name).groupBy("question_id").agg(F.collect_list(F.col("item_id").cast("long")).alias("had"))
            mine, before = mine.join(had, "question_id", "left"), F.coalesce("had", before)
        n_i, n_q = max(1, -(-items.count() // item_block)), max(1, -(-mine.count() // ask_block))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        one = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        left = mine.select(one("question_id", n_q).alias("qb"), every(n_i).alias("ib"), F.lit(0).alias("side"), F.col("question_id").alias("id"), F.col("as_of_ts").cast("long").alias("ts"), "vector", before.alias("seen"))
        right = items.select(every(n_q).alias("qb"), one("item_id", n_i).alias("ib"), F.lit(1).alias("side"), F.col("item_id").alias("id"), F.col("ts").cast("long").alias("ts"), "vector", F.lit(None).cast("array<long>").alias("seen"))
        local = left.unionByName(right).groupBy("qb", "ib").applyInArrow(best_visible(k), "question_id long, item_id long, score double")
        order = Window.partitionBy("question_id").orderBy(F.desc("score"), "item_id")
        best = local.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
        got = best.join(items.select("item_id", "content"), "item_id").select("question_id", F.lit(name).alias("memory_type"), "item_id", "content", "score")
        out = got if out is None else out.unionByName(got)
    return out


def answer(questions: DataFrame, memories: Memories, embedder: Embedder, generator: Generator, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(question_id, num_rounds, retrieved, context) of questions (question_id, question, as_of_ts).

    retrieved: array<struct<round, memory_type, item_id>>; context: the contents in the order found, by blank lines.
    """
    state = written(questions.withColumn("history", F.lit("")).withColumn("open", F.lit(True)).withColumn("num_rounds", F.lit(0)), "agent")
    seen = None
    for number in range(1, rounds + 1):
        prompt = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n"), F.col("history"))
        replies = generate(state.filter("open").withColumn("prompt", prompt), "question_id", "prompt", generator)
        plan = written(replies.select("question_id", decision(F.coalesce("response", F.lit("{}"))).alias("d")).select("question_id", "d.*"), "agent-plan")
        search = plan.filter((F.col("decision") == "search") & F.col("memory_type").isin(*memories.tables))
        if search.isEmpty():
            break
        vectors = embed_column(search, "question_id", "search_query", embedder)
        asks = search.join(vectors, "question_id").join(questions.select("question_id", "as_of_ts"), "question_id")
        found = written(retrieve(asks, memories, seen).withColumn("round", F.lit(number)), "agent-found")
        seen = found if seen is None else seen.unionByName(found)
        told = search.select("question_id", F.format_string(f"Round {number}: %s: %s\n", "memory_type", F.coalesce("search_query", F.lit(""))).alias("line"))
        state = written(
            state.join(told, "question_id", "left").select("question_id", "question", "as_of_ts", F.concat("history", F.coalesce("line", F.lit(""))).alias("history"), F.col("line").isNotNull().alias("open"), F.when(F.col("line").isNotNull(), F.lit(number)).otherwise(F.col("num_rounds")).alias("num_rounds")),
            "agent",
        )
    if seen is None:
        return state.select("question_id", "num_rounds", F.array().cast("array<struct<round:int,memory_type:string,item_id:string>>").alias("retrieved"), F.lit("").alias("context"))
    packed = seen.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("round", (-F.col("score")).alias("less"), "memory_type", "item_id", "content"))).alias("items"))
    done = state.join(packed, "question_id", "left")
    return done.select("question_id", "num_rounds", F.transform("items", lambda x: F.struct(x["round"].alias("round"), x["memory_type"].alias("memory_type"), x["item_id"].cast("string").alias("item_id"))).alias("retrieved"), F.array_join(F.transform("items", lambda x: x["content"]), "\n\n").alias("context"))
