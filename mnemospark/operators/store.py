"""Content-addressed store: keys, upsert, delete with reference counting, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import chunk_id


def keyed(df: DataFrame, text: str = "text", prefix: str = "chunk-") -> DataFrame:
    """(hash_id, content): one row for each distinct text."""
    return df.select(chunk_id(F.col(text), prefix).alias("hash_id"), F.col(text).alias("content")).dropDuplicates(["hash_id"])


def missing(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of incoming whose hash_id the store lacks: what has to be embedded."""
    return incoming.join(store.select("hash_id"), "hash_id", "left_anti")


def upsert(store: DataFrame, incoming: DataFrame, embed) -> DataFrame:
    """The store with the missing rows embedded; known rows are not computed again."""
    return store.unionByName(embed(missing(incoming, store)))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("hash_id"), "hash_id", "left_anti")


def rows_in_order(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Store rows for ids (ordinal, hash_id), in the order asked for."""
    return ids.join(store, "hash_id", "left").orderBy("ordinal")


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def delete_documents(facts: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Reference counting over facts (chunk, s, p, o): what remains and what only the gone chunks held.

    facts: rows that stay; lost_facts: triples no remaining chunk has; lost_entities: likewise for phrases.
    """
    stay = facts.join(gone.select("chunk"), "chunk", "left_anti")
    went = facts.join(gone.select("chunk"), "chunk", "left_semi")
    phrases = lambda x: x.select(F.explode(F.array("s", "o")).alias("entity")).distinct()
    return {
        "facts": stay,
        "lost_facts": went.select("s", "p", "o").distinct().join(stay.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti"),
        "lost_entities": phrases(went).join(phrases(stay), "entity", "left_anti"),
    }
