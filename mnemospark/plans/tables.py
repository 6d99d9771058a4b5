"""Driver tables as stand-ins for the engine's concepts, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with day d, second of the day sec and hundredths ff."""
    e = table(spark, sf_dir, "events")
    sec = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return e.select("event_id", "user_id", "event_type", "value", "props", "ts", F.dayofmonth("ts").cast("long").alias("d"), sec.cast("long").alias("sec"), F.date_format("ts", "SS").cast("long").alias("ff"))


EVENTS_SQL = """ev AS (
  SELECT event_id, user_id, event_type, value, props, ts, day(ts)::BIGINT AS d,
         (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS sec,
         ((epoch_us(ts) % 1000000) // 10000)::BIGINT AS ff
  FROM events)"""


def star_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (chunk, s, p, o) of the star schema; chunk groups customers and suppliers by hundreds."""
    t = lambda n: table(spark, sf_dir, n)
    nation, region = t("nation"), t("region")
    of_nation = nation.select("n_nationkey", "n_name", "n_regionkey")
    customer = t("customer").join(of_nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("chunk-c"), F.floor(F.col("c_custkey") / 100).cast("string")).alias("chunk"), F.lower("c_name").alias("s"), F.lit("lives in").alias("p"), F.lower("n_name").alias("o"))
    supplier = t("supplier").join(of_nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("chunk-s"), F.floor(F.col("s_suppkey") / 100).cast("string")).alias("chunk"), F.lower("s_name").alias("s"), F.lit("located in").alias("p"), F.lower("n_name").alias("o"))
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("chunk-n"), F.col("n_regionkey").cast("string")).alias("chunk"), F.lower("n_name").alias("s"), F.lit("part of").alias("p"), F.lower("r_name").alias("o"))
    return customer.unionByName(supplier).unionByName(place)


FACTS_SQL = """facts AS (
  SELECT 'chunk-c' || (c_custkey // 100)::VARCHAR AS chunk, lower(c_name) AS s, 'lives in' AS p, lower(n_name) AS o
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'chunk-s' || (s_suppkey // 100)::VARCHAR, lower(s_name), 'located in', lower(n_name)
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'chunk-n' || n_regionkey::VARCHAR, lower(n_name), 'part of', lower(r_name)
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
