"""Data-quality gates: completeness, coverage, duplicates, unknown ids, agreement of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def artifact_gaps(units: DataFrame, artifacts: DataFrame, required: list[str]) -> DataFrame:
    """(unit_id, kind, problem) for required kinds that a unit lacks or has empty, sorted."""
    need = units.select("unit_id").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in required])))
    have = artifacts.groupBy("unit_id", "kind").agg(F.max("size").alias("size"))
    x = need.join(have, ["unit_id", "kind"], "left")
    problem = F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty")
    return x.withColumn("problem", problem).filter("problem is not null").select("unit_id", "kind", "problem").orderBy("unit_id", "kind")


def coverage(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """One row: expected, covered, missing, unexpected (distinct keys)."""
    e, p = expected.select(key).distinct(), present.select(key).distinct()
    both = e.withColumn("e", F.lit(1)).join(p.withColumn("p", F.lit(1)), key, "full")
    return both.agg(F.count("e").alias("expected"), F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("covered"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _raise_if(df: DataFrame, what: str) -> None:
    if found := df.head(5):
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    _raise_if(duplicates(df, key), f"{key} occurs more than once")
    return df


def require_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    _raise_if(df.join(known.select(key).distinct(), key, "left_anti").select(key), f"unknown {key}")
    return df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if lacking := [n for n in names if n not in df.columns]:
        raise ValueError(f"required parts are missing: {lacking}")
    return df


def require_same_size(*parts: DataFrame) -> None:
    if len(set(sizes := [p.count() for p in parts])) > 1:
        raise ValueError(f"sizes differ: {sizes}")


def require_task(df: DataFrame, kind: str, known: list[str]) -> DataFrame:
    """Task types that nothing handles are an error."""
    _raise_if(df.filter(~F.col(kind).isin(known) | F.col(kind).isNull()).select(kind).distinct(), f"unhandled {kind}")
    return df


def require_frames(df: DataFrame, key: str, index: str, total: str) -> DataFrame:
    """Frames must be there, and indices lie among them."""
    bad = F.col(total).isNull() | (F.col(total) <= 0) | F.col(index).isNull() | (F.col(index) < 0) | (F.col(index) >= F.col(total))
    _raise_if(df.filter(bad).select(key, index, total), "no such frame")
    return df


def metric_gaps(found: DataFrame, expected: list[str]) -> DataFrame:
    """(metric, value, problem): expected metrics that found (metric, value) lacks, and found ones that nobody expects."""
    want = found.sparkSession.createDataFrame([(m, True) for m in expected], "metric string, wanted boolean")
    x = found.withColumn("there", F.lit(True)).join(F.broadcast(want), "metric", "full")
    return x.select("metric", "value", F.when(F.col("there").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").otherwise("").alias("problem"))
