"""Interval joins without nested loops: both sides meet in time buckets, then the exact predicate decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, start: Column, end: Column, width: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, inclusive: bool, on: list[str] | None = None) -> DataFrame:
    """Pairs whose spans overlap: start <= end' and end >= start' (inclusive), or both strict (half-open).

    A pair meets in each bucket that both spans touch; it is kept in the first of them only, so no distinct is
    needed. on: columns that must be equal as well. width should be about the length of a typical span.
    """
    (a, b), (c, d), on = left_span, right_span, on or []
    l = _bucketed(left, F.col(a), F.col(b), width, "_bucket")
    r = _bucketed(right, F.col(c), F.col(d), width, "_bucket")
    first = F.col("_bucket") == F.floor(F.greatest(F.col(a), F.col(c)) / width)
    meet = (F.col(a) <= F.col(d)) & (F.col(b) >= F.col(c)) if inclusive else (F.col(a) < F.col(d)) & (F.col(b) > F.col(c))
    return l.join(r, [*on, "_bucket"]).filter(first & meet).drop("_bucket")


def containing_interval(points: DataFrame, intervals: DataFrame, at: str, span: tuple[str, str], width: int, ordinal: str, key: list[str], on: list[str] | None = None) -> DataFrame:
    """Each point with the first interval (by ordinal) that holds it, ends included; nulls where none does."""
    on = on or []
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    i = _bucketed(intervals, F.col(span[0]), F.col(span[1]), width, "_bucket")
    hits = p.join(i, [*on, "_bucket"]).filter(F.col(at).between(F.col(span[0]), F.col(span[1])))
    best = hits.groupBy(*key).agg(F.min_by(F.struct(*[c for c in intervals.columns if c not in on]), F.col(ordinal)).alias("_hit"))
    return points.join(best, key, "left").select(*points.columns, *[F.col(f"_hit.{c}").alias(c) for c in intervals.columns if c not in on])


def asof_backward(queries: DataFrame, snapshots: DataFrame, at: str, ts: str, by: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """Each query row with the latest snapshot time that is not after it.

    No range join: the time range of the snapshots is cut into buckets, the last snapshot of each bucket is carried on to
    the buckets after it (a few rows a key), and rows meet the snapshots of their own bucket in one window, so a
    key's rows are spread over many tasks.
    """
    by = by or []
    kind = queries.schema[at].dataType
    seconds = lambda c: F.col(c).cast("timestamp").cast("double") if kind.typeName() in ("timestamp", "date", "timestamp_ntz") else F.col(c).cast("double")
    low, high = snapshots.agg(F.min(seconds(ts)), F.max(seconds(ts))).first()
    low, width = low or 0.0, max(1e-9, ((high or 0.0) - (low or 0.0)) / buckets)
    bucket = lambda c: F.greatest(F.lit(-1), F.least(F.lit(buckets), F.floor((seconds(c) - F.lit(low)) / F.lit(width)))).cast("int")
    times = snapshots.select(*by, F.col(ts).alias("_t")).distinct().withColumn("_b", bucket("_t"))
    asks = queries.select(*by, F.col(at).alias("_t"), F.struct("*").alias("_row")).withColumn("_b", bucket("_t"))
    # The last snapshot of each bucket, and for each bucket with rows the last one of the buckets before it.
    lasts = times.groupBy(*by, "_b").agg(F.max("_t").alias("_last"))
    seats = asks.select(*by, "_b").distinct().unionByName(lasts.select(*by, "_b")).distinct()
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = seats.join(lasts, [*by, "_b"], "left").withColumn("_carry", F.last("_last", ignorenulls=True).over(w)).select(*by, "_b", "_carry")
    marks = times.select(*by, "_b", "_t", F.lit(0).alias("_q"), F.lit(None).cast(asks.schema["_row"].dataType).alias("_row"))
    near = Window.partitionBy(*by, "_b").orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.unionByName(asks.withColumn("_q", F.lit(1))).withColumn("_own", F.last(F.when(F.col("_q") == 0, F.col("_t")), ignorenulls=True).over(near))
    found = seen.filter("_q = 1")
    same = found["_b"].eqNullSafe(carried["_b"])
    for c in by:
        same = same & found[c].eqNullSafe(carried[c])
    return found.join(carried, same, "left").select(found["_row"].alias("_row"), F.coalesce("_own", "_carry").alias("snapshot")).select("_row.*", "snapshot")


def fixed_segments(df: DataFrame, duration: str, unit: int) -> DataFrame:
    """Rows with seg_start, seg_end: ceil(duration / unit) segments, the last one cut, one at least."""
    n = F.greatest(F.ceil(F.col(duration) / unit), F.lit(1))
    k = df.withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return k.withColumn("seg_start", F.col("seg") * unit).withColumn("seg_end", F.least((F.col("seg") + 1) * unit, F.col(duration)))


def slots(df: DataFrame, length: int = 30, span: int = 3600) -> DataFrame:
    """Rows with slot_start, slot_end in seconds: the fixed slots of an hour."""
    return df.withColumn("slot_start", F.explode(F.sequence(F.lit(0), F.lit(span - 1), F.lit(length)))).withColumn("slot_end", F.col("slot_start") + length)
