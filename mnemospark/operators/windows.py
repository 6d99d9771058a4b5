"""Window-shaped operators: anchored tumbling windows, groups of N rows, index sampling, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.search import place
from mnemospark.operators.segmented import prefix


def anchored_windows(df: DataFrame, start: str, width: int, by: list[str]) -> DataFrame:
    """Adds w_start, w_end: tumbling windows whose first one begins at the first row of each group.

    Later windows are aligned to multiples of width. The anchor is one aggregate a group and joins back, so rows of a
    group need not meet in one task.
    """
    first = df.groupBy(*by).agg(F.min(start).alias("_s0"))
    x = df.join(first, by)
    aligned = F.floor(F.col(start) / width) * width
    w = F.when(F.col(start) < F.col("_s0") + width, F.col("_s0")).otherwise(aligned)
    return x.withColumn("w_start", w.cast("long")).withColumn("w_end", (F.col("w_start") + width).cast("long")).drop("_s0")


def rollup_windows(df: DataFrame, start: str, end: str, text: str, width: int, by: list[str], ordinal: str) -> DataFrame:
    """One row a window: count, the last end, and the texts joined in order by newlines."""
    w = anchored_windows(df, start, width, by)
    return w.groupBy(*by, "w_start", "w_end").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(end).alias("last_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, ordinal, text))), lambda e: e[text]), "\n").alias("text"),
    )


def every_n(df: DataFrame, ordinal: str, n: int, by: list[str]) -> DataFrame:
    """Adds group_no: rows 0..n-1 by ordinal are group 0, and so on."""
    return prefix(df, by, [ordinal], position="_pos").withColumn("group_no", F.floor(F.col("_pos") / n).cast("long")).drop("_pos")


def running_mean(df: DataFrame, value: str, ordinal: list[str], by: list[str]) -> DataFrame:
    """Adds mean_so_far: the mean of value over the rows of a group up to this one."""
    sums = {"_sum": F.col(value), "_given": F.col(value).isNotNull().cast("long")}
    return prefix(df, by, ordinal, sums, position="_pos").withColumn("mean_so_far", F.try_divide("_sum", "_given")).drop("_pos", "_sum", "_given")


def linspace_positions(n: Column, m: int) -> Column:
    """The m whole positions of linspace(0, n - 1, m), as an array."""
    if m == 1:
        return F.array(F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor(i * (n - 1) / (m - 1)).cast("long"))


def linspace_sample(df: DataFrame, ordinal: list[str], m: int, by: list[str]) -> DataFrame:
    """At most m rows of each group, evenly spread by position."""
    x = prefix(df, by, ordinal, size="_n", position="_pos")
    return x.filter((F.col("_n") <= m) | F.array_contains(linspace_positions(F.col("_n"), m), F.col("_pos"))).drop("_pos", "_n")


def proportional_sample(df: DataFrame, ordinal: list[str], ratio: float, by: list[str]) -> DataFrame:
    """max(1, int(n * ratio)) rows of each group, evenly spread by position.

    Place p is taken when some i has floor(i * (n - 1) / (m - 1)) = p; the only one that can is the least i that does not fall below p.
    """
    x = prefix(df, by, ordinal, size="_n", position="_pos")
    x = x.withColumn("_m", F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)).cast("long"))
    x = x.withColumn("_i", F.expr("CASE WHEN _m > 1 THEN (CAST(_pos AS DECIMAL(19, 0)) * (_m - 1) + (_n - 2)) DIV (_n - 1) ELSE 0 END"))
    at = F.expr("CASE WHEN _m > 1 THEN (CAST(_i AS DECIMAL(19, 0)) * (_n - 1)) DIV (_m - 1) ELSE 0 END")
    return x.filter((F.col("_i") < F.col("_m")) & (at == F.col("_pos"))).drop("_pos", "_n", "_m", "_i")


def contiguous_splits(df: DataFrame, ordinal: str, k: int) -> DataFrame:
    """Adds split: rows in order, ceil(n / k) to a split. Positions come from counts of ordinal ranges, not one window."""
    n = df.count()
    size = max(1, -(-n // k))
    return positions(df, ordinal).withColumn("split", F.floor(F.col("position") / size).cast("int")).drop("position")


def positions(df: DataFrame, ordinal: str, rows: int = 100_000, most: int = 10_000) -> DataFrame:
    """Adds position: the 0-based place of each row by ordinal (distinct, not null), by ranges of about rows rows.

    The ranges' bounds are approximate quantiles, so they hold about as many rows each however the ordinals lie. Each range
    numbers its own rows; the ranges' counts, one row each and at most most of them, give what comes before.
    """
    n = df.count()
    ranges = max(1, min(most, -(-n // rows)))
    bounds = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        bounds = sorted(set(df.agg(F.percentile_approx(ordinal, shares, 10 * ranges)).first()[0]))
    x = df.withColumn("_b", place(F.col(ordinal).cast("long"), bounds, "bigint"))
    before = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = before.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"))
    w = Window.partitionBy("_b").orderBy(ordinal)
    return x.join(F.broadcast(before), "_b").withColumn("position", (F.col("_before") + F.row_number().over(w) - 1).cast("long")).drop("_b", "_before")
