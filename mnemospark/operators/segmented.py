"""Places and running sums inside groups, however few groups hold the rows: segmented prefix counts.

A window over a group would sort all its rows in one task. Here rows are cut into ranges of the whole order (group, then
order), so a large group is many ranges and a range may hold many groups. Each range numbers its own rows; the counts
of a group's earlier ranges come back to it by a broadcast. Only groups that span ranges need that, and a range
holds at most two such pieces (what it begins with and what it ends with), so at most twice as many rows are broadcast as there are ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import written

RANGE = 100_000  # rows of a range
MOST = 10_000  # ranges at most; their rows grow beyond


def prefix(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, size: str | None = None, position: str = "position", rows: int = RANGE, most: int = MOST) -> DataFrame:
    """Adds position, the 0-based place in the group by order, and for each of sums a running sum up to and with the row.

    size names a column for the number of the group's rows. Rows alike in all of order are placed in any order, and a null
    is a group like any other; by may be empty (one group). df is read more than once: give a written table where it is dear.
    """
    sums = sums or {}
    x = df.withColumns({f"_v_{n}": c for n, c in sums.items()} | {"_tie": F.monotonically_increasing_id()})
    ranges = max(1, min(most, -(-df.count() // rows)))
    if ranges > 1:  # written, so that every later pass sees the same ranges
        x = written(x.repartitionByRange(ranges, *by, *order, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")
    else:
        x = x.withColumn("_range", F.lit(0))
    inside = Window.partitionBy("_range", *by)
    upto = inside.orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {position: (F.row_number().over(inside.orderBy(*order, "_tie")) - 1).cast("long")}
    local |= {n: F.sum(f"_v_{n}").over(upto) for n in sums}
    if size:
        local[size] = F.count(F.lit(1)).over(inside)
    if ranges == 1:
        return x.withColumns(local).drop("_tie", "_range", *[f"_v_{n}" for n in sums])

    across = Window.partitionBy(*by)
    before = across.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    pieces = counts.select(
        F.col("_range").alias("_at"),
        *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)],
        F.count(F.lit(1)).over(across).alias("_parts"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(across).alias("_total"),
        *[F.sum(f"_s_{n}").over(before).alias(f"_b_{n}") for n in sums],
    ).filter("_parts > 1")
    met = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)], F.col("_range") == F.col("_at"))
    out = x.withColumns(local).join(F.broadcast(pieces), met, "left")  # at most two rows a range
    whole = {position: F.col(position) + F.coalesce("_before", F.lit(0))}
    for n in sums:  # a sum is null only where all its values are
        whole[n] = F.when(F.col(f"_b_{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_b_{n}")).otherwise(F.col(n) + F.col(f"_b_{n}"))
    if size:
        whole[size] = F.coalesce("_total", size)
    return out.withColumns(whole).select(*df.columns, *local)
