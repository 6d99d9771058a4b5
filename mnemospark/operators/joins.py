"""Joins whose hot keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, limit: int = 10_000, most: int = 50_000) -> DataFrame:
    """rows with the columns of their group; groups has one row a key, whose number of rows is in column size.

    A key of more than limit rows would send them all to one task, so such groups are broadcast to where the rows are:
    with limit raised to a share of all rows, there are at most ``most`` of them at any scale. All other rows meet
    their group in a shuffle.
    """
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    bound = max(limit, -(-(total or 0) // most))
    if (largest or 0) <= bound:
        return rows.join(groups.drop(size), keys)
    hot = F.col(size) > bound
    cold = rows.join(F.broadcast(groups.filter(hot).select(*keys)), keys, "left_anti").join(groups.filter(~hot).drop(size), keys)
    return cold.unionByName(rows.join(F.broadcast(groups.filter(hot).drop(size)), keys))
