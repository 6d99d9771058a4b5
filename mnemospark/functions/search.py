"""Places in sorted tables of bounds, as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def place(value: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted bounds, JSON values of a SQL type, are at most value: a binary search in a literal."""
    table = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))
