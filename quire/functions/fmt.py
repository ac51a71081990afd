"""Output formatting shared by queries (stable across engines)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round a double for comparison across plans (float sums vary by order)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def num_list(arr: Column, digits: int = 6) -> Column:
    """Double array -> 'a,b,c' with fixed decimals (engine-independent text)."""
    return F.array_join(
        F.transform(arr, lambda x: F.round(x, digits).cast(f"decimal(30,{digits})").cast("string")), ",")


def str_list(arr: Column, sep: str = "|") -> Column:
    return F.array_join(arr, sep)


# DuckDB counterparts used inside oracle text.
SQL_NUM_LIST = ("array_to_string(list_transform({}, lambda x: "
                "cast(cast(round(x, 6) as decimal(30,6)) as varchar)), ',')")
