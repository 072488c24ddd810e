"""Joins in which a NULL key is a key like any other."""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``; the keys of ``b`` go (use inner or left joins)."""
    renamed = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return a.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])
