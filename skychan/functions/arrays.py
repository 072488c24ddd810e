"""Array-column helpers (fixed-length vectors stay one row per observation)."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(arr: Column, i) -> Column:
    """0-based element access that yields NULL out of range (ANSI-safe)."""
    idx = F.lit(i + 1) if isinstance(i, int) else i + 1
    return F.try_element_at(arr, idx)


def lit_array(values: Sequence[float]) -> Column:
    """A constant double array (constant-folded by Catalyst)."""
    return F.array(*[F.lit(float(v)) for v in values])


def clip_array(arr: Column, lo: float, hi: float) -> Column:
    return F.transform(arr, lambda x: F.when(x.isNull(), F.lit(None))
                       .otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x))))


def array_sum(arr: Column) -> Column:
    """Sum of the elements in index order (NULL elements propagate)."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def head_sort(arr: Column, k: int, descending: bool = True) -> Column:
    """Sort the first ``k`` elements, keep the tail in place."""
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError("k must be a whole number above 0")
    head = F.sort_array(F.slice(arr, 1, k), asc=not descending)
    tail = F.slice(arr, k + 1, F.greatest(F.size(arr), F.lit(1)))
    return F.concat(head, tail)


def affine(arr: Column, shift: Sequence[float], scale: Sequence[float], inverse: bool = False) -> Column:
    """Per-slot ``(x - shift) / scale`` or its inverse ``x * scale + shift``."""
    sh, sc = lit_array(shift), lit_array(scale)
    if inverse:
        return F.transform(arr, lambda x, i: x * at(sc, i) + at(sh, i))
    return F.transform(arr, lambda x, i: (x - at(sh, i)) / at(sc, i))


def one_hot(c: Column, categories: Sequence) -> Column:
    """Fixed-category one-hot as a double array; unknown -> all zeros (F1)."""
    return F.array(*[F.when(c == F.lit(k), F.lit(1.0)).otherwise(F.lit(0.0)) for k in categories])
