"""Arithmetic on the path arrays of whole Arrow batches.

A lambda of ``transform`` is interpreted and boxes every element; the path columns hold 120 numbers a row, so that took
most of the time of all queries that touch them. Here numpy does the same operations in the same order on the elements
of a batch at once. Spark hands out the batches; NULLs keep their place, NaN is treated as Spark's functions treat it.
"""
from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

RADIAN, DEGREE = 0.017453292519943295, 57.29577951308232


def on_batches(kind: str):
    """``F.arrow_udf`` for functions that use this package where they run."""
    ship(SparkSession.active())
    return F.arrow_udf(kind)


def floats(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (what stands for a NULL is NaN) and which are not NULL."""
    there = np.ones(len(a), bool) if not a.null_count else a.is_valid().to_numpy(zero_copy_only=False)
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False), there


def counts(a: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def doubles(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values.ravel(), pa.float64(), mask=None if there.all() else ~there.ravel())


def lists(n: np.ndarray, inner: pa.Array, like: pa.Array | None = None) -> pa.ListArray:
    """``inner`` cut into lists of ``n`` elements; NULL where ``like`` is."""
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    gone = None if like is None or not like.null_count else np.append(like.is_null().to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=gone), inner)


def places(n: np.ndarray) -> np.ndarray:
    """Position of each element in its list."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def four(paths: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The first four elements of each path; what isn't there is NULL."""
    flat, n = paths.flatten(), counts(paths)
    v, there = floats(flat)
    if len(n) and (n == 4).all():
        return v.reshape(-1, 4), there.reshape(-1, 4)
    at = (np.cumsum(n) - n)[:, None] + np.arange(4)
    inside = np.arange(4) < n[:, None]
    at = np.where(inside, at, 0)
    if not len(v):
        return np.zeros(at.shape), np.zeros(at.shape, bool)
    return v[at], there[at] & inside


def rotated(ang: np.ndarray, there: np.ndarray, terms: Sequence[pa.Array], n: np.ndarray, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """The four angles of each path against the directions of its row (``n`` paths a row), as ``geo.rotate`` gives them."""
    out, ok = np.empty(ang.shape), np.empty(there.shape, bool)
    for i in (0, 2):
        known = [floats(t) for t in terms[2 * i:2 * i + 4]]
        cp, sp, ct, st = (np.repeat(v, n) for v, _ in known)
        p, t = ang[:, i] * RADIAN, ang[:, i + 1] * RADIAN
        s = np.sin(t)
        u, v, w = s * np.cos(p), s * np.sin(p), np.cos(t)
        if inverse:
            x, y, z = cp * ct * u + -sp * v + cp * st * w, sp * ct * u + cp * v + sp * st * w, -st * u + ct * w
        else:
            x, y, z = cp * ct * u + sp * ct * v + -st * w, -sp * u + cp * v, cp * st * u + sp * st * v + ct * w
        phi = np.arctan2(y, x) * DEGREE
        out[:, i] = np.where(phi == -180.0, 180.0, phi)
        # Spark's least() takes 1 for NaN
        out[:, i + 1] = np.arccos(np.where(np.isnan(z), 1.0, np.clip(z, -1.0, 1.0))) * DEGREE
        ok[:, i] = ok[:, i + 1] = there[:, i] & there[:, i + 1] & np.repeat(np.logical_and.reduce([k for _, k in known]), n)
    return out, ok


ANGLES = ("aoa_phi", "aoa_theta", "aod_phi", "aod_theta")


def rotated_paths(ang: Column, terms: Sequence[Column], inverse: bool) -> Column:
    """``array<struct<aoa_phi,aoa_theta,aod_phi,aod_theta>>`` in degrees."""
    @on_batches("array<struct<" + ",".join(f"{a}:double" for a in ANGLES) + ">>")
    def run(a: pa.Array, t0: pa.Array, t1: pa.Array, t2: pa.Array, t3: pa.Array, t4: pa.Array, t5: pa.Array, t6: pa.Array, t7: pa.Array) -> pa.Array:
        n = counts(a)
        v, ok = rotated(*four(a.flatten()), (t0, t1, t2, t3, t4, t5, t6, t7), n, inverse)
        return lists(n, pa.StructArray.from_arrays([doubles(v[:, i], ok[:, i]) for i in range(4)], ANGLES), a)
    return run(ang.cast("array<array<double>>"), *terms)


def angle_blocks(ang: Column, terms: Sequence[Column], n_max: int, unit: float) -> Column:
    """Relative angles / ``unit`` of the first ``n_max`` paths as four blocks of ``n_max``, NULL where a path or angle is missing."""
    @on_batches("array<double>")
    def run(a: pa.Array, t0: pa.Array, t1: pa.Array, t2: pa.Array, t3: pa.Array, t4: pa.Array, t5: pa.Array, t6: pa.Array, t7: pa.Array) -> pa.Array:
        n = counts(a)
        v, ok = rotated(*four(a.flatten()), (t0, t1, t2, t3, t4, t5, t6, t7), n, False)
        out, there, row, k = np.zeros((len(a), 4, n_max)), np.zeros((len(a), 4, n_max), bool), np.repeat(np.arange(len(a)), n), places(n)
        kept = k < n_max
        for i in range(4):
            out[row[kept], i, k[kept]], there[row[kept], i, k[kept]] = v[kept, i] / unit, ok[kept, i]
        return lists(np.full(len(a), 4 * n_max), doubles(out, there))
    return run(ang.cast("array<array<double>>"), *terms)


def blocks_inverse(x: Column, terms: Sequence[Column], n_max: int, unit: float) -> Column:
    """Inverse of ``angle_blocks``: ``array<array<double>>``, as many paths as the longest block has slots."""
    @on_batches("array<array<double>>")
    def run(a: pa.Array, t0: pa.Array, t1: pa.Array, t2: pa.Array, t3: pa.Array, t4: pa.Array, t5: pa.Array, t6: pa.Array, t7: pa.Array) -> pa.Array:
        size, (flat, known) = counts(a), floats(a.flatten())
        n = np.minimum(size, n_max)
        row, k = np.repeat(np.arange(len(a)), n), places(n)
        at = (np.cumsum(size) - size)[row][:, None] + k[:, None] + np.arange(4) * n_max
        inside = k[:, None] + np.arange(4) * n_max < size[row][:, None]
        at = np.where(inside, at, 0)
        v, there = (flat[at], known[at] & inside) if len(flat) else (np.zeros(at.shape), np.zeros(at.shape, bool))
        v, ok = rotated(v * unit, there, (t0, t1, t2, t3, t4, t5, t6, t7), n, True)
        return lists(n, lists(np.full(len(v), 4), doubles(v, ok)), a)
    return run(x.cast("array<double>"), *terms)


def affine_slots(arr: Column, shift: Sequence[float], scale: Sequence[float], inverse: bool = False) -> Column:
    """Per slot ``(x - shift) / scale`` or its inverse ``x * scale + shift``; NaN, and slots beyond the scaler's, become NULL."""
    sh, sc = np.array(list(shift) or [0.0], float), np.array(list(scale) or [1.0], float)
    slots = len(shift)

    @on_batches("array<double>")
    def run(a: pa.Array) -> pa.Array:
        n, (v, there) = counts(a), floats(a.flatten())
        k = places(n)
        i = np.minimum(k, len(sh) - 1)
        return lists(n, doubles(v * sc[i] + sh[i] if inverse else (v - sh[i]) / sc[i], there & ~np.isnan(v) & (k < slots)), a)
    return run(arr.cast("array<double>"))


def from_top(arr: Column, top: float) -> Column:
    """``top - x`` of each element; NaN becomes NULL."""
    @on_batches("array<double>")
    def run(a: pa.Array) -> pa.Array:
        v, there = floats(a.flatten())
        return lists(counts(a), doubles(top - v, there & ~np.isnan(v)), a)
    return run(arr.cast("array<double>"))


def above(arr: Column, base: Column, unit: float = 1.0) -> Column:
    """``max(0, x - base) / unit`` of each element; NULL where the element is NULL or NaN or the base is NULL."""
    @on_batches("array<double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        n, (v, there), (low, known) = counts(a), floats(a.flatten()), floats(b)
        d = v - np.repeat(low, n)
        return lists(n, doubles(np.where((d > 0) | np.isnan(d), d, 0.0) / unit, there & ~np.isnan(v) & np.repeat(known, n)), a)
    return run(arr.cast("array<double>"), base.cast("double"))


def above_inverse(arr: Column, base: Column, unit: float) -> Column:
    """``x * unit + base`` of each element."""
    @on_batches("array<double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        n, (v, there), (low, known) = counts(a), floats(a.flatten()), floats(b)
        return lists(n, doubles(v * unit + np.repeat(low, n), there & np.repeat(known, n)), a)
    return run(arr.cast("array<double>"), base.cast("double"))
