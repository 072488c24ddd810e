"""Seeded, partition-independent random numbers as column expressions.

``rand()`` changes with partitioning and cannot be reproduced by another
engine; a hash of (seed, tag, key) can. The first 52 bits of md5 give a
uniform on [0, 1).
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = 4503599627370496.0


def _s(v) -> Column:
    return v.cast("string") if isinstance(v, Column) else F.lit(str(v))


def hash_key(*parts) -> Column:
    """md5 hex of the parts joined by ':' (e.g. ``seed:obs_id``)."""
    return F.md5(F.concat_ws(":", *[_s(p) for p in parts]))


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of ``hash_key(parts)``."""
    h = hash_key(*parts)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(TWO52)


def hash_uniform_open(*parts) -> Column:
    """Uniform in (0, 1): centre of the 2^-52 cell, safe for ``log``."""
    h = hash_key(*parts)
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO52)


def hash_normal(*parts) -> Column:
    """Standard normal by Box-Muller from two seeded uniforms."""
    u1 = hash_uniform_open(*parts, "n1")
    u2 = hash_uniform_open(*parts, "n2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def uniform_between(lo: float, hi: float, *parts) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * hash_uniform(*parts)
