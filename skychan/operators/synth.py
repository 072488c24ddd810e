"""Synthetic observations and random vectors.

Rows are keyed by an existing key column (e.g. the order keys of a table), so
the generated volume follows the input and every value is a seeded hash of
(seed, field, key[, slot]): the same under any partitioning, and reproducible
in SQL.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.uniform import hash_normal, hash_uniform, uniform_between

# Ranges of the synthetic observation generator (fixed values).
DVEC_RANGE = (-1000.0, 1000.0)
LOS_PL_RANGE = (80.0, 200.0)
LOS_DLY_RANGE = (0.0, 5e-6)
NLOS_PL_RANGE = (140.0, 180.0)
NLOS_ANG_RANGES = ((-90.0, -50.0), (90.0, 100.0), (-180.0, 100.0), (80.0, 90.0))
NLOS_DLY_RANGE = (2.4e-6, 3.2e-6)
N_CODES = 3                      # rx_type and link_state drawn from {0, 1, 2}


def synth_observations(keys: DataFrame, key: str = "obs_id", seed: int = 42, n_paths: int = 20) -> DataFrame:
    """One synthetic observation per key, in the canonical column set.
    ``rx_type`` includes the unknown code 2, as in the reference generator."""
    k = F.col(key)
    slots = F.sequence(F.lit(0), F.lit(n_paths - 1))

    def per_path(fn):
        return F.transform(slots, fn)

    return keys.select(
        k.cast("bigint").alias("obs_id"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: uniform_between(*DVEC_RANGE, seed, "dvec", k, i)).alias("dvec"),
        F.floor(hash_uniform(seed, "rx", k) * N_CODES).cast("int").alias("rx_type"),
        F.floor(hash_uniform(seed, "ls", k) * N_CODES).cast("int").alias("link_state"),
        uniform_between(*LOS_PL_RANGE, seed, "lpl", k).alias("los_pl"),
        F.array(*[F.lit(0.0)] * 4).alias("los_ang"),
        uniform_between(*LOS_DLY_RANGE, seed, "ldly", k).alias("los_dly"),
        per_path(lambda j: uniform_between(*NLOS_PL_RANGE, seed, "pl", k, j)).alias("nlos_pl"),
        per_path(lambda j: F.array(*[uniform_between(lo, hi, seed, f"a{a}", k, j)
                                     for a, (lo, hi) in enumerate(NLOS_ANG_RANGES)])).alias("nlos_ang"),
        per_path(lambda j: uniform_between(*NLOS_DLY_RANGE, seed, "dly", k, j)).alias("nlos_dly"),
    )


def cartesian_columns(k, seed: int = 42, dim: int = 3):
    """N(0, 1) Cartesian components; z = 0 when ``dim == 2``."""
    z = hash_normal(seed, "cz", k) if dim == 3 else F.lit(0.0)
    return hash_normal(seed, "cx", k), hash_normal(seed, "cy", k), z


def spherical_columns(k, seed: int = 42):
    """r in [0.1, 100], phi in [-180, 180], theta in [0, 180] degrees."""
    return (uniform_between(0.1, 100.0, seed, "r", k), uniform_between(-180.0, 180.0, seed, "phi", k),
            uniform_between(0.0, 180.0, seed, "theta", k))


def random_cartesian(keys: DataFrame, key: str = "obs_id", seed: int = 42, dim: int = 3) -> DataFrame:
    k = F.col(key)
    x, y, z = cartesian_columns(k, seed, dim)
    return keys.select(k.cast("bigint").alias("obs_id"), x.alias("x"), y.alias("y"), z.alias("z"))


def random_spherical(keys: DataFrame, key: str = "obs_id", seed: int = 42) -> DataFrame:
    k = F.col(key)
    r, p, t = spherical_columns(k, seed)
    return keys.select(k.cast("bigint").alias("obs_id"), r.alias("r"), p.alias("phi"), t.alias("theta"))
