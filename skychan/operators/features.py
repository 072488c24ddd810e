"""Feature engineering (F1-F19) as DataFrame -> DataFrame operators.

``fit_*`` functions run one aggregate job whose result is a single row (a few
numbers per slot), collected to the driver and applied as literals by the
matching transform: no join, no shuffle in the transform. Fits see the
training part only; the transforms are narrow projections.
"""
from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, paths
from ..functions.arrays import affine, at, array_sum, clip_array, head_sort, one_hot
from ..schema import (ANGLE_SCALE, DEFAULT_MAX_PATH_LOSS, DEFAULT_N_MAX_PATHS, LOS, RX_TYPES)


def _num(c: Column) -> Column:
    """NaN -> NULL, so aggregates skip it and transforms keep it."""
    c = c.cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def padded(arr: Column, n: int) -> Column:
    """Exactly ``n`` slots: short or NULL arrays get NULLs, so blocks that follow keep their place."""
    none = F.lit(None).cast("double")
    return F.slice(F.concat(F.coalesce(arr, F.array().cast("array<double>")), F.array_repeat(none, n)), 1, n)


def _elems(df: DataFrame, col: str, dim: int | None) -> int:
    if dim is None:
        dim = df.select(F.max(F.size(col))).first()[0] or 0
    return int(dim)


# ---------------------------------------------------------------- scalers
@dataclass
class StandardState:
    """Fitted state of the standard scaler (population variance)."""
    mean: list
    var: list
    scale: list
    n_samples_seen: int

    def to_dict(self) -> dict:
        return {"type": "standard_scaler", "params": asdict(self)}


@dataclass
class MinMaxState:
    """Fitted state of the min-max scaler (range [0, 1])."""
    data_min: list
    data_max: list
    data_range: list
    n_samples_seen: int

    def to_dict(self) -> dict:
        return {"type": "min_max_scaler", "params": asdict(self)}


@dataclass
class OneHotState:
    """Learned categories of a one-hot encoder (sorted)."""
    categories: list
    drop_last: bool = False

    def to_dict(self) -> dict:
        return {"type": "one_hot_encoder", "params": asdict(self)}


def fit_standard(df: DataFrame, col: str, dim: int | None = None) -> StandardState:
    """Per-slot mean / population variance of an array column."""
    dim = _elems(df, col, dim)
    aggs = []
    for i in range(dim):
        v = _num(at(F.col(col), i))
        aggs += [F.avg(v), F.var_pop(v), F.count(v)]
    row = df.agg(*aggs).first() if dim else []
    mean = [row[3 * i] for i in range(dim)]
    var = [row[3 * i + 1] for i in range(dim)]
    n = [row[3 * i + 2] for i in range(dim)]
    scale = [math.sqrt(v) if v is not None and v > 0 else 1.0 for v in var]
    return StandardState([m if m is not None else 0.0 for m in mean],
                         [v if v is not None else 0.0 for v in var], scale, int(max(n) if n else 0))


def standard_transform(arr: Column, state: StandardState, inverse: bool = False) -> Column:
    """``(x - mean) / scale`` per slot."""
    return affine(F.transform(arr, _num), state.mean, state.scale, inverse)


def fit_min_max(df: DataFrame, col: str, dim: int | None = None) -> MinMaxState:
    """Per-slot min / max of an array column, one aggregate row."""
    dim = _elems(df, col, dim)
    aggs = []
    for i in range(dim):
        v = _num(at(F.col(col), i))
        aggs += [F.min(v), F.max(v)]
    row = df.agg(*aggs, F.count(F.lit(1))).first()
    lo = [row[2 * i] if row[2 * i] is not None else 0.0 for i in range(dim)]
    hi = [row[2 * i + 1] if row[2 * i + 1] is not None else 0.0 for i in range(dim)]
    rng = [(h - l) if h - l != 0 else 1.0 for l, h in zip(lo, hi)]
    return MinMaxState(lo, hi, rng, int(row[-1]))


def min_max_transform(arr: Column, state: MinMaxState, inverse: bool = False) -> Column:
    """``(x - min) / range`` per slot, or ``x * range + min`` (F7). A constant
    slot has range 1, so it maps to 0."""
    return paths.affine_slots(arr, state.data_min, state.data_range, inverse)


def fit_one_hot(df: DataFrame, col: str, drop_last: bool = False) -> OneHotState:
    """Learned categories: distinct values, sorted (F2). Their number is the width of every feature vector, so
    it fits the driver whenever the vectors fit a row."""
    cats = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]
    return OneHotState(cats, drop_last and len(cats) > 1)


def one_hot_transform(c: Column, state: OneHotState) -> Column:
    cats = state.categories[:-1] if state.drop_last else state.categories
    return one_hot(c, cats)


# ---------------------------------------------------------------- link features
def rx_name(code: Column) -> Column:
    """Receiver code or spelling -> name (T6 shorthand; unknown -> NULL)."""
    from ..sources.decode import normalize_rx
    return normalize_rx(code, on_unknown="null")


def link_features(df: DataFrame, dvec: str = "dvec", rx: str = "rx_type",
                  categories: Sequence = RX_TYPES, horizontal: bool = False,
                  out: str = "features") -> DataFrame:
    """``[onehot * dr, onehot * dh]`` (F3): all distance slots, then all height
    slots. ``horizontal=True`` uses the horizontal norm of the draft (P3)."""
    x, y, z = geo.vec_elems(F.col(dvec))
    dr = geo.hnorm(x, y) if horizontal else geo.norm3(x, y, z)
    oh = one_hot(rx_name(F.col(rx)), categories)
    return df.withColumn(out, F.concat(F.transform(oh, lambda v: v * dr), F.transform(oh, lambda v: v * z)))


# ---------------------------------------------------------------- conditions
def condition_base(dvec: Column, los: Column) -> Column:
    """``[d3d, log10 d3d, dh, los]`` with ``d3d = max(|dvec|, 1)``."""
    x, y, z = geo.vec_elems(dvec)
    r = geo.norm3(x, y, z)
    d3d = F.when(r.isNotNull(), F.greatest(r, F.lit(1.0)))
    return F.array(d3d, F.log10(d3d), z.cast("double"), los.cast("double"))


def with_conditions(df: DataFrame, enc: OneHotState, dvec: str = "dvec", rx: str = "rx_type",
                    link_state: str = "link_state", out: str = "cond") -> DataFrame:
    """Raw condition vector: base ++ one-hot of the receiver code (drop-last, P6)."""
    los = (F.col(link_state) == LOS).cast("double")
    return df.withColumn(out, F.concat(condition_base(F.col(dvec), los), one_hot_transform(F.col(rx), enc)))


# ---------------------------------------------------------------- path loss
def path_loss_raw(pl: Column, max_path_loss: float = DEFAULT_MAX_PATH_LOSS,
                  n_max_paths: int = DEFAULT_N_MAX_PATHS) -> Column:
    """``max_path_loss - pl[:n]``."""
    return paths.from_top(F.slice(pl, 1, n_max_paths), max_path_loss)


def fit_path_loss(df: DataFrame, pl: str = "nlos_pl", max_path_loss: float = DEFAULT_MAX_PATH_LOSS,
                  n_max_paths: int = DEFAULT_N_MAX_PATHS) -> MinMaxState:
    tmp = df.select(path_loss_raw(F.col(pl), max_path_loss, n_max_paths).alias("_plr"))
    return fit_min_max(tmp, "_plr", n_max_paths)


def path_loss_transform(pl: Column, state: MinMaxState, max_path_loss: float = DEFAULT_MAX_PATH_LOSS,
                        n_max_paths: int = DEFAULT_N_MAX_PATHS) -> Column:
    return min_max_transform(path_loss_raw(pl, max_path_loss, n_max_paths), state)


def path_loss_inverse(x: Column, state: MinMaxState, max_path_loss: float = DEFAULT_MAX_PATH_LOSS,
                      sort: bool = True) -> Column:
    """Clip to [0, 1], unscale, sort descending, ``max - x``: losses ascending,
    strongest path first (F9). ``sort=False`` keeps slot order (P11)."""
    v = min_max_transform(clip_array(x, 0.0, 1.0), state, inverse=True)
    if sort:
        v = F.sort_array(v, asc=False)
    return F.transform(v, lambda e: F.lit(max_path_loss) - e)


# ---------------------------------------------------------------- angles
_TERMS = ("_aoa_cp", "_aoa_sp", "_aoa_ct", "_aoa_st", "_aod_cp", "_aod_sp", "_aod_ct", "_aod_st")


def with_los_terms(df: DataFrame, dvec: str = "dvec") -> DataFrame:
    """Project the LOS rotation terms once per row (reused by all paths, §4)."""
    aoa_p, aoa_t, aod_p, aod_t = geo.los_directions(F.col(dvec))
    terms = list(geo.rotation_terms(aoa_p, aoa_t)) + list(geo.rotation_terms(aod_p, aod_t))
    return df.select("*", *[t.alias(n) for t, n in zip(terms, _TERMS)])


def _los_terms():
    cols = [F.col(n) for n in _TERMS]
    return cols[:4], cols[4:]


def relative_angles(nlos_ang: Column, inverse: bool = False) -> Column:
    """Per path: AoA relative to the LOS arrival, AoD relative to the LOS
    departure (``inverse=False`` subtracts; ``True`` adds back). Needs
    ``with_los_terms``. Returns ``array<struct<aoa_phi,aoa_theta,aod_phi,aod_theta>>``
    in degrees, phi canonical in (-180, 180] (F10/F11, P9, P10, P21).

    Same operations in the same order as ``geo.rotate``."""
    aoa, aod = _los_terms()
    return paths.rotated_paths(nlos_ang, [*aoa, *aod], inverse)


def angles_transform(df: DataFrame, nlos_ang: str = "nlos_ang", dvec: str = "dvec",
                     n_max_paths: int = DEFAULT_N_MAX_PATHS, out: str = "ang_x") -> DataFrame:
    """Relative angles / 180 laid out as four blocks of n, NULL where a path or angle is missing."""
    aoa, aod = _los_terms()
    x = paths.angle_blocks(F.col(nlos_ang), [*aoa, *aod], n_max_paths, ANGLE_SCALE)
    return with_los_terms(df, dvec).withColumn(out, x).drop(*_TERMS)


def angles_inverse(df: DataFrame, x: str = "ang_x", dvec: str = "dvec",
                   n_max_paths: int = DEFAULT_N_MAX_PATHS, out: str = "nlos_ang_hat") -> DataFrame:
    """Inverse of ``angles_transform``: x180, add the LOS direction back, n x 4."""
    aoa, aod = _los_terms()
    ang = paths.blocks_inverse(F.col(x), [*aoa, *aod], n_max_paths, ANGLE_SCALE)
    return with_los_terms(df, dvec).withColumn(out, ang).drop(*_TERMS)


# ---------------------------------------------------------------- delays
def excess_delay(nlos_dly: Column, dvec: Column, unit: float = 1.0) -> Column:
    """``max(0, dly - |dvec| / c) / unit`` per path (F12 numerator)."""
    x, y, z = geo.vec_elems(dvec)
    los = geo.los_delay(geo.norm3(x, y, z))
    return paths.above(nlos_dly, los, unit)


def fit_delay_scale(df: DataFrame, nlos_dly: str = "nlos_dly", dvec: str = "dvec",
                    n_max_paths: int | None = None) -> float:
    """Mean over all entries, clipped zeros included; NULL or 0 -> 1.0."""
    dl = F.col(nlos_dly) if n_max_paths is None else F.slice(F.col(nlos_dly), 1, n_max_paths)
    rel = excess_delay(dl, F.col(dvec))
    row = df.select(array_sum(F.transform(rel, lambda v: F.coalesce(v, F.lit(0.0)))).alias("s"),
                    F.size(F.filter(rel, lambda v: v.isNotNull())).alias("n")) \
        .agg(F.sum("s"), F.sum("n")).first()
    if not row[1] or not row[0]:
        return 1.0
    return float(row[0] / row[1])


def delays_transform(nlos_dly: Column, dvec: Column, scale: float) -> Column:
    return excess_delay(nlos_dly, dvec, scale)


def delays_inverse(x: Column, dvec: Column, scale: float) -> Column:
    """``rel * scale + LOS delay``."""
    a, b, c = geo.vec_elems(dvec)
    los = geo.los_delay(geo.norm3(a, b, c))
    return paths.above_inverse(x, los, scale)


# ---------------------------------------------------------------- data vector
@dataclass
class PathPreproc:
    """Everything the path-model transforms learn at fit time (F18 unit)."""
    path_loss: MinMaxState
    delay_scale: float
    conditions: StandardState
    rx_encoder: OneHotState
    max_path_loss: float = DEFAULT_MAX_PATH_LOSS
    n_max_paths: int = DEFAULT_N_MAX_PATHS

    def to_dict(self) -> dict:
        return {"path_loss": self.path_loss.to_dict(), "delay_scale": self.delay_scale,
                "conditions": self.conditions.to_dict(), "rx_encoder": self.rx_encoder.to_dict(),
                "max_path_loss": self.max_path_loss, "n_max_paths": self.n_max_paths}

    @classmethod
    def from_dict(cls, d: dict) -> "PathPreproc":
        states = {k: state_from_dict(d[k]) for k in ("path_loss", "conditions", "rx_encoder")}
        return cls(**states, delay_scale=d["delay_scale"], max_path_loss=d["max_path_loss"], n_max_paths=d["n_max_paths"])

    def save(self, spark, path: str) -> None:
        """Write the whole unit as one JSON text."""
        spark.createDataFrame([(json.dumps(self.to_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> "PathPreproc":
        return cls.from_dict(json.loads(spark.read.text(path).first()[0]))


def fit_path_preproc(df: DataFrame, max_path_loss: float = DEFAULT_MAX_PATH_LOSS,
                     n_max_paths: int = DEFAULT_N_MAX_PATHS, rx: str = "rx_type") -> PathPreproc:
    """Fit the three path-model transforms on linked training rows in ONE pass.

    One aggregate grouped by the receiver code (at most 256 groups: the code
    range) yields, per group, the row count, mean / population variance of
    the four base condition slots, min / max of every path-loss slot and the
    excess-delay sum and count. The driver merges the (bounded) group rows:
    Chan's formula for the variances, min/max, sums; the receiver categories
    are the group keys, and a one-hot slot's mean/variance follow from its
    category count."""
    los = (F.col("link_state") == LOS).cast("double")
    base = condition_base(F.col("dvec"), los)
    plr = path_loss_raw(F.col("nlos_pl"), max_path_loss, n_max_paths)
    exc = excess_delay(F.slice(F.col("nlos_dly"), 1, n_max_paths), F.col("dvec"))
    d = df.select(F.col(rx).alias("_rx"), base.alias("_b"), plr.alias("_p"), exc.alias("_e"))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(4):
        v = _num(at(F.col("_b"), i))
        aggs += [F.count(v).alias(f"bn{i}"), F.avg(v).alias(f"bm{i}"), F.var_pop(v).alias(f"bv{i}")]
    for k in range(n_max_paths):
        v = at(F.col("_p"), k)
        aggs += [F.min(v).alias(f"lo{k}"), F.max(v).alias(f"hi{k}")]
    aggs += [F.sum(array_sum(F.transform(F.col("_e"), lambda v: F.coalesce(v, F.lit(0.0))))).alias("es"),
             F.sum(F.size(F.filter(F.col("_e"), lambda v: v.isNotNull()))).alias("en")]
    groups = d.groupBy("_rx").agg(*aggs).collect()       # <= 257 rows (codes + NULL)
    n_all = sum(g["n"] for g in groups)
    # receiver categories, drop-last
    cats = sorted(g["_rx"] for g in groups if g["_rx"] is not None)
    enc = OneHotState(cats, len(cats) > 1)
    used = cats[:-1] if enc.drop_last else cats
    # base condition slots: merge group means/variances (Chan et al.)
    mean, var = [], []
    for i in range(4):
        parts = [(g[f"bn{i}"], g[f"bm{i}"], g[f"bv{i}"]) for g in groups if g[f"bn{i}"]]
        n = sum(p[0] for p in parts)
        m = sum(p[0] * p[1] for p in parts) / n if n else 0.0
        m2 = sum(p[0] * p[2] + p[0] * (p[1] - m) ** 2 for p in parts)
        mean.append(m)
        var.append(m2 / n if n else 0.0)
    for c in used:
        p = sum(g["n"] for g in groups if g["_rx"] == c) / n_all if n_all else 0.0
        mean.append(p)
        var.append(p * (1.0 - p))
    scale = [math.sqrt(v) if v > 0 else 1.0 for v in var]
    cond = StandardState(mean, var, scale, int(n_all))
    # path-loss slots
    lo, hi = [], []
    for k in range(n_max_paths):
        ls = [g[f"lo{k}"] for g in groups if g[f"lo{k}"] is not None]
        hs = [g[f"hi{k}"] for g in groups if g[f"hi{k}"] is not None]
        lo.append(min(ls) if ls else 0.0)
        hi.append(max(hs) if hs else 0.0)
    rng = [(h - l) if h - l != 0 else 1.0 for l, h in zip(lo, hi)]
    pl = MinMaxState(lo, hi, rng, int(n_all))
    es = sum(g["es"] or 0.0 for g in groups)
    en = sum(g["en"] or 0 for g in groups)
    delay_scale = float(es / en) if en and es else 1.0
    return PathPreproc(pl, delay_scale, cond, enc, max_path_loss, n_max_paths)


def data_vector(df: DataFrame, pp: PathPreproc, out: str = "x", dtype: str = "float") -> DataFrame:
    """``[path loss n | angles 4n | delays n]`` as float array (F15, P8); missing paths are NULL slots.
    ``dtype='double'`` keeps full precision (exact inverse)."""
    n = pp.n_max_paths
    d = angles_transform(df, n_max_paths=n, out="_ang_x")
    pl = path_loss_transform(F.col("nlos_pl"), pp.path_loss, pp.max_path_loss, n)
    dl = delays_transform(F.slice(F.col("nlos_dly"), 1, n), F.col("dvec"), pp.delay_scale)
    return d.withColumn(out, F.concat(padded(pl, n), F.col("_ang_x"), padded(dl, n)).cast(f"array<{dtype}>")).drop("_ang_x")


def data_vector_inverse(df: DataFrame, pp: PathPreproc, x: str = "x", sort: bool = True) -> DataFrame:
    """Split the data vector and invert each part (F16)."""
    n = pp.n_max_paths
    xc = F.col(x).cast("array<double>")
    d = df.withColumn("_ang_x", F.slice(xc, n + 1, 4 * n))
    d = angles_inverse(d, "_ang_x", n_max_paths=n, out="nlos_ang_hat").drop("_ang_x")
    return d.select(
        "*",
        path_loss_inverse(F.slice(xc, 1, n), pp.path_loss, pp.max_path_loss, sort).alias("nlos_pl_hat"),
        delays_inverse(F.slice(xc, 5 * n + 1, n), F.col("dvec"), pp.delay_scale).alias("nlos_dly_hat"),
    )


def conditions(df: DataFrame, pp: PathPreproc, scaled: bool = True, out: str = "cond") -> DataFrame:
    """Condition vector, standard-scaled with the fitted state."""
    d = with_conditions(df, pp.rx_encoder, out="_cond_raw")
    c = standard_transform(F.col("_cond_raw"), pp.conditions) if scaled else F.col("_cond_raw")
    return d.withColumn(out, c.cast("array<float>")).drop("_cond_raw")


def train_frame(df: DataFrame, pp: PathPreproc, keep=()) -> DataFrame:
    """Linked rows -> (obs_id, *keep, cond, x): generator input (F19). Both
    parts are columns of the same row, so their row counts agree (T11)."""
    from .sampling import keep_linked
    d = keep_linked(df)
    d = conditions(d, pp)
    return data_vector(d, pp).select("obs_id", *keep, "cond", "x")


def head_sorted(df: DataFrame, col: str, k: int, descending: bool = True, out: str | None = None) -> DataFrame:
    """F17 as an operator."""
    return df.withColumn(out or col, head_sort(F.col(col), k, descending))


# ---------------------------------------------------------------- persistence
_TYPES = {"standard_scaler": StandardState, "min_max_scaler": MinMaxState, "one_hot_encoder": OneHotState}


def state_from_dict(d: dict):
    t = d.get("type")
    if t not in _TYPES:
        raise ValueError(f"no fitted state is called {t!r}")
    return _TYPES[t](**d["params"])


def save_states(spark, states: dict, path: str) -> None:
    """Write fitted states as one JSON record per state: name, type, params."""
    rows = [(k, v.to_dict()["type"], json.dumps(v.to_dict()["params"])) for k, v in states.items()]
    spark.createDataFrame(rows, "name string, type string, params string") \
        .coalesce(1).write.mode("overwrite").json(path)


def load_states(spark, path: str) -> dict:
    """Read states written by ``save_states`` (a handful of rows)."""
    out = {}
    for r in spark.read.schema("name string, type string, params string").json(path).collect():
        out[r["name"]] = state_from_dict({"type": r["type"], "params": json.loads(r["params"])})
    return out
