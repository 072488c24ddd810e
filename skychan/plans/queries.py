"""Named queries over the driver's tables: one per operator group of the survey.

Every query reads the test tables (or data Spark derives from them) in full
and returns a DataFrame of scalars (arrays are exploded by position), with
doubles rounded so another engine can be compared value by value.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.arrays import array_sum
from ..operators import features as fe
from ..operators import sampling as sa
from ..schema import ANGLE_NAMES, DEFAULT_FREQUENCY
from .fixture import ROWS_PER_TASK, observations, observed, order_pieces, read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Arrays are exploded with ``posexplode_outer``: for plain ``posexplode`` the
# optimizer infers ``size(arr) > 0`` and pushes it below the projections that
# build ``arr``, inlining the whole array expression into the scan filter (a
# 700k-character plan for the data vector). The arrays here are never NULL or
# empty, so both give the same rows.


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column, d: int = 6) -> Column:
    """Round for cross-engine comparison; ``+ 0.0`` turns -0.0 into 0.0."""
    return F.round(c, d) + F.lit(0.0)


def rphi(c: Column, d: int = 5, full: float = 180.0) -> Column:
    """Rounded azimuth with the branch cut -full mapped to +full."""
    return geo.canon_phi(r6(c, d), full)


def path_rows(obs: DataFrame, *keep: str) -> DataFrame:
    """One row per (observation, path slot ``k``): pl, the four angles, dly."""
    z = F.arrays_zip(F.col("nlos_pl").alias("pl"), F.col("nlos_ang").alias("ang"),
                     F.col("nlos_dly").alias("dly"))
    e = obs.select("obs_id", *keep, F.posexplode_outer(z).alias("k", "p"))
    return e.select("obs_id", *keep, F.col("k").cast("bigint").alias("k"),
                    F.col("p.pl").alias("pl"),
                    *[F.col("p.ang")[i].alias(n) for i, n in enumerate(ANGLE_NAMES)],
                    F.col("p.dly").alias("dly"))


@query
def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (rx_type, link_state) of linked observations: count,
    mean distance, mean LOS polar angle, mean excess delay, mean path loss."""
    obs = sa.keep_linked(observations(spark, sf_dir))
    x, y, z = geo.vec_elems(F.col("dvec"))
    r, _, theta = geo.cart_to_sph(x, y, z)
    exc = fe.excess_delay(F.col("nlos_dly"), F.col("dvec"))
    per = obs.select(
        "rx_type", "link_state", r.alias("r"), theta.alias("theta"),
        array_sum(exc).alias("s_exc"), F.size(exc).alias("n_exc"),
        array_sum(F.col("nlos_pl")).alias("s_pl"), F.size("nlos_pl").alias("n_pl"))
    return per.groupBy("rx_type", "link_state").agg(
        F.count(F.lit(1)).alias("n_obs"),
        r6(F.avg("r")).alias("mean_d3d"),
        r6(F.avg("theta")).alias("mean_los_theta"),
        r6(F.sum("s_exc") / F.sum("n_exc") * F.lit(1e9)).alias("mean_excess_delay_ns"),
        r6(F.sum("s_pl") / F.sum("n_pl")).alias("mean_path_loss"),
    )


# ---------------------------------------------------------------- geometry
@query
def cart2sph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOS arrival (from -dvec) and departure (from dvec) directions."""
    obs = observations(spark, sf_dir)
    x, y, z = geo.vec_elems(F.col("dvec"))
    r, aod_p, aod_t = geo.cart_to_sph(x, y, z)
    _, aoa_p, aoa_t = geo.cart_to_sph(-x, -y, -z)
    return obs.select("obs_id", r6(r).alias("r"), rphi(aoa_p, 6).alias("aoa_phi"), r6(aoa_t).alias("aoa_theta"),
                      rphi(aod_p, 6).alias("aod_phi"), r6(aod_t).alias("aod_theta"))


@query
def sph2cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path's arrival direction with its loss as radius -> x, y, z."""
    p = path_rows(observations(spark, sf_dir))
    x, y, z = geo.sph_to_cart(F.col("pl"), F.col("aoa_phi"), F.col("aoa_theta"))
    return p.select("obs_id", "k", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query
def sph_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest residual of cart->sph->cart (observations) and of
    sph->cart->sph (paths); phi compared modulo 360 away from the poles.
    One pass over the path rows: the observation residual rides along on
    slot 0 of its row."""
    obs = observations(spark, sf_dir)
    x, y, z = geo.vec_elems(F.col("dvec"))
    r, p, t = geo.cart_to_sph(x, y, z)
    x2, y2, z2 = geo.sph_to_cart(r, p, t)
    o = obs.select("*", F.abs(x2 - x).alias("dx"), F.abs(y2 - y).alias("dy"), F.abs(z2 - z).alias("dz"))
    pr = path_rows(o, "dx", "dy", "dz")
    a, b, c = geo.sph_to_cart(F.col("pl"), F.col("aoa_phi"), F.col("aoa_theta"))
    r3, p3, t3 = geo.cart_to_sph(a, b, c)
    dphi = F.abs(F.pmod(p3 - F.col("aoa_phi") + F.lit(540.0), F.lit(360.0)) - F.lit(180.0))
    away = F.sin(F.radians(F.col("aoa_theta"))) > F.lit(1e-6)
    first = F.col("k") == 0
    agg = pr.agg(F.count(F.when(first, F.lit(1))).alias("n_cart"), F.count(F.lit(1)).alias("n_sph"),
                 *[F.max(F.when(first, F.col(c))).alias(c) for c in ("dx", "dy", "dz")],
                 F.max(F.abs(r3 - F.col("pl"))).alias("dr"), F.max(F.when(away, dphi)).alias("dphi"),
                 F.max(F.abs(t3 - F.col("aoa_theta"))).alias("dtheta"))
    return agg.select("n_cart", "n_sph", *[r6(F.col(c)).alias(f"max_{c}") for c in ("dx", "dy", "dz", "dr", "dphi", "dtheta")])


@query
def norms_wavelength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-D and horizontal norm, LOS delay, wavelength at 28 GHz."""
    obs = observations(spark, sf_dir)
    x, y, z = geo.vec_elems(F.col("dvec"))
    d3d = geo.norm3(x, y, z)
    return obs.select("obs_id", r6(d3d).alias("d3d"), r6(geo.hnorm(x, y)).alias("d2d"),
                      r6(geo.los_delay(d3d) * F.lit(1e9)).alias("los_delay_ns"),
                      r6(geo.wavelength(F.lit(DEFAULT_FREQUENCY)) * F.lit(1000.0)).alias("wavelength_mm"))


def _rotated_paths(spark, sf_dir, inverse: bool) -> DataFrame:
    obs = fe.with_los_terms(observations(spark, sf_dir))
    p = path_rows(obs, *fe._TERMS)
    aoa, aod = fe._los_terms()
    p1, t1 = geo.rotate(F.col("aoa_phi"), F.col("aoa_theta"), aoa, inverse=inverse)
    p2, t2 = geo.rotate(F.col("aod_phi"), F.col("aod_theta"), aod, inverse=inverse)
    return p.select("obs_id", "k", rphi(p1).alias("aoa_phi"), r6(t1, 5).alias("aoa_theta"),
                    rphi(p2).alias("aod_phi"), r6(t2, 5).alias("aod_theta"))


@query
def sub_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path direction relative to its row's LOS direction."""
    return _rotated_paths(spark, sf_dir, inverse=True)


@query
def add_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path direction rotated forward by its row's LOS direction."""
    return _rotated_paths(spark, sf_dir, inverse=False)


# ---------------------------------------------------------------- splits, augmentation
@query
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded exact 80/20 split of all observations."""
    return sa.exact_split(observations(spark, sf_dir).select("obs_id"), val_ratio=0.2, seed=42)


@query
def split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded exact 70/20/10 split (cut points from Python floats)."""
    return sa.exact_split(observations(spark, sf_dir).select("obs_id"), val_ratio=0.2, test_ratio=0.1, seed=7)


@query
def split_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 with repeated keys: rows of each order key in each part (60/40 split of all line items)."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obs_id"), "l_partkey", "l_quantity")
    s = sa.exact_split(li, val_ratio=0.4, seed=11)
    return s.groupBy("obs_id").agg(*[F.sum((F.col("split") == p).cast("bigint")).alias(f"n_{p}") for p in ("train", "val")])


@query
def rank_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 with repeated keys: first and last rank and row count of each order key over all line items."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obs_id"), "l_returnflag")
    r = sa.exact_rank(li, seed=11)
    return r.groupBy("obs_id").agg(F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
                                   F.count(F.lit(1)).alias("n"))


@query
def augment_los_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 % zero-distance LOS rows drawn with replacement and appended."""
    obs = observations(spark, sf_dir).select("obs_id", "dvec", "rx_type", "link_state")
    a = sa.augment_los_zero(obs, frac=0.1, seed=42)
    x, y, z = geo.vec_elems(F.col("dvec"))
    return a.select("obs_id", "aug_index", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"),
                    "rx_type", "link_state")


# ---------------------------------------------------------------- features
def _explode(df: DataFrame, arr: Column, keys=("obs_id",), digits: int = 6, idx: str = "idx") -> DataFrame:
    e = df.select(*keys, F.posexplode_outer(arr).alias("_i", "_v"))
    return e.select(*keys, F.col("_i").cast("bigint").alias(idx), r6(F.col("_v").cast("double"), digits).alias("value"))


@query
def link_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixed-category one-hot of the receiver type (Terrestrial, Aerial)."""
    obs = observations(spark, sf_dir)
    oh = fe.one_hot(fe.rx_name(F.col("rx_type")), ("Terrestrial", "Aerial"))
    return obs.select("obs_id", oh[0].alias("oh_terrestrial"), oh[1].alias("oh_aerial"))


@query
def link_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[onehot * |dvec|, onehot * dz], exploded by slot."""
    d = fe.link_features(observations(spark, sf_dir))
    return _explode(d, F.col("features"))


@query
def link_features_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 F5 (+R3): standard scaler fitted on the train part, applied to all rows."""
    d = fe.link_features(observations(spark, sf_dir))
    train = sa.split_frames(d, val_ratio=0.2, seed=42)[0]
    st = fe.fit_standard(train, "features", 4)
    return _explode(d, fe.standard_transform(F.col("features"), st))


@query
def state_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fitted scaler written as JSON, read back, applied: same as link_features_scaled."""
    from ..session import work_path
    d = fe.link_features(observations(spark, sf_dir))
    train = sa.split_frames(d, val_ratio=0.2, seed=42)[0]
    path = work_path(spark, "states")
    fe.save_states(spark, {"link_scaler": fe.fit_standard(train, "features", 4)}, path)
    st = fe.load_states(spark, path)["link_scaler"]
    return _explode(d, fe.standard_transform(F.col("features"), st))


@query
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition vector of linked rows, learned one-hot (drop last), scaled."""
    lk = sa.keep_linked(observations(spark, sf_dir))
    enc = fe.fit_one_hot(lk, "rx_type", drop_last=True)
    raw = fe.with_conditions(lk, enc, out="cond_raw")
    st = fe.fit_standard(raw, "cond_raw")
    return _explode(raw, fe.standard_transform(F.col("cond_raw"), st))


@query
def pathloss_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max_loss - pl[:20], min-max scaled per slot (linked rows)."""
    lk = sa.keep_linked(observations(spark, sf_dir))
    st = fe.fit_path_loss(lk)
    return _explode(lk, fe.path_loss_transform(F.col("nlos_pl"), st), idx="k")


@query
def pathloss_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inverse of the scaled losses: ascending losses (strongest path first)."""
    lk = sa.keep_linked(observations(spark, sf_dir))
    st = fe.fit_path_loss(lk)
    inv = fe.path_loss_inverse(fe.path_loss_transform(F.col("nlos_pl"), st), st)
    return _explode(lk, inv, idx="k")


def _angle_rows(df: DataFrame, arr: Column, scale: float, digits: int) -> DataFrame:
    """Explode an array of 4-angle structs/arrays into per-path rows."""
    e = df.select("obs_id", F.posexplode_outer(arr).alias("k", "a"))
    full = 180.0 / scale
    return e.select("obs_id", F.col("k").cast("bigint").alias("k"),
                    rphi(F.col("a")[0] / F.lit(scale), digits, full).alias("aoa_phi"),
                    r6(F.col("a")[1] / F.lit(scale), digits).alias("aoa_theta"),
                    rphi(F.col("a")[2] / F.lit(scale), digits, full).alias("aod_phi"),
                    r6(F.col("a")[3] / F.lit(scale), digits).alias("aod_theta"))


@query
def angles_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path angles relative to the LOS directions, / 180 (linked rows)."""
    lk = fe.with_los_terms(sa.keep_linked(observations(spark, sf_dir)))
    rel = fe.relative_angles(F.col("nlos_ang"))
    arr = F.transform(rel, lambda s: F.array(s["aoa_phi"], s["aoa_theta"], s["aod_phi"], s["aod_theta"]))
    return _angle_rows(lk, arr, 180.0, 7)


@query
def angles_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative angles added back to the LOS directions = input angles;
    azimuths are NULL where the input polar angle is 0 or 180 (undefined)."""
    lk = sa.keep_linked(observations(spark, sf_dir))
    d = fe.angles_inverse(fe.angles_transform(lk), "ang_x")
    z = F.arrays_zip(F.col("nlos_ang").alias("o"), F.col("nlos_ang_hat").alias("h"))
    e = d.select("obs_id", F.posexplode_outer(z).alias("k", "p"))
    pole_a = F.abs(F.sin(F.radians(F.col("p.o")[1]))) < F.lit(1e-9)
    pole_d = F.abs(F.sin(F.radians(F.col("p.o")[3]))) < F.lit(1e-9)
    return e.select("obs_id", F.col("k").cast("bigint").alias("k"),
                    F.when(~pole_a, rphi(F.col("p.h")[0])).alias("aoa_phi"), r6(F.col("p.h")[1], 5).alias("aoa_theta"),
                    F.when(~pole_d, rphi(F.col("p.h")[2])).alias("aod_phi"), r6(F.col("p.h")[3], 5).alias("aod_theta"))


@query
def delays_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """excess delays over the LOS delay divided by their global mean."""
    lk = sa.keep_linked(observations(spark, sf_dir))
    scale = fe.fit_delay_scale(lk)
    return _explode(lk, fe.delays_transform(F.col("nlos_dly"), F.col("dvec"), scale), idx="k")


@query
def delays_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inverse of the relative delays, in ns (= max(delay, LOS delay))."""
    lk = sa.keep_linked(observations(spark, sf_dir))
    scale = fe.fit_delay_scale(lk)
    inv = fe.delays_inverse(fe.delays_transform(F.col("nlos_dly"), F.col("dvec"), scale), F.col("dvec"), scale)
    return _explode(lk, F.transform(inv, lambda v: v * F.lit(1e9)), idx="k")


@query
def data_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[path loss 20 | angles 80 | delays 20] as float32, exploded."""
    lk = sa.keep_linked(observations(spark, sf_dir))
    pp = fe.fit_path_preproc(lk)
    d = fe.data_vector(lk, pp)
    e = d.select("obs_id", F.posexplode_outer("x").alias("idx", "v"))
    v = F.col("v").cast("double")
    phi_block = ((F.col("idx") >= 20) & (F.col("idx") < 40)) | ((F.col("idx") >= 60) & (F.col("idx") < 80))
    out = F.when(phi_block, geo.canon_phi(r6(v, 5), 1.0)).otherwise(r6(v, 5))
    return e.select("obs_id", F.col("idx").cast("bigint").alias("idx"), out.alias("value"))


@query
def data_vector_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 (+F9/F11/F13): data vector split and inverted; losses come back
    sorted ascending, angles and delays in slot order (P11 parity)."""
    lk = sa.keep_linked(observations(spark, sf_dir))
    pp = fe.fit_path_preproc(lk)
    d = fe.data_vector_inverse(fe.data_vector(lk, pp, dtype="double"), pp)
    z = F.arrays_zip(F.col("nlos_pl_hat").alias("pl"), F.col("nlos_ang").alias("o"),
                     F.col("nlos_ang_hat").alias("h"), F.col("nlos_dly_hat").alias("dly"))
    e = d.select("obs_id", F.posexplode_outer(z).alias("k", "p"))
    pole_a = F.abs(F.sin(F.radians(F.col("p.o")[1]))) < F.lit(1e-9)
    pole_d = F.abs(F.sin(F.radians(F.col("p.o")[3]))) < F.lit(1e-9)
    return e.select("obs_id", F.col("k").cast("bigint").alias("k"), r6(F.col("p.pl")).alias("pl"),
                    F.when(~pole_a, rphi(F.col("p.h")[0])).alias("aoa_phi"), r6(F.col("p.h")[1], 5).alias("aoa_theta"),
                    F.when(~pole_d, rphi(F.col("p.h")[2])).alias("aod_phi"), r6(F.col("p.h")[3], 5).alias("aod_theta"),
                    r6(F.col("p.dly") * F.lit(1e9), 5).alias("dly_ns"))


@query
def head_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first 5 path losses sorted descending, the tail kept in place."""
    d = fe.head_sorted(observations(spark, sf_dir), "nlos_pl", 5, descending=True, out="hs")
    return _explode(d, F.col("hs"), idx="k")


@query
def train_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19 T11 (+R1 R2 R3): fit on the linked train part, transform train and
    val; mean of every condition / data slot per part."""
    lk = sa.keep_linked(observations(spark, sf_dir))
    sp = sa.exact_split(lk, val_ratio=0.2, seed=42)
    pp = fe.fit_path_preproc(sp.filter(F.col("split") == "train"))
    tf = fe.train_frame(sp, pp, keep=("split",))
    parts = [tf.select("split", F.lit("cond").alias("part"), F.posexplode_outer("cond").alias("idx", "v")),
             tf.select("split", F.lit("x").alias("part"), F.posexplode_outer("x").alias("idx", "v"))]
    u = parts[0].unionByName(parts[1])
    i = F.col("idx")
    phi_block = (F.col("part") == "x") & (((i >= 20) & (i < 40)) | ((i >= 60) & (i < 80)))
    v = r6(F.col("v").cast("double"), 5)
    u = u.withColumn("v", F.when(phi_block, geo.canon_phi(v, 1.0)).otherwise(v))
    return u.groupBy("split", "part", i.cast("bigint").alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("v"), 5).alias("mean_value"))


# ---------------------------------------------------------------- evaluation
def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with truth, the fixed rule-based prediction, and softmax
    class probabilities from distance-based logits (M3)."""
    from ..functions.nn import softmax
    obs = observations(spark, sf_dir)
    x, y, z = geo.vec_elems(F.col("dvec"))
    d3d = geo.norm3(x, y, z)
    logits = F.array((d3d - 1100) / 200, -F.abs(d3d - 850) / 200, (600 - d3d) / 200)
    return obs.select("obs_id", "rx_type", F.col("link_state").alias("label"),
                      F.col("pred_state").alias("prediction"), softmax(logits).alias("probability"))


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix of the rule-based prediction."""
    from ..operators.metrics import confusion_matrix
    return confusion_matrix(_scored(spark, sf_dir))


@query
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision / recall / F1 / support, accuracy, macro and weighted avg."""
    from ..operators.metrics import classification_report
    r = classification_report(_scored(spark, sf_dir))
    return r.select("class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@query
def class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class accuracy (diagonal / row sum)."""
    from ..operators.metrics import per_class_accuracy
    r = per_class_accuracy(_scored(spark, sf_dir))
    return r.select("label", r6(F.col("accuracy")).alias("accuracy"))


@query
def overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall accuracy."""
    from ..operators.metrics import overall_accuracy as acc
    r = acc(_scored(spark, sf_dir))
    return r.select(r6(F.col("accuracy")).alias("accuracy"), "n")


@query
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 M3 M4: softmax probabilities, sparse cross-entropy and arg-max
    accuracy per receiver type."""
    from ..functions.nn import argmax, sparse_cross_entropy_row
    s = _scored(spark, sf_dir)
    ce = sparse_cross_entropy_row(F.col("probability"), F.col("label"))
    hit = (argmax(F.col("probability")) == F.col("label")).cast("double")
    return s.groupBy("rx_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(ce)).alias("cross_entropy"),
                                    r6(F.avg(hit)).alias("argmax_accuracy"))


@query
def sample_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: link state drawn from the class probabilities by inverse CDF with a
    seeded uniform per observation."""
    from ..functions.nn import inverse_cdf_draw
    from ..functions.uniform import hash_uniform
    s = _scored(spark, sf_dir)
    u = hash_uniform(42, "state", F.col("obs_id"))
    return s.select("obs_id", inverse_cdf_draw(F.col("probability"), u).alias("sampled_state"))


@query
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing statistics of ``events.value`` per event type (exact p95/p99)."""
    from ..operators.metrics import timing_stats as ts
    r = ts(read_table(spark, sf_dir, "events"), ["event_type"], "value")
    return r.select("event_type", "count", *[r6(F.col(c)).alias(c) for c in r.columns[2:]])


@query
def timing_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 with a NULL group and few candidates, so that the narrowing loop runs."""
    from ..operators.metrics import timing_stats as ts
    e = read_table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("event_type"), "value")
    r = ts(e, ["event_type"], "value", max_candidates=50)
    return r.select("event_type", "count", *[r6(F.col(c)).alias(c) for c in r.columns[2:]])


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows/s and speed-up against the first run of each event type."""
    from ..operators.metrics import throughput as tp
    r = tp(read_table(spark, sf_dir, "events"), "event_type", "event_id", "value", rows=1000)
    return r.select("event_type", "event_id", *[r6(F.col(c)).alias(c) for c in ("time_ms", "rows_per_s", "speedup")])


# ---------------------------------------------------------------- sources, decoding, validation
from ..schema import NULL_TOKENS  # noqa: E402
from ..sources import decode as dc  # noqa: E402
from ..sources import io as sio  # noqa: E402

CANON = ["obs_id", "dvec", "rx_type", "link_state", "los_pl", "los_ang", "los_dly", "nlos_pl", "nlos_ang", "nlos_dly"]

# Fixed corruption rule of the decode test table: obs_id % 50 -> raw cell.
CORRUPT = {
    "dvec": {1: "oops", 2: "[1,2", 3: "", 4: "5", 5: '{"a":1}', 6: "[NaN,1]", 7: "[1,2]", 8: "[1,null]", 9: "NA"},
    "rx_type": {10: "300", 11: "abc", 12: "null", 17: " 1 "},
    "los_pl": {13: "nan", 14: "x1", 18: "-1.#IND"},
    "nlos_ang": {15: "[[1,2,3,4]]", 16: "[[1,2],[3"},
    "nlos_pl": {19: "[1e5]", 20: "[Infinity]"},
}


def corrupted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV-style cells of the fixture with the CORRUPT rule applied."""
    return corrupted(observations(spark, sf_dir))


def corrupted(obs: DataFrame) -> DataFrame:
    raw = sio.encode_cells(obs.select(*CANON))
    m = F.col("obs_id").cast("bigint") % 50
    cols = []
    for c in raw.columns:
        if c in CORRUPT:
            e = None
            for k, v in CORRUPT[c].items():
                e = (F.when(m == k, F.lit(v)) if e is None else e.when(m == k, F.lit(v)))
            cols.append(e.otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return raw.select(*cols)


def _roundtrip_out(d: DataFrame) -> DataFrame:
    x, y, z = geo.vec_elems(F.col("dvec"))
    dbl = lambda c: c.cast("double")
    return d.select(
        F.col("obs_id").cast("bigint").alias("obs_id"),
        r6(dbl(x)).alias("x"), r6(dbl(y)).alias("y"), r6(dbl(z)).alias("z"), "rx_type", "link_state",
        r6(dbl(F.col("los_pl")), 4).alias("los_pl"), r6(dbl(F.col("los_dly")) * F.lit(1e9), 3).alias("los_dly_ns"),
        F.size("nlos_pl").cast("bigint").alias("n_paths"),
        r6(array_sum(F.col("nlos_pl")), 3).alias("pl_sum"),
        r6(array_sum(F.flatten(F.col("nlos_ang"))), 3).alias("ang_sum"),
        r6(array_sum(F.col("nlos_dly")) * F.lit(1e9), 3).alias("dly_sum_ns"))


@query
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture written as CSV with JSON cells, read back by
    name and decoded to the declared float/int types, a piece of the table at a time."""
    from ..session import drop_path, work_path
    decoded, path = work_path(spark, "roundtrip-rows"), None
    with order_pieces(spark, sf_dir) as pieces:
        for piece in pieces:
            if path is not None:
                drop_path(spark, path)  # its rows are stored
            path = work_path(spark, "observations") + ".csv"
            sio.save_observations(observed(piece), path, columns=CANON)
            rows = _roundtrip_out(sio.load_observations(spark, path))
            rows.write.mode("append").option("compression", "zstd").parquet(decoded)
    return spark.read.schema(rows.schema).parquet(decoded)


def _file_count(spark: SparkSession, path: str) -> int:
    """Files of a folder: one a task that wrote them, so their number grows with the rows and a stream takes a share of them at a time."""
    return len(spark.read.text(path).inputFiles())


@query
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same CSV files ingested by a file stream (availableNow) into a
    Parquet table with a checkpoint, a piece of the table at a time; equals the batch decode."""
    from ..session import drop_path, work_path
    from ..streaming.ingest import ingest
    src = work_path(spark, "stream-src")
    out = work_path(spark, "stream-out")
    ck = work_path(spark, "stream-ckpt")
    with order_pieces(spark, sf_dir) as pieces:
        for k, piece in enumerate(pieces):
            if k:
                drop_path(spark, src)  # ingested
            sio.save_observations(observed(piece), src, fmt="csv", columns=CANON)
            d = ingest(spark, src, out, ck, max_files_per_trigger=max(2, len(pieces) * _file_count(spark, src) // 2))
    return _roundtrip_out(d)


@query
def ingest_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of CSV files with three headers (declared order; reversed; an extra column in front) and one that lacks a
    column, ingested by a stream that groups each micro-batch's files by header; equals the batch decode. Files come and go a piece
    of the table at a time."""
    from ..session import drop_path, work_path
    from ..streaming.mixed import ingest_mixed as ingest
    src = work_path(spark, "mixed-src")
    sinks = [work_path(spark, f"mixed-{n}") for n in ("out", "rejects", "ckpt")]
    reverse, note = list(reversed(CANON)), ["note", *CANON]
    forms = [(0, CANON), (1, reverse), (2, note), (0, [c for c in CANON if c != "los_dly"])]
    saved = set()
    with order_pieces(spark, sf_dir) as pieces:
        for k, piece in enumerate(pieces):
            if k:
                drop_path(spark, src)  # ingested
            obs = observed(piece).withColumn("note", F.lit("x, y"))
            for j, (rest, columns) in enumerate(forms):
                these = F.col("obs_id") % 3 == rest
                if (k < len(pieces) - 1 or j in saved) and piece.filter(these).isEmpty():
                    continue  # only a table without such rows is an error, not a piece
                sio.save_observations(obs.filter(these), src, fmt="csv", mode="append", columns=columns)
                saved.add(j)
            good, _ = ingest(spark, src, *sinks, max_files_per_trigger=max(3, len(pieces) * _file_count(spark, src) // 6))
    return _roundtrip_out(good)


@query
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with undecodable cells, truncated records and a missing column, ingested with a quarantine a piece of the table at
    a time: rejects by reason and column with the sum of their keys, and the rows kept."""
    from ..session import drop_path, work_path
    from ..streaming.mixed import ingest_mixed as ingest
    src = work_path(spark, "rejects-src")
    sinks = [work_path(spark, f"rejects-{n}") for n in ("out", "bad", "ckpt")]
    line = F.to_csv(F.struct(*CANON), {"escape": '"', "nullValue": ""})
    cut = F.when(F.col("obs_id").cast("bigint") % 50 == 30, F.substring_index(line, '"', 1)).otherwise(line)
    with order_pieces(spark, sf_dir) as pieces:
        for k, piece in enumerate(pieces):
            if k:
                drop_path(spark, src)  # ingested
            whole = corrupted(observed(piece)).select(cut.alias(",".join(CANON)))  # a column whose name is the header line
            whole.write.option("header", True).option("quote", "").option("escape", "").option("delimiter", "\u0001").csv(src)
            if k == len(pieces) - 1:  # one file of the whole table
                sio.save_observations(observations(spark, sf_dir).filter("obs_id % 50 = 0").coalesce(1), src, fmt="csv", mode="append", columns=[c for c in CANON if c != "los_dly"])
            good, bad = ingest(spark, src, *sinks)
    kept = good.agg(F.lit("kept").alias("reason"), F.lit(None).cast("string").alias("column"), F.count("*").alias("n"), F.sum("obs_id").alias("ids"))
    return bad.groupBy("reason", "column").agg(F.count("*").alias("n"), F.sum("obs_id").alias("ids")).unionByName(kept)


@query
def decode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per declared column, NULL cells, rejected cells (present,
    not a null token, not decodable) and arrays of the wrong shape."""
    from ..operators.quality import wrong_size
    d = dc.decode_observations(corrupted_cells(spark, sf_dir), with_rejects=True)
    aggs = []
    names = list(CANON[1:])
    for c in names:
        aggs += [F.sum(F.col(c).isNull().cast("bigint")).alias(f"{c}__n"),
                 F.sum(F.col(f"{c}__reject").cast("bigint")).alias(f"{c}__r"),
                 F.sum(wrong_size(c, F.col(c)).cast("bigint")).alias(f"{c}__w")]
    s = d.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__n`, `{c}__r`, `{c}__w`" for c in names)
    return s.selectExpr(f"stack({len(names)}, {stack}) as (column, n_null, n_rejects, n_wrong_size)")


@query
def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NA-like strings become NULL; counts per raw cell value (other cells
    are counted as '<value>')."""
    obs = observations(spark, sf_dir).select("obs_id", "los_pl")
    toks = F.array(*[F.lit(t) for t in NULL_TOKENS])
    k = F.col("obs_id")
    cell = F.when(k % 4 == 0, F.element_at(toks, ((k / 4).cast("bigint") % len(NULL_TOKENS) + 1).cast("int"))) \
        .otherwise(F.col("los_pl").cast("string"))
    d = obs.select(cell.alias("raw")).select("raw", dc.decode_scalar(F.col("raw"), "los_pl").alias("v"))
    label = F.when(F.col("v").isNull(), F.col("raw")).otherwise(F.lit("<value>"))
    return d.groupBy(label.alias("cell")).agg(F.count(F.lit(1)).alias("n"),
                                              F.sum(F.col("v").isNull().cast("bigint")).alias("n_null"))


@query
def load_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table written three times (all columns; without
    ``los_dly`` -> skipped; columns permuted) plus a missing path, loaded and
    unioned by name, a piece of the table at a time: every observation arrives twice."""
    from ..session import drop_path, work_path
    loaded, base = work_path(spark, "union-rows"), None
    with order_pieces(spark, sf_dir) as pieces:
        for piece in pieces:
            if base is not None:
                drop_path(spark, base)  # its rows are stored
            obs = observed(piece).select(*CANON)
            base = work_path(spark, "parts")
            a, b, c = f"{base}/a.csv", f"{base}/b.csv", f"{base}/c.csv"
            # three texts of the rows are 40 times the table they are made from; a task writes and reads some MB of them
            sio.save_observations(obs, a, compression="gzip")
            sio.save_observations(obs, b, columns=[x for x in CANON if x != "los_dly"], compression="gzip")
            sio.save_observations(obs, c, columns=list(reversed(CANON)), compression="gzip")
            d = sio.load_observations(spark, [a, b, "missing.csv", c], data_dir=base)
            rows = d.select("rx_type", "link_state", "obs_id", geo.vec_elems(F.col("dvec"))[0].cast("double").alias("x"))
            rows.write.mode("append").option("compression", "zstd").parquet(loaded)
    d = spark.read.schema(rows.schema).parquet(loaded)
    return d.groupBy("rx_type", "link_state").agg(F.count(F.lit(1)).alias("n"),
                                                  F.countDistinct("obs_id").alias("n_obs"),
                                                  r6(F.sum("x"), 2).alias("sum_x"))


@query
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dtype, count, NULL count, min/max outer size per decoded column."""
    from ..operators.quality import profile as prof
    d = dc.decode_observations(corrupted_cells(spark, sf_dir))
    return prof(d)


@query
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation report of the decoded corrupted table."""
    from ..operators.quality import validate as val
    return val(dc.decode_observations(corrupted_cells(spark, sf_dir)))


@query
def rx_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receiver spellings (code, name, padded code, lower-case name,
    unknown code 2) -> name; unknown -> NULL."""
    from ..schema import RX_TYPES
    obs = observations(spark, sf_dir).select("obs_id", "rx_type")
    names = F.array(*[F.lit(n) for n in RX_TYPES])
    name = F.element_at(names, F.col("rx_type") + 1)
    m = F.col("obs_id") % 5
    raw = (F.when(m == 0, F.col("rx_type").cast("string")).when(m == 1, name)
           .when(m == 2, F.concat(F.lit(" "), F.col("rx_type").cast("string"), F.lit(" ")))
           .when(m == 3, F.lower(name)).otherwise(F.lit("2")))
    d = obs.select(raw.alias("raw")).select("raw", dc.normalize_rx(F.col("raw"), on_unknown="null").alias("rx_name"))
    return d.groupBy("raw", "rx_name").agg(F.count(F.lit(1)).alias("n"))


@query
def state_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link-state code <-> label and angle name -> slot, case-insensitive."""
    from ..schema import ANGLE_NAMES as AN
    obs = observations(spark, sf_dir).select("obs_id", "link_state")
    lab = dc.link_state_label(F.col("link_state"))
    m = F.col("obs_id") % 3
    var = (F.when(m == 0, lab).when(m == 1, F.lower(lab))
           .otherwise(F.concat(F.upper(F.substring(lab, 1, 1)), F.lower(F.substring(lab, 2, 100)))))
    ang = F.upper(F.element_at(F.array(*[F.lit(a) for a in AN]), (F.col("obs_id") % 4 + 1).cast("int")))
    return obs.select("obs_id", lab.alias("state_label"), var.alias("variant"),
                      dc.link_state_code(var).alias("state_code"), ang.alias("angle_name"),
                      dc.angle_index(ang).alias("angle_idx"))


# ---------------------------------------------------------------- generative-model maths (embeddings)
def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of ``embedding``: x as it is, mu reversed, logvar rotated by 16 and times 10; a weight per row."""
    e = spread(read_table(spark, sf_dir, "embeddings"))
    emb = F.transform("embedding", lambda v: v.cast("double"))
    turned = F.concat(F.slice(emb, 17, F.greatest(F.size(emb), F.lit(1))), F.slice(emb, 1, 16))
    return e.select("vec_id", "label", emb.alias("x"), F.reverse(emb).alias("mu"),
                    F.transform(turned, lambda v: v * F.lit(10.0)).alias("lv"), (F.col("vec_id") % 3 + 1).cast("double").alias("w"))


@query
def reparam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: mu + eps * exp(logvar / 2) with seeded Box-Muller normals."""
    from ..functions.nn import reparameterize
    from ..functions.uniform import hash_normal
    e = _emb(spark, sf_dir)
    eps = F.transform(F.sequence(F.lit(0), F.size("mu") - 1), lambda i: hash_normal(42, F.col("vec_id"), i))
    z = reparameterize(F.col("mu"), F.col("lv"), eps)
    return _explode(e.select("vec_id", z.alias("z")), F.col("z"), keys=("vec_id",))


@query
def recon_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: Gaussian reconstruction loss, mean over rows, per label."""
    from ..functions.nn import gaussian_nll_row
    e = _emb(spark, sf_dir)
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                  r6(F.avg(gaussian_nll_row(F.col("x"), F.col("mu"), F.col("lv")))).alias("recon_loss"))


@query
def kl_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted KL term as written (raw) and with the -1/2 factor."""
    from ..functions.nn import kl_row
    e = _emb(spark, sf_dir)
    w = F.col("w")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                  r6(F.avg(w * kl_row(F.col("mu"), F.col("lv"), "raw"))).alias("kl_raw"),
                                  r6(F.avg(w * kl_row(F.col("mu"), F.col("lv"), "kl"))).alias("kl"))


@query
def logvar_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log(min_var + softplus(t)) elementwise, min_var = 1e-4."""
    from ..functions.nn import logvar_floor as lf
    e = _emb(spark, sf_dir)
    return _explode(e.select("vec_id", lf(F.col("lv"), 1e-4).alias("v")), F.col("v"), keys=("vec_id",))


# ---------------------------------------------------------------- synthetic data
@query
def synth_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic observation per order key (seeded), summarised per row."""
    from ..operators.synth import synth_observations
    keys = spread(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id")), rows_per_task=ROWS_PER_TASK)
    s = synth_observations(keys)
    x, y, z = geo.vec_elems(F.col("dvec"))
    n = F.size("nlos_pl")
    def slot(i):
        return F.transform("nlos_ang", lambda a: a[i])
    ang = [slot(i) for i in range(4)]
    return s.select("obs_id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"), "rx_type", "link_state",
                    r6(F.col("los_pl")).alias("los_pl"), r6(F.col("los_dly") * F.lit(1e9)).alias("los_dly_ns"),
                    r6(array_sum(F.col("nlos_pl")) / n).alias("pl_mean"),
                    *[r6(array_sum(a) / n).alias(f"a{i}_mean") for i, a in enumerate(ang)],
                    r6(array_sum(F.col("nlos_dly")) / n * F.lit(1e9)).alias("dly_mean_ns"))


@query
def synth_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded N(0,1) Cartesian and uniform spherical vectors per order key."""
    from ..operators.synth import cartesian_columns, spherical_columns
    keys = spread(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id")), rows_per_task=ROWS_PER_TASK)
    k = F.col("obs_id")
    cols = list(zip(("cx", "cy", "cz"), cartesian_columns(k))) + list(zip(("r", "phi", "theta"), spherical_columns(k)))
    return keys.select("obs_id", *[r6(c).alias(n) for n, c in cols])


# ---------------------------------------------------------------- classifier: what another engine can check of it
def _fitted(spark: SparkSession, sf_dir: str, max_iter: int = 50):
    from ..operators.model import LinkStateModel
    obs = observations(spark, sf_dir)
    train, val = sa.split_frames(obs, val_ratio=0.2, seed=42)
    return LinkStateModel(max_iter=max_iter).fit(train), train, val


@query
def mlp_link_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 M2 M4 (+R3 R5 F3-F5): fit the MLP on the train part, predict the validation part. Per label: rows, rows whose
    probabilities are proper (three, in 0 to 1, summing to 1, the prediction their first highest), and whether the
    accuracy is above the share of the most frequent label."""
    m, _, val = _fitted(spark, sf_dir)
    p = m.predict_proba(val)
    prob = F.col("probability")
    proper = ((F.size(prob) == 3) & F.forall(prob, lambda v: (v >= 0) & (v <= 1)) & (F.abs(array_sum(prob) - 1) < 1e-9)
              & (F.element_at(prob, F.col("prediction") + 1) == F.array_max(prob)))
    per = p.groupBy(F.col("link_state").alias("label")).agg(F.count("*").alias("n"), F.sum(proper.cast("bigint")).alias("n_proper"),
                                                            F.sum((F.col("prediction") == F.col("link_state")).cast("bigint")).alias("right"))
    every = Window.partitionBy()     # over a row a label
    return per.select("label", "n", "n_proper", (F.sum("right").over(every) > F.max("n").over(every)).alias("better_than_majority"))


@query
def model_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save model + scaler + config, load, predict again: the
    predictions of both models agree row for row."""
    from ..operators.model import LinkStateModel
    from ..session import work_path
    m, _, val = _fitted(spark, sf_dir)
    path = work_path(spark, "link-model")
    m.save(spark, path)
    m2 = LinkStateModel.load(spark, path)
    a = m.predict_proba(val).select("obs_id", F.col("probability").alias("p1"))
    b = m2.predict_proba(val).select("obs_id", F.col("probability").alias("p2"))
    return a.join(b, "obs_id").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum((F.col("p1") == F.col("p2")).cast("bigint")).alias("n_equal"))


@query
def channel_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 (+E2 F19): link model and path transforms fitted together on the train part; support of each class in the validation
    report, whether its figures are in 0 to 1, and the generator-input row count."""
    from ..operators.metrics import classification_report
    from ..operators.model import ChannelModel
    obs = observations(spark, sf_dir)
    train, val = sa.split_frames(obs, val_ratio=0.2, seed=42)
    cm = ChannelModel().fit(train)
    rep = classification_report(cm.link.predict_proba(val).withColumnRenamed("link_state", "label"))
    within = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "f1_score")]
    rep = rep.filter(F.col("class").isin("No-Link", "NLOS", "LOS")).select("class", (within[0] & within[1] & within[2]).alias("in_range"), "support")
    rows = cm.path_input(val).agg(F.lit("path_input_rows").alias("class"), F.lit(True).alias("in_range"), F.count("*").alias("support"))
    return rep.unionByName(rows)


@query
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight epochs of two batches each; per epoch the sizes of both parts, whether all four metrics are in range, whether the
    best epoch is the first of the highest validation accuracy, and whether the last epoch's loss is below the first's."""
    from ..operators.metrics import best_epoch, history_table
    from ..operators.model import LinkStateModel
    obs = observations(spark, sf_dir)
    train, val = sa.split_frames(obs, val_ratio=0.2, seed=42)
    n = read_table(spark, sf_dir, "orders").count()
    m = LinkStateModel().fit_epochs(train, val, epochs=8, batch_size=max(1, n // 2), steps=3)
    h = history_table(m.history_frame(spark))
    top = best_epoch(h).first()
    ok = F.col("loss").between(0, 50) & F.col("val_loss").between(0, 50) & F.col("accuracy").between(0, 1) & F.col("val_accuracy").between(0, 1)
    first = F.when(F.col("epoch") < top.epoch, F.col("val_accuracy") < top.val_accuracy).otherwise(F.col("val_accuracy") <= top.val_accuracy)
    return h.select(F.col("epoch").cast("bigint").alias("epoch"), F.lit(m.n_train).cast("bigint").alias("n_train"), F.lit(m.n_val).cast("bigint").alias("n_val"),
                    ok.alias("in_range"), first.alias("best_is_first_highest"), F.lit(m.epochs["loss"][-1] < m.epochs["loss"][0]).alias("loss_fell"))


@query
def asof_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each event with the last earlier event of its user."""
    from ..operators.asof import asof_join
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = asof_join(e, e, ["user_id"], "ts", "event_id", ["event_id", "event_type", "value"])
    return out.select("event_id", "user_id", F.col("last_event_id").alias("prev_id"), F.col("last_event_type").alias("prev_type"), F.col("last_value").alias("prev_value"),
                      (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))).alias("gap_us"))


@query
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 T10 with subtotals: per receiver type x link state and all subtotals, observations, different 50 m cells and accuracy."""
    from ..operators.rollup import distinct_rollup
    x, y, _ = geo.vec_elems(F.col("dvec"))
    cell = F.floor((x + 1000) / F.lit(50.0)) * 1000 + F.floor((y + 1000) / F.lit(50.0))
    obs = observations(spark, sf_dir).select("rx_type", "link_state", "pred_state", cell.cast("bigint").alias("cell"))
    right = (F.col("link_state") == F.col("pred_state")).cast("bigint")
    d = distinct_rollup(obs, ["rx_type", "link_state"], "cell", {"n_right": right})
    return d.select("level", "rx_type", "link_state", "n", F.col("n_distinct").alias("n_cells"), "n_right", r6(F.col("n_right") / F.col("n")).alias("accuracy"))


@query
def row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition rows and data-vector rows built as separate frames
    agree one to one (full outer join on the key; one-sided rows counted)."""
    from ..operators.quality import check_aligned
    lk = sa.keep_linked(observations(spark, sf_dir))
    pp = fe.fit_path_preproc(lk)
    a = fe.conditions(lk, pp).select("obs_id", "cond")
    b = fe.data_vector(lk, pp).select("obs_id", "x")
    return check_aligned(a, b, raise_on_mismatch=False)


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average / min / max time and run count per event type."""
    from ..operators.metrics import run_summary as rs
    r = rs(read_table(spark, sf_dir, "events"), "event_type", "value")
    return r.select("event_type", *[r6(F.col(c)).alias(c) for c in ("avg_ms", "min_ms", "max_ms")], "runs")


# ---------------------------------------------------------------- event time
def _event_files(spark: SparkSession, sf_dir: str):
    """``events`` as six folders' worth of files that arrive five days apart; two rows of 50 arrive one or two files late."""
    from pyspark.sql.types import StructType

    from ..session import work_path
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    e = read_table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(us).alias("at"), "user_id", "event_type", "value", us.alias("_us"))
    day = F.floor((F.col("_us") - 1704067200000000) / F.lit(86400000000))
    late = F.when(F.col("event_id") % 50 == 0, 2).when(F.col("event_id") % 50 == 1, 1).otherwise(0)
    e = e.withColumn("_part", F.least(F.floor(day / 5) + late, F.lit(5)))
    src = work_path(spark, "event-files")
    schema = StructType.fromDDL("event_id long, at timestamp, user_id long, event_type string, value double")
    for i in range(6):  # one after the other: the stream takes files by age
        e.where(F.coalesce(F.col("_part"), F.lit(0)) == i).select(*schema.names).coalesce(1).write.mode("append").parquet(src)
    return src, schema


@query
def timing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 E8 on a stream: statistics of ``events.value`` per event type and closed day, with the rows that came too late."""
    from ..session import work_path
    from ..streaming.windows import windowed_timings
    src, schema = _event_files(spark, sf_dir)
    r, _ = windowed_timings(spark, src, schema, "at", "value", ["event_type"], "1 day", "12 hours", work_path(spark, "windows"), max_files_per_trigger=1)
    return r.select("event_type", F.unix_micros("start").alias("start_us"), "n_rows", "count", "n_late",
                    *[r6(F.col(c)).alias(c) for c in ("mean_ms", "min_ms", "max_ms", "stddev_ms", "total_ms", "rows_per_s")])


@query
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 on a stream: the closed sessions of each user (gap of six hours), rows out of order within the watermark's delay."""
    from ..session import work_path
    from ..streaming.windows import sessions
    src, schema = _event_files(spark, sf_dir)
    r = sessions(spark, src, schema, "at", "value", ["user_id"], "6 hours", "15 days", work_path(spark, "sessions"), max_files_per_trigger=1)
    return r.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_rows", r6(F.col("total_ms")).alias("total_ms"))


# ---------------------------------------------------------------- open class sets
def _open_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and predictions with classes outside 0-2 and NULLs."""
    i = F.col("obs_id")
    return observations(spark, sf_dir).select(
        F.when(i % 97 != 0, F.when(i % 89 == 0, 7).otherwise(F.col("link_state"))).alias("label"),
        F.when(i % 83 != 0, F.when(i % 79 == 0, 9).otherwise(F.col("pred_state"))).alias("prediction"))


@query
def confusion_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 for whatever classes are there, NULL included: the occupied cells."""
    from ..operators.metrics import confusion_cells
    return confusion_cells(_open_classes(spark, sf_dir))


@query
def report_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 for whatever classes are there, NULL included."""
    from ..operators.metrics import confusion_cells, open_report
    r = open_report(confusion_cells(_open_classes(spark, sf_dir)))
    return r.select("class", "tp", "support", "predicted", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1_score")])


@query
def onehot_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 T7 by a dictionary table: sparse one-hot vectors of part keys, of which one holds a third of all rows and some are NULL."""
    from ..operators.dictionary import fit_dictionary, one_hot_sparse
    key = F.when(F.col("l_orderkey") % 50 != 0, F.when(F.col("l_orderkey") % 3 == 1, 1).otherwise(F.col("l_partkey")))
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("part"))
    r = one_hot_sparse(rows, "part", fit_dictionary(rows, "part"), drop_last=True)
    return r.select("l_orderkey", "l_linenumber", "part", F.col("one_hot.size").alias("size"), F.get("one_hot.indices", F.lit(0)).alias("index"),
                    F.get("one_hot.values", F.lit(0)).alias("value"))
