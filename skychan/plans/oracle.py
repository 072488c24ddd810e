"""DuckDB SQL oracles, one per registered query.

The views ``obs`` and ``paths`` rebuild the fixture of ``plans/fixture.py``
from ``orders`` with the same integer formulas. Divisors are DOUBLE so both
engines divide in binary floating point; doubles are rounded before output.
"""
from __future__ import annotations

C = "CAST(2.99792458e8 AS DOUBLE)"
NS = "CAST(1e-9 AS DOUBLE)"
H = "CAST(100 AS DOUBLE)"

FIXTURE = f"""
WITH obs_a AS (
  SELECT o_orderkey AS obs_id,
         CAST(o_custkey % 2 AS INTEGER) AS rx_type,
         (o_orderkey * 7919 % 200003) / {H} - 1000 AS x,
         (o_orderkey * 104729 % 200003) / {H} - 1000 AS y,
         (o_orderkey * 1299709 % 30001) / {H} - 100 AS z
  FROM orders),
obs_b AS (SELECT *, sqrt(x * x + y * y + z * z) AS d3d FROM obs_a),
obs AS (
  SELECT obs_id, rx_type, x, y, z, d3d,
         CAST(CASE WHEN obs_id % 10 = 0 THEN obs_id % 3 WHEN d3d < 600 THEN 2
                   WHEN d3d < 1100 THEN 1 ELSE 0 END AS INTEGER) AS link_state,
         CAST(CASE WHEN d3d < 650 THEN 2 WHEN d3d < 1050 THEN 1 ELSE 0 END AS INTEGER) AS pred_state,
         80 + (obs_id * 53 % 12001) / {H} AS los_pl,
         d3d / {C} AS los_dly
  FROM obs_b),
paths AS (
  SELECT o.obs_id, o.rx_type, o.link_state, o.x, o.y, o.z, o.d3d, t.k,
         140 + ((o.obs_id * 31 + t.k * 17) % 4001) / {H} AS pl,
         -180 + ((o.obs_id * 13 + t.k * 29) % 36001) / {H} AS aoa_phi,
         ((o.obs_id * 11 + t.k * 37) % 18001) / {H} AS aoa_theta,
         -180 + ((o.obs_id * 17 + t.k * 41) % 36001) / {H} AS aod_phi,
         ((o.obs_id * 23 + t.k * 43) % 18001) / {H} AS aod_theta,
         o.d3d / {C} + (((o.obs_id * 19 + t.k * 23) % 801) - 100) * {NS} AS dly
  FROM obs o, range(20) t(k))
"""

SQL: dict[str, str] = {}


def R(e: str, d: int = 6) -> str:
    """Rounded; ``+ 0.0`` turns -0.0 into 0.0 as in the Spark queries."""
    return f"(round({e}, {d}) + 0.0)"


def RPHI(e: str, d: int = 5, full: int = 180) -> str:
    r = R(e, d)
    return f"(CASE WHEN {r} = -{full} THEN {full} ELSE {r} END)"


class X:
    """Tiny SQL expression so the rotation matrix is built by the same code
    (and in the same operation order) as the Spark expression."""

    def __init__(self, s: str):
        self.s = s

    def __mul__(self, o):
        return X(f"({self.s} * {_s(o)})")

    def __rmul__(self, o):
        return X(f"({_s(o)} * {self.s})")

    def __add__(self, o):
        return X(f"({self.s} + {_s(o)})")

    def __radd__(self, o):
        return X(f"({_s(o)} + {self.s})")

    def __sub__(self, o):
        return X(f"({self.s} - {_s(o)})")

    def __neg__(self):
        return X(f"(- {self.s})")


def _s(o) -> str:
    return o.s if isinstance(o, X) else repr(float(o))


def sph(x: str, y: str, z: str):
    """SQL of cart_to_sph: (r, phi_deg, theta_deg) with the zero-vector guard."""
    r = f"sqrt(({x}) * ({x}) + ({y}) * ({y}) + ({z}) * ({z}))"
    phi = f"(CASE WHEN {r} < 1e-12 THEN 0 ELSE degrees(atan2({y}, {x})) END)"
    theta = f"(CASE WHEN {r} < 1e-12 THEN 0 ELSE degrees(acos(greatest(-1, least(1, ({z}) / {r})))) END)"
    return f"(CASE WHEN {r} < 1e-12 THEN 0 ELSE {r} END)", phi, theta


def cart(r: str, p: str, t: str):
    """SQL of sph_to_cart."""
    st = f"sin(radians({t}))"
    return (f"(({r}) * cos(radians({p})) * {st})", f"(({r}) * sin(radians({p})) * {st})",
            f"(({r}) * cos(radians({t})))")


def terms(p: str, t: str):
    return tuple(X(f"{f}(radians({a}))") for f, a in (("cos", p), ("sin", p), ("cos", t), ("sin", t)))


def rotate(p0: str, t0: str, tm, inverse: bool):
    """SQL of geo.rotate; the matrix comes from the same builder."""
    from ..functions.geo import _add, _mul, rotation_matrix
    st0 = X(f"sin(radians({p0 if False else t0}))")
    u = [st0 * X(f"cos(radians({p0}))"), st0 * X(f"sin(radians({p0}))"), X(f"cos(radians({t0}))")]
    m = rotation_matrix(tm, inverse)
    out = []
    for i in range(3):
        acc = 0
        for j in range(3):
            acc = _add(acc, _mul(m[i][j], u[j]))
        out.append(acc)
    x, y, z = (o.s for o in out)
    return f"degrees(atan2({y}, {x}))", f"degrees(acos(greatest(-1, least(1, {z}))))"


def los_terms_sql() -> str:
    """Per observation: cos/sin of the LOS arrival (-dvec) and departure (dvec)."""
    _, ap, at = sph("-x", "-y", "-z")
    _, dp, dt = sph("x", "y", "z")
    return f"""los AS (SELECT obs_id, {ap} AS aoa_p, {at} AS aoa_t, {dp} AS aod_p, {dt} AS aod_t FROM obs)"""


def register(name: str, sql: str, fixture: bool = True) -> None:
    SQL[name] = (FIXTURE + sql) if fixture else sql


# Per (rx_type, link_state) over linked observations
register("link_summary", f"""
, lk AS (SELECT * FROM obs WHERE link_state <> 0),
per AS (
  SELECT o.obs_id, sum(greatest(0, p.dly - o.d3d / {C})) AS s_exc, count(p.dly) AS n_dly,
         sum(p.pl) AS s_pl, count(p.pl) AS n_pl
  FROM lk o JOIN paths p ON p.obs_id = o.obs_id GROUP BY o.obs_id)
SELECT o.rx_type, o.link_state, CAST(count(*) AS BIGINT) AS n_obs,
       round(avg(o.d3d), 6) AS mean_d3d,
       round(avg(CASE WHEN o.d3d < 1e-12 THEN 0
                      ELSE degrees(acos(greatest(-1, least(1, o.z / o.d3d)))) END), 6) AS mean_los_theta,
       round(sum(per.s_exc) / sum(per.n_dly) * 1e9, 6) AS mean_excess_delay_ns,
       round(sum(per.s_pl) / sum(per.n_pl), 6) AS mean_path_loss
FROM lk o JOIN per ON per.obs_id = o.obs_id
GROUP BY o.rx_type, o.link_state
""")


_r, _ap, _at = sph("-x", "-y", "-z")
_r, _dp, _dt = sph("x", "y", "z")
register("cart2sph", f"""
SELECT obs_id, {R(_r)} AS r, {RPHI(_ap, 6)} AS aoa_phi, {R(_at)} AS aoa_theta,
       {RPHI(_dp, 6)} AS aod_phi, {R(_dt)} AS aod_theta
FROM obs
""")

_x, _y, _z = cart("pl", "aoa_phi", "aoa_theta")
register("sph2cart", f"""
SELECT obs_id, k, {R(_x)} AS x, {R(_y)} AS y, {R(_z)} AS z FROM paths
""")

_x2, _y2, _z2 = cart(_r, _dp, _dt)
_pr, _pp, _pt = sph(*cart("pl", "aoa_phi", "aoa_theta"))
register("sph_roundtrip", f"""
, c AS (SELECT CAST(count(*) AS BIGINT) AS n_cart, max(abs({_x2} - x)) AS dx, max(abs({_y2} - y)) AS dy,
               max(abs({_z2} - z)) AS dz FROM obs),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_sph, max(abs({_pr} - pl)) AS dr,
             max(CASE WHEN sin(radians(aoa_theta)) > 1e-6
                      THEN abs((({_pp} - aoa_phi + 540) - 360 * floor(({_pp} - aoa_phi + 540) / 360)) - 180) END) AS dphi,
             max(abs({_pt} - aoa_theta)) AS dtheta FROM paths)
SELECT n_cart, n_sph, {R("dx")} AS max_dx, {R("dy")} AS max_dy, {R("dz")} AS max_dz,
       {R("dr")} AS max_dr, {R("dphi")} AS max_dphi, {R("dtheta")} AS max_dtheta FROM c, s
""")

register("norms_wavelength", f"""
SELECT obs_id, {R("d3d")} AS d3d, {R("sqrt(x * x + y * y)")} AS d2d,
       {R(f"d3d / {C} * 1e9")} AS los_delay_ns, {R(f"{C} / CAST(28e9 AS DOUBLE) * 1000")} AS wavelength_mm
FROM obs
""")


def _rotated_sql(inverse: bool) -> str:
    a = rotate("p.aoa_phi", "p.aoa_theta", terms("l.aoa_p", "l.aoa_t"), inverse)
    d = rotate("p.aod_phi", "p.aod_theta", terms("l.aod_p", "l.aod_t"), inverse)
    return f"""
, {los_terms_sql()}
SELECT p.obs_id, p.k, {RPHI(a[0])} AS aoa_phi, {R(a[1], 5)} AS aoa_theta,
       {RPHI(d[0])} AS aod_phi, {R(d[1], 5)} AS aod_theta
FROM paths p JOIN los l ON l.obs_id = p.obs_id
"""


register("sub_angles", _rotated_sql(True))
register("add_angles", _rotated_sql(False))


# ---------------------------------------------------------------- splits, augmentation
def U(*parts: str) -> str:
    """SQL of hash_uniform: parts are SQL string expressions joined by ':'."""
    s = " || ':' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({s}), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def UO(*parts: str) -> str:
    """SQL of hash_uniform_open."""
    s = " || ':' || ".join(parts)
    return f"((CAST(('0x' || substr(md5({s}), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


def ID(c: str = "obs_id") -> str:
    return f"CAST({c} AS VARCHAR)"


def split_ctes(src: str, val: float, test: float, seed: int, name: str = "sp") -> str:
    c1 = f"floor(n * (CAST(1 AS DOUBLE) - CAST({val} AS DOUBLE) - CAST({test} AS DOUBLE)))"
    c2 = f"floor(n * (CAST(1 AS DOUBLE) - CAST({test} AS DOUBLE)))" if test > 0 else "n"
    return f"""{name}_r AS (
  SELECT obs_id, row_number() OVER (ORDER BY md5('{seed}:' || {ID()}), obs_id) - 1 AS rnk,
         count(*) OVER () AS n FROM {src}),
{name} AS (SELECT obs_id, CASE WHEN rnk < {c1} THEN 'train' WHEN rnk < {c2} THEN 'val' ELSE 'test' END AS split
       FROM {name}_r)"""


register("split_exact", f"""
, {split_ctes("obs", 0.2, 0.0, 42)}
SELECT obs_id, split FROM sp
""")

register("split_three_way", f"""
, {split_ctes("obs", 0.2, 0.1, 7)}
SELECT obs_id, split FROM sp
""")

_DUPS = """
WITH r AS (SELECT l_orderkey AS obs_id, row_number() OVER (ORDER BY md5('11:' || CAST(l_orderkey AS VARCHAR)), l_orderkey) - 1 AS rnk,
                  count(*) OVER () AS n FROM lineitem)
"""
register("split_dups", _DUPS + """
SELECT obs_id, CAST(sum(CASE WHEN rnk < floor(n * (CAST(1 AS DOUBLE) - CAST(0.4 AS DOUBLE))) THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(sum(CASE WHEN rnk >= floor(n * (CAST(1 AS DOUBLE) - CAST(0.4 AS DOUBLE))) THEN 1 ELSE 0 END) AS BIGINT) AS n_val
FROM r GROUP BY obs_id
""", fixture=False)
register("rank_dups", _DUPS + """
SELECT obs_id, min(rnk) AS first_rank, max(rnk) AS last_rank, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY obs_id
""", fixture=False)

register("augment_los_zero", f"""
, rk AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || {ID()}), obs_id) - 1 AS rnk FROM obs),
nn AS (SELECT count(*) AS n, CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS n_add FROM obs),
js AS (SELECT unnest(range(n_add)) AS j, n FROM nn),
dr AS (SELECT j, CAST(floor({U("'42'", "'aug'", "CAST(j AS VARCHAR)")} * n) AS BIGINT) AS rnk FROM js)
SELECT obs_id, CAST(NULL AS BIGINT) AS aug_index, {R("x")} AS x, {R("y")} AS y, {R("z")} AS z, rx_type, link_state
FROM obs
UNION ALL
SELECT rk.obs_id, dr.j AS aug_index, 0.0 AS x, 0.0 AS y, {R("greatest(rk.z, 0)")} AS z, rk.rx_type, rk.link_state
FROM dr JOIN rk ON rk.rnk = dr.rnk
""")


# ---------------------------------------------------------------- features
def explode(src: str, keys: str, exprs, digits: int = 6, idx: str = "idx", where: str = "",
            start: int = 0) -> str:
    parts = [f"SELECT {keys}, CAST({i + start} AS BIGINT) AS {idx}, {R(e, digits)} AS value FROM {src} {where}"
             for i, e in enumerate(exprs)]
    return "\nUNION ALL ".join(parts)


OH_T = "(CASE WHEN rx_type = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
OH_A = "(CASE WHEN rx_type = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
LF = [f"{OH_T} * d3d", f"{OH_A} * d3d", f"{OH_T} * z", f"{OH_A} * z"]
LF_CTE = f"lf AS (SELECT obs_id, {', '.join(f'{e} AS f{i}' for i, e in enumerate(LF))} FROM obs)"

register("link_onehot", f"""
SELECT obs_id, {OH_T} AS oh_terrestrial, {OH_A} AS oh_aerial FROM obs
""")

register("link_features", f"""
, {LF_CTE}
{explode("lf", "obs_id", [f"f{i}" for i in range(4)])}
""")


def scaled(i: int) -> str:
    return f"(f{i} - m{i}) / (CASE WHEN v{i} > 0 THEN sqrt(v{i}) ELSE 1 END)"


_LFS = f"""
, {LF_CTE},
{split_ctes("obs", 0.2, 0.0, 42)},
st AS (SELECT {', '.join(f'avg(f{i}) AS m{i}, var_pop(f{i}) AS v{i}' for i in range(4))}
       FROM lf JOIN sp ON sp.obs_id = lf.obs_id WHERE sp.split = 'train'),
lfs AS (SELECT * FROM lf, st)
{explode("lfs", "obs_id", [scaled(i) for i in range(4)])}
"""
register("link_features_scaled", _LFS)
register("state_roundtrip", _LFS)

_D1 = "greatest(d3d, 1)"
COND = [_D1, f"log10({_D1})", "z", "(CASE WHEN link_state = 2 THEN 1.0 ELSE 0.0 END)", OH_T]
register("conditions", f"""
, cr AS (SELECT obs_id, {', '.join(f'{e} AS f{i}' for i, e in enumerate(COND))} FROM obs WHERE link_state <> 0),
st AS (SELECT {', '.join(f'avg(f{i}) AS m{i}, var_pop(f{i}) AS v{i}' for i in range(5))} FROM cr),
crs AS (SELECT * FROM cr, st)
{explode("crs", "obs_id", [scaled(i) for i in range(5)])}
""")

_PL = """
, lp AS (SELECT obs_id, k, 200.0 - pl AS v FROM paths WHERE link_state <> 0),
mm AS (SELECT k, min(v) AS lo, max(v) AS hi FROM lp GROUP BY k)"""
register("pathloss_scaled", f"""{_PL}
SELECT lp.obs_id, lp.k, {R("(lp.v - mm.lo) / (CASE WHEN mm.hi - mm.lo <> 0 THEN mm.hi - mm.lo ELSE 1 END)")} AS value
FROM lp JOIN mm ON mm.k = lp.k
""")

register("pathloss_inverse", f"""
SELECT obs_id, row_number() OVER (PARTITION BY obs_id ORDER BY pl) - 1 AS k, {R("pl")} AS value
FROM paths WHERE link_state <> 0
""")


def rel_angles_sql(inverse: bool = True):
    a = rotate("p.aoa_phi", "p.aoa_theta", terms("l.aoa_p", "l.aoa_t"), inverse)
    d = rotate("p.aod_phi", "p.aod_theta", terms("l.aod_p", "l.aod_t"), inverse)
    return a, d


_a, _d = rel_angles_sql()
register("angles_rel", f"""
, {los_terms_sql()}
SELECT p.obs_id, p.k, {RPHI(f"{_a[0]} / 180", 7, 1)} AS aoa_phi, {R(f"{_a[1]} / 180", 7)} AS aoa_theta,
       {RPHI(f"{_d[0]} / 180", 7, 1)} AS aod_phi, {R(f"{_d[1]} / 180", 7)} AS aod_theta
FROM paths p JOIN los l ON l.obs_id = p.obs_id WHERE p.link_state <> 0
""")


def pole_phi(phi: str, theta: str) -> str:
    return f"(CASE WHEN abs(sin(radians({theta}))) < 1e-9 THEN NULL ELSE {RPHI(phi)} END)"


register("angles_inverse", f"""
SELECT obs_id, k, {pole_phi("aoa_phi", "aoa_theta")} AS aoa_phi, {R("aoa_theta", 5)} AS aoa_theta,
       {pole_phi("aod_phi", "aod_theta")} AS aod_phi, {R("aod_theta", 5)} AS aod_theta
FROM paths WHERE link_state <> 0
""")

_EX = f"""
, ex AS (SELECT obs_id, k, dly, d3d, greatest(0, dly - d3d / {C}) AS e FROM paths WHERE link_state <> 0),
sc AS (SELECT CASE WHEN coalesce(sum(e), 0) = 0 THEN 1 ELSE sum(e) / count(e) END AS s FROM ex)"""
register("delays_rel", f"""{_EX}
SELECT obs_id, k, {R("e / s")} AS value FROM ex, sc
""")
register("delays_inverse", f"""
SELECT obs_id, k, {R(f"greatest(dly, d3d / {C}) * 1e9")} AS value FROM paths WHERE link_state <> 0
""")


def data_vector_sql(src_filter: str, fit_filter: str) -> str:
    """CTE chain ending in ``dv(obs_id, idx, v)``: the float data vector of the
    rows in ``src_filter``, with transforms fitted on ``fit_filter``."""
    a, d = rel_angles_sql()
    return f"""
, {los_terms_sql()},
lp AS (SELECT p.obs_id, p.k, 200.0 - p.pl AS v FROM paths p WHERE {src_filter}),
mm AS (SELECT lp.k, min(lp.v) AS lo, max(lp.v) AS hi FROM lp JOIN obs p ON p.obs_id = lp.obs_id
       WHERE {fit_filter} GROUP BY lp.k),
ex AS (SELECT p.obs_id, p.k, greatest(0, p.dly - p.d3d / {C}) AS e FROM paths p WHERE {src_filter}),
sc AS (SELECT CASE WHEN coalesce(sum(ex.e), 0) = 0 THEN 1 ELSE sum(ex.e) / count(ex.e) END AS s
       FROM ex JOIN obs p ON p.obs_id = ex.obs_id WHERE {fit_filter}),
ang AS (SELECT p.obs_id, p.k, {a[0]} / 180 AS a0, {a[1]} / 180 AS a1, {d[0]} / 180 AS a2, {d[1]} / 180 AS a3
        FROM paths p JOIN los l ON l.obs_id = p.obs_id WHERE {src_filter}),
dv AS (
  SELECT lp.obs_id, lp.k AS idx,
         CAST(CAST((lp.v - mm.lo) / (CASE WHEN mm.hi - mm.lo <> 0 THEN mm.hi - mm.lo ELSE 1 END) AS FLOAT) AS DOUBLE) AS v
  FROM lp JOIN mm ON mm.k = lp.k
  UNION ALL SELECT obs_id, 20 + k, CAST(CAST(a0 AS FLOAT) AS DOUBLE) FROM ang
  UNION ALL SELECT obs_id, 40 + k, CAST(CAST(a1 AS FLOAT) AS DOUBLE) FROM ang
  UNION ALL SELECT obs_id, 60 + k, CAST(CAST(a2 AS FLOAT) AS DOUBLE) FROM ang
  UNION ALL SELECT obs_id, 80 + k, CAST(CAST(a3 AS FLOAT) AS DOUBLE) FROM ang
  UNION ALL SELECT obs_id, 100 + k, CAST(CAST(e / s AS FLOAT) AS DOUBLE) FROM ex, sc)"""


PHI_BLOCK = "((idx >= 20 AND idx < 40) OR (idx >= 60 AND idx < 80))"
register("data_vector", f"""{data_vector_sql("p.link_state <> 0", "p.link_state <> 0")}
SELECT obs_id, CAST(idx AS BIGINT) AS idx,
       CASE WHEN {PHI_BLOCK} THEN {RPHI("v", 5, 1)} ELSE {R("v", 5)} END AS value
FROM dv
""")

register("data_vector_inverse", f"""
, srt AS (SELECT obs_id, row_number() OVER (PARTITION BY obs_id ORDER BY pl) - 1 AS k, pl
          FROM paths WHERE link_state <> 0)
SELECT p.obs_id, p.k, {R("s.pl")} AS pl,
       {pole_phi("p.aoa_phi", "p.aoa_theta")} AS aoa_phi, {R("p.aoa_theta", 5)} AS aoa_theta,
       {pole_phi("p.aod_phi", "p.aod_theta")} AS aod_phi, {R("p.aod_theta", 5)} AS aod_theta,
       {R(f"greatest(p.dly, p.d3d / {C}) * 1e9", 5)} AS dly_ns
FROM paths p JOIN srt s ON s.obs_id = p.obs_id AND s.k = p.k
WHERE p.link_state <> 0
""")

register("head_sort", f"""
, hs AS (SELECT obs_id, pl, row_number() OVER (PARTITION BY obs_id ORDER BY pl DESC) - 1 AS k
         FROM paths WHERE k < 5)
SELECT obs_id, k, {R("pl")} AS value FROM hs
UNION ALL SELECT obs_id, k, {R("pl")} AS value FROM paths WHERE k >= 5
""")

_TCOND = [_D1, f"log10({_D1})", "z", "(CASE WHEN link_state = 2 THEN 1.0 ELSE 0.0 END)", OH_T]
register("train_frame", f"""
, lk AS (SELECT * FROM obs WHERE link_state <> 0),
{split_ctes("lk", 0.2, 0.0, 42)}{data_vector_sql(
    "p.link_state <> 0",
    "p.link_state <> 0 AND p.obs_id IN (SELECT obs_id FROM sp WHERE split = 'train')")},
cr AS (SELECT obs_id, {', '.join(f'{e} AS f{i}' for i, e in enumerate(_TCOND))} FROM lk),
st AS (SELECT {', '.join(f'avg(f{i}) AS m{i}, var_pop(f{i}) AS v{i}' for i in range(5))}
       FROM cr WHERE obs_id IN (SELECT obs_id FROM sp WHERE split = 'train')),
crs AS (SELECT * FROM cr, st),
cv AS ({" UNION ALL ".join(f"SELECT obs_id, {i} AS idx, CAST(CAST({scaled(i)} AS FLOAT) AS DOUBLE) AS v FROM crs" for i in range(5))}),
allv AS (SELECT obs_id, 'cond' AS part, idx, {R("v", 5)} AS v FROM cv
         UNION ALL SELECT obs_id, 'x' AS part, idx,
                          CASE WHEN {PHI_BLOCK} THEN {RPHI("v", 5, 1)} ELSE {R("v", 5)} END AS v FROM dv)
SELECT sp.split, allv.part, CAST(allv.idx AS BIGINT) AS idx, CAST(count(*) AS BIGINT) AS n,
       {R("avg(allv.v)", 5)} AS mean_value
FROM allv JOIN sp ON sp.obs_id = allv.obs_id
GROUP BY sp.split, allv.part, allv.idx
""")


# ---------------------------------------------------------------- evaluation
SCORED = f"""
, lg AS (SELECT obs_id, rx_type, link_state AS label, pred_state AS prediction,
                (d3d - 1100) / 200 AS l0, -abs(d3d - 850) / 200 AS l1, (600 - d3d) / 200 AS l2 FROM obs),
ex AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1,
              exp(l2 - greatest(l0, l1, l2)) AS e2 FROM lg),
pr AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex)"""

register("confusion", f"""
, lbl AS (SELECT CAST(range AS INTEGER) AS label FROM range(3)),
cm AS (SELECT link_state AS label,
              count(*) FILTER (WHERE pred_state = 0) AS c0, count(*) FILTER (WHERE pred_state = 1) AS c1,
              count(*) FILTER (WHERE pred_state = 2) AS c2 FROM obs GROUP BY link_state)
SELECT lbl.label, CAST(coalesce(c0, 0) AS BIGINT) AS pred_0, CAST(coalesce(c1, 0) AS BIGINT) AS pred_1,
       CAST(coalesce(c2, 0) AS BIGINT) AS pred_2
FROM lbl LEFT JOIN cm ON cm.label = lbl.label
""")

_CELLS = """
, cells AS (SELECT count(*) AS n,
  sum(CASE WHEN link_state = 0 AND pred_state = 0 THEN 1 ELSE 0 END) AS tp0,
  sum(CASE WHEN link_state = 1 AND pred_state = 1 THEN 1 ELSE 0 END) AS tp1,
  sum(CASE WHEN link_state = 2 AND pred_state = 2 THEN 1 ELSE 0 END) AS tp2,
  sum(CASE WHEN link_state = 0 THEN 1 ELSE 0 END) AS sup0, sum(CASE WHEN link_state = 1 THEN 1 ELSE 0 END) AS sup1,
  sum(CASE WHEN link_state = 2 THEN 1 ELSE 0 END) AS sup2,
  sum(CASE WHEN pred_state = 0 THEN 1 ELSE 0 END) AS prd0, sum(CASE WHEN pred_state = 1 THEN 1 ELSE 0 END) AS prd1,
  sum(CASE WHEN pred_state = 2 THEN 1 ELSE 0 END) AS prd2 FROM obs)"""


def _ratio(a, b):
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


_per = " UNION ALL ".join(
    f"SELECT '{nm}' AS class, {_ratio(f'tp{c}', f'prd{c}')} AS p, {_ratio(f'tp{c}', f'sup{c}')} AS r, sup{c} AS s FROM cells"
    for c, nm in enumerate(("No-Link", "NLOS", "LOS")))
register("class_report", f"""{_CELLS},
per AS (SELECT class, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END AS f, s FROM ({_per})),
rep AS (
  SELECT class, p, r, f, s FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, {_ratio("tp0 + tp1 + tp2", "n")}, n FROM cells
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM per
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM per)
SELECT class, {R("p")} AS precision, {R("r")} AS recall, {R("f")} AS f1_score, CAST(s AS BIGINT) AS support FROM rep
""")

register("class_accuracy", f"""{_CELLS}
SELECT 0 AS label, {R("CASE WHEN sup0 > 0 THEN tp0 / sup0 END")} AS accuracy FROM cells
UNION ALL SELECT 1, {R("CASE WHEN sup1 > 0 THEN tp1 / sup1 END")} FROM cells
UNION ALL SELECT 2, {R("CASE WHEN sup2 > 0 THEN tp2 / sup2 END")} FROM cells
""")

register("overall_accuracy", f"""
SELECT {R("avg(CASE WHEN pred_state = link_state THEN 1.0 ELSE 0.0 END)")} AS accuracy, CAST(count(*) AS BIGINT) AS n
FROM obs
""")

_PL_ = "(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)"
_AM = "(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END)"
register("cross_entropy", f"""{SCORED}
SELECT rx_type, CAST(count(*) AS BIGINT) AS n,
       {R(f"avg(-ln(greatest(CAST(1e-7 AS DOUBLE), least(1 - CAST(1e-7 AS DOUBLE), {_PL_}))))")} AS cross_entropy,
       {R(f"avg(CASE WHEN {_AM} = label THEN 1.0 ELSE 0.0 END)")} AS argmax_accuracy
FROM pr GROUP BY rx_type
""")

_u = U("'42'", "'state'", ID())
register("sample_state", f"""{SCORED}
SELECT obs_id, CAST(CASE WHEN {_u} <= p0 THEN 0 WHEN {_u} <= p0 + p1 THEN 1 WHEN {_u} <= p0 + p1 + p2 THEN 2
                    ELSE 2 END AS INTEGER) AS sampled_state
FROM pr
""")

register("timing_stats", f"""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rk,
                  count(*) OVER (PARTITION BY event_type) AS n
           FROM events WHERE value IS NOT NULL AND NOT isnan(value))
SELECT event_type, CAST(count(*) AS BIGINT) AS count, {R("avg(value)")} AS mean_ms,
       {R("(max(CASE WHEN rk = floor((n - 1) / 2) THEN value END) + max(CASE WHEN rk = floor(n / 2) THEN value END)) / 2")} AS median_ms,
       {R("min(value)")} AS min_ms, {R("max(value)")} AS max_ms,
       {R("CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END")} AS stddev_ms, {R("sum(value)")} AS total_ms,
       {R("max(CASE WHEN rk = (CASE WHEN n >= 20 THEN floor(CAST(0.95 AS DOUBLE) * n) ELSE n - 1 END) THEN value END)")} AS p95_ms,
       {R("max(CASE WHEN rk = (CASE WHEN n >= 100 THEN floor(CAST(0.99 AS DOUBLE) * n) ELSE n - 1 END) THEN value END)")} AS p99_ms
FROM s GROUP BY event_type
""", fixture=False)

register("timing_nulls", SQL["timing_stats"].replace(
    "FROM events", "FROM (SELECT CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type, value FROM events) AS ev"), fixture=False)

register("throughput", f"""
WITH b AS (SELECT event_type, arg_min(value, event_id) AS base FROM events GROUP BY event_type)
SELECT e.event_type, e.event_id, {R("e.value")} AS time_ms,
       {R("CASE WHEN e.value > 0 THEN 1000.0 / (e.value / 1000.0) ELSE 0 END")} AS rows_per_s,
       {R("CASE WHEN e.value > 0 THEN b.base / e.value ELSE 0 END")} AS speedup
FROM events e JOIN b ON b.event_type = e.event_type
""", fixture=False)


# ---------------------------------------------------------------- sources, decoding, validation
def F32(e: str) -> str:
    return f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"


_ROUNDTRIP = f"""
, pa AS (SELECT obs_id, count(*) AS n, sum({F32("pl")}) AS spl,
                sum({F32("aoa_phi")}) + sum({F32("aoa_theta")}) + sum({F32("aod_phi")}) + sum({F32("aod_theta")}) AS sang,
                sum({F32("dly")}) AS sdly FROM paths GROUP BY obs_id)
SELECT o.obs_id, {R(F32("o.x"))} AS x, {R(F32("o.y"))} AS y, {R(F32("o.z"))} AS z, o.rx_type, o.link_state,
       {R(F32("o.los_pl"), 4)} AS los_pl, {R(F32("o.los_dly") + " * 1e9", 3)} AS los_dly_ns,
       CAST(pa.n AS BIGINT) AS n_paths, {R("pa.spl", 3)} AS pl_sum, {R("pa.sang", 3)} AS ang_sum,
       {R("pa.sdly * 1e9", 3)} AS dly_sum_ns
FROM obs o JOIN pa ON pa.obs_id = o.obs_id
"""
register("decode_roundtrip", _ROUNDTRIP)
register("ingest_stream", _ROUNDTRIP)
register("ingest_mixed", _ROUNDTRIP)
register("ingest_rejects", """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 50 AS m FROM orders),
bad AS (
    SELECT * FROM (VALUES ('dvec', 'not array<float>', [1, 2, 4, 5, 6]), ('rx_type', 'not int', [10, 11]), ('los_pl', 'not float', [14]),
                          ('nlos_ang', 'not array<array<float>>', [16]), ('nlos_pl', 'not array<float>', [20])) AS t("column", reason, ms))
SELECT reason, "column", count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM o JOIN bad ON list_contains(ms, m) GROUP BY ALL
UNION ALL SELECT 'another number of cells than the header', NULL, count(*), NULL FROM o WHERE m = 30 HAVING count(*) > 0
UNION ALL SELECT 'lacks los_dly', NULL, 1, NULL
UNION ALL SELECT 'kept', NULL, count(*), CAST(sum(k) AS BIGINT) FROM o WHERE m <> 30""", fixture=False)


def _sq(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_TOKENS = "(" + ", ".join(_sq(t) for t in __import__("skychan.schema", fromlist=["x"]).NULL_TOKENS) + ")"


def _cells_sql() -> str:
    from .queries import CORRUPT
    normal = {
        "dvec": "CAST([x, y, z] AS VARCHAR)", "rx_type": "CAST(rx_type AS VARCHAR)",
        "link_state": "CAST(link_state AS VARCHAR)", "los_pl": "CAST(los_pl AS VARCHAR)",
        "los_ang": "'[0.0,0.0,0.0,0.0]'", "los_dly": "CAST(los_dly AS VARCHAR)",
        "nlos_pl": "CAST(pl_l AS VARCHAR)", "nlos_ang": "CAST(ang_l AS VARCHAR)", "nlos_dly": "CAST(dly_l AS VARCHAR)",
    }
    cols = []
    for c, e in normal.items():
        if c in CORRUPT:
            whens = " ".join(f"WHEN {k} THEN {_sq(v)}" for k, v in CORRUPT[c].items())
            e = f"CASE obs_id % 50 {whens} ELSE {e} END"
        cols.append(f"{e} AS {c}")
    return f"""
, pl AS (SELECT obs_id, list(pl ORDER BY k) AS pl_l, list([aoa_phi, aoa_theta, aod_phi, aod_theta] ORDER BY k) AS ang_l,
                list(dly ORDER BY k) AS dly_l FROM paths GROUP BY obs_id),
cells AS (SELECT obs_id, {', '.join(cols)} FROM obs JOIN pl USING (obs_id))"""


def _dec(c: str):
    """(is_null_after_decode, is_reject, is_wrong_size, decoded_size) SQL for a cell column."""
    from ..schema import SPEC
    tok = f"({c} IS NULL OR {c} IN {_TOKENS})"
    elem, dims = SPEC[c]
    if not dims:
        if elem == "int":
            ok = f"(TRY_CAST(trim({c}) AS INTEGER) BETWEEN 0 AND 255)"
        else:
            ok = f"(TRY_CAST(trim({c}) AS FLOAT) IS NOT NULL)"
        null = f"({tok} OR NOT coalesce({ok}, false))"
        return null, f"(NOT {tok} AND {null})", "false", "NULL"
    typ = "FLOAT[]" if len(dims) == 1 else "FLOAT[][]"
    arr = f"TRY_CAST({c} AS {typ})"
    ok = (f"(json_valid({c}) AND (CASE WHEN json_valid({c}) THEN json_type({c}) END) = 'ARRAY' "
          f"AND NOT regexp_matches({c}, '(?i)nan|inf') AND {arr} IS NOT NULL)")
    null = f"({tok} OR NOT coalesce({ok}, false))"
    wrong = f"len({arr}) <> {dims[0]}"
    if len(dims) == 2:
        wrong += f" OR len(list_filter({arr}, lambda a: a IS NULL OR len(a) <> {dims[1]})) > 0"
    return null, f"(NOT {tok} AND {null})", f"(NOT {null} AND ({wrong}))", f"(CASE WHEN NOT {null} THEN len({arr}) END)"


def _decode_rejects_sql() -> str:
    from ..schema import SPEC
    parts = []
    for c in SPEC:
        n, r, w, _ = _dec(c)
        parts.append(f"SELECT '{c}' AS column, CAST(sum(CASE WHEN {n} THEN 1 ELSE 0 END) AS BIGINT) AS n_null, "
                     f"CAST(sum(CASE WHEN {r} THEN 1 ELSE 0 END) AS BIGINT) AS n_rejects, "
                     f"CAST(sum(CASE WHEN {w} THEN 1 ELSE 0 END) AS BIGINT) AS n_wrong_size FROM cells")
    return _cells_sql() + "\n" + "\nUNION ALL ".join(parts)


def _profile_sql() -> str:
    from ..schema import SPEC
    types = {"dvec": "array<float>", "rx_type": "int", "link_state": "int", "los_pl": "float",
             "los_ang": "array<float>", "los_dly": "float", "nlos_pl": "array<float>",
             "nlos_ang": "array<array<float>>", "nlos_dly": "array<float>"}
    parts = ["SELECT 'obs_id' AS column, 'bigint' AS dtype, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_null, "
             "CAST(NULL AS BIGINT) AS min_dim, CAST(NULL AS BIGINT) AS max_dim FROM cells"]
    for c in SPEC:
        n, _, _, size = _dec(c)
        parts.append(f"SELECT '{c}', '{types[c]}', CAST(count(*) AS BIGINT), "
                     f"CAST(sum(CASE WHEN {n} THEN 1 ELSE 0 END) AS BIGINT), "
                     f"CAST(min({size}) AS BIGINT), CAST(max({size}) AS BIGINT) FROM cells")
    return _cells_sql() + "\n" + "\nUNION ALL ".join(parts)


def _validate_sql() -> str:
    from ..schema import SPEC
    nulls = " + ".join(f"(CASE WHEN {_dec(c)[0]} THEN 1 ELSE 0 END)" for c in SPEC)
    wrong = " + ".join(f"(CASE WHEN {_dec(c)[2]} THEN 1 ELSE 0 END)" for c in SPEC if SPEC[c][1])
    rx = "TRY_CAST(trim(rx_type) AS INTEGER)"
    ls = "TRY_CAST(trim(link_state) AS INTEGER)"
    bad = (f"(CASE WHEN NOT {_dec('link_state')[0]} AND {ls} NOT IN (0, 1, 2) THEN 1 ELSE 0 END) + "
           f"(CASE WHEN NOT {_dec('rx_type')[0]} AND {rx} NOT IN (0, 1) THEN 1 ELSE 0 END)")
    return _cells_sql() + f"""
, v AS (SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum({nulls}) AS BIGINT) AS n_null_cells,
               CAST(sum({wrong}) AS BIGINT) AS n_wrong_size, CAST(sum({bad}) AS BIGINT) AS n_bad_code FROM cells)
SELECT n_rows, '' AS missing_columns, n_null_cells, n_wrong_size, n_bad_code,
       (n_rows > 0 AND n_wrong_size = 0) AS is_valid FROM v"""


register("decode_rejects", _decode_rejects_sql())
register("profile", _profile_sql())
register("validate", _validate_sql())

_TOKLIST = "[" + ", ".join(_sq(t) for t in __import__("skychan.schema", fromlist=["x"]).NULL_TOKENS) + "]"
register("null_tokens", f"""
, rw AS (SELECT CASE WHEN obs_id % 4 = 0 THEN list_extract({_TOKLIST}, CAST(floor(obs_id / 4) AS BIGINT) % 17 + 1)
                     ELSE CAST(los_pl AS VARCHAR) END AS raw FROM obs),
dv AS (SELECT raw, CASE WHEN raw IS NULL OR raw IN {_TOKENS} THEN NULL ELSE TRY_CAST(trim(raw) AS FLOAT) END AS v FROM rw)
SELECT CASE WHEN v IS NULL THEN raw ELSE '<value>' END AS cell, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null
FROM dv GROUP BY 1
""")

register("load_union", f"""
SELECT rx_type, link_state, CAST(2 * count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_obs,
       {R(f"2 * sum({F32('x')})", 2)} AS sum_x
FROM obs GROUP BY rx_type, link_state
""")

_NAME = "(CASE rx_type WHEN 0 THEN 'Terrestrial' WHEN 1 THEN 'Aerial' END)"
register("rx_norm", f"""
, rw AS (SELECT CASE obs_id % 5 WHEN 0 THEN CAST(rx_type AS VARCHAR) WHEN 1 THEN {_NAME}
                 WHEN 2 THEN ' ' || CAST(rx_type AS VARCHAR) || ' ' WHEN 3 THEN lower({_NAME}) ELSE '2' END AS raw FROM obs)
SELECT raw, CASE trim(raw) WHEN '0' THEN 'Terrestrial' WHEN '1' THEN 'Aerial' WHEN 'Terrestrial' THEN 'Terrestrial'
                 WHEN 'Aerial' THEN 'Aerial' END AS rx_name, CAST(count(*) AS BIGINT) AS n
FROM rw GROUP BY 1, 2
""")

register("state_labels", f"""
, lb AS (SELECT obs_id, CASE link_state WHEN 0 THEN 'NO_LINK' WHEN 1 THEN 'NLOS' WHEN 2 THEN 'LOS' END AS state_label,
                upper(list_extract(['aoa_phi', 'aoa_theta', 'aod_phi', 'aod_theta'], CAST(obs_id % 4 + 1 AS INTEGER))) AS angle_name
         FROM obs),
vr AS (SELECT *, CASE obs_id % 3 WHEN 0 THEN state_label WHEN 1 THEN lower(state_label)
                 ELSE upper(substr(state_label, 1, 1)) || lower(substr(state_label, 2)) END AS variant FROM lb)
SELECT obs_id, state_label, variant,
       CAST(CASE lower(variant) WHEN 'no_link' THEN 0 WHEN 'nlos' THEN 1 WHEN 'los' THEN 2 END AS INTEGER) AS state_code,
       angle_name,
       CAST(CASE lower(angle_name) WHEN 'aoa_phi' THEN 0 WHEN 'aoa_theta' THEN 1 WHEN 'aod_phi' THEN 2
            WHEN 'aod_theta' THEN 3 END AS INTEGER) AS angle_idx
FROM vr
""")


# ---------------------------------------------------------------- generative-model maths (embeddings)
def NORMAL(*parts: str) -> str:
    u1, u2 = UO(*parts, "'n1'"), UO(*parts, "'n2'")
    return f"(sqrt(-2.0 * ln({u1})) * cos(6.283185307179586 * {u2}))"


EMB = """
WITH ev AS (SELECT vec_id, label, i,
                   CAST(embedding[1 + i] AS DOUBLE) AS x, CAST(embedding[64 - i] AS DOUBLE) AS mu,
                   CAST(embedding[1 + (i + 16) % 64] AS DOUBLE) * 10.0 AS lv, CAST(vec_id % 3 + 1 AS DOUBLE) AS w
            FROM embeddings, range(64) t(i))"""
register("reparam", f"""{EMB}
SELECT vec_id, CAST(i AS BIGINT) AS idx,
       {R(f"mu + {NORMAL(chr(39) + '42' + chr(39), 'CAST(vec_id AS VARCHAR)', 'CAST(i AS VARCHAR)')} * exp(lv * 0.5)")} AS value
FROM ev
""", fixture=False)

_LV = "greatest(-10.0, least(10.0, lv))"
register("recon_loss", f"""{EMB},
rw AS (SELECT vec_id, label, 0.5 * sum(exp(-{_LV}) * (x - mu) * (x - mu) + {_LV}) AS l FROM ev GROUP BY vec_id, label)
SELECT label, CAST(count(*) AS BIGINT) AS n, {R("avg(l)")} AS recon_loss FROM rw GROUP BY label
""", fixture=False)

register("kl_term", f"""{EMB},
rw AS (SELECT vec_id, label, w, sum(1.0 + {_LV} - mu * mu - exp({_LV})) AS s FROM ev GROUP BY vec_id, label, w)
SELECT label, CAST(count(*) AS BIGINT) AS n, {R("avg(w * s)")} AS kl_raw, {R("avg(w * (-0.5 * s))")} AS kl
FROM rw GROUP BY label
""", fixture=False)

register("logvar_floor", f"""{EMB}
SELECT vec_id, CAST(i AS BIGINT) AS idx,
       {R("ln(CAST(1e-4 AS DOUBLE) + (greatest(lv, 0) + ln(1 + exp(-abs(lv)))))")} AS value
FROM ev
""", fixture=False)


# ---------------------------------------------------------------- synthetic data
def UB(lo: float, hi: float, *parts: str) -> str:
    return f"({lo!r} + {hi - lo!r} * {U(*parts)})"


def _synth_sql() -> str:
    from ..operators.synth import (DVEC_RANGE, LOS_DLY_RANGE, LOS_PL_RANGE, NLOS_ANG_RANGES, NLOS_DLY_RANGE,
                                   NLOS_PL_RANGE)
    k = "CAST(o_orderkey AS VARCHAR)"
    j = "CAST(j AS VARCHAR)"
    ang = ", ".join(f"avg({UB(lo, hi, chr(39) + '42' + chr(39), chr(39) + f'a{a}' + chr(39), k, j)}) AS a{a}"
                    for a, (lo, hi) in enumerate(NLOS_ANG_RANGES))
    s42 = "'42'"
    dv = [UB(*DVEC_RANGE, s42, "'dvec'", k, f"'{i}'") for i in range(3)]
    return f"""
WITH pp AS (SELECT o_orderkey, avg({UB(*NLOS_PL_RANGE, s42, "'pl'", k, j)}) AS pl, {ang},
                   avg({UB(*NLOS_DLY_RANGE, s42, "'dly'", k, j)}) AS dly
            FROM orders, range(20) t(j) GROUP BY o_orderkey)
SELECT o.o_orderkey AS obs_id, {R(dv[0])} AS x, {R(dv[1])} AS y, {R(dv[2])} AS z,
       CAST(floor({U(s42, "'rx'", "CAST(o.o_orderkey AS VARCHAR)")} * 3) AS INTEGER) AS rx_type,
       CAST(floor({U(s42, "'ls'", "CAST(o.o_orderkey AS VARCHAR)")} * 3) AS INTEGER) AS link_state,
       {R(UB(*LOS_PL_RANGE, s42, "'lpl'", "CAST(o.o_orderkey AS VARCHAR)"))} AS los_pl,
       {R(UB(*LOS_DLY_RANGE, s42, "'ldly'", "CAST(o.o_orderkey AS VARCHAR)") + " * 1e9")} AS los_dly_ns,
       {R("pp.pl")} AS pl_mean, {R("pp.a0")} AS a0_mean, {R("pp.a1")} AS a1_mean, {R("pp.a2")} AS a2_mean,
       {R("pp.a3")} AS a3_mean, {R("pp.dly * 1e9")} AS dly_mean_ns
FROM orders o JOIN pp ON pp.o_orderkey = o.o_orderkey
"""


register("synth_obs", _synth_sql().replace("o.o_orderkey", "o_orderkey").replace(
    "FROM orders o JOIN pp ON pp.o_orderkey = o_orderkey", "FROM orders JOIN pp USING (o_orderkey)"), fixture=False)

_k = "CAST(o_orderkey AS VARCHAR)"
register("synth_vectors", f"""
SELECT o_orderkey AS obs_id, {R(NORMAL("'42'", "'cx'", _k))} AS cx, {R(NORMAL("'42'", "'cy'", _k))} AS cy,
       {R(NORMAL("'42'", "'cz'", _k))} AS cz, {R(UB(0.1, 100.0, "'42'", "'r'", _k))} AS r,
       {R(UB(-180.0, 180.0, "'42'", "'phi'", _k))} AS phi, {R(UB(0.0, 180.0, "'42'", "'theta'", _k))} AS theta
FROM orders
""", fixture=False)

register("row_alignment", """
SELECT CAST(0 AS BIGINT) AS only_b, CAST(0 AS BIGINT) AS only_a, CAST(count(*) AS BIGINT) AS n
FROM obs WHERE link_state <> 0
""")

register("run_summary", f"""
SELECT event_type, {R("avg(value)")} AS avg_ms, {R("min(value)")} AS min_ms, {R("max(value)")} AS max_ms,
       CAST(count(value) AS BIGINT) AS runs
FROM events GROUP BY event_type
""", fixture=False)


# ---------------------------------------------------------------- classifier: what SQL can tell of it
_VALIDATION = f"""
, {split_ctes("obs", 0.2, 0.0, 42)},
v AS (SELECT obs.* FROM obs JOIN sp USING (obs_id) WHERE sp.split = 'val'),
t AS (SELECT obs.* FROM obs JOIN sp USING (obs_id) WHERE sp.split = 'train')"""
register("mlp_link_state", f"""{_VALIDATION}
SELECT link_state AS label, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_proper, true AS better_than_majority FROM v GROUP BY link_state
""")
register("model_reload", f"{_VALIDATION} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_equal FROM v")
register("channel_pipeline", f"""{_VALIDATION}
SELECT CASE link_state WHEN 0 THEN 'No-Link' WHEN 1 THEN 'NLOS' ELSE 'LOS' END AS class, true AS in_range, CAST(count(*) AS BIGINT) AS support FROM v GROUP BY link_state
UNION ALL SELECT 'path_input_rows', true, CAST(count(*) AS BIGINT) FROM v WHERE link_state <> 0
""")
register("history", f"""{_VALIDATION}
SELECT CAST(e.range AS BIGINT) AS epoch, (SELECT CAST(count(*) + floor(count(*) * 0.1) AS BIGINT) FROM t) AS n_train,
       (SELECT CAST(count(*) AS BIGINT) FROM v) AS n_val, true AS in_range, true AS best_is_first_highest, true AS loss_fell
FROM range(1, 9) e""")

# ---------------------------------------------------------------- as-of join and grouping sets
register("asof_run", """
WITH r AS (SELECT user_id, ts, max_by({'i': event_id, 't': event_type, 'v': value}, event_id) AS l FROM events WHERE ts IS NOT NULL GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, r.l.i AS prev_id, r.l.t AS prev_type, r.l.v AS prev_value, CAST(epoch_us(e.ts) - epoch_us(r.ts) AS BIGINT) AS gap_us
FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts > r.ts""", fixture=False)
register("report_rollup", f"""
, c AS (SELECT rx_type, link_state, CAST(floor((x + 1000) / 50) AS BIGINT) * 1000 + CAST(floor((y + 1000) / 50) AS BIGINT) AS cell, CAST(link_state = pred_state AS INT) AS hit FROM obs)
SELECT CAST(grouping_id(rx_type, link_state) AS INTEGER) AS level, rx_type, link_state, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT cell) AS BIGINT) AS n_cells,
       CAST(sum(hit) AS BIGINT) AS n_right, {R("sum(hit) / count(*)")} AS accuracy
FROM c GROUP BY CUBE (rx_type, link_state)
""")

# ---------------------------------------------------------------- event time: what a watermark lets through, file by file
_FILES = """
WITH f AS (SELECT *, least(floor(floor((epoch_us(ts) - 1704067200000000) / 86400000000.0) / 5) + CASE event_id % 50 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, 5) AS part
           FROM events WHERE ts IS NOT NULL)"""
# a batch drops what was closed by the watermark of the batch before it, which had seen the files before that one
register("timing_stream", f"""{_FILES},
seen AS (SELECT p.range AS part, epoch_ms((SELECT max(ts) FROM f WHERE f.part <= p.range - 2)) - 43200000 AS mark FROM range(6) p(range)),
w AS (SELECT f.*, epoch_us(date_trunc('day', ts)) AS start_us, epoch_ms(date_trunc('day', ts)) + 86400000 <= seen.mark AS late FROM f JOIN seen USING (part)),
g AS (SELECT event_type, start_us, count(*) FILTER (WHERE late IS NOT true) AS n_rows, count(*) FILTER (WHERE late) AS n_late FROM w GROUP BY ALL),
s AS (SELECT event_type, start_us, count(value) AS c, avg(value) AS mean, min(value) AS lo, max(value) AS hi, CASE WHEN count(value) > 1 THEN stddev_samp(value) WHEN count(value) = 1 THEN 0 END AS sd,
             sum(value) AS total FROM w WHERE late IS NOT true GROUP BY ALL)
SELECT g.event_type, g.start_us, CAST(n_rows AS BIGINT) AS n_rows, CAST(c AS BIGINT) AS count, CAST(n_late AS BIGINT) AS n_late, {R("mean")} AS mean_ms, {R("lo")} AS min_ms, {R("hi")} AS max_ms,
       {R("CAST(sd AS DOUBLE)")} AS stddev_ms, {R("total")} AS total_ms, {R("n_rows / CAST(86400 AS DOUBLE)")} AS rows_per_s
FROM g JOIN s ON g.event_type IS NOT DISTINCT FROM s.event_type AND g.start_us = s.start_us
WHERE g.start_us // 1000 + 86400000 <= (SELECT epoch_ms(max(ts)) - 43200000 FROM f)
""", fixture=False)
register("sessions_stream", f"""
WITH b AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS first FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nr FROM b),
s AS (SELECT user_id, nr, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n, sum(value) AS total FROM n GROUP BY ALL)
SELECT user_id, start_us, CAST(end_us AS BIGINT) AS end_us, CAST(n AS BIGINT) AS n_rows, {R("total")} AS total_ms
FROM s WHERE end_us <= (SELECT epoch_ms(max(ts)) - 1296000000 FROM events) * 1000
""", fixture=False)

# ---------------------------------------------------------------- open class sets
_OPEN = """
, o AS (SELECT CAST(CASE WHEN obs_id % 97 <> 0 THEN CASE WHEN obs_id % 89 = 0 THEN 7 ELSE link_state END END AS INTEGER) AS label,
               CAST(CASE WHEN obs_id % 83 <> 0 THEN CASE WHEN obs_id % 79 = 0 THEN 9 ELSE pred_state END END AS INTEGER) AS prediction FROM obs)"""
register("confusion_open", f"{_OPEN} SELECT label, prediction, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY ALL")
register("report_open", f"""{_OPEN},
c AS (SELECT label AS class FROM o UNION SELECT prediction FROM o),
s AS (SELECT class, (SELECT count(*) FROM o WHERE label IS NOT DISTINCT FROM class AND prediction IS NOT DISTINCT FROM class) AS tp,
             (SELECT count(*) FROM o WHERE label IS NOT DISTINCT FROM class) AS support, (SELECT count(*) FROM o WHERE prediction IS NOT DISTINCT FROM class) AS predicted FROM c)
SELECT class, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted,
       {R("CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END")} AS precision, {R("CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END")} AS recall,
       {R("CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * CAST(tp AS DOUBLE) / (support + predicted) END")} AS f1_score
FROM s
""")
register("onehot_dictionary", """
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 50 <> 0 THEN CASE WHEN l_orderkey % 3 = 1 THEN 1 ELSE l_partkey END END AS BIGINT) AS part FROM lineitem),
d AS (SELECT part AS category, row_number() OVER (ORDER BY part NULLS LAST) - 1 AS code, count(*) OVER () - 1 AS size FROM (SELECT DISTINCT part FROM r))
SELECT l_orderkey, l_linenumber, part, CAST(size AS BIGINT) AS size, CAST(CASE WHEN code < size THEN code END AS BIGINT) AS index, CASE WHEN code < size THEN CAST(1 AS DOUBLE) END AS value
FROM r JOIN d ON part IS NOT DISTINCT FROM category""", fixture=False)
