"""Geometry as native column expressions.

Angles are in degrees at the interface and radians inside. phi is the azimuth
``atan2(y, x)``, theta the polar angle from +z. Every helper takes and returns
``Column`` objects, so it works on flat columns and inside ``transform`` lambdas.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LIGHT_SPEED, ZERO_EPS


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def norm3(x, y, z) -> Column:
    """3-D Euclidean norm (G1)."""
    x, y, z = _c(x), _c(y), _c(z)
    return F.sqrt(x * x + y * y + z * z)


def hnorm(x, y) -> Column:
    """Horizontal norm of the first two components (G1, draft variant)."""
    x, y = _c(x), _c(y)
    return F.sqrt(x * x + y * y)


def clip(c, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (greatest/least would skip it)."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def clip_unit(c) -> Column:
    """Clamp to [-1, 1] before acos."""
    return clip(c, -1.0, 1.0)


def canon_phi(phi, full: float = 180.0) -> Column:
    """Map the branch-cut value -full to +full, so phi lies in (-full, full].

    Apply it after rounding, when comparing engines."""
    phi = _c(phi)
    return F.when(phi == -full, F.lit(full)).otherwise(phi)


def cart_to_sph(x, y, z):
    """Cartesian -> (r, phi_deg, theta_deg); the zero vector maps to (0, 0, 0)."""
    x, y, z = _c(x), _c(y), _c(z)
    r = norm3(x, y, z)
    zero = r < ZERO_EPS
    phi = F.when(zero, F.lit(0.0)).otherwise(F.degrees(F.atan2(y, x)))
    theta = F.when(zero, F.lit(0.0)).otherwise(F.degrees(F.acos(clip_unit(z / r))))
    return F.when(zero, F.lit(0.0)).otherwise(r), phi, theta


def sph_to_cart(r, phi_deg, theta_deg):
    """(r, phi_deg, theta_deg) -> Cartesian (G4). Scalars broadcast as literals."""
    r = _c(r)
    p, t = F.radians(_c(phi_deg)), F.radians(_c(theta_deg))
    st = F.sin(t)
    return r * F.cos(p) * st, r * F.sin(p) * st, r * F.cos(t)


def vec_elems(arr) -> tuple:
    """(x, y, z) of a 3-vector array column."""
    arr = _c(arr) if not isinstance(arr, str) else F.col(arr)
    return tuple(F.try_element_at(arr, F.lit(i)) for i in (1, 2, 3))


def los_directions(dvec):
    """LOS arrival and departure directions of a Tx->Rx vector.

    Arrival looks back along -dvec, departure along dvec. Returns
    ``(aoa_phi, aoa_theta, aod_phi, aod_theta)`` in degrees."""
    x, y, z = vec_elems(dvec)
    _, aoa_p, aoa_t = cart_to_sph(-x, -y, -z)
    _, aod_p, aod_t = cart_to_sph(x, y, z)
    return aoa_p, aoa_t, aod_p, aod_t


def rotation_terms(phi_deg, theta_deg):
    """cos/sin of a reference direction; project these as columns once per row
    and reuse them for all paths of the row (G5)."""
    p, t = F.radians(_c(phi_deg)), F.radians(_c(theta_deg))
    return F.cos(p), F.sin(p), F.cos(t), F.sin(t)


def _mul(a, b):
    if isinstance(a, int) and a == 0 or isinstance(b, int) and b == 0:
        return 0
    if isinstance(a, int) and a == 1:
        return b
    if isinstance(b, int) and b == 1:
        return a
    return a * b


def _add(a, b):
    if isinstance(a, int) and a == 0:
        return b
    if isinstance(b, int) and b == 0:
        return a
    return a + b


def _matmul(a, b):
    n = len(a)
    out = []
    for i in range(n):
        row = []
        for j in range(n):
            acc = 0
            for k in range(n):
                acc = _add(acc, _mul(a[i][k], b[k][j]))
            row.append(acc)
        out.append(row)
    return out


def rotation_matrix(terms, inverse: bool = False):
    """3x3 matrix R = Rz(phi1) . Ry(theta1), or its transpose when ``inverse``.

    Entries are Columns or the integers 0/1 (folded away when applied)."""
    cp, sp, ct, st = terms
    rz = [[cp, -sp, 0], [sp, cp, 0], [0, 0, 1]]
    ry = [[ct, 0, st], [0, 1, 0], [-st, 0, ct]]
    m = _matmul(rz, ry)
    if inverse:
        m = [[m[j][i] for j in range(3)] for i in range(3)]
    return m


def apply_matrix(m, u) -> list:
    """``m @ u`` with the 0/1 entries folded away; sums in column order."""
    out = []
    for i in range(3):
        acc = 0
        for j in range(3):
            acc = _add(acc, _mul(m[i][j], u[j]))
        out.append(acc)
    return out


def rotate(phi0_deg, theta0_deg, terms, inverse: bool = False):
    """Rotate direction (phi0, theta0) by the frame of ``terms``.

    Forward (``inverse=False``) adds the reference direction (G7), inverse
    subtracts it (G8): ``rotate(rotate(a, b), b, inverse=True) == a``."""
    p0, t0 = F.radians(_c(phi0_deg)), F.radians(_c(theta0_deg))
    st0 = F.sin(t0)
    u = [st0 * F.cos(p0), st0 * F.sin(p0), F.cos(t0)]
    x, y, z = apply_matrix(rotation_matrix(terms, inverse), u)
    return F.degrees(F.atan2(y, x)), F.degrees(F.acos(clip_unit(z)))


def add_angles(phi0, theta0, phi1, theta1):
    """Direction (phi0, theta0) expressed in the global frame, given it is
    relative to (phi1, theta1) (G7)."""
    return rotate(phi0, theta0, rotation_terms(phi1, theta1), inverse=False)


def sub_angles(phi0, theta0, phi1, theta1):
    """Direction (phi0, theta0) relative to (phi1, theta1)."""
    return rotate(phi0, theta0, rotation_terms(phi1, theta1), inverse=True)


def los_delay(d3d) -> Column:
    """Line-of-sight delay in seconds for a distance in metres."""
    return _c(d3d) / F.lit(LIGHT_SPEED)


def wavelength(frequency) -> Column:
    """Wavelength c / f in metres."""
    return F.lit(LIGHT_SPEED) / _c(frequency)
