"""Network-output maths as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KERAS_EPSILON, LOGVAR_CLIP
from .arrays import array_sum, at
from .geo import clip


def softmax(logits: Column) -> Column:
    """Numerically stable softmax of an array column (M3)."""
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    s = array_sum(e)
    return F.transform(e, lambda x: x / s)


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum, like ``np.argmax`` (M4)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def cdf(p: Column) -> Column:
    """Prefix sums of a probability array."""
    return F.transform(p, lambda x, i: array_sum(F.slice(p, 1, i + 1)))


def inverse_cdf_draw(p: Column, u: Column) -> Column:
    """First class i with ``u <= cdf[i]``; the last class when rounding leaves
    ``cdf[-1] < u`` (M5, P5)."""
    c = cdf(p)
    hits = F.filter(F.transform(c, lambda x, i: F.when(u <= x, i)), lambda i: i.isNotNull())
    return F.coalesce(at(hits, 0), F.size(p) - 1).cast("int")


def softplus(t: Column) -> Column:
    """Overflow-safe ``log(1 + exp(t))``."""
    return F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))


def logvar_floor(t: Column, min_variance: float) -> Column:
    """``log(min_var + softplus(t))`` elementwise."""
    return F.transform(t, lambda x: F.log(F.lit(min_variance) + softplus(x)))


# The functions of several arrays pair them with ``zip_with``: an index into an array expression inside a lambda would
# evaluate the whole expression again for each element.
def reparameterize(mu: Column, logvar: Column, eps: Column) -> Column:
    """``mu + eps * exp(logvar / 2)`` elementwise; ``eps`` an array of normals (M8)."""
    return F.zip_with(mu, F.zip_with(eps, logvar, lambda e, lv: e * F.exp(lv * 0.5)), lambda m, d: m + d)


def gaussian_nll_row(x: Column, mu: Column, logvar: Column) -> Column:
    """Per-row ``1/2 * sum(exp(-lv) (x - mu)^2 + lv)``, lv clipped (M9)."""
    clipped = F.transform(logvar, lambda lv: clip(lv, -LOGVAR_CLIP, LOGVAR_CLIP))
    return F.lit(0.5) * array_sum(F.zip_with(F.zip_with(x, mu, lambda a, b: a - b), clipped, lambda d, lv: F.exp(-lv) * d * d + lv))


def kl_row(mu: Column, logvar: Column, form: str = "raw") -> Column:
    """Per-row ``sum(1 + lv - mu^2 - exp(lv))`` (M10). ``form='kl'`` applies the
    missing -1/2 factor, giving the usual KL divergence (P19)."""
    s = array_sum(F.zip_with(mu, logvar, _kl_term))
    if form == "raw":
        return s
    if form == "kl":
        return F.lit(-0.5) * s
    raise ValueError(f"unknown KL form {form!r}")


def _kl_term(m, lv):
    lv = clip(lv, -LOGVAR_CLIP, LOGVAR_CLIP)
    return F.lit(1.0) + lv - m * m - F.exp(lv)


def sparse_cross_entropy_row(p: Column, label: Column) -> Column:
    """``-log(clip(p[label], eps, 1 - eps))`` for a 0-based label (E5)."""
    return -F.log(clip(at(p, label), KERAS_EPSILON, 1.0 - KERAS_EPSILON))
