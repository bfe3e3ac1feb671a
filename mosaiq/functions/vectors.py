"""Column expressions over arrays of doubles; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the metrics: added in divergences, and added to sums that are divided by.
EPSILON, SUM_EPSILON = 1e-8, 1e-16


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def pairwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over the places of two arrays of one length."""
    return total(F.zip_with(a, b, f))


def dot(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: x * y)


def generalized_kl(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return pairwise(a, b, lambda x, y: x * F.ln((x + eps) / (y + eps)) - x + y)


def kl(a: Column, b: Column, normalize: bool = False) -> Column:
    return generalized_kl(normalized(a), normalized(b)) if normalize else generalized_kl(a, b)


def rev_kl(a: Column, b: Column) -> Column:
    return kl(b, a)


def sym_kl(a: Column, b: Column) -> Column:
    return (kl(a, b) + rev_kl(a, b)) / 2


def frobenius(a: Column, b: Column) -> Column:
    return F.sqrt(pairwise(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where the product is 0, as for a zero vector."""
    product = dot(a, b)
    return product / (F.sqrt(dot(a, a) * dot(b, b)) + F.when(product == 0, 1.0).otherwise(0.0))


def cosine_diff(a: Column, b: Column) -> Column:
    return -cosine_similarity(a, b)


#: Distances by name, for the operators that take one.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {"kl": kl, "rev_kl": rev_kl, "sym_kl": sym_kl, "frobenius": frobenius, "cosine": cosine_diff}


def normalized(a: Column, eps: float = SUM_EPSILON) -> Column:
    return F.transform(a, lambda x: x / (total(a) + eps))


def clip(x: Column, low: float, high: float) -> Column:
    """Both bounds hold; F.greatest and F.least pass over nulls, so a null stays null here."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def minmax(x: Column, low: Column, high: Column) -> Column:
    """x between its bounds on a scale from 0 to 1; bounds of zero width count as 1 wide."""
    return (x - low) / F.when(high == low, 1.0).otherwise(high - low)


def argmax(a: Column) -> Column:
    """The first place, from 0, of the largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def hoyer_ratio(a: Column, eps: float = EPSILON) -> Column:
    return (total(F.transform(a, F.abs)) + eps) / (F.sqrt(dot(a, a)) + eps)


def tolerant_floor(x: Column, tol: float) -> Column:
    """The largest integer up to x; an integer that x is below by less than ``tol`` counts."""
    near = F.round(x)
    return F.when(F.abs(x - near) < tol, near).otherwise(F.floor(x)).cast("long")


def tolerant_ceil(x: Column, tol: float) -> Column:
    near = F.round(x)
    return F.when(F.abs(x - near) < tol, near).otherwise(F.ceil(x)).cast("long")


def quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))


def quat_multiply(p: Column, q: Column) -> Column:
    """The Hamilton product p q of quaternions with the scalar last."""
    px, py, pz, pw, qx, qy, qz, qw = (c[f] for c in (p, q) for f in "xyzw")
    return quaternion(pw * qx + px * qw + py * qz - pz * qy, pw * qy - px * qz + py * qw + pz * qx, pw * qz + px * qy - py * qx + pz * qw, pw * qw - px * qx - py * qy - pz * qz)


def quat_conjugate(q: Column) -> Column:
    return quaternion(-q["x"], -q["y"], -q["z"], q["w"])


def quat_norm2(q: Column) -> Column:
    return q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"]


def quat_inverse(q: Column) -> Column:
    n = quat_norm2(q)
    return quaternion(-q["x"] / n, -q["y"] / n, -q["z"] / n, q["w"] / n)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once: nested columns name it again wherever f does, and grow by that factor each time."""
    return F.transform(F.array(value), f)[0]


def quat_turn(p: Column, q: Column) -> Column:
    """The rotation from p to q: the inverse of p times q."""
    return bound(quat_inverse(p), lambda i: quat_multiply(i, q))


def turn_angles(p: Column, q: Column) -> Column:
    """``quat_euler`` of the rotation from p to q."""
    return bound(quat_turn(p, q), quat_euler)


def quat_euler(q: Column) -> Column:
    """Angles about the fixed axes x, y, z of a rotation; at the gimbal lock the last is 0, and a null rotation is none."""
    n = quat_norm2(q)
    s = F.when(n < 8.881784197001252e-16, 0.0).otherwise(2.0 / n)
    x, y, z, w = (q[f] for f in "xyzw")
    m00, m10, m20 = 1 - s * (y * y + z * z), s * (x * y + z * w), s * (x * z - y * w)
    m21, m22, m12, m11 = s * (y * z + x * w), 1 - s * (x * x + y * y), s * (y * z - x * w), 1 - s * (x * x + z * z)
    cy = F.sqrt(m00 * m00 + m10 * m10)
    free = cy > 8.881784197001252e-16
    return F.struct(F.when(free, F.atan2(m21, m22)).otherwise(F.atan2(-m12, m11)).alias("ax"), F.atan2(-m20, cy).alias("ay"), F.when(free, F.atan2(m10, m00)).otherwise(0.0).alias("az"))
