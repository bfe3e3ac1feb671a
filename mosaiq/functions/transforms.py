"""Homogeneous transforms as column expressions: a matrix is an array of four rows, a vector an array, a quaternion a struct x, y, z, w.

All of it stays in the JVM. What is used more than once is bound to a lambda's variable, so that expressions
don't grow by nesting. A null argument gives a null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bound, dot, quat_multiply, quat_norm2, quaternion

EPS = 8.881784197001252e-16
#: Sequences of Euler axes: s for fixed and r for moving ones, then three axes, neighbours different.
AXES = [f + "".join(a) for f in "sr" for a in [*permutations("xyz"), *((x, y, x) for x in "xyz" for y in "xyz" if x != y)]]
Cells = list[list[Column]]


def _num(x: float | Column) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def matrix(cells: list[list[float | Column]]) -> Column:
    return F.array(*(F.array(*map(_num, row)) for row in cells))


def vector(*x: float | Column) -> Column:
    return F.array(*map(_num, x))


def identity_matrix() -> Column:
    return matrix([[float(i == j) for j in range(4)] for i in range(4)])


def vector_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit_vector(v: Column) -> Column:
    """A vector divided by its length; a null vector stays as it is."""
    return bound(vector_norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, x).otherwise(x / n)))


def applied(m: Column, v: Column) -> Column:
    """The point, of three coordinates, that a transform takes a point to."""
    return bound(F.transform(m, lambda r: r[0] * v[0] + r[1] * v[1] + r[2] * v[2] + r[3]), lambda p: vector(p[0] / p[3], p[1] / p[3], p[2] / p[3]))


def _times(a: Column, b: Column) -> Column:
    return bound(b, lambda b: F.transform(a, lambda r: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: r[0] * b[0][j] + r[1] * b[1][j] + r[2] * b[2][j] + r[3] * b[3][j])))


def product(*ms: Column) -> Column:
    """Matrices one behind another; none gives the identity."""
    return reduce(_times, ms) if ms else identity_matrix()


def inverse_matrix(m: Column) -> Column:
    """By minors of two rows; a singular matrix gives null."""

    def of(a: Column) -> Column:
        two = lambda i, j, k, n: a[i][k] * a[j][n] - a[i][n] * a[j][k]
        s = F.array(*(two(0, 1, k, n) for k, n in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))))
        c = F.array(*(two(2, 3, k, n) for k, n in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))))

        def with_minors(x: Column) -> Column:
            s, c = ([x[k][j] for j in range(6)] for k in range(2))
            det = s[0] * c[5] - s[1] * c[4] + s[2] * c[3] + s[3] * c[2] - s[4] * c[1] + s[5] * c[0]
            b = [
                [a[1][1] * c[5] - a[1][2] * c[4] + a[1][3] * c[3], -a[0][1] * c[5] + a[0][2] * c[4] - a[0][3] * c[3], a[3][1] * s[5] - a[3][2] * s[4] + a[3][3] * s[3], -a[2][1] * s[5] + a[2][2] * s[4] - a[2][3] * s[3]],
                [-a[1][0] * c[5] + a[1][2] * c[2] - a[1][3] * c[1], a[0][0] * c[5] - a[0][2] * c[2] + a[0][3] * c[1], -a[3][0] * s[5] + a[3][2] * s[2] - a[3][3] * s[1], a[2][0] * s[5] - a[2][2] * s[2] + a[2][3] * s[1]],
                [a[1][0] * c[4] - a[1][1] * c[2] + a[1][3] * c[0], -a[0][0] * c[4] + a[0][1] * c[2] - a[0][3] * c[0], a[3][0] * s[4] - a[3][1] * s[2] + a[3][3] * s[0], -a[2][0] * s[4] + a[2][1] * s[2] - a[2][3] * s[0]],
                [-a[1][0] * c[3] + a[1][1] * c[1] - a[1][2] * c[0], a[0][0] * c[3] - a[0][1] * c[1] + a[0][2] * c[0], -a[3][0] * s[3] + a[3][1] * s[1] - a[3][2] * s[0], a[2][0] * s[3] - a[2][1] * s[1] + a[2][2] * s[0]],
            ]
            return bound(F.when(det != 0, det), lambda d: F.when(d.isNotNull(), F.transform(matrix(b), lambda r: F.transform(r, lambda y: y / d))))

        return bound(F.array(s, c), with_minors)

    return bound(m, of)


def _about(linear: Cells, point: Column | None) -> Column:
    """A linear map that keeps a point in place, the origin if not given."""
    at = [0.0] * 3 if point is None else [point[i] - sum((linear[i][j] * point[j] for j in range(1, 3)), linear[i][0] * point[0]) for i in range(3)]
    return matrix([[*linear[i], at[i]] for i in range(3)] + [[0.0, 0.0, 0.0, 1.0]])


def _plus_outer(scale: Column, a: Column, b: Column) -> Cells:
    """The unit matrix plus a multiple of an outer product."""
    return [[float(i == j) + scale * a[i] * b[j] for j in range(3)] for i in range(3)]


def translation_matrix(d: Column) -> Column:
    return matrix([[1.0, 0.0, 0.0, d[0]], [0.0, 1.0, 0.0, d[1]], [0.0, 0.0, 1.0, d[2]], [0.0, 0.0, 0.0, 1.0]])


def translation_from_matrix(m: Column) -> Column:
    return vector(m[0][3], m[1][3], m[2][3])


def rotation_matrix(angle: Column, axis: Column, point: Column | None = None) -> Column:
    """A rotation about an axis through a point."""

    def of(n: Column) -> Column:
        c, s = F.cos(angle), F.sin(angle)
        cross = [[F.lit(0.0), -n[2], n[1]], [n[2], F.lit(0.0), -n[0]], [-n[1], n[0], F.lit(0.0)]]
        return _about([[(c if i == j else F.lit(0.0)) + (1 - c) * n[i] * n[j] + s * cross[i][j] for j in range(3)] for i in range(3)], point)

    return bound(unit_vector(axis), of)


def reflection_matrix(point: Column, normal: Column) -> Column:
    return bound(unit_vector(normal), lambda n: _about(_plus_outer(F.lit(-2.0), n, n), point))


def scale_matrix(factor: Column, origin: Column | None = None, direction: Column | None = None) -> Column:
    """Scaling in all directions, or in one."""
    if direction is None:
        return _about([[factor if i == j else F.lit(0.0) for j in range(3)] for i in range(3)], origin)
    return bound(unit_vector(direction), lambda d: _about(_plus_outer(factor - 1, d, d), origin))


def shear_matrix(angle: Column, direction: Column, point: Column, normal: Column) -> Column:
    """Null where direction and normal aren't orthogonal."""
    both = F.array(unit_vector(direction), unit_vector(normal))
    return bound(both, lambda b: F.when(F.abs(dot(b[0], b[1])) <= 1e-6, _about(_plus_outer(F.tan(angle), b[0], b[1]), point)))


def projection_matrix(point: Column, normal: Column, direction: Column | None = None, perspective: Column | None = None, pseudo: bool = False) -> Column:
    """Projection onto a plane: orthogonal, along a direction, or from a centre (with ``pseudo`` depth is kept)."""

    def of(n: Column) -> Column:
        if perspective is None:
            d = n if direction is None else direction
            return bound(-1.0 / dot(d, n), lambda s: _about(_plus_outer(s, d, n), point))
        c = perspective
        high, plane = sum(((c[k] - point[k]) * n[k] for k in range(1, 3)), (c[0] - point[0]) * n[0]), dot(point, n)
        rows = [[(high if i == j else F.lit(0.0)) - c[i] * n[j] - (n[i] * n[j] if pseudo else F.lit(0.0)) for j in range(3)] + [plane * (c[i] + n[i] if pseudo else c[i])] for i in range(3)]
        return matrix([*rows, [-n[0], -n[1], -n[2], dot(c, n)]])

    return bound(unit_vector(normal), of)


def clip_matrix(low: Column, high: Column, perspective: bool = False) -> Column:
    """From the frustum between ``low`` (left, bottom, near) and ``high`` (right, top, far); null where it is empty."""
    span = [high[k] - low[k] for k in range(3)]
    mid = [(high[k] + low[k]) / span[k] for k in range(3)]
    good = (low[0] < high[0]) & (low[1] < high[1]) & (low[2] < high[2])
    if not perspective:
        return F.when(good, matrix([[*(2.0 / span[i] if i == j else 0.0 for j in range(3)), -mid[i]] for i in range(3)] + [[0.0, 0.0, 0.0, 1.0]]))
    near, far = low[2], high[2]
    return F.when(good & (near > EPS), matrix([[-2 * near / span[0], 0.0, mid[0], 0.0], [0.0, -2 * near / span[1], mid[1], 0.0], [0.0, 0.0, -mid[2], 2 * near * far / span[2]], [0.0, 0.0, -1.0, 0.0]]))


def orthogonalization_matrix(lengths: Column, degrees: Column) -> Column:
    """From coordinates in a cell, of three lengths and three angles, to orthogonal ones."""

    def of(r: Column) -> Column:
        co = (F.cos(r[0]) * F.cos(r[1]) - F.cos(r[2])) / (F.sin(r[0]) * F.sin(r[1]))
        a, b, c = (lengths[k] for k in range(3))
        return matrix([[a * F.sin(r[1]) * F.sqrt(1 - co * co), 0.0, 0.0, 0.0], [-a * F.sin(r[1]) * co, b * F.sin(r[0]), 0.0, 0.0], [a * F.cos(r[1]), b * F.cos(r[0]), c, 0.0], [0.0, 0.0, 0.0, 1.0]])

    return bound(F.transform(degrees, F.radians), of)


def _sequence(axes: str) -> list[int]:
    if axes not in AXES:
        raise ValueError(f"axes {axes}")
    return ["xyz".index(x) for x in axes[1:]]


def _axis(k: int) -> Column:
    return vector(*(float(j == k) for j in range(3)))


def _turned(angle: Column, k: int) -> list[list[float | Column]]:
    """A rotation about a coordinate axis."""
    c, s, i, j = F.cos(angle), F.sin(angle), (k + 1) % 3, (k + 2) % 3
    cells: list[list[float | Column]] = [[0.0] * 3 for _ in range(3)]
    cells[i][i], cells[i][j], cells[j][i], cells[j][j], cells[k][k] = c, -s, s, c, 1.0
    return cells


def _multiplied(a: list[list[float | Column]], b: list[list[float | Column]]) -> list[list[float | Column]]:
    """A product written out, without its zeros and ones."""

    def cell(i: int, j: int) -> float | Column:
        pairs = [(a[i][k], b[k][j]) for k in range(3)]
        terms = [y if isinstance(x, float) else x if isinstance(y, float) else x * y for x, y in pairs if not (isinstance(x, float) and x == 0 or isinstance(y, float) and y == 0)]
        return reduce(lambda x, y: x + y, terms) if terms else 0.0

    return [[cell(i, j) for j in range(3)] for i in range(3)]


def euler_matrix(a: Column, b: Column, c: Column, axes: str = "sxyz") -> Column:
    """The product of three turns, written out by cell, so that it is compiled; a null angle makes all cells of the rotation null."""
    turns = [_turned(x, k) for x, k in zip((a, b, c), _sequence(axes), strict=True)]
    cells = reduce(_multiplied, turns[::-1] if axes[0] == "s" else turns)
    known = a * 0.0 + b * 0.0 + c * 0.0
    return matrix([[x + known for x in row] + [0.0] for row in cells] + [[0.0, 0.0, 0.0, 1.0]])


def euler_from_matrix(m: Column, axes: str = "sxyz") -> Column:
    """The three angles of a rotation; at the gimbal lock the third is 0. Moving axes are fixed ones in reverse."""
    i, j, k = _sequence(axes)
    if axes[0] == "r":
        return F.reverse(euler_from_matrix(m, "s" + axes[:0:-1]))
    repeats, sign = i == k, 1.0 if (j - i) % 3 == 1 else -1.0
    k = 3 - i - j

    def of(r: Column) -> Column:
        if repeats:
            s = F.hypot(r[i][j], r[i][k])
            return F.when(s > EPS, vector(F.atan2(r[i][j], sign * r[i][k]), F.atan2(s, r[i][i]), F.atan2(r[j][i], -sign * r[k][i]))).otherwise(vector(F.atan2(-sign * r[j][k], r[j][j]), F.atan2(s, r[i][i]), 0.0))
        c = F.hypot(r[i][i], r[j][i])
        return F.when(c > EPS, vector(F.atan2(sign * r[k][j], r[k][k]), F.atan2(-sign * r[k][i], c), F.atan2(sign * r[j][i], r[i][i]))).otherwise(vector(F.atan2(-sign * r[j][k], r[j][j]), F.atan2(-sign * r[k][i], c), 0.0))

    return bound(m, of)


def quaternion_about_axis(angle: Column, axis: Column) -> Column:
    return bound(unit_vector(axis), lambda n: quaternion(*(F.sin(angle / 2) * n[k] for k in range(3)), F.cos(angle / 2)))


def quaternion_from_euler(a: Column, b: Column, c: Column, axes: str = "sxyz") -> Column:
    q = [quaternion_about_axis(x, _axis(k)) for x, k in zip((a, b, c), _sequence(axes), strict=True)]
    p, q, r = q[::-1] if axes[0] == "s" else q
    return bound(F.array(p, q, r), lambda x: bound(quat_multiply(x[0], x[1]), lambda y: quat_multiply(y, x[2])))


def quaternion_matrix(q: Column) -> Column:
    """A null quaternion is no rotation."""

    def of(p: Column) -> Column:
        s = F.when(quat_norm2(p) < EPS, 0.0).otherwise(2.0 / quat_norm2(p))
        v, w = [p[f] for f in "xyz"], p["w"]
        cross = [[F.lit(0.0), -v[2], v[1]], [v[2], F.lit(0.0), -v[0]], [-v[1], v[0], F.lit(0.0)]]
        square = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
        return _about([[(1 - s * square if i == j else F.lit(0.0)) + s * (v[i] * v[j] + w * cross[i][j]) for j in range(3)] for i in range(3)], None)

    return bound(q, of)


def quaternion_from_matrix(m: Column) -> Column:
    """From the largest of the four squares, with a scalar that isn't negative."""

    def of(r: Column) -> Column:
        t = r[0][0] + r[1][1] + r[2][2]
        four = F.array(F.lit(1.0) + t, *(1.0 - t + 2 * r[k][k] for k in range(3)))  # 4 w w, 4 x x, ...
        odd = [r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]]
        even = lambda i, j: r[i][j] + r[j][i]

        def chosen(f: Column) -> Column:
            top = F.array_max(f)
            rows = [(f[0], [*odd, f[0]])] + [(f[k + 1], [*(f[k + 1] if j == k else even(k, j) for j in range(3)), odd[k]]) for k in range(3)]
            out = None
            for square, cells in rows:
                got = vector(*(x / (2 * F.sqrt(square)) for x in cells))
                out = F.when(square == top, got) if out is None else out.when(square == top, got)
            return bound(out, lambda q: quaternion(*(F.when(q[3] < 0, -q[k]).otherwise(q[k]) for k in range(4))))

        return bound(four, chosen)

    return bound(m, of)


def quaternion_slerp(p: Column, q: Column, fraction: Column, spin: int = 0, shortest: bool = True) -> Column:
    """Between two rotations on the sphere of unit quaternions."""
    unit = lambda x: unit_vector(vector(*(x[f] for f in "xyzw")))

    def of(b: Column) -> Column:
        d = dot(b[0], b[1])
        turn = F.when(d < 0, -1.0).otherwise(1.0) if shortest else F.lit(1.0)

        def with_angle(x: Column) -> Column:
            near = fraction.isin(0.0, 1.0) | (F.abs(x[0]) < EPS) | (F.abs(F.abs(x[1]) - 1) < EPS)
            ends = lambda k: F.when(fraction == 1.0, x[2] * b[1][k]).otherwise(b[0][k])
            between = lambda k: (F.sin((1 - fraction) * x[0]) * b[0][k] + F.sin(fraction * x[0]) * x[2] * b[1][k]) / F.sin(x[0])
            return quaternion(*(F.when(near, ends(k)).otherwise(between(k)) for k in range(4)))

        return bound(vector(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), turn * d))) + spin * math.pi, turn * d, turn), with_angle)

    return bound(F.array(unit(p), unit(q)), of)


def random_vector(n: int, seed: int) -> Column:
    return F.array(*(F.rand(seed + k) for k in range(n)))


def random_quaternion(seed: int) -> Column:
    """A rotation at random, all alike likely."""
    return bound(unit_vector(F.array(*(F.randn(seed + k) for k in range(4)))), lambda q: quaternion(*(q[k] for k in range(4))))


def random_rotation_matrix(seed: int) -> Column:
    return quaternion_matrix(random_quaternion(seed))


def is_same_transform(a: Column, b: Column) -> Column:
    """Whether two matrices differ by a factor alone, within rounding."""
    flat = lambda m: bound(m, lambda x: F.transform(F.flatten(x), lambda y: y / x[3][3]))
    return F.forall(F.zip_with(flat(a), flat(b), lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)), lambda ok: ok)


def compose_matrix(scale: Column | None = None, shear: Column | None = None, angles: Column | None = None, translate: Column | None = None, perspective: Column | None = None) -> Column:
    """The transform that scales, shears, turns, moves and projects, in this order."""
    steps = []
    if perspective is not None:
        steps.append(matrix([[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [perspective[k] for k in range(4)]]))
    if translate is not None:
        steps.append(translation_matrix(translate))
    if angles is not None:
        steps.append(euler_matrix(angles[0], angles[1], angles[2]))
    if shear is not None:
        steps.append(matrix([[1.0, shear[0], shear[1], 0.0], [0.0, 1.0, shear[2], 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]))
    if scale is not None:
        steps.append(matrix([[scale[i] if i == j else 0.0 for j in range(3)] + [0.0] for i in range(3)] + [[0.0, 0.0, 0.0, 1.0]]))
    return bound(product(*steps), lambda m: F.transform(m, lambda r: F.transform(r, lambda x: x / m[3][3])))


def _rank_one(m: Column, f: Callable[[Column, Column], Column], sign: float) -> Column:
    """``f`` of an amount s and of unit vectors a, b where m's linear part is the unit matrix plus s a b'; b is its longest row, times ``sign`` of the amount."""

    def of(r: Column) -> Column:
        rest = F.array(*(vector(*(r[i][j] - float(i == j) for j in range(3))) for i in range(3)))

        def with_rest(x: Column) -> Column:
            long_ = F.array_max(F.transform(x, lambda v: F.struct(dot(v, v).alias("n"), v.alias("v"))))["v"]

            def with_b(b: Column) -> Column:
                a = F.transform(x, lambda v: dot(v, b))
                return bound(vector_norm(a), lambda s: bound(F.array(F.transform(a, lambda y: sign * y / s), b), lambda ab: f(sign * s, ab)))

            return bound(unit_vector(long_), with_b)

        return bound(rest, with_rest)

    return bound(m, of)


def reflection_from_matrix(m: Column) -> Column:
    """``point, normal`` of a reflection; the point is the one nearest to the origin."""
    t = translation_from_matrix(m)
    return _rank_one(m, lambda s, ab: F.struct(F.transform(ab[1], lambda y: y * dot(t, ab[1]) / 2).alias("point"), ab[1].alias("normal")), -1.0)


def rotation_from_matrix(m: Column) -> Column:
    """``angle, axis, point`` of a rotation, the angle from 0 to pi; the point is the one of the axis that is nearest to the origin, the origin where nothing turns."""

    def of(x: Column) -> Column:
        q = x["q"]
        v = vector(q["x"], q["y"], q["z"])

        def with_axis(n: Column) -> Column:
            t = x["t"]
            half, size = F.atan2(vector_norm(v), q["w"]), dot(t, n)
            flat = [t[k] - size * n[k] for k in range(3)]
            cross = [n[1] * t[2] - n[2] * t[1], n[2] * t[0] - n[0] * t[2], n[0] * t[1] - n[1] * t[0]]
            point = vector(*(F.when(half < 1e-12, 0.0).otherwise((flat[k] + cross[k] * F.cos(half) / F.sin(half)) / 2) for k in range(3)))
            return F.struct((2 * half).alias("angle"), n.alias("axis"), point.alias("point"))

        return bound(unit_vector(v), with_axis)

    return bound(F.struct(quaternion_from_matrix(m).alias("q"), translation_from_matrix(m).alias("t")), of)


def scale_from_matrix(m: Column) -> Column:
    """``factor, origin, direction`` of a scaling; the direction is null where all are scaled alike."""
    def of(r: Column) -> Column:
        t = translation_from_matrix(r)
        uniform = r[0][0]
        alike = (F.abs(r[1][1] - uniform) < 1e-8) & (F.abs(r[2][2] - uniform) < 1e-8) & (F.abs(r[0][1]) + F.abs(r[0][2]) + F.abs(r[1][2]) < 1e-8)
        still = lambda n: F.when(F.abs(n) < 1e-12, None).otherwise(n)
        every = F.struct(uniform.alias("factor"), F.transform(t, lambda y: F.coalesce(y / still(1 - uniform), F.lit(0.0))).alias("origin"), F.lit(None).cast("array<double>").alias("direction"))
        factor = r[0][0] + r[1][1] + r[2][2] - 2
        one = _rank_one(r, lambda s, ab: F.struct(factor.alias("factor"), F.transform(ab[1], lambda y: y * dot(t, ab[1]) / (1 - factor)).alias("origin"), ab[1].alias("direction")), 1.0)
        return F.when(alike, every).otherwise(one)

    return bound(m, of)


def shear_from_matrix(m: Column) -> Column:
    """``angle, direction, point, normal`` of a shear with a positive angle."""
    t = translation_from_matrix(m)
    return _rank_one(m, lambda s, ab: F.struct(F.atan(s).alias("angle"), ab[0].alias("direction"), F.transform(ab[1], lambda y: -y * dot(t, ab[0]) / s).alias("point"), ab[1].alias("normal")), 1.0)


def projection_from_matrix(m: Column) -> Column:
    """``point, normal, direction`` of a projection that isn't from a centre; the point is the plane's nearest to the origin."""
    t = translation_from_matrix(m)
    return _rank_one(m, lambda s, ab: F.struct(F.transform(ab[1], lambda y: y * dot(t, ab[1])).alias("point"), ab[1].alias("normal"), ab[0].alias("direction")), -1.0)


def decompose_matrix(m: Column) -> Column:
    """``scale, shear, angles, translate`` of a transform without perspective; the inverse of ``compose_matrix``."""

    def of(r: Column) -> Column:
        column = lambda k: vector(*(r[i][k] / r[3][3] for i in range(3)))

        def first(x: Column) -> Column:
            a, b, c = x[0], x[1], x[2]
            u = unit_vector(a)

            def second(u: Column) -> Column:
                rest = bound(dot(u, b), lambda s: F.zip_with(b, u, lambda y, z: y - s * z))

                def third(v: Column) -> Column:
                    w = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

                    def last(w: Column) -> Column:
                        sx, sy, sz = dot(u, a), dot(v, b), dot(w, c)
                        turn = matrix([[u[i], v[i], w[i], 0.0] for i in range(3)] + [[0.0, 0.0, 0.0, 1.0]])
                        return F.struct(vector(sx, sy, sz).alias("scale"), vector(dot(u, b) / sy, dot(u, c) / sz, dot(v, c) / sz).alias("shear"), euler_from_matrix(turn).alias("angles"), F.transform(translation_from_matrix(r), lambda y: y / r[3][3]).alias("translate"))

                    return bound(vector(*w), last)

                return bound(unit_vector(rest), third)

            return bound(u, second)

        return bound(F.array(column(0), column(1), column(2)), first)

    return bound(m, of)
