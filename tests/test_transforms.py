"""Transforms as column expressions, against the same ones in numpy."""

import math

import numpy as np
import plain_geometry as G
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import transforms as T
from mosaiq.functions import vectors as V

FIELDS = "id long, angle double, part double, axis array<double>, point array<double>, normal array<double>, angles array<double>, scale array<double>, q array<double>, p array<double>, eye array<double>"


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(17)
    rows = []
    for k in range(40):
        v = lambda n=3: rng.normal(size=n).tolist()
        rows.append((k, float(rng.uniform(0.1, 3)), float(rng.random()), v(), v(), v(), rng.uniform(-1.4, 1.4, 3).tolist(), rng.uniform(0.5, 2, 3).tolist(), v(4), v(4), (np.array(v()) * 3).tolist()))
    return rows, spark.createDataFrame(rows, FIELDS)


def struct(q):
    return V.quaternion(*(q[k] for k in range(4)))


def evaluated(given, *columns):
    rows, df = given
    got = {r.id: r for r in df.select("id", *columns).collect()}
    return [(r, *(got[r[0]][k + 1] for k in range(len(columns)))) for r in rows]


def test_matrices_are_those_of_numpy(given):
    c = {n: F.col(n) for n in FIELDS.replace(",", "").split()[::2]}
    across = lambda r: np.cross(r[5], r[3])
    ortho = V.bound(F.array("normal", "axis"), lambda x: T.vector(x[0][1] * x[1][2] - x[0][2] * x[1][1], x[0][2] * x[1][0] - x[0][0] * x[1][2], x[0][0] * x[1][1] - x[0][1] * x[1][0]))
    cases = [
        (T.rotation_matrix(c["angle"], c["axis"], c["point"]), lambda r: G.rotation_matrix(r[1], r[3], r[4])),
        (T.rotation_matrix(c["angle"], c["axis"]), lambda r: G.rotation_matrix(r[1], r[3])),
        (T.translation_matrix(c["point"]), lambda r: G.translation_matrix(r[4])),
        (T.reflection_matrix(c["point"], c["normal"]), lambda r: G.reflection_matrix(r[4], r[5])),
        (T.scale_matrix(c["angle"], c["point"]), lambda r: G.scale_matrix(r[1], r[4])),
        (T.scale_matrix(c["angle"], c["point"], c["axis"]), lambda r: G.scale_matrix(r[1], r[4], r[3])),
        (T.shear_matrix(c["part"], ortho, c["point"], c["normal"]), lambda r: G.shear_matrix(r[2], across(r), r[4], r[5])),
        (T.projection_matrix(c["point"], c["normal"]), lambda r: G.projection_matrix(r[4], r[5])),
        (T.projection_matrix(c["point"], c["normal"], c["axis"]), lambda r: G.projection_matrix(r[4], r[5], r[3])),
        (T.projection_matrix(c["point"], c["normal"], perspective=c["eye"]), lambda r: G.projection_matrix(r[4], r[5], perspective=r[10])),
        (T.projection_matrix(c["point"], c["normal"], perspective=c["eye"], pseudo=True), lambda r: G.projection_matrix(r[4], r[5], perspective=r[10], pseudo=True)),
        (T.orthogonalization_matrix(c["scale"], F.transform("angles", lambda x: x * 10 + 80)), lambda r: G.orthogonalization_matrix(r[7], np.array(r[6]) * 10 + 80)),
        (T.quaternion_matrix(struct(c["q"])), lambda r: G.quaternion_matrix(r[8])),
        (T.product(T.quaternion_matrix(struct(c["q"])), T.translation_matrix(c["point"]), T.scale_matrix(c["angle"])), lambda r: G.concatenate_matrices(G.quaternion_matrix(r[8]), G.translation_matrix(r[4]), G.scale_matrix(r[1]))),
        (T.inverse_matrix(T.projection_matrix(c["point"], c["normal"], perspective=c["eye"], pseudo=True)), lambda r: np.linalg.inv(G.projection_matrix(r[4], r[5], perspective=r[10], pseudo=True))),
        (T.compose_matrix(c["scale"], c["axis"], c["angles"], c["point"]), lambda r: G.compose_matrix(r[7], r[3], r[6], r[4])),
        (T.compose_matrix(c["scale"], c["axis"], c["angles"], c["point"], T.vector(0.01, 0.02, -0.01, 1.0)), lambda r: G.compose_matrix(r[7], r[3], r[6], r[4], [0.01, 0.02, -0.01, 1.0])),
        (T.clip_matrix(F.transform("scale", lambda x: x - 0.4), F.transform("scale", lambda x: x + 1)), lambda r: G.clip_matrix(*np.array([np.array(r[7]) - 0.4, np.array(r[7]) + 1]).T.ravel())),
        (T.clip_matrix(F.transform("scale", lambda x: x - 0.4), F.transform("scale", lambda x: x + 1), True), lambda r: G.clip_matrix(*np.array([np.array(r[7]) - 0.4, np.array(r[7]) + 1]).T.ravel(), True)),
        (T.identity_matrix(), lambda r: np.eye(4)),
    ]
    for row, *got in evaluated(given, *(x for x, _ in cases)):
        for n, (m, (_, want)) in enumerate(zip(got, cases, strict=True)):
            assert np.allclose(m, want(row)), n


@pytest.mark.parametrize("axes", T.AXES)
def test_euler_angles(given, axes):
    a = [F.col("angles")[k] for k in range(3)]
    m = T.euler_matrix(*a, axes)
    for row, got, angles, q in evaluated(given, m, T.euler_from_matrix(m, axes), T.quaternion_matrix(T.quaternion_from_euler(*a, axes))):
        want = G.euler_matrix(*row[6], axes)
        assert np.allclose(got, want) and np.allclose(q, want) and np.allclose(G.euler_matrix(*angles, axes), want)


def test_quaternions(given):
    q, p = struct(F.col("q")), struct(F.col("p"))
    cases = [
        (T.quaternion_about_axis(F.col("angle"), F.col("axis")), lambda r: G.quaternion_about_axis(r[1], r[3])),
        (T.quaternion_from_matrix(T.quaternion_matrix(q)), lambda r: G.quaternion_from_matrix(G.quaternion_matrix(r[8]))),
        (T.quaternion_slerp(q, p, F.col("part")), lambda r: G.quaternion_slerp(r[8], r[9], r[2])),
        (T.quaternion_slerp(q, p, F.col("part"), 1, False), lambda r: G.quaternion_slerp(r[8], r[9], r[2], 1, False)),
        (T.quaternion_slerp(q, p, F.lit(1.0)), lambda r: G.quaternion_slerp(r[8], r[9], 1.0)),
        (V.quat_conjugate(q), lambda r: G.quaternion_conjugate(r[8])),
        (T.random_quaternion(4), None),
    ]
    for row, *got in evaluated(given, *(x for x, _ in cases)):
        for x, (_, want) in zip(got[:-1], cases, strict=False):
            assert np.allclose(list(x), want(row))
        assert np.linalg.norm(list(got[-1])) == pytest.approx(1)


def test_parts_of_matrices_make_them_again(given):
    c = F.col
    turn, mirror = T.rotation_matrix(c("angle"), c("axis"), c("point")), T.reflection_matrix(c("point"), c("normal"))
    one, every = T.scale_matrix(-c("angle"), c("point"), c("axis")), T.scale_matrix(c("angle"), c("point"))
    shear = T.shear_matrix(c("part"), T.vector(0.0, 1.0, 0.0), c("point"), T.vector(0.6, 0.0, 0.8))
    flat = T.projection_matrix(c("point"), c("normal"), c("axis"))
    whole = T.compose_matrix(c("scale"), c("axis"), c("angles"), c("point"))
    columns = [turn, T.rotation_from_matrix(turn), mirror, T.reflection_from_matrix(mirror), one, T.scale_from_matrix(one), every, T.scale_from_matrix(every), shear, T.shear_from_matrix(shear), flat, T.projection_from_matrix(flat), whole, T.decompose_matrix(whole)]
    for _, *x in evaluated(given, *columns):
        assert np.allclose(G.rotation_matrix(x[1].angle, x[1].axis, x[1].point), x[0]) and 0 <= x[1].angle <= math.pi
        assert np.allclose(G.reflection_matrix(x[3].point, x[3].normal), x[2])
        assert np.allclose(G.scale_matrix(x[5].factor, x[5].origin, x[5].direction), x[4])
        assert np.allclose(G.scale_matrix(x[7].factor, x[7].origin), x[6]) and x[7].direction is None
        assert np.allclose(G.shear_matrix(x[9].angle, x[9].direction, x[9].point, x[9].normal), x[8]) and x[9].angle > 0
        assert np.allclose(G.projection_matrix(x[11].point, x[11].normal, x[11].direction), x[10])
        assert np.allclose(G.compose_matrix(x[13].scale, x[13].shear, x[13].angles, x[13].translate), x[12])


def test_vectors_and_sameness(given):
    m = T.rotation_matrix(F.col("angle"), F.col("axis"), F.col("point"))
    twice = F.transform(m, lambda r: F.transform(r, lambda x: x * 2))
    for row, n, u, p, same, other, at in evaluated(given, T.vector_norm(F.col("q")), T.unit_vector(F.col("axis")), T.applied(m, F.col("point")), T.is_same_transform(m, twice), T.is_same_transform(m, T.identity_matrix()), T.translation_from_matrix(T.translation_matrix(F.col("point")))):
        assert n == pytest.approx(np.linalg.norm(row[8])) and np.allclose(u, G.unit_vector(row[3])) and np.allclose(p, row[4]) and same and not other and at == row[4]


def test_what_has_no_transform_is_null(given):
    _, df = given
    none = df.limit(1).select(T.inverse_matrix(T.projection_matrix(F.col("point"), F.col("normal"))), T.shear_matrix(F.lit(0.3), F.col("axis"), F.col("point"), F.col("axis")), T.clip_matrix(F.col("scale"), F.col("scale")), T.unit_vector(T.vector(0.0, 0.0, 0.0)), T.rotation_from_matrix(T.identity_matrix())["angle"]).first()
    assert none[1] is None and none[2] is None and none[3] == [0.0, 0.0, 0.0] and none[4] == 0
    with pytest.raises(ValueError):
        T.euler_matrix(F.lit(0.0), F.lit(0.0), F.lit(0.0), "sxxy")


def test_all_of_it_stays_in_the_jvm(given):
    plan = given[1].select(T.decompose_matrix(T.compose_matrix(F.col("scale"), F.col("axis"), F.col("angles"), F.col("point"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
