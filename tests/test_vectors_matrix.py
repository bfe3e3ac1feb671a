import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators import information, matrix


def one(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(f(F.col("a"), F.col("b"))).first()[0]


def test_divergence(spark):
    x, y = [0.0] * 8, [0.5] * 8
    x[3] = 1.0
    assert one(spark, x, y, V.kl) == pytest.approx(math.log(2) + 3, abs=1e-6)
    assert one(spark, y, y, V.kl) == 0


@pytest.mark.parametrize("a,b,want", [([1, 0, 0], [1, 0, 0], 1), ([0, 1, 0], [1, 1, 0], 0.5**0.5), ([0, 0, 1], [1, 0, 0], 0), ([1, 1, 1], [0, 2, 1], 0.6**0.5), ([0, 0, 0], [0, 0, 0], 0)])
def test_cosine(spark, a, b, want):
    assert one(spark, list(map(float, a)), list(map(float, b)), V.cosine_similarity) == pytest.approx(want)


def test_tolerant_integers(spark):
    xs = [3.14, -3.14, 3.94, 3.04, -3.04, -3.94]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", V.tolerant_floor(F.col("x"), 0.1), V.tolerant_ceil(F.col("x"), 0.1)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {3.14: (3, 4), -3.14: (-4, -3), 3.94: (4, 4), 3.04: (3, 3), -3.04: (-3, -3), -3.94: (-4, -4)}


def test_quaternions(spark):
    q = lambda *v: V.quaternion(*map(F.lit, map(float, v)))
    r = spark.range(1).select(V.quat_multiply(q(1, -2, 3, 4), q(-5, 6, 7, 8)).alias("m"), V.quat_euler(q(0.06146124, 0, 0, 0.99810947)).alias("e"), V.quat_euler(q(0, 0, 0, 0)).alias("z")).first()
    assert tuple(r.m) == (-44, -14, 48, 28)
    assert np.allclose(r.e, [0.123, 0, 0]) and np.allclose(r.z, 0)


def cells(spark, rows):
    return spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)], "i long, j long, x double")


def dense(df):
    got = {(r.i, r.j): r.x for r in df.collect()}
    return [[got[i, j] for j in range(1 + max(k[1] for k in got))] for i in range(1 + max(k[0] for k in got))]


def test_normalization(spark):
    m = cells(spark, [[0, 1, 3], [2, 3, 3]])
    assert np.allclose(dense(matrix.normalize_sum(m, "j")), [[0, 0.25, 0.5], [1, 0.75, 0.5]])
    assert np.allclose(dense(matrix.normalize_sum(m, "i")), [[0, 0.25, 0.75], [0.25, 0.375, 0.375]])
    assert np.allclose(dense(matrix.normalize_features(cells(spark, [[1, 0, 1.5, 0.1], [1, 0, 0.5, 0.3]]))), [[0.5, 0.75, 0.25], [0.5, 0.25, 0.75]])


def test_scaling_and_products(spark):
    m = cells(spark, [[1, 2, 3], [4, 5, 6]])
    assert dense(matrix.scale(m, spark.createDataFrame([(0, 2.0), (1, 3.0)], "i long, f double"), "i")) == [[2, 4, 6], [12, 15, 18]]
    b = m.select(F.col("j").alias("k"), F.col("i").alias("j"), "x")
    assert dense(matrix.matmul(m.select("i", F.col("j").alias("k"), "x"), b)) == [[14, 32], [32, 77]]
    mask = spark.createDataFrame([(0, 1, 1.0), (1, 1, 0.0)], "i long, j long, x double")
    assert [tuple(r) for r in matrix.masked_dot(m.select("i", F.col("j").alias("k"), "x"), b, mask).collect()] == [(0, 1, 32.0)]


def test_information(spark):
    p = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 0.5), ("a", "y", 0.0)], "a string, b string, p double")
    assert information.mutual_information(p, "a", "b").first()[0] == pytest.approx(math.log(2))
    assert information.entropy(p).first()[0] == pytest.approx(math.log(2))
    assert information.conditional_entropy(p, "a").first()[0] == pytest.approx(0)
    c = information.confusion(spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "t int, f int"), "t", "f")
    assert {(r.truth, r.found): r.n for r in c.collect()} == {(1, 1): 1, (1, 2): 2, (2, 1): 0, (2, 2): 0}
