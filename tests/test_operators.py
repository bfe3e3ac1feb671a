import numpy as np
import plain_geometry as G
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import sound
from mosaiq.operators import assignment, evaluation, factorize, pairing, quantize, series, windows
from mosaiq.plans.runlog import RunLog
from mosaiq.sources import objects, recordings


def test_cooccurrences(spark):
    codes = [0, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([(0, t, c) for t, c in enumerate(codes)], "s long, t long, c long")
    got = {r.code: r.n for r in series.cooccurrences(df, "c", 2, [2], "s", "t").collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    assert sound.cooccurrences(np.array(codes), 2, 2).tolist() == [0, 1, 2, 2]
    with pytest.raises(ValueError):
        series.cooccurrences(df, "c", 2, [0], "s", "t")


@pytest.mark.parametrize("n,ratio,folds,size", [(137, 0.1, 10, 13), (137, 0.11, 9, 15), (130, 0.1, 10, 13)])
def test_folds(spark, n, ratio, folds, size):
    got = series.with_folds(spark.range(n), ratio, "id").filter("fold IS NOT NULL").groupBy("fold").count().collect()
    assert len(got) == folds and {r["count"] for r in got} == {size}


@pytest.mark.parametrize("args,full,partial", [((1, 5, 2, 2), 2, 2), ((0, 5, 2, 2), 2, 3), ((1, 5, 2, 2 / 3), 4, 6), ((0, 1, 2, 0.4), 0, 3)])
def test_slider(spark, args, full, partial):
    t0, t1, w, s = (F.lit(float(x)) for x in args)
    for want, flag in ((full, False), (partial, True)):
        got = windows.slider(spark.range(1), t0, t1, w, s, flag).orderBy("start").collect()
        assert len(got) == want and all(r.end <= args[1] for r in got)


@pytest.mark.parametrize("ts,te,start,want", [(2.5, 3, 2.6, [17, 16]), (2.4, 3, 2.4, [18, 17, 16]), (2.4, 3.2, 2.4, [18, 17, 16, 15])])
def test_subwindow(spark, ts, te, start, want):
    c = windows.subwindow(F.array(*map(F.lit, range(20, 10, -1))), F.lit(2.0), F.lit(5.0), F.lit(float(ts)), F.lit(float(te)))
    r = spark.range(1).select(c.alias("c")).first().c
    assert r.samples == want and r.start == pytest.approx(start)


def test_lookup_at_borders(spark):
    w = spark.createDataFrame([(0, 0.0, 1.0, "a"), (0, 1.0, 2.5, "b")], "g long, start double, end double, name string")
    p = spark.createDataFrame([(0, t) for t in (0.0, 1.0, 1.1, 2.5, 3.0)], "g long, t double")
    assert {r.t: r.name for r in windows.lookup(p, "t", w, "g", 0.7).collect()} == {0.0: "a", 1.0: "a", 1.1: "b", 2.5: "b"}


def test_pairing(spark):
    a = spark.createDataFrame(list(enumerate([1, 1, 2, 1, 3, 2, 3])), "k long, l long")
    b = spark.createDataFrame(list(enumerate("456554")), "k long, l string")
    got = pairing.pair({"a": (a, "k", "l"), "b": (b, "k", "l")}).orderBy("label_idx", "rn").collect()
    assert [(r.label_idx, r.a, r.b) for r in got] == [(0, 0, 0), (0, 1, 5), (1, 2, 1), (1, 5, 3), (2, 4, 2)]
    with pytest.raises(ValueError):
        pairing.pair({"a": (a, "k", "l"), "b": (b.filter("l <> '6'"), "k", "l")})


def test_nearest_and_ties(spark):
    s = spark.createDataFrame([(0, [1.0, 0.0], 5), (1, [0.0, 1.0], 6)], "i long, v array<double>, label int")
    e = spark.createDataFrame([(2, [1.0, 0.0], 7), (1, [1.0, 0.0], 5), (3, [0.0, 2.0], 6)], "ex_id long, ev array<double>, ex_label int")
    got = evaluation.classify(s, e, "frobenius")
    assert {r.i: r.found for r in got.collect()} == {0: 5, 1: 6}
    assert evaluation.score(got).first()[0] == 1.0


@pytest.mark.parametrize("w,want", [([[0, 1, 10], [1, 5, 10], [10, 10, 0]], [1, 0, 2]), ([[0, 1, 10, 20], [1, 5, 10, 20], [10, 10, 0, 20]], [1, 0, 2]), ([[0, 1, 10], [1, 5, 10], [10, 10, 0], [20, 20, 20]], [1, 0, 2, None])])
def test_assignment(w, want):
    assert assignment.min_weight_assignment(np.array(w)) == want


def test_assignment_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(5):
        w = rng.random((6, 6))
        assert sum(w[i, j] for i, j in enumerate(assignment.min_weight_assignment(w))) == pytest.approx(assignment.brute_force(w))


def test_factorization(spark):
    rng = np.random.default_rng(0)
    x = rng.random((12, 3)) @ rng.random((3, 6))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")
    m = factorize.fit(rows, 3, steps=8, tol=0)
    assert np.allclose(m.h.sum(1), 1) and (m.h >= 0).all()
    assert all(a >= b for a, b in zip(m.errors, m.errors[1:]))
    # The same updates in numpy.
    h = factorize.start_dictionary(3, 6)
    w = x @ h.T
    for want in m.errors:
        wh = w @ h
        assert (x * np.log((x + 1e-8) / (wh + 1e-8)) - x + wh).sum() == pytest.approx(want)
        q = (x + 1e-8) / (wh + 1e-8)
        w = w * (q @ h.T)
        h = h * (w.T @ q)
        h /= h.sum(1, keepdims=True)


def test_kmeans_splits(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.5, (10, 2)) for c in ((0, 1), (0, -1), (10, 0))])
    book = quantize.iterative_kmeans(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>"), 2, steps=5)
    got = sorted(r.centroid for r in book.collect())
    assert np.abs(np.array(got) - [[0, 0], [10, 0]]).max() < 1


def test_transforms():
    rng = np.random.default_rng(3)
    for axes in G.AXES:
        a = rng.uniform(-1, 1, 3) + np.array([0, 1.3, 0]) * (axes[1] == axes[3])
        assert np.allclose(G.euler_matrix(*G.euler_from_matrix(G.euler_matrix(*a, axes), axes), axes), G.euler_matrix(*a, axes))
        assert G.is_same_transform(G.quaternion_matrix(G.quaternion_from_euler(*a, axes)), G.euler_matrix(*a, axes))
    r = G.rotation_matrix(0.7, [1, 2, 3], [4, 5, 6])
    angle, axis, point = G.rotation_from_matrix(r)
    assert G.is_same_transform(G.rotation_matrix(angle, axis, point), r)
    assert G.is_same_transform(G.quaternion_matrix(G.quaternion_from_matrix(r)), G.rotation_matrix(0.7, [1, 2, 3]))
    s = G.shear_matrix(0.4, [1, 0, 0], [1, 2, 3], [0, 1, 0])
    assert G.is_same_transform(G.shear_matrix(*G.shear_from_matrix(s)), s)
    m = G.compose_matrix([1.2, 0.7, 2], [0.1, 0.2, 0.3], [0.3, 0.4, 0.5], [1, 2, 3])
    assert G.is_same_transform(G.compose_matrix(*G.decompose_matrix(m)), m)
    v = rng.random((3, 10))
    moved = (r @ np.vstack([v, np.ones(10)]))[:3]
    assert np.allclose(G.superimposition_matrix(v, moved), r)
    p = G.projection_matrix([1, 2, 3], [0, 0, 1], direction=[1, 0, 1])
    assert np.allclose(p @ p, p)


def test_frame_lines(spark):
    lines = ["0_01_o01_1372086405.972948 | 10 6 301 336", "x_o07_12.5 | 1 2 3 4 | 5 6 7 8", "no name | 1 2 3 4"]
    got = objects.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()
    assert (got[0].label, got[0].ts, [tuple(v) for v in got[0].views]) == (1, 1372086405.972948, [(10, 6, 301, 336)])
    assert len(got[1].views) == 2 and got[2].label is None


def test_sound_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(recordings.wav_bytes(8000, np.arange(100)))
    r = recordings.read_wavs(spark, str(tmp_path)).first()
    assert r.rate == 8000 and r.samples == list(range(100))
    assert sound.mfcc(np.random.default_rng(0).normal(size=8000), 8000).shape == (13, 16)


def test_run_log(tmp_path):
    log = RunLog()
    log.new_run()
    log.store_result("a", 1.0)
    with pytest.raises(ValueError):
        log.store("a", 2)
    log.save(tmp_path / "log.json")
    assert RunLog.load(tmp_path / "log.json") == log and len(log.merged(log).runs) == 2
