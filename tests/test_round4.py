"""Learning without moving rows, folds and codebooks learned together, windows that compose, and timelines made of pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import factorize, quantize, sliding, windows
from mosaiq.plans.experiment import METRICS, Experiment, scored

EPS = 1e-8


def updates(x, h, steps, fit):
    """The same updates in numpy: dictionary, coefficients and errors before each."""
    w, errors = x @ h.T, []
    for _ in range(steps):
        wh = w @ h
        errors.append(np.where(x > 0, x * np.log((x + EPS) / (wh + EPS)), 0).sum() - x.sum() + wh.sum())
        q = np.where(x > 0, (x + EPS) / (wh + EPS), 0)
        w = w * (q @ h.T)
        if fit:
            h = h * (w.T @ q)
            h = h / (h.sum(1, keepdims=True) + 1e-16)
    return h, w, errors


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")


@pytest.fixture(scope="module")
def thin():
    """Rows of which most cells are zero, one row wholly."""
    rng = np.random.default_rng(3)
    x = rng.random((40, 30)) * (rng.random((40, 30)) < 0.2)
    x[7] = 0
    return x


def test_sparse_rows_learn_like_dense_ones(spark, thin, monkeypatch):
    h0 = factorize.start_dictionary(4, 30)
    h, w, errors = updates(thin, h0, 6, True)
    m = factorize.fit(frame(spark, thin), steps=6, tol=0.0, h0=h0)
    assert np.allclose(m.h, h) and m.errors == pytest.approx(errors)
    for name, value in (("CELLS", 17), ("PART", 13), ("BUCKET_BYTES", 300)):
        monkeypatch.setattr(factorize, name, value)
    idx, x = factorize.sparse(F.col("v"))
    again = factorize.fit(frame(spark, thin).select("i", idx, x), steps=6, tol=0.0, h0=h0)
    assert np.allclose(again.h, h) and again.errors == pytest.approx(errors)
    got = {r.i: r.w for r in factorize.transform(frame(spark, thin), h0, 3).collect()}
    assert np.allclose(np.array([got[i] for i in range(40)]), updates(thin, h0, 3, False)[1])
    start = {r.i: r.w for r in factorize.transform(frame(spark, thin), h0, 0).collect()}
    assert np.allclose(np.array([start[i] for i in range(40)]), thin @ h0.T)


def test_errors_stop_a_model(spark, thin):
    h0 = factorize.start_dictionary(2, 30)
    full = factorize.fit(frame(spark, thin), steps=40, tol=1e-4, h0=h0)
    assert 1 < len(full.errors) < 40
    assert full.errors == pytest.approx(updates(thin, h0, len(full.errors), True)[2])


def test_steps_move_no_row(spark, thin):
    """Neither the data nor the coefficients are shuffled or sorted by a step."""
    data = factorize.placed(frame(spark, thin))
    h = factorize.start_dictionary(3, 30)[None]
    w = factorize._stored(factorize._pass(data, None, h, [True], True), int(spark.sparkContext.defaultParallelism))
    plan = factorize._pass(data, w, h, [True], True)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan and "Sort " not in plan
    factorize._dropped(data, w)


def test_bad_rows_are_errors(spark):
    h = factorize.start_dictionary(2, 2)
    for v in ([1.0, -1.0], [1.0, float("nan")]):
        with pytest.raises(Exception, match="negative or not finite"):
            factorize.fit(spark.createDataFrame([(0, v)], "i long, v array<double>"), steps=1, h0=h)
    with pytest.raises(Exception, match="a row without i"):
        factorize.fit(spark.createDataFrame([(None, [1.0, 2.0])], "i long, v array<double>"), steps=1, h0=h)


@pytest.mark.parametrize("most", [64 << 20, 700])
def test_folds_learn_like_one_at_a_time(spark, thin, monkeypatch, most):
    """All folds in one reading a step; also when the models are taken in shares."""
    monkeypatch.setattr(factorize, "MODEL_BYTES", most)
    h0 = factorize.start_dictionary(3, 30)
    passes = []
    monkeypatch.setattr(factorize, "_pass", lambda *a, run=factorize._pass: passes.append(1) or run(*a))
    others = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("i") % 5)
    found = factorize.fit_models(frame(spark, thin), others, np.repeat(h0[None], 5, 0), 4, 0.0)
    assert len(passes) == 4 if most > 700 else len(passes) > 4
    for f, model in enumerate(found):
        h, _, errors = updates(thin[np.arange(40) % 5 != f], h0, 4, True)
        assert np.allclose(model.h, h) and model.errors == pytest.approx(errors)
    hs = np.array([m.h for m in found])
    got = factorize.transform_models(frame(spark, thin), F.array((F.col("i") % 5).cast("int")), hs, 3).collect()
    assert len(got) == 40
    for r in got:
        assert r.model == r.i % 5 and np.allclose(r.w, updates(thin[r.i][None], hs[r.model], 3, False)[1][0])


def test_models_that_stop_at_different_steps(spark, thin):
    """Coefficients are those before the update that no longer helped, for each model by itself."""
    h = np.array([factorize.start_dictionary(3, 30), np.eye(30)[:3] + 1e-3])
    every = factorize.transform_models(frame(spark, thin), F.array(F.lit(0), F.lit(1)), h, 12, 1e-3).collect()
    for m in range(2):
        alone = {r.i: r.w for r in factorize.transform(frame(spark, thin), h[m], 12, 1e-3).collect()}
        assert all(np.allclose(r.w, alone[r.i]) for r in every if r.model == m)


def test_an_experiment_of_several_folds(spark, tmp_path, monkeypatch):
    """The scores of a loop over folds, each learned from its own training rows."""
    rng = np.random.default_rng(5)
    made = {}
    for name, d in (("a", 6), ("b", 5)):
        base = rng.random((3, d)) ** 3
        made[name] = (spark.createDataFrame([(i, i % 3, (base[i % 3] + 0.2 * rng.random(d)).tolist()) for i in range(33)], "key long, label long, v array<double>"), d)
    e = Experiment(made, k=3, steps_train=4, steps_test=3, mode=0.25)
    found, n = e.comparisons()
    got = {(r.fold, r.source, r.target, r.space): [r[f"score_{m}"] for m in METRICS] for r in scored(found, by=("fold",)).collect()}
    assert n == 4 and len(got) == 4 * 12
    samples, ex, coefs = e.prepare()
    cut, _ = e.folds(samples)
    from mosaiq.operators.factorize import FoldLearner
    from mosaiq.plans.experiment import compared

    for f in (0, 3):
        learner = FoldLearner(["a", "b"], [6, 5], coefs, 3)
        alone = learner.train(cut.filter(~F.col("fold").eqNullSafe(f)), 4)
        learner.h = alone.h[None]
        zero = F.array(F.lit(0))
        t = e.spaces(learner, cut.filter(F.col("fold") == f), zero).withColumnRenamed("mod", "source")
        x = e.spaces(learner, ex, zero).select("fold", F.col("mod").alias("target"), "space", F.col("i").alias("ex_id"), F.col("label").alias("ex_label"), F.col("v").alias("ev"))
        for r in scored(compared(t, x, on=("fold", "space"))).collect():
            assert got[f, r.source, r.target, r.space] == pytest.approx([r[f"score_{m}"] for m in METRICS])
    log = e.run(str(tmp_path / "found"))
    assert len(log.runs) == 4 and len(log.results) == 48


def test_codebooks_learned_together(spark, monkeypatch):
    """30 keys and several starts are one model: equal to separate fits from the same starts, one reading a step."""
    rng = np.random.default_rng(9)
    points = [(k, rng.normal(rng.integers(0, 3, 2) * 4, 0.7).tolist()) for k in range(6) for _ in range(80)] + [(6, [1.0, 1.0])] * 5
    rows = spark.createDataFrame(points, "key long, v array<double>").repartition(4).cache()
    starts = quantize.random_starts(rows, "key", 3, 4)
    assert all(b.shape == (4, 3, 2) for b in starts.books.values()) and np.isnan(starts.books[6][:, 1:]).all()
    again = quantize.random_starts(rows.repartition(3), "key", 3, 4)
    assert all(np.array_equal(again.books[n], b, equal_nan=True) for n, b in starts.books.items())
    steps = []
    monkeypatch.setattr(quantize, "keyed_kmeans_step", lambda *a, step=quantize.keyed_kmeans_step: steps.append(1) or step(*a))
    best, far = quantize.keyed_kmeans(rows, "key", 3, 4, steps=50)
    taken = []
    for n in range(6):
        x = np.array([v for k, v in points if k == n])
        fits = []
        for book in starts.books[n]:
            last, book = np.inf, book.copy()
            for step in range(50):
                d = ((x[:, None] - book[None]) ** 2).sum(2)
                code, mean = d.argmin(1), np.sqrt(d.min(1)).mean()
                if last - mean <= 1e-5:
                    break
                last = mean
                new = np.array([x[code == c].mean(0) if (code == c).any() else book[c] for c in range(3)])
                book = new
            taken.append(step + 1)
            fits.append((min(last, mean), book))
        want = min(fits, key=lambda f: f[0])
        assert far[n] == pytest.approx(want[0]) and np.allclose(best.books[n][0], want[1])
    assert len(steps) <= max(taken) and far[6] == 0
    hard = quantize.keyed_assign(rows, "key", best).collect()
    assert len(hard) == len(points) and {r.weight for r in hard} == {1.0}
    soft = quantize.keyed_assign(rows.withColumn("n", F.monotonically_increasing_id()), "key", best, 1.0).groupBy("n").agg(F.sum("weight").alias("s"), F.count("*").alias("c"), F.first("key").alias("key")).collect()
    assert all(r.s == pytest.approx(1) and r.c == (1 if r.key == 6 else 3) for r in soft)
    monkeypatch.setattr(quantize, "BOOK_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        quantize.keyed_kmeans(rows, "key", 3, 4)


def test_pairs_across_panes(spark):
    """Each window's pairs, also those that lie in two panes; a missing code parts no neighbours but gives no pair."""
    rng = random.Random(2)
    t = sorted(rng.uniform(0, 100) for _ in range(200))
    rows = [("a", x, rng.randrange(3) if k % 17 else None) for k, x in enumerate(t)] + [("b", 0.0, 1), ("b", 3.0, 2), ("b", 3.0001, 0), ("b", 90.0, 1), ("b", 95.0, 1)]
    df = spark.createDataFrame(rows, "s string, t double, code long").withColumn("t0", F.lit(0.0))
    got = {(r.s, r["window"], r.cell): r.n for r in sliding.pane_cooccurrences(df, "t", "t0", 12, 5, "code", 3, [1, 4], "s", "t").collect()}
    want = {}
    for s in "ab":
        mine = [(x, c) for n, x, c in rows if n == s and x > 0]
        for k in range(20):
            for at, lag in enumerate((1, 4)):
                for (x, c), (y, d) in zip(mine, mine[lag:]):
                    if x > 5 * k and y <= 5 * k + 12 and c is not None and d is not None:
                        cell = (s, k, d * 3 + c + 9 * at)
                        want[cell] = want.get(cell, 0) + 1
    assert {k: n for k, n in got.items() if k[1] < 20} == want
    with pytest.raises(ValueError):
        sliding.pane_cooccurrences(df, "t", "t0", 12, 5, "code", 3, [0], "s", "t")


def test_windows_are_recognised(spark):
    """Windows of one habit or the other, by coefficients under a dictionary with a row for each."""
    rows = [("u", float(k), (k % 2) if k < 60 else (2 if k % 3 else 0)) for k in range(1, 120)]
    df = spark.createDataFrame(rows, "s string, t double, code long").withColumn("t0", F.lit(0.0))
    counts = sliding.pane_cooccurrences(df, "t", "t0", 20, 10, "code", 3, [1], "s", "t").filter(F.col("window") <= 9)
    h = np.full((2, 9), 1e-3)
    h[0, [1, 3]], h[1, [2, 6, 8]] = 1.0, 1.0
    ex = spark.createDataFrame([(0, "even", [1.0, 0.0]), (1, "odd", [0.0, 1.0])], "ex_id long, ex_label string, ev array<double>")
    got = {r["window"]: r.label for r in sliding.recognised(counts, "s", h, ex, steps=5).collect()}
    assert [got[k] for k in range(10)] == ["even"] * 5 + ["odd"] * 5


def test_long_intervals_are_few_rows(spark):
    """Rows grow with the logarithm of an interval's length, and points find what a range join finds."""
    rng = random.Random(4)
    spans = [(0, 10 * 365 * 86400)] + [(s := rng.randrange(0, 10**8), s + rng.choice([0, 1, 59, 3600, 86400 * 400])) for _ in range(60)] + [(-500, -100), (77, 70)]
    intervals = spark.createDataFrame([("g", k, float(a), float(b)) for k, (a, b) in enumerate(spans)], "g string, id long, start double, end double")
    cells = intervals.filter("start <= end").select("start", "end", F.size(windows.dyadic_cells(F.floor("start"), F.floor("end"))).alias("n")).collect()
    assert all(1 <= r.n <= 2 * max(1, np.log2(r.end - r.start + 1)) + 1 for r in cells) and max(r.n for r in cells) < 60
    for r in intervals.filter("start <= end and end - start < 5000").select("start", "end", windows.dyadic_cells(F.floor("start"), F.floor("end")).alias("c")).collect():
        covered = sorted(x for c in r.c for x in range(c.cell << c.level, (c.cell + 1) << c.level))
        assert covered == list(range(int(r.start), int(r.end) + 1))
    points = [(k, float(t)) for k, t in enumerate([-500, -300, -100, 0, 1, 70, 77, *(x for s in spans[1:20] for x in s), *(rng.randrange(0, 10**8) for _ in range(100))])]
    got = windows.lookup(spark.createDataFrame([("g", *p) for p in points], "g string, point long, t double"), "t", intervals, "g", 1.0)
    want = {(p, k) for p, t in points for k, (a, b) in enumerate(spans) if a < t <= b or a == t == -500 and a <= b}
    rows = got.select("point", "id").collect()
    assert len(rows) == len(want) and set(map(tuple, rows)) == want


def timeline(spark):
    """Three pieces of 4, 2 and 3 seconds at 10 samples a second, from 1.0 on."""
    rows, t, x = [], 1.0, 0
    for n in (40, 20, 30):
        rows.append(("a", t, t + n / 10, 10.0, list(range(x, x + n))))
        t, x = t + n / 10, x + n
    return spark.createDataFrame(rows, "s string, start double, end double, rate double, samples array<int>")


def cuts(spark, *rows):
    return spark.createDataFrame([("a", k, *r) for k, r in enumerate(rows)], "s string, cut int, ts double, te double")


def test_cuts_span_pieces(spark):
    pieces = timeline(spark)
    wanted = [(1.0, 10.0), (2.0, 3.0), (4.5, 5.5), (2.05, 7.51), (5.0, 7.0), (5.0, 5.0), (1.0, 1.0)]
    got = {r.cut: (r.start, r.samples) for r in windows.cut(pieces, cuts(spark, *wanted), "s", 2.0).collect()}
    for k, (ts, te) in enumerate(wanted):
        want = [x for x in range(90) if 1 + x / 10 >= ts - 1e-4 and 1 + (x + 1) / 10 <= te + 1e-4]
        assert got[k][1] == want
        assert not want or got[k][0] == pytest.approx(1 + want[0] / 10)
    parts = windows.cut(pieces, cuts(spark, (4.5, 7.5)), "s", 2.0, samples=False).orderBy("start").collect()
    assert [(r.start, r.end) for r in parts] == [(4.5, 5.0), (5.0, 7.0), (7.0, 7.5)]


@pytest.mark.parametrize("ts,te", [(0.5, 3.0), (2.0, 10.5), (3.0, 2.0)])
def test_cuts_out_of_range_are_errors(spark, ts, te):
    with pytest.raises(Exception, match="out of its timeline"):
        windows.cut(timeline(spark), cuts(spark, (ts, te)), "s", 2.0).collect()


def test_timelines_that_don_t_join_are_errors(spark):
    gap = timeline(spark).withColumn("start", F.col("start") + F.when(F.col("start") == 7.0, 0.5).otherwise(0.0))
    with pytest.raises(Exception, match="not consecutive"):
        windows.cut(gap, cuts(spark, (2.0, 9.0)), "s", 2.0).collect()
    rates = timeline(spark).withColumn("rate", F.when(F.col("start") == 5.0, 20.0).otherwise(F.col("rate")))
    with pytest.raises(Exception, match="different rates"):
        windows.cut(rates, cuts(spark, (4.0, 6.0)), "s", 2.0).collect()


def test_settings_and_three_modalities(spark, tmp_path):
    """Settings come back; three modalities give 12 comparisons by their coefficients."""
    rng = np.random.default_rng(8)
    made = {}
    for name, d in (("a", 4), ("b", 3), ("c", 3)):
        rows = [(i, i % 2, (rng.random(d) * 0.1 + np.eye(d)[i % 2]).tolist()) for i in range(16)]
        made[name] = (spark.createDataFrame(rows, "key long, label long, v array<double>"), d)
    e = Experiment(made, k=2, steps_train=2, steps_test=2, mode="single")
    e.save_settings(str(tmp_path / "settings"))
    again = Experiment.load_settings(str(tmp_path / "settings"), {n: rows for n, (rows, _) in made.items()})
    assert (again.k, again.mode, again.seed, [d for _, d in again.modalities.values()]) == (2, "single", 0, [4, 3, 3])
    with pytest.raises(ValueError):
        Experiment.load_settings(str(tmp_path / "settings"), {"a": made["a"][0]})
    log = again.run()
    assert len(log.results) == 48 and all(0 <= log.last(k) <= 1 for k in log.results)
    assert {"score_a+b2c_cosine", "score_a2b+c_kl", "score_c2a_frobenius"} <= set(log.results)
