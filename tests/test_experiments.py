import io
import math
import random

import numpy as np
import plain_geometry as G
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators import density, evaluation, factorize, information, motion, pairing, series, windows
from mosaiq.plans.experiment import Experiment
from mosaiq.sources import recordings


def test_an_experiment_of_two_modalities(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = {"a": [], "b": []}
    for label in range(3):
        for _ in range(12):
            for name, d in (("a", 6), ("b", 4)):
                v = rng.random(d) * 0.1
                v[label] += 1
                rows[name].append((len(rows[name]), label, v.tolist()))
    made = {n: (spark.createDataFrame(r, "key long, label int, v array<double>"), len(r[0][2])) for n, r in rows.items()}
    log = Experiment(made, k=3, steps_train=3, steps_test=2, mode="single").run(str(tmp_path / "found"))
    scores = log.runs[0]
    assert len(log.results) == 48 and all(0 <= s <= 1 for s in map(float, scores.values()))
    assert scores["score_a2a_a_cosine"] == 1.0 and "score_a2b_cosine" in scores and "score_b2a_a_kl" in scores
    found = spark.read.parquet(str(tmp_path / "found"))
    assert found.select("comparison").distinct().count() == 12


def test_nearest_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    s = spark.createDataFrame([(i, i % 3, rng.random(4).tolist()) for i in range(30)], "i long, label int, v array<double>")
    e = spark.createDataFrame([(i, i % 3, rng.random(4).tolist()) for i in range(50)], "ex_id long, ex_label int, ev array<double>")
    want = sorted(map(tuple, evaluation.classify(s, e, "frobenius").collect()))
    all_ = sorted(tuple(r) for r in evaluation.distances(s, e, "kl").select("i", "ex_id", "dist").collect())
    monkeypatch.setattr(evaluation, "BLOCK_BYTES", 300)
    monkeypatch.setattr(evaluation, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, evaluation.classify(s, e, "frobenius").collect())) == want
    assert sorted(tuple(r) for r in evaluation.distances(s, e, "kl").select("i", "ex_id", "dist").collect()) == all_


def test_a_constant_column_has_one_bin(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (1.0, "a")], "x double, l string")
    assert sorted(map(tuple, information.histogram_by_label(df, "x", "l").collect())) == [("a", 0, 2), ("b", 0, 1)]


def test_numbers_within_a_key(spark):
    rows = [(random.Random(k).choice("aab"), k) for k in range(200)]
    got = {r.k: r.rn for r in pairing.numbered(spark.createDataFrame(rows, "l string, k long"), "l", "k").collect()}
    for label in "ab":
        keys = [k for lab, k in rows if lab == label]
        assert [got[k] for k in keys] == list(range(1, len(keys) + 1))


def test_frames_that_run_out(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "w long, l long")
    pool = spark.createDataFrame([(7, 0), (8, 1)], "f long, l long")
    got = {r.w: r.f for r in windows.associate_frames(a, pool, "l", "f", "w", "f").collect()}
    assert got == {1: 7, 2: None, 3: 8}
    with pytest.raises(ValueError):
        windows.associate_frames(a, pool, "l", "f", "w", "f", check=True)


@pytest.mark.parametrize("n,delay", [(6, 2), (3, 3), (2, 5), (1, 1)])
def test_circular_delays(spark, n, delay):
    x = [float(k * k) for k in range(n)]
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(x)], "s long, t long, x double")
    got = [r.velocity for r in series.delayed_velocities_circular(df, "x", delay, "s", "t").orderBy("t").collect()]
    d = min(delay, n)
    assert got == [x[t] - x[(t - d) % n] for t in range(n)]


def test_panes(spark):
    rng = random.Random(5)
    rows = [(k, rng.uniform(0, 100)) for k in range(300)] + [(400, 0.0), (401, 12.0)]
    df = spark.createDataFrame(rows, "id long, t double").withColumn("t0", F.lit(0.0)).withColumn("g", F.lit(1))
    got = {r["window"]: r.n for r in windows.pane_counts(df, "t", "t0", 12, 5, "g").collect()}
    for k in range(17):
        assert got.get(k, 0) == sum(5 * k < t <= 5 * k + 12 for _, t in rows)


def test_densities_in_the_plane(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), *p) for g in range(2) for p in rng.uniform(0.2, 0.8, (200, 2)).tolist()]
    df = spark.createDataFrame(rows, "g long, x double, y double")
    each = density.bins2d(df, "x", "y", (0.0, 1.0, 0.0, 1.0), 10, ("g",))
    one = density.bins2d(df.filter("g = 1"), "x", "y", (0.0, 1.0, 0.0, 1.0), 10)
    key = lambda d: {(r.bin_x, r.bin_y): pytest.approx(r.density) for r in d.collect()}
    assert key(each.filter("g = 1")) == {k: v.expected for k, v in key(one).items()}
    assert density.kl2d(one, one, 0.1, 0.1, 10).first().kl == pytest.approx(0.0)
    f = np.zeros((11, 11))
    for r in one.collect():
        f[r.bin_x, r.bin_y] = r.density
    w = np.ones(11)
    w[[0, -1]] = 0.5
    want = float((-f * np.log(f + 1e-14) * w[:, None] * w).sum() * 0.01)
    assert density.entropy2d(one, 0.1, 0.1, 10).first().entropy == pytest.approx(want)
    line = density.bins1d(df, "x", 0.2, 0.8, 6)
    full = density.smooth(line, ["bin"], density.kernel(0.1, 0.2), 6, full=True)
    assert full.agg(F.sum("density")).first()[0] == pytest.approx(line.agg(F.sum("density")).first()[0])
    assert full.agg(F.min("bin")).first()[0] < 0


def test_scaling_keeps_the_product(spark):
    h = np.array([[1.0, 2.0], [3.0, 4.0]])
    w = spark.createDataFrame([(0, [1.0, 2.0])], "i long, w array<double>")
    w2, h2 = factorize.rescaled(w, h, np.array([2.0, 5.0]))
    assert np.array(w2.first().w) @ h2 == pytest.approx(np.array([1.0, 2.0]) @ h)
    with pytest.raises(ValueError):
        factorize.rescaled(w, h, np.array([1.0, 0.0]))


def test_learning_and_several_targets(spark):
    rng = np.random.default_rng(4)
    x = rng.random((20, 2)) @ rng.random((2, 9)) + 0.01
    rows = spark.createDataFrame([(i, v[:4].tolist(), v[4:6].tolist(), v[6:].tolist()) for i, v in enumerate(x)], "i long, a array<double>, b array<double>, c array<double>")
    learner = factorize.JointLearner(["a", "b", "c"], [4, 2, 3], [1.0, 1.0, 1.0], 2)
    model = learner.train(rows, 4)
    assert all(p >= q - 1e-9 for p, q in zip(model.errors, model.errors[1:]))
    got = learner.modalities_to_modalities(rows, ["a"], ["b", "c"], 2)
    assert {n: len(d.first().v) for n, d in got.items()} == {"b": 2, "c": 3}
    one = learner.modality_to_modality(rows, "a", "b", 2)
    assert sorted((r.i, tuple(r.v)) for r in one.collect()) == sorted((r.i, tuple(r.v)) for r in got["b"].collect())


def test_matrices_compose_and_decompose():
    args = [1.2, 0.7, 2.0], [0.1, -0.2, 0.3], [0.4, -0.5, 0.6], [1.0, 2.0, -3.0]
    m = G.compose_matrix(*args, perspective=[0.01, 0.02, -0.01, 1.0])
    want = np.eye(4)
    want[3] = 0.01, 0.02, -0.01, 1
    shear = np.eye(4)
    shear[0, 1:3], shear[1, 2] = args[1][:2], args[1][2]
    for part in (G.translation_matrix(args[3]), G.euler_matrix(*args[2]), shear, np.diag([*args[0], 1])):
        want = want @ part
    assert m == pytest.approx(want / want[3, 3])
    plain = G.compose_matrix(*args)
    assert G.compose_matrix(*G.decompose_matrix(plain)) == pytest.approx(plain)
    assert plain @ G.inverse_matrix(plain) == pytest.approx(G.identity_matrix())
    assert G.vector_norm([3, 4]) == 5 and G.vector_norm([[3, 4], [6, 8]], axis=1).tolist() == [5, 10]


def turned(axis, angle):
    q = [0.0, 0.0, 0.0, math.cos(angle / 2)]
    q["xyz".index(axis)] = math.sin(angle / 2)
    return q


def test_joint_angles(spark):
    """Ten joints: one turns about z, the markers of another are missing, the rest don't move."""
    markers = sorted({m for pair in motion.JOINTS for m in pair})
    rows = []
    for record in range(2):
        for t in range(4):
            for m in markers:
                if m != "right_foot":
                    rows.append((record, t, m, *(turned("z", 0.1 * t * (record + 1)) if m == "left_elbow" else [0.0, 0.0, 0.0, 1.0])))
    df = spark.createDataFrame(rows, "record_id long, t int, marker string, qx double, qy double, qz double, qw double")
    got = {(r.record_id, r.t, r.dof): r.angle for r in motion.joint_angles(df).collect()}
    assert len(got) == 2 * 4 * 30
    assert got[1, 3, 2] == pytest.approx(0.6) and got[1, 3, 5] == pytest.approx(-0.6) and got[0, 1, 8] == 0 and got[0, 0, 27] is None
    v = {(r.record_id, r.t, r.dof): r.velocity for r in motion.with_velocities(motion.joint_angles(df)).collect()}
    assert v[1, 3, 2] == pytest.approx(0.2) and v[1, 0, 2] == pytest.approx(0.0)
    h = motion.quantized_histograms(df, 2, joints=motion.JOINTS[:2])
    shares = {r.record_id: r.s for r in h.groupBy("record_id").agg(F.sum("share").alias("s")).collect()}
    assert shares == {0: pytest.approx(1.0), 1: pytest.approx(1.0)}
    b = motion.binned_histograms(df, 16, (-1.0, 1.0), (-1.0, 1.0), joints=(motion.JOINTS[0], motion.JOINTS[9]))
    assert b.select("record_id", "dof").distinct().count() == 2 * 3 and b.agg(F.min("density")).first()[0] >= 0


def test_turns_stay_small_plans(spark):
    q = V.quaternion(F.col("id") * 0.1, F.lit(0.2), F.lit(0.3), F.lit(0.9))
    p = V.quaternion(F.lit(0.1), F.col("id") * 0.2, F.lit(0.3), F.lit(0.8))
    plan = spark.range(3).select(V.turn_angles(p, q).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000


def test_recordings_from_files(spark, tmp_path):
    x = np.arange(2 * 2 * 7, dtype=float).reshape(2, 2, 7)
    np.savez(tmp_path / "m.npz", d0=x, d1=x + 1)
    (tmp_path / "m.json").write_text('{"marker_names": ["a", "b"], "records": [{"data_id": "d0", "labels": [1, 2]}, {"data_id": "d1", "labels": [3]}]}')
    got = recordings.read_motion(spark, str(tmp_path / "m.npz"), str(tmp_path / "m.json"))
    rows = {(r.record_id, r.t, r.marker): (r.tx, r.qw, r.labels) for r in got.collect()}
    assert len(rows) == 8 and rows[0, 1, "b"] == (21.0, 27.0, [1, 2]) and rows[1, 0, "a"] == (1.0, 7.0, [3])
    (tmp_path / "s.json").write_text('{"tags": ["dog", "cat"], "speakers": [{"name": "ann", "records": [{"audio_file": "x.wav", "tags": [1]}, {"audio_file": "y.wav", "tags": [0, 1]}]}]}')
    r, tags = recordings.read_sounds(spark, str(tmp_path / "s.json"))
    assert [(x.speaker, x.pos, x.audio, x.tags) for x in r.orderBy("pos").collect()] == [("ann", 0, "x.wav", [1]), ("ann", 1, "y.wav", [0, 1])]
    assert {t.id: t.name for t in tags.collect()} == {0: "dog", 1: "cat"}
    assert recordings.first_tags(r, tags).orderBy("pos").select("label").collect() == [("cat",), ("dog",)]
    gone = recordings.without(r, spark.createDataFrame([(0, 0)], "speaker_id int, pos int"))
    assert [x.pos for x in gone.collect()] == [1]
    recordings.write_sounds(r, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select(F.size("records")).first()[0] == 2
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.xml").write_text("<doc><utterance><audio>a.wav</audio><trans><x>1</x><y>2</y><z>a red car</z></trans><vistags><vistag>car</vistag><vistag>red</vistag></vistags></utterance><utterance><audio>b.wav</audio></utterance></doc>")
    u = recordings.read_utterances(spark, str(tmp_path / "u")).first()
    assert (u.audio, u.transcription, u.tags) == ("a.wav", "a red car", ["car", "red"])
    (tmp_path / "i.txt").write_text("p1 23 F English New York\n\np2  ?  M Scots\n")
    assert [tuple(r) for r in recordings.speaker_info(spark, str(tmp_path / "i.txt")).orderBy("id").collect()] == [("p1", 23, "F", "English", "New York"), ("p2", None, "M", "Scots", "")]
    for f in ("w/p1/a.wav", "t/p1/a.txt", "t/p1/b.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(recordings.wav_bytes(8000, np.array([1, -2])) if f.endswith("wav") else b" words \n")
    s = {r.name: r for r in recordings.read_speech(spark, str(tmp_path / "w/*"), str(tmp_path / "t/*")).collect()}
    assert s["a"].audio.endswith("a.wav") and s["a"].transcription.strip() == "words" and s["b"].audio is None
    assert recordings.in_all(spark.createDataFrame([("p", "a", "x", "t"), ("p", "b", None, "t")], "speaker string, name string, audio string, transcription string")).count() == 1


def test_sounds_to_codebooks(spark, tmp_path):
    from mosaiq.functions import sound

    rng = np.random.default_rng(6)
    for k in range(2):
        (tmp_path / f"{k}.wav").write_bytes(recordings.wav_bytes(8000, (rng.normal(size=4000) * 3000).astype(int)))
    wavs = recordings.read_wavs(spark, str(tmp_path))
    books = recordings.codebooks(wavs, (3, 2, 2), mode="raw")
    assert [b.shape for b in books] == [(3, 13), (2, 13), (2, 13)]
    got = wavs.select(sound.histograms(F.col("samples"), F.col("rate"), books).alias("h")).collect()
    assert all(len(r.h) == 2 * (9 + 4 + 4) for r in got)
    joined = recordings.joined(wavs.orderBy("path"), "path")
    assert len(joined[1]) == 8000 and joined[0] == 8000
    with pytest.raises(ValueError):
        recordings.cropped(joined[0], joined[1], 0.5, 2.0)
    rate, part = recordings.cropped(joined[0], joined[1], 0.25, 0.5)
    assert rate == 8000 and len(part) == 2000
    recordings.save_wav(str(tmp_path / "out.wav"), rate, part)
    assert len((tmp_path / "out.wav").read_bytes()) == 44 + 4000
    assert io.BytesIO((tmp_path / "out.wav").read_bytes()).read(4) == b"RIFF"
