"""Data sources by name, writers that commit, grids of jobs, and expressions at any depth of nesting."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import nested
from mosaiq.plans import jobs
from mosaiq.sources import formats, recordings


@pytest.fixture
def motion_files(tmp_path):
    x = np.arange(3 * 2 * 7, dtype=float).reshape(3, 2, 7)
    np.savez(tmp_path / "one.npz", d0=x, d1=x[:2] + 100)
    np.savez_compressed(tmp_path / "two.npz", d2=x[:1] + 200, unused=x)
    meta = {"marker_names": ["a", "b"], "records": [{"data_id": f"d{k}", "labels": [k, 7]} for k in range(3)]}
    (tmp_path / "meta.json").write_text(json.dumps(meta))
    return tmp_path, x


def test_motion_by_records(spark, motion_files):
    folder, x = motion_files
    df = formats.load(spark, "motion", str(folder), meta=str(folder / "meta.json"), samples=3)
    rows = {(r.record_id, r.t, r.marker): (r.tx, r.qw, r.labels) for r in df.collect()}
    assert len(rows) == 2 * (3 + 2 + 1) and rows[1, 1, "b"] == (x[1, 1, 0] + 100, x[1, 1, 6] + 100, [1, 7]) and rows[2, 0, "a"][0] == 200
    assert df.rdd.getNumPartitions() == 3  # two records of one file are two tasks
    one = df.filter("record_id = 1 and t > 0").select("marker", "tx")
    assert one.rdd.getNumPartitions() == 1 and [tuple(r) for r in one.orderBy("marker").collect()] == [("a", 114.0), ("b", 121.0)]
    assert df.filter(F.col("record_id").isin(0, 2)).rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="3 samples, not 4"):
        formats.load(spark, "motion", str(folder), meta=str(folder / "meta.json"), samples=4).count()
    (folder / "more.json").write_text(json.dumps({"marker_names": ["a", "b"], "records": [{"data_id": "none"}]}))
    with pytest.raises(Exception, match="without an array"):
        formats.load(spark, "motion", str(folder), meta=str(folder / "more.json")).count()


def test_wavs_by_stretches(spark, tmp_path):
    rng = np.random.default_rng(1)
    sounds = {f"{k}.wav": rng.integers(-2000, 2000, n) for k, n in enumerate((1000, 1, 0, 257))}
    for name, x in sounds.items():
        (tmp_path / name).write_bytes(recordings.wav_bytes(8000, x))
    df = formats.load(spark, "wav", str(tmp_path), samples_per_task=100)
    assert df.rdd.getNumPartitions() == 10 + 1 + 1 + 3
    got = {}
    for r in df.orderBy("path", "first").collect():
        assert r.rate == 8000 and r.first == len(got.get(r.path, []))
        got[r.path] = got.get(r.path, []) + r.samples
    assert {p.rsplit("/", 1)[1]: x for p, x in got.items()} == {n: x.tolist() for n, x in sounds.items()}
    assert df.filter(F.col("path") == str(tmp_path / "3.wav")).rdd.getNumPartitions() == 3
    (tmp_path / "bad.wav").write_bytes(b"RIFF0000WAVEdata")
    with pytest.raises(Exception, match="without"):
        formats.load(spark, "wav", str(tmp_path / "bad.wav")).count()
    with pytest.raises(ValueError, match="no loader"):
        formats.loader(spark, "smell")


def test_records_come_back(spark, tmp_path):
    rows = [("ADS", "a.wav", "x < y & \"z\"", ["dog", "c&t"]), (None, None, None, []), ("", "b.wav", "", ["é"]), *[(f"s{k}", f"{k}.wav", f"text {k}", []) for k in range(20)]]
    df = spark.createDataFrame(rows, "style string, audio string, transcription string, tags array<string>").repartition(3)
    formats.register(spark)
    out = str(tmp_path / "records")
    df.write.format("mosaiq_records").mode("append").save(out)
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(formats.load(spark, "records", out).collect()) == key(rows)
    df.limit(2).write.format("mosaiq_records").mode("append").save(out)
    assert formats.load(spark, "records", out).count() == len(rows) + 2
    df.limit(1).write.format("mosaiq_records").mode("overwrite").save(out)
    assert formats.load(spark, "records", out).count() == 1
    with pytest.raises(Exception, match="records have"):
        spark.range(1).write.format("mosaiq_records").mode("append").save(out)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    formats.register(spark)
    out = tmp_path / "records"
    bad = spark.range(0, 40, 1, 4).select(F.lit("s").alias("style"), F.when(F.col("id") == 39, F.raise_error(F.lit("no audio"))).otherwise("a").alias("audio"), F.lit("t").alias("transcription"), F.array(F.lit("x")).alias("tags"))
    with pytest.raises(Exception, match="no audio"):
        bad.write.format("mosaiq_records").mode("append").save(str(out))
    assert not out.exists() or list(out.iterdir()) == []


def test_the_whole_grid(spark):
    grid = jobs.full_grid(spark)
    names = [r.name for r in grid.collect()]
    assert len(names) == len(set(names)) == 980
    assert {"motion_sound_5_0", "image_motion_sound_200_19", "image_sound_feats_SURF_color_50_3"} <= set(names)
    assert grid.groupBy("k").count().filter("k = 50").first()["count"] == 4 * 20 + 180


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    store, ran = str(tmp_path / "store"), []
    grid = jobs.grid(spark, [("a", "b"), ("a", "c")], [("x",)], (2, 3), 2)
    assert jobs.status(grid, store).collect() == [("left", 8)] and jobs.results(spark, store).count() == 0

    def score(session, job):
        ran.append(job.name)
        if job.name == "a_c_3_1" and ran.count(job.name) == 1:
            raise ValueError("broken")
        return {"kl": session.range(job.k).count() + job.run / 4, "cosine": 1.0}

    first = jobs.run(grid, store, score, at_once=3, most=3).collect()
    assert [r.error for r in first] == [None] * 3 and jobs.left(grid, store).count() == 5
    second = {r.name: r.error for r in jobs.run(grid, store, score, at_once=3).collect()}
    assert len(second) == 5 and second["a_c_3_1"] == "ValueError: broken" and sum(e is None for e in second.values()) == 4
    assert {r.state: r.n for r in jobs.status(grid, store).collect()} == {"done": 7, "left": 1}
    jobs.run(grid, store, score)
    assert jobs.left(grid, store).count() == 0 and len(ran) == 9
    stats = {(tuple(r.modalities), r.k, r.key): (r.n, r.avg, r.std) for r in jobs.statistics(grid, store).collect()}
    assert len(stats) == 8 and stats[("a", "c"), 3, "kl"] == (2, 3.125, 0.125) and stats[("a", "b"), 2, "cosine"] == (2, 1.0, 0.0)


def test_jobs_run_at_once(spark, tmp_path):
    def wait(session, job):
        time.sleep(1.0)
        return {"x": 1.0}

    began = time.time()
    jobs.run(jobs.grid(spark, [("a",)], [("x",)], (1,), 6), str(tmp_path / "s"), wait, at_once=6)
    assert time.time() - began < 5.5


def plain(x, depth, f):
    return f(x) if depth == 0 else None if x is None else [plain(y, depth - 1, f) for y in x]


def spread(x, values, level):
    return plain(x, level, lambda y: None if y is None else [[*y, v] for v in values])


def flat(x, level):
    return [x] if level == 0 else [z for y in x or [] for z in (flat(y, level - 1) if level > 1 and y is not None else [y] if level == 1 else [])]


@pytest.mark.parametrize("kind,rows", [
    ("array<long>", [[1, 2], [], None, [None]]),
    ("array<array<long>>", [[[1, 2], []], [], None, [None, [3]]]),
    ("array<array<array<long>>>", [[[[1], [2, 3]], [[]]], [], None, [None, [None, [4]], []]]),
    ("array<array<array<array<long>>>>", [[[[[1, 2]], []], [[[3]]]], None, [[None, [[]]]]]),
])
def test_expressions_at_depth(spark, kind, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i long, x {kind}")
    levels = nested.depth_of(df.schema["x"].dataType)
    assert levels == kind.count("array")
    for depth in range(1, levels + 1):
        if depth == levels:
            got = df.select("i", nested.mapped(F.col("x"), depth, lambda v: v * 10).alias("y"))
            want = {i: plain(x, depth, lambda v: None if v is None else v * 10) for i, x in enumerate(rows)}
        else:
            got = df.select("i", nested.mapped(F.col("x"), depth, F.size).alias("y"))
            want = {i: plain(x, depth, lambda v: None if v is None else len(v)) for i, x in enumerate(rows)}
        assert {r.i: r.y for r in got.collect()} == want
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for level in range(levels):
        got = df.select("i", nested.distributed(F.col("x"), F.array(F.lit(7), F.lit(8)).cast("array<long>") if level == levels - 1 else F.slice(nested.flattened(F.col("x"), level + 1), 1, 0), level).alias("y"))
        if level == levels - 1:
            assert {r.i: r.y for r in got.collect()} == {i: spread(x, [7, 8], level) for i, x in enumerate(rows)}
    for level in range(levels + 1):
        got = {r.i: r.y for r in df.select("i", nested.flattened(F.col("x"), level).alias("y")).collect()}
        assert got == {i: flat(x, level) for i, x in enumerate(rows)}


def test_sparse_counts_of_sounds(spark):
    from mosaiq.functions import sound

    rng = np.random.default_rng(3)
    sounds = {f"s{k}": rng.normal(0, 2000, n).astype(int).tolist() for k, n in enumerate((6000, 9000, 300))}
    wavs = spark.createDataFrame([(n, 8000, x) for n, x in sounds.items()], "name string, rate int, samples array<int>")
    books = [rng.normal(0, 20, (k, 13)) for k in (4, 3, 2)]
    got = {}
    for r in sound.sparse_histograms(wavs, "name", books).collect():
        got.setdefault(r.name, {})[r.cell] = r.n
    for name, x in sounds.items():
        dense = sound.sound_histogram(np.array(x), 8000, books)
        assert got.get(name, {}) == {k: n for k, n in enumerate(dense.tolist()) if n}


def test_broadcasts_are_measured_in_bytes(spark):
    from mosaiq.operators import pairing

    df = spark.createDataFrame([(1, "abc", [1.0] * 1000, {"k": ["x" * 50]}, None), (2, None, None, None, (3, "y" * 100))], "i long, s string, v array<double>, m map<string, array<string>>, n struct<a: long, b: string>")
    assert 8200 < pairing.bytes_of(df) < 8700 and pairing.bytes_of(df.limit(0)) == 0
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(pairing.small(df)) and not hinted(pairing.small(df, 8000))
