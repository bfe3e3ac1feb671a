import tracemalloc

import numpy as np
import pyarrow as pa

from test_collocations import brute, random_rows

from mosaiq.llm import collocations, jaccard, suffix

NAMES = ["anchor", "content", "copies", "bytes"]


def _batches(rows, size=7):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return iter([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names=NAMES) for i in range(0, len(rows), size)])


def test_memory_of_a_suffix_array():
    rng = np.random.default_rng(3)
    n = 1 << 20
    text = rng.integers(97, 123, n).astype(np.uint8)
    text[n // 2 : n // 2 + 5000] = text[:5000]
    allowed = np.ones(n, bool)
    allowed[-199:] = False
    tracemalloc.start()
    found = suffix.repeated_starts(text, allowed, np.ones(n, np.uint8), 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int(found.sum()) == 2 * (5000 - 199)
    assert peak < 72 * n


def test_anchors_share_a_suffix_array_only_while_they_fit(monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 3000)
    sizes, plain = [], suffix.repeated_starts
    monkeypatch.setattr(suffix, "repeated_starts", lambda text, *rest: sizes.append(len(text)) or plain(text, *rest))
    rng = np.random.default_rng(4)
    rows = []
    for anchor, many in enumerate((3, 2, 12, 1, 4, 1)):
        same = rng.integers(97, 123, 210).astype(np.uint8).tobytes()
        rows += [(anchor, k, 1, bytes([65 + k]) + same + bytes([97 + k]) * 189) for k in range(many)]
    got = [row for batch in suffix._marks(_batches(rows)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    # Anchors of 1,200, 800, 4,800, 400, 1,600 and 400 bytes: the large one isn't joined to others.
    assert sizes == [2000, 4800, 2400]
    assert sorted((a, c) for a, c, *_ in got) == [(a, c) for a, c, *_ in rows if a not in (3, 5)]
    assert {(tuple(b), tuple(e)) for _, _, b, e in got} == {((1,), (211,))}


def test_the_readings_of_the_texts_dont_grow_with_the_candidates(spark, monkeypatch):
    rows = random_rows()
    docs = spark.createDataFrame([(t, lang) for t, lang in rows], "text string, lang string").repartition(5)
    tables, plain = [], collocations.keep
    monkeypatch.setattr(collocations, "keep", lambda df, name: tables.append(name) or plain(df, name))
    monkeypatch.setattr(collocations, "KEYS", 3000)
    monkeypatch.setattr(collocations, "width", lambda words, support: 25, raising=False)
    got = sorted(map(tuple, collocations.collocations(docs, collocations.Rule(12, 80, 25)).collect()))
    assert got == sorted(brute(rows, 12, 80, 25))
    assert len(tables) == 3


def test_sieves_grow_with_the_words():
    assert collocations.width(1000, 30) == collocations.SIEVE
    assert 1 << collocations.width(10**9, 30) >= 2 * 10**9 // 30
    assert collocations.width(10**12, 30) == collocations.WIDEST


def test_candidates_with_one_hash_are_seen():
    h = np.array([[1, 1, 1], [2, 3, 2], [0, 0, 0], [0, 0, 0]], np.uint64)
    k, n = np.array([2, 2, 2], np.int32), np.array([5, 7, 9])
    slots = collocations.Slots.of(k, h, n)
    assert sorted(slots.f.tolist()) == [7, 14]
    assert collocations.Slots.of(np.array([2, 3, 2], np.int32), h, n).f.sum() == 21
    twice = h.copy()
    plain = collocations._combined
    try:
        collocations._combined = lambda g, h, k: g
        assert collocations.Slots.of(k, twice, n) is None
    finally:
        collocations._combined = plain


def test_what_the_driver_gets_of_common_shingles_doesnt_grow_with_the_partitions(spark):
    most = 5000
    texts = [" ".join(f"{chr(97 + k)}{i}" for i in range(3000 if k == 3 else 12_000)) for k in range(4)]
    rows = [*[texts[0]] * 3, *[texts[1]] * 3, "only once", *[texts[2]] * 3, *[texts[3]] * 4]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in rows], 2), "text string")
    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    sc = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sc.setJobGroup("common shingles", "")
        got = jaccard.common_shingles(docs, jaccard.Rule(), most)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {i for j in sc.statusTracker().getJobIdsForGroup("common shingles") for i in sc.statusTracker().getJobInfo(j).stageIds}
    sent = [sc._jsc.sc().statusStore().lastStageAttempt(i).resultSize() for i in stages]
    assert max(sent) < 500_000, sent  # the first 5,000 rows of each of 12 partitions take more
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    hashes = [jaccard.shingles(np.array([0, len(d)]), d, 4)[1] for d in data]
    # The last text's four copies first, then all that come three times, each by hash.
    ordered = np.concatenate([np.sort(hashes[3].view(np.int64)), np.sort(np.concatenate(hashes[:3]).view(np.int64))])
    np.testing.assert_array_equal(got[::-1].view(np.int64), ordered[:most])
