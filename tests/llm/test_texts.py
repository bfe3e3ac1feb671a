import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.llm import gif, jaccard, packing, sharding, spm, suffix


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=6000), st.booleans())
def test_lzw_round_trip(data, packed):
    assert gif.lzw_decode((gif.lzw_encode if packed else gif.literal_encode)(data), 8) == data


def test_lzw_long_runs():
    for data in (b"a" * 90_000, bytes(range(256)) * 300, random.Random(1).randbytes(40_000)):
        assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def test_gif_disposal_transparency_and_time():
    a = np.zeros((4, 4), np.uint8)
    b = np.full((2, 2), 1, np.uint8)
    b[0, 0] = 2
    blob = bytearray(gif.encode([a, b], delay_cs=7))
    second = blob.rindex(b"\x21\xf9\x04")
    blob[second + 3 : second + 7] = bytes([3 << 2 | 1, 7, 0, 2])  # puts back what was there; index 2 is clear
    third = gif.encode([a])[13 + 768 + 19 : -1]
    got = gif.decode(bytes(blob[:-1]) + third + b";")
    assert [f.delay_cs for f in got.frames] == [7, 7, 4] and got.loops == 0
    zero, one = got.frames[0].rgba[0, 0].tolist(), got.frames[1].rgba[0, 1].tolist()
    assert got.frames[1].rgba[0, 0].tolist() == zero and one != zero
    assert (got.frames[2].rgba == zero).all()
    for bad in (b"", b"GIF89a", b"GIF89a" + bytes(20), blob[:900]):
        try:
            gif.decode(bytes(bad))
        except (gif.GifError, IndexError):
            pass


def test_gif_frames_as_rows(spark):
    blob = gif.encode([np.zeros((3, 5), np.uint8), np.ones((3, 5), np.uint8)])
    df = spark.createDataFrame([(1, blob), (2, None), (3, b"nonsense")], "k int, content binary")
    got = gif.decode_frames(df).collect()
    assert [(r.k, r.frame, r.start_ms) for r in got] == [(1, 0, 0), (1, 1, 40), (2, None, None), (3, None, None)]
    assert sum(got[0].histogram) == 15 and got[2].error
    with pytest.raises(ValueError):
        gif.decode_frames(df.withColumnRenamed("k", "frame"))


def test_stored_texts(docs):
    want = {}
    for r in docs.collect():
        p = (r.text or "").encode()
        q = p.ljust(max(1, -(-len(p) // 192)) * 192)
        want[r.doc_id] = (len(p), len(q), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-16:]))
    got = gif.stored_texts(docs).collect()
    assert len(got) == docs.count() and {r.doc_id: tuple(r[1:5]) for r in got} == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert gif.stored_texts(docs.limit(0)).count() == 0


def brute_components(rows, size=4, percent=85):
    sets, up = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        up[i] = i
    find = lambda x: x if up[x] == x else find(up[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check_components(df):
    rows = [(r.doc_id, r.text) for r in df.filter("doc_id IS NOT NULL").collect()]
    got = jaccard.jaccard_components(df).filter("doc_id IS NOT NULL").collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_components_of_cases(docs):
    check_components(docs)


def test_components_of_a_long_list(spark):
    """A chain of near copies beyond the short lists: blocks must join what hubs leave apart."""
    rng = random.Random(4)
    words = [f"t{k}" for k in range(90)]
    rows = []
    for i in range(90):
        w = list(words)
        for _ in range(1 + i % 4):
            w[rng.randrange(90)] = f"n{rng.randrange(6)}"
        rows.append((i, " ".join(w)))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"))


def test_components_of_an_empty_table(docs):
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=400) | st.text("ab", max_size=400).map(str.encode))
def test_two_stage_order(data):
    text = np.frombuffer(data, np.uint8)
    got = suffix.two_stage(text, 24)
    assert sorted(got.tolist()) == list(range(len(data)))
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert [data[i : i + 24] for i in got] == [data[i : i + 24] for i in want]
    prefixes = suffix.common_prefixes(text, got, 24)
    for n in range(1, len(data)):
        x, y = data[got[n] :][:24], data[got[n - 1] :][:24]
        assert prefixes[n] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def brute_repeats(rows):
    count = collections.Counter()
    for _, t in rows:
        count.update(t[k : k + 200] for k in range(len(t) - 199))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_spans(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    got = suffix.dedup_report(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)
    assert suffix.dedup_report(docs.limit(0)).count() == 0


def test_repeated_spans_of_a_hot_anchor(docs, monkeypatch):
    monkeypatch.setattr(suffix, "ANCHOR_BYTES", 0)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert sorted(map(tuple, suffix.dedup_report(docs).collect()), key=str) == brute_repeats(rows)


def test_cut_texts(docs):
    with pytest.raises(ValueError):
        suffix.without_repeats(docs)
    plain = docs.drop("begin")
    got = suffix.without_repeats(plain).collect()
    assert len(got) == docs.count() and got[0].__fields__ == plain.columns
    by = {r.doc_id: r.text for r in got}
    assert by[5] is None and by[6] == "" and by[8] == "a b" and "shared30" not in by[11]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2])), max_size=40))
def test_packing_is_best_fit(items):
    sizes, sources, clusters = [list(c) for c in zip(*items)] if items else ([], [], [])
    got = packing.pack(sizes, sources, clusters, 10)
    assert sum(g[3] for g in got) == sum(sizes)
    assert {g[0] for g in got} == set(range(len(sizes)))
    bins = collections.defaultdict(list)
    for i, b, at, n in got:  # in the order in which they were placed
        if n < 10 and (n or not sizes[i]):
            fit = [(10 - sum(x[1] for x in v), k) for k, v in bins.items() if sum(x[1] for x in v) + n <= 10 and sum(x[1] for x in v) < 10 and not any((sources[i] is not None and sources[x[0]] == sources[i]) or (clusters[i] is not None and clusters[x[0]] == clusters[i]) for x in v)]
            if fit:
                assert 10 - sum(x[1] for x in bins[b]) == min(fit)[0]
            else:
                assert b not in bins
        assert at == sum(x[1] for x in bins[b])
        bins[b].append((i, n))


def test_packed(docs):
    from pyspark.sql import functions as F

    got = packing.packed(docs, F.octet_length("text"), packing.text_cluster(F.col("text")), 512).collect()
    assert sum(r.n_bytes for r in got) == sum(len((r.text or "").encode()) for r in docs.collect())
    assert packing.packed(docs.limit(0), F.octet_length("text"), packing.text_cluster(F.col("text")), 512).count() == 0


def test_shards(spark):
    rows = spark.createDataFrame([(k, 10) for k in range(400)] + [(None, None), (7, 1000), (8, 5000)] + [(9, 10)] * 300, "k long, n long")
    got = sharding.extendible_shards(rows, "k", "n", 900).collect()
    assert len(got) == rows.count()
    size, depth = collections.Counter(), {}
    for r in got:
        size[r.shard] += r.n or 0
        depth[r.shard] = r.local_depth
    for r in got:
        assert len(r.shard) == r.local_depth and size[r.shard] == r.shard_bytes
        assert r.shard_bytes <= 900 or r.local_depth == sharding.BITS
    for a in depth:
        parent = sum(n for s, n in size.items() if s.startswith(a[:-1]))
        assert not a or parent > 900
    pages = collections.Counter()
    for r in got:
        if r.k == 9:
            pages[r.page] += 10
    assert max(pages.values()) <= 900 + 10
    assert sharding.extendible_shards(rows.limit(0), "k", "n", 900).count() == 0
    d = sharding.directory(sharding.extendible_shards(rows.filter("k < 9"), "k", "n", 900)).collect()
    slots = sorted((r.first_slot, r.last_slot) for r in d)
    assert all(a[1] < b[0] for a, b in zip(slots, slots[1:])) and slots[-1][1] < 2 ** d[0].global_depth
    assert all(r.last_slot - r.first_slot + 1 == 2 ** (r.global_depth - r.local_depth) for r in d)


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return spm.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def test_segmentations(spark, docs, vocabulary):
    import sentencepiece
    import public_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = spm.sampled_segmentations(docs, vocabulary, 3, ids=True)
    got = out.collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        assert r.restored and 0 < r.inclusion <= 1 and r.n_pieces == len(r.ids)
        assert sp.decode(list(r.ids)) == texts[r.doc_id]
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(by[1]) == 3 and len(by[6]) == 1 and len({r.ids_sha256 for r in by[1]}) == 3
    assert all(a.perturbed > b.perturbed for a, b in zip(by[1], by[1][1:]))
    assert {r.text for r in spm.restored_texts(out, vocabulary).filter("doc_id = 1").collect()} == {texts[1]}
    assert spm.sampled_segmentations(docs.limit(0), vocabulary).count() == 0


def test_segmentations_are_drawn_by_their_probability():
    toy = spm.Vocabulary(["▁", "a", "b", "ab", "ba", "▁a"], np.arange(6), np.log(np.array([0.1, 0.2, 0.2, 0.2, 0.15, 0.15])), np.arange(256) + 6, -6.0)
    toy.prepare()
    lat = spm.lattice(["▁aba"], toy)
    n = 4000
    got = spm.sample_texts(lat, np.zeros(n, np.int64), np.ones(n, np.int64), spm.mix(np.arange(n).astype(np.uint64)), 2)
    p = {s: np.exp(sum(toy.logp[i] for i in s)) for s in ((0, 1, 2, 1), (0, 3, 1), (0, 1, 4), (5, 2, 1), (5, 4))}
    total = sum(p.values())
    first = collections.Counter(tuple(lat.piece[s[0].arcs].tolist()) for s, _ in got)
    second = collections.Counter(tuple(lat.piece[s[1].arcs].tolist()) for s, _ in got)
    for s, x in p.items():
        assert abs(first[s] / n - x / total) < 0.03
        assert abs(second[s] / n - sum(q / total * x / (total - q) for o, q in p.items() if o != s)) < 0.03


def test_suffix_array_of_wanted_places_only():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        text = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        data, wanted = text.tobytes(), (rng.random(n) < 0.4) & (np.arange(n) + 6 <= n)
        order = suffix.two_stage(text, 24, wanted).tolist()
        assert len(set(order)) == len(order) and set(np.flatnonzero(wanted).tolist()) <= set(order)
        assert [data[i : i + 24] for i in order] == sorted(data[i : i + 24] for i in order)
        starts = [data[i : i + 6] for i in np.flatnonzero(wanted)]
        want = [bool(wanted[i]) and starts.count(data[i : i + 6]) > 1 for i in range(n)]
        assert suffix.repeated_starts(text, wanted, np.ones(n, int), 6).tolist() == want
