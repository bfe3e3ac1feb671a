import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mosaiq.llm import gif, html, jaccard, quality, sharding, toxicity, vptree

from test_texts import brute_components

P = "<p>A long enough paragraph of the story that tells what happened, and to whom, and when.</p>"


@pytest.mark.parametrize("name", ["content no-sidebar", "post has-banner", "main nav-open", "page notice-free"])
def test_layout_flags_on_the_wrapper_keep_the_article(name):
    got = html.main_text(f"<html><body><nav><a href=x>m</a></nav><div class='{name}'>{P * 3}</div><div class='sidebar'><p>Side words here.</p></div></body></html>")
    assert got.count("A long enough") == 3 and "Side" not in got


def test_headers_and_words_of_an_article_stay():
    got = html.main_text(f"<body><article><div class='entry-header'><h1>T</h1></div>{P}<p>They <span class='share'>share</span> it.</p><div class='share'>on x</div><section class='comments'>{P * 5}</section></article></body>")
    assert got.split("\n")[0] == "T" and "They share it." in got and "on x" not in got and got.count("A long") == 1


def test_subtrees_above_the_threshold_belong_to_the_text():
    got = html.main_text(f"<body><div>{P * 4}</div><div><a href=1>x y</a> <a href=2>z</a></div><div>{P * 2}</div></body>")
    assert got.count("A long") == 6 and "x y" not in got


def test_deep_and_broken_pages():
    assert html.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert "A long" in html.main_text(f"<body><div class='x{P}<article>{P}</b></i>{P}")


def test_passages_depend_on_their_own_text_only(spark):
    """Each text alone and all in one batch, bit for bit, also beside blank texts."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["word", "Other", "THIRD", "4th.", "|"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    texts += ["", "   ", "\n\t ", "  led by blanks", "x"]
    rng.shuffle(texts)
    label = np.array([float("THIRD" in t) for t in texts])
    at = lambda ts: (np.concatenate([[0], np.cumsum([len(t) for t in ts])]), np.frombuffer("".join(ts).encode(), np.uint8))
    count, x = quality.passages(*at(texts))
    model = quality.fit(count, x, label, steps=20)
    together = model.scores(x, count)
    for k, t in enumerate(texts):
        c, one = quality.passages(*at([t]))
        assert (one == x[count[:k].sum() : count[:k].sum() + count[k]]).all()
        assert model.scores(one, c)[0] == together[k]


def test_a_forward_pass_by_hand():
    rng = np.random.default_rng(2)
    x, count = rng.normal(size=(5, quality.FEATURES)), np.array([2, 3])
    m = quality.fit(count, x, np.array([0.0, 1.0]), steps=3)
    for k, rows in enumerate((x[:2], x[2:])):
        z = np.clip((rows - m.mean) / m.scale, -8, 8)
        code = np.tanh(z @ m.p["W"] + m.p["b"])
        e = (np.tanh(code @ m.p["V"]) / (1 + np.exp(-(code @ m.p["G"])))) @ m.p["u"]
        a = np.exp(e) / np.exp(e).sum()
        assert m.scores(x, count)[k] == pytest.approx(1 / (1 + np.exp(-((a @ code) @ m.p["c"] + m.p["d"]))))


def test_an_id_that_occurs_twice_is_one_query(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 4)))] + [(100, [0.5] * 4)]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, shard_rows=60).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in (0, 100) for k in range(1, 11)]
    assert all(len({r.vec_id for r in got if r.query_id == q}) == 10 for q in (0, 100))


def test_recall_of_the_registered_search(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found, exact = ({(r.query_id, r.vec_id) for r in vptree.nearest(df, F.col("vec_id") % 100 == 0, factor=f).collect()} for f in (vptree.FACTOR, 1.0))
    assert len(found & exact) >= 0.9 * len(exact)


def test_streams_of_strings_and_streams_that_end_early():
    data = np.frombuffer(b"a rose is a rose is a rose. " * 48, np.uint8)[:1152].reshape(6, 192)
    media = gif.encode([data])
    assert len(media) < len(gif.encode([data], packed=False)) and (gif.decode(media).frames[0].indices == data).all()
    short = gif.encode([data[:3]])
    tall = bytearray(short)
    at = tall.index(b"\x2c\0\0\0\0")
    tall[at + 7 : at + 9] = (6).to_bytes(2, "little")
    with pytest.raises(gif.GifError):
        gif.decode(bytes(tall))


def test_pages_of_one_hot_key(spark):
    """Equal rows of one key, and rows of any size: a page keeps the limit unless one row alone is above half of it."""
    rows = [("k", 40)] * 3000 + [("k", 7 * (i % 50)) for i in range(500)] + [("k", 700), ("k", 60), (None, 5)]
    got = sharding.extendible_shards(spark.createDataFrame(rows, "key string, n long"), "key", "n", 100).collect()
    assert sorted((r.key is None, r.key, r.n) for r in got if r.key) == sorted((False, k, n) for k, n in rows if k) and len(got) == len(rows)
    pages = {}
    for r in got:
        pages.setdefault((r.shard, r.page), []).append(r.n)
    assert all(sum(ns) <= 100 or len(ns) == 1 for ns in pages.values())


def near_copies(seed, groups=4, most=40, common=30):
    """Documents around a few originals with random edits, some beside a passage that many share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(common)]
    rows, number = [], 0
    for g in range(groups):
        base = [f"w{g}x{k}" for k in range(rng.randrange(20, 120))] + passage * rng.randrange(2)
        for _ in range(rng.randrange(2, most)):
            w = list(base)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [f"n{rng.randrange(40)}"] * rng.randrange(3)
            rows.append((number, " ".join(w)))
            number += 1
    for _ in range(60):
        rows.append((number, " ".join(passage + [f"u{rng.randrange(1000)}" for _ in range(rng.randrange(2, 60))])))
        number += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 5, 80)])
def test_components_of_random_near_copies(spark, seed, size, percent):
    rows = near_copies(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), jaccard.Rule(size, percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, size, percent)


def test_lists_pass_in_batches_of_any_size(spark):
    """The held rows of a list give the same lists and hubs whatever the batches."""
    docs = spark.createDataFrame(near_copies(3), "doc_id long, text string")
    rule = jaccard.Rule()
    got = []
    for n in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        every = jaccard.shingle_sets(docs, rule, np.zeros(0, np.uint64))
        lists = jaccard.shared_lists(every, rule).collect()
        got.append(sorted(tuple(str(v) for v in r[:-1]) for r in lists))
        of_token = {}
        for r in lists:
            of_token.setdefault(r.token, []).append(r.g)
        assert all(r.mate is None or sorted(of_token[r.token]) == sorted([r.g, r.mate]) for r in lists)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2] and got[0]


def test_the_pipeline_by_brute_force(spark, tmp_path):
    """Every stage's decision, and the whole result, against plain Python on small tables with null and repeated ids."""
    clean, bad, rude = "the garden was quiet and {} came by in the evening with bread", "$$ ## {} || 00 11 %% @@ !!", "you idiot {} moron go away"
    rng = random.Random(6)
    name = lambda: " ".join(f"n{rng.randrange(10**6)}" for _ in range(8))
    rows, labels = [], []
    for i in range(360):
        kind = i % 3
        text = " ".join(x.format(name()) for _ in range(3) for x in ([clean], [bad], [rude, clean])[kind])
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    near = " ".join(clean.format(name()) for _ in range(6)).split()
    for i in range(5):
        w = list(near)
        w[10 + 16 * i] = "zz"
        text = " ".join(w)
        rows.append((1000 + i, text, "en", "t", len(text)))
    block = " ".join(clean.format(name()) for _ in range(3))
    for i in range(3):
        text = f"{clean.format(name())} {clean.format(name())} {block} {clean.format(name())} {clean.format(name())} {clean.format(name())}"
        rows.append((None if i == 2 else 2000 + i, text, "en", f"u{i}", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs, folder = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)

    def kept(stage, docs):
        out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{tmp_path}/{stage.replace(' ', '_')}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    ids = lambda d: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in d.collect())
    all_rows = [(r[0] is None, r[0] or 0, r[1]) for r in rows]
    one = kept("toxicity", docs)
    assert ids(one) == sorted(r for r in all_rows if "idiot" not in r[2])
    two = kept("quality", one)
    assert ids(two) == sorted(r for r in all_rows if "idiot" not in r[2] and "$$" not in r[2])
    three = kept("near duplicates", two)
    held = list(enumerate(r[2] for r in ids(two)))
    comp = brute_components(held, 5, 80)
    smallest = {}
    for k, row in enumerate(ids(two)):
        smallest.setdefault(comp[k][1], row)
    assert ids(three) == sorted(smallest.values()) and len(smallest) < len(held)
    four = kept("repeated spans", three)
    texts = [r[2].encode() for r in ids(three)]
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    cut = []
    for flag, i, t in ids(three):
        b, gone = t.encode(), set()
        for at in range(len(b) - 199):
            if seen[b[at : at + 200]] > 1:
                gone |= set(range(at, at + 200))
        cut.append((flag, i, bytes(x for at, x in enumerate(b) if at not in gone).decode()))
    assert ids(four) == sorted(cut) and cut != ids(three)
    five = corpus_pipeline.packed(spark, four, folder).collect()
    sizes = sorted((r[0], r[1], len(r[2].encode())) for r in ids(four))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in five) == sizes
    source = {r.doc_id: r.source for r in four.collect()}
    bins = {}
    for r in five:
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert all(sum(r.n_bytes for r in b) <= corpus_pipeline.SEQUENCE and len({source[r.doc_id] for r in b}) == len(b) for b in bins.values())
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in whole) == sizes


def test_a_text_of_very_many_terms():
    """The pair sum of a long text stays finite and in range."""
    m = toxicity.Machine(np.arange(100_000), 0.0, np.full(100_000, 0.1), np.full((100_000, 8), 0.5))
    p = m.logits(np.zeros(100_000, np.int64), np.arange(100_000), 1)
    assert np.isfinite(p).all() and 0 <= toxicity._sigmoid(p)[0] <= 1


def test_lists_part_where_sizes_are_too_far_apart_to_link(spark):
    """One element in sets of 20, 21, 100, 104 and 400 elements, whatever the batches."""
    rows = [(g, n, [7]) for g, n in ((1, 20), (2, 21), (3, 100), (4, 104), (5, 400))]
    for most in ("1", "2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        lists = {}
        for r in jaccard.shared_lists(spark.createDataFrame(rows, "g long, n long, prefix array<long>"), jaccard.Rule()).collect():
            lists.setdefault(r.token, set()).add(r.g)
        assert sorted(map(sorted, lists.values())) == [[1, 2], [3, 4]]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
