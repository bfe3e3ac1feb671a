import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from mosaiq.llm import queries, ranked

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def brute(docs, items, top):
    held = [(doc_id, Counter(t), len(t)) for doc_id, text in docs if (t := terms(text))]
    n, total = len(held), sum(x for *_, x in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tf, length in held:
            m = 75 + (25 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, doc_id, -score) for k, (score, _, doc_id) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:top])]
    return out


def tables():
    rng = random.Random(12)
    vocabulary = [f"{rng.choice('aäbcd')}{k}" for k in range(120)]
    topic = lambda k: vocabulary[(k % 6) * 20 : (k % 6) * 20 + 20]
    docs = [(k, " ".join(rng.choices(topic(k) if rng.random() < 0.8 else vocabulary, k=rng.randrange(1, 50)))) for k in range(900)]
    docs += [(2000 + k, docs[3][1]) for k in range(150)]  # copies: ties by id
    docs += [(None, docs[5][1]), (None, None), (3000, ""), (3001, " .,;\n"), (3002, "B3" * 5000), (3003, "ÄB c7-c7 " * 4000), *[(77, docs[77][1])] * 60]
    items = [(k, " ".join(rng.choices(topic(k), k=rng.randrange(1, 12))) + "!") for k in range(40)]
    return docs, [*items, (1, items[2][1]), (41, None), (42, "nowhere"), (None, docs[3][1]), (43, "ÄB b3")]


@pytest.mark.parametrize("cluster,block,items", [(256, 4096, 1024), (8, 100, 5)])
def test_against_brute_force(spark, monkeypatch, cluster, block, items):
    for name, value in (("CLUSTER", cluster), ("BLOCK", block), ("ITEMS", items)):
        monkeypatch.setattr(ranked, name, value)
    docs, wanted = tables()
    frame = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, score int").repartition(6)
    got = ranked.search(frame, spark.createDataFrame([(*r, 0) for r in wanted], "item_id long, text string, rank int"), 10).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute(docs, wanted, 10)
    assert len(want) > 300 and sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_clusters_are_left_out(spark, monkeypatch):
    """With documents of six topics, an item visits a part of the clusters."""
    for name, value in (("CLUSTER", 16), ("BLOCK", 4096)):
        monkeypatch.setattr(ranked, name, value)
    docs, wanted = tables()
    frame = spark.createDataFrame([r for r in docs if r[0] is not None and r[0] < 900], "doc_id long, text string")
    listed = ranked.item_terms(spark.createDataFrame(wanted[:40], "item_id long, text string"))
    visits = ranked._search_block(spark, frame, listed, 5)[1].first()[0]
    assert 40 < visits < 0.6 * 40 * 900 / 16


def test_bisection_parts_topics():
    rng = np.random.default_rng(6)
    topic = rng.permutation(np.repeat(np.arange(4), 64))
    doc = np.repeat(np.arange(256), 20)
    term = topic[doc] * 50 + rng.integers(0, 50, len(doc))
    leaf = ranked.bisected(doc, term, 256, 2)
    assert np.bincount(leaf).tolist() == [64] * 4
    assert sum(len(set(topic[leaf == k])) == 1 for k in range(4)) >= 2
    assert ranked.bisected(np.zeros(0, int), np.zeros(0, int), 3, 1).tolist() == [0, 0, 1]
    upper = ranked.Upper.fitted(doc, term, 256, 200, 2)
    assert len(np.unique(upper.leaf(doc, term, 256))) == 4


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id int, text string")
    items = spark.createDataFrame([("x", "a b"), ("y", None)], "item_id string, text string")
    got = ranked.search(docs, items)
    assert got.count() == 0 and [k for _, k in got.dtypes] == ["string", "int", "int", "bigint"]
    assert ranked.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranked.search(spark.createDataFrame([(5, "A")], docs.schema), items).collect()] == [("x", 1, 5, 287 * (10**9 // (1000 + 1200)))]


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.sql(queries.ORACLES["op11_ranked_search"])
    got = queries.QUERIES["op11_ranked_search"](spark, folder)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
