import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_texts import brute_components

from mosaiq.llm import graph, jaccard, spm, suffix


def test_anchors_take_little_memory():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 4000, np.uint8)).decode() for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k).encode() for k in range(1000)], pa.binary()), pa.array(texts)], names=["key", "text"])
    assert sum(b.num_rows for b in suffix._runs(iter([batch.slice(0, 10)]))) > 0  # what stays in memory is made here
    tracemalloc.start()
    rows = 0
    for got in suffix._runs(iter([batch])):
        rows += got.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 1000 and peak < 100 << 20


def lowest(links):
    above = {x: x for link in links for x in link}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {x: top(x) for x in above}


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_links_are_joined_in_few_tables(spark, monkeypatch, most):
    """A long chain and random links, in one task and in several; one task needs no rounds."""
    rng = random.Random(4)
    ids = rng.sample(range(10**6), 200)
    links = [*zip(ids[:60], ids[1:61], strict=True), *((rng.choice(ids[61:]), rng.choice(ids[61:])) for _ in range(50))]
    written = []
    monkeypatch.setattr(graph, "keep", lambda df, name, keep=graph.keep: written.append(name) or keep(df, name))
    monkeypatch.setattr(graph, "LINKS", most)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert got == lowest(links)
    assert most < len(links) or len(written) == 2


def test_lists_are_sorted_by_one_number(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 40))) for k in range(30)], "doc_id long, text string")
    lists = jaccard.shared_lists(jaccard.shingle_sets(docs, jaccard.Rule(), np.zeros(0, np.uint64)), jaccard.Rule())
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [by#" in plan and "ASC NULLS FIRST, " not in plan
    assert lists.count() > 0


def test_units_that_come_again_are_kept(monkeypatch):
    pieces = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc"]
    v = spm.Vocabulary(pieces, np.arange(len(pieces)), np.log(np.full(len(pieces), 0.1)), np.arange(256) + 100, -9.0)
    v.prepare()
    built, lattice = [], spm.lattice
    monkeypatch.setattr(spm, "lattice", lambda names, v: built.extend(names) or lattice(names, v))
    units, rng = spm.Units(v, 200), random.Random(6)
    for _ in range(40):
        rare = " ".join("".join(rng.choice("abc") for _ in range(9)) for _ in range(5))
        unit, per = units.add([f"abc ab cab {rare}", "ab abc é"])
        assert per.tolist() == [8, 4] and len(units.lat.piece) <= 200 + 400
        names = list(units.number)
        for u in set(unit.tolist()):
            one = spm._some(units.lat, np.array([u]))
            fresh = lattice([names[u]], v)
            for x, y in ((one.target, fresh.target), (one.piece, fresh.piece), (one.arc_at, fresh.arc_at), (one.cond, fresh.cond)):
                assert np.array_equal(x, y)
            assert np.allclose(one.upto, fresh.upto, atol=1e-9)
    assert built.count("▁abc") == 1


@pytest.mark.parametrize("few,rounds", [(0, 2), (1 << 40, 4)])
def test_short_lists_meet_once(spark, monkeypatch, few, rounds):
    """Lists of few members are done after one turn; pairs are verified at once where they are few."""
    words = [f"w{k}" for k in range(60)]
    rows = [(9 * g + i, " ".join(f"{w}x{g}" if 2 + i * (i < 4) != j else f"n{g}y{i}" for j, w in enumerate(words))) for g in range(4) for i in range(9)]
    calls = []
    monkeypatch.setattr(jaccard, "_verified", lambda *a, verified=jaccard._verified: calls.append(1) or verified(*a))
    monkeypatch.setattr(jaccard, "FEW", few)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85)
    assert len(calls) <= rounds


def test_elements_of_one_set_leave_before_the_sort(spark, monkeypatch):
    """Of 3,000 elements the two that two sets share are sorted, however many are sent at once; places stay."""
    monkeypatch.setattr(jaccard, "SENT", 7)
    sets = [(k, 100, [1000 * k + j for j in range(1000)]) for k in range(3)]
    sets[2][2][5], sets[2][2][999] = 1007, 3
    got = jaccard._entries(spark.createDataFrame([*sets, (7, 5, []), (8, 5, None)], "g long, n long, prefix array<long>").repartition(2)).collect()
    assert sorted(map(tuple, got)) == [(3, 0, 100, 3), (3, 2, 100, 999), (1007, 1, 100, 7), (1007, 2, 100, 5)]
