import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from mosaiq.llm import collocations, queries, sums
from mosaiq.llm.perfecthash import PerfectHash


def brute(rows, support, inside, most):
    """The contract's rows, word by word."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    often = {p: a for p, a in f.items() if a >= support and len(p) > 2}
    for (lang, *p), a in often.items():
        score, _, l, r = min(((2_000_000 * a) // (f[lang, *p[:k]] + f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
        if not any(q[0] == lang and len(q) - 1 > len(p) and any(list(q[1 + i : 1 + i + len(p)]) == p for i in range(len(q) - len(p))) and 100 * b >= inside * a for q, b in often.items()):
            out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= most:
            ranked.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def random_rows():
    rng, words = random.Random(8), ["Alpha", "beta", "gamma\t", "delta.", "é", "Éa", "it's", "new york", "new york city", "in the end of,", "ONE", "\n", "two;", "three  ", "z\x0bq"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for _ in range(400)]
    return [*rows, (None, "en"), ("", None), (" \t", "fr"), *[("copied text of many words again and again", "en")] * 30, ("long " * 20_000, "de")]


@pytest.mark.parametrize("keys,text,fan", [(1 << 20, 8 << 20, 64), (60, 500, 2)])
def test_against_brute_force(spark, monkeypatch, keys, text, fan):
    """Small blocks, chunks and sums give the same rows as large ones."""
    for module, name, value in ((collocations, "KEYS", keys), (collocations, "TEXT", text), (sums, "FAN", fan)):
        monkeypatch.setattr(module, name, value)
    rows = random_rows()
    docs = spark.createDataFrame([(i % 7, t, lang, 0) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, score int").repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, collocations.Rule(12, 80, 25)).collect()))
    want = sorted(brute(rows, 12, 80, 25))
    assert len(want) > 40 and got == want


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "a b c", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    """A count whose product with two million doesn't fit in 64 bits."""
    big = 9 * 10**18
    rows = spark.createDataFrame([(2, big, [big, 0, 0], [big - 1, 0, 0]), (3, 50, [100, 60, 0], [60, 100, 0])], "k int, a long, l array<long>, r array<long>")
    got = rows.select(collocations._lowest_cut().alias("c")).select("c.*").collect()
    assert [(r.score, r.cut, r.l, r.r) for r in got] == [(2_000_000 * big // (2 * big - 1), 1, big, big - 1), (2_000_000 * 50 // 160, 1, 100, 60)]


def test_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = con.sql(queries.ORACLES["op12_phrase_collocations"])
    got = queries.QUERIES["op12_phrase_collocations"](spark, folder)
    assert got.columns == want.columns and [k for _, k in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and got.count() > 100


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 200_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        perfect = PerfectHash(keys)
        assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))
        other = perfect.slots(rng.integers(1 << 63, 1 << 64, 1000, np.uint64))
        assert other.min(initial=0) >= -1 and other.max(initial=-1) < len(keys)
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash(np.array([5, 5], np.uint64))


def test_arrays_of_counts_come_back():
    rng = np.random.default_rng(4)
    for counts in (np.zeros(9, np.int64), rng.integers(0, 300, 1000), (rng.random(70_000) < 0.01) * rng.integers(1, 1 << 40, 70_000)):
        assert np.array_equal(sums.unpacked(sums.packed(counts)), counts)
