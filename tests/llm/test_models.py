import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import html, quality, toxicity, vptree

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.93), (quality, "quality", 0.97)])
def test_held_out_accuracy(tables, module, label, least):
    docs, labels = tables
    got = module.scored(docs, module.learn(docs, labels)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held[label]).mean() >= least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_missing_labels(docs, tables, module):
    _, labels = tables
    model = module.learn(docs, labels.limit(0))
    got = module.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert module.scored(docs.limit(0), model).count() == 0
    keeps = toxicity.only_clean(docs, model) if module is toxicity else quality.only_good(docs, model)
    assert keeps.columns == docs.columns


@pytest.mark.parametrize("module,fit", [(toxicity, "fit_lists"), (quality, "fit")])
def test_learning_takes_no_memory_of_the_driver(tables, module, fit, monkeypatch):
    monkeypatch.setattr(module, fit, lambda *features: (os.getpid(), len(features[-1])))
    where, rows = module.learn(*tables)
    assert where != os.getpid() and rows > 100


def test_pairs_of_terms_matter():
    """An insult with a group's name is toxic, and neither is alone: an additive model can't tell."""
    rng = np.random.default_rng(0)
    text, bucket, label = [], [], []
    for i in range(800):
        a, b = map(int, rng.random(2) < 0.3)
        here = [1] * a + [2] * b + [3 + int(rng.integers(50))]
        text += [i] * len(here)
        bucket += here
        label.append(float(a and b))
    m = toxicity.fit(np.array(text), np.array(bucket), np.array(label))
    p = m.logits(np.array([0, 1, 2, 2]), np.array([1, 2, 1, 2]), 3)
    assert p[2] > 0 > max(p[0], p[1])


@pytest.mark.parametrize("rate", [0.5, 0.25])
def test_pairs_of_terms_that_are_equally_common_alone(rate):
    """Insults 1 and 2 are toxic with their own group, 11 and 12; clean rows hold each term as often, in the other pairs."""
    rng = np.random.default_rng(5)
    text, bucket, label = [], [], []
    for i in range(1600):
        toxic, one, here = i % 2, int(rng.integers(2)), [20 + int(rng.integers(50))]
        if rng.random() < 2 * rate:
            here += [1 + one, 11 + (one if toxic else 1 - one)]
        text += [i] * len(here)
        bucket += here
        label.append(float(toxic))
    m = toxicity.fit(np.array(text), np.array(bucket), np.array(label))
    p = m.logits(np.repeat(np.arange(4), 2), np.array([1, 11, 2, 12, 1, 12, 2, 11]), 4)
    assert min(p[:2]) > 2 and max(p[2:]) < -2


def test_a_term_of_many_clean_rows_counts():
    """Term 1 is in half of the clean rows and in nearly all toxic ones."""
    rng = np.random.default_rng(6)
    lists = [np.array([1, 2 + i % 50] if rng.random() < (0.97 if i % 2 else 0.5) else [2 + i % 50]) for i in range(1000)]
    m = toxicity.fit_lists(lists, np.arange(1000) % 2.0)
    p = m.logits(np.array([0]), np.array([1]), 2)
    assert p[0] > 0 > p[1]


def lexicon(n, size, kind, seed=1):
    """Documents of 40 filler words. ``both``: toxic ones have an insult and a group, clean ones either; ``pairs``: all have both, and which go together decides."""
    rng, lists, label = np.random.default_rng(seed), [], []
    for _ in range(n):
        a, b, one = int(rng.integers(size)), 100 + int(rng.integers(size)), rng.random() < 0.5
        toxic = one if kind == "both" else (a + b) % 2 == 0
        own = [a, b] if kind == "pairs" or toxic else [a] if rng.random() < 0.5 else [b]
        lists.append(np.unique([*(1000 + rng.zipf(1.3, 40) % 3000), *own]))
        label.append(float(toxic))
    return lists, np.array(label)


@pytest.mark.parametrize("n,size,kind", [(6000, 10, "both"), (6000, 20, "both"), (12_000, 10, "both"), (12_000, 20, "both"), (6000, 10, "pairs"), (12_000, 10, "pairs")])
def test_a_lexicon_whose_pairs_are_rare(n, size, kind):
    """Insults and groups by tens: no single pair is in many rows, and some pairs are in none that is learned from."""
    lists, label = lexicon(n + 2000, size, kind)
    seen = {(x[0], x[1]) for x in lists[:n] if x[1] < 200}
    m = toxicity.fit_lists(lists[:n], label[:n])
    rest, want = lists[n:], label[n:]
    p = toxicity._sigmoid(m.logits(np.repeat(np.arange(2000), [len(x) for x in rest]), np.concatenate(rest), 2000)) >= 0.7
    assert p[want == 1].mean() >= 0.9 and p[want == 0].mean() < 0.01
    assert len(m.buckets) < 2000 and len(seen) <= size * size


def test_pairs_that_were_never_seen():
    """An insult and a group that no learned row has together are toxic together all the same."""
    lists, label = lexicon(8000, 10, "both")
    never = [k for k, x in enumerate(lists) if x[1] < 200 and x[0] % 5 == x[1] % 5]
    rest = np.setdiff1d(np.arange(8000), never)
    m = toxicity.fit_lists([lists[k] for k in rest], label[rest])
    held = [lists[k] for k in never]
    p = toxicity._sigmoid(m.logits(np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate(held), len(held)))
    assert len(held) > 500 and (p >= 0.7).mean() >= 0.9


def test_scores_are_the_plain_double_sum():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.array([3, 8, 9, 40]), 0.3, rng.normal(size=4), rng.normal(size=(4, 3)))
    texts = [[3, 8, 40], [5], [9, 3, 7, 8, 40], []]
    want = []
    for x in texts:
        at = [m.buckets.tolist().index(b) for b in x if b in m.buckets]
        want.append(m.bias + sum(m.weight[k] for k in at) + sum(m.factors[j] @ m.factors[k] for i, j in enumerate(at) for k in at[i + 1 :]))
    got = m.logits(np.repeat(np.arange(4), [len(x) for x in texts]), np.array([b for x in texts for b in x]), 4)
    assert np.allclose(got, want)


def test_attention_finds_the_passage():
    rng = np.random.default_rng(1)
    count = np.full(300, 6)
    x = rng.normal(0, 1, (1800, quality.FEATURES))
    label = (rng.random(300) < 0.5).astype(float)
    where = rng.integers(0, 6, 300)
    x[np.arange(300) * 6 + where, 0] += np.where(label == 0, 6, 0)
    m = quality.fit(count, x, label)
    assert ((m.scores(x, count) > 0.5) == label).mean() > 0.95
    a = m.attention(x, count).reshape(300, 6)
    assert np.allclose(a.sum(1), 1)
    assert (a[label == 0].argmax(1) == where[label == 0]).mean() > 0.6


@pytest.mark.parametrize("page,want", [
    ("<body><nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three<p>Four &#233;</article><footer>f</footer>", "A & B\nOne two three\nFour é"),
    ("<html><body><div class='comment-list'><p>nice one, friend</p></div><main><h1>T</h1><div><p>Long enough text of the page.</p></div><form>x</form></main></body>", "T\nLong enough text of the page."),
    ("<p>plain text without a body</p>", "plain text without a body"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style>", ""),
    ("", ""),
    (None, ""),
    ("<article>unclosed <b>text", "unclosed text"),
    ("<body><p>a &lt; b</p><", "a < b\n<"),
])
def test_main_text(page, want):
    assert html.main_text(page or "") == want or (page or "").endswith("<")


def test_extraction_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (2, None, "<p>x</p>" * 3000, 6)], "page_id long, url string, html string, text int")
    got = html.extracted(df).orderBy("page_id").collect()
    assert got[0].text == "" and got[0].n_chars == 0 and got[1].text.count("\n") == 2999
    assert html.extracted(df.limit(0)).count() == 0


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    x[500:700] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = vptree.nearest(df, F.col("vec_id") % 100 == 0, factor=1.0, shard_rows=300).collect()
    assert len(got) == 90
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    for q in range(0, 900, 100):
        d = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in enumerate(x) if i != q)[:10]
        for n, (s, i) in enumerate(d, 1):
            assert found[q][n][1] == i and found[q][n][0] == pytest.approx(s, abs=1e-12)
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_recall(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"], float)
    tree = vptree.Tree(ids, x)
    q = ids % 10 == 0
    _, found = tree.search(ids[q], x[q], 10, vptree.FACTOR)
    exact = vptree.Tree(ids, x, leaf=len(ids)).search(ids[q], x[q], 10, 1.0)[1]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, exact)]) >= 0.9


LONG = "A sentence of the page's own text. " * 20


@pytest.mark.parametrize("page", [
    f"<body><header>Site</header><form id='aspnetForm'><div class='menu'><a href=x>Home</a></div><div id='content'><p>{LONG}</p></div><div class='comments'><p>first!</p></div></form><footer>f</footer>",
    f"<body><div class='nav'><a href=x>Home</a></div><div class='post category-social hentry'><p>{LONG}</p></div><div class='sidebar'>More</div>",
    f"<body><div class='post-12 post tag-recommended-reading'><p>{LONG}</p></div><div class='related-posts'><a href=x>Another</a></div>",
    f"<body><div class='weather-alert-story'><p>{LONG}</p></div><footer>f</footer>",
    f"<body class='login'><div class='login-guide'><p>{LONG}</p></div><nav><a href=x>Home</a></nav>",
    f"<body><div class='ad'>Buy now<article><p>{LONG}</p></article><footer>f</footer>",
    f"<body><div class='content'><p>{LONG}</p></div><div class='comment-list'>{'<p>I read it, and I liked it a lot.</p>' * 60}</div>",
    f"<body><article><p>{LONG}</p></article><form><p>{'Please fill in this form. ' * 100}</p></form>",
])
def test_no_name_empties_a_page(page):
    assert html.main_text(page) == LONG.strip()


def test_densities_by_their_definition():
    """Counts, densities and the main node of random trees, from the definition alone."""
    rng = np.random.default_rng(11)

    def tree(depth):
        parts = []
        for _ in range(rng.integers(1, 5)):
            kind = rng.integers(4) if depth else 0
            parts.append(("text", "x" * int(rng.integers(1, 60)), bool(rng.integers(2))) if kind < 2 else ("node", tree(depth - 1)))
        return parts

    def page(parts):
        return "".join((f"<a href=y>{p[1]}</a>" if p[2] else p[1]) if p[0] == "text" else f"<div>{page(p[1])}</div>" for p in parts)

    def counts(parts):
        n = [0, 0, 0, 0]  # characters, of links, tags, of links
        for p in parts:
            more = (len(p[1]), len(p[1]) * p[2], int(p[2]), int(p[2])) if p[0] == "text" else [a + b for a, b in zip(counts(p[1]), (0, 0, 1, 0))]
            n = [a + b for a, b in zip(n, more)]
        return n

    for _ in range(60):
        body = tree(4)
        total = counts(body)
        share = (total[1] + 1) / (total[0] + 1)

        def density(parts):
            chars, link_chars, tags, link_tags = counts(parts)
            if not chars:
                return 0.0
            base = np.log(chars / max(1, chars - link_chars) * link_chars + share * chars + np.e)
            ratio = max(chars / (link_chars or 1) * (tags or 1) / (link_tags or 1), 1.0)
            return chars / (tags or 1) * np.log(ratio + np.e - 1) / np.log(max(2.0, base))

        def sums(parts):
            own = sum(len(p[1]) for p in parts if p[0] == "text")
            here = sum(density(p[1]) for p in parts if p[0] == "node") + (density(parts) if own * 2 > counts(parts)[0] else 0)
            return [here, *(s for p in parts if p[0] == "node" for s in sums(p[1]))]

        root = html.parse("<body>" + page(body))
        best, least = html.main_node(root)
        (inner,) = [p for p in root.parts if isinstance(p, html.Node)]
        assert [inner.chars, inner.link_chars, inner.tags, inner.link_tags] == total
        assert best.total == pytest.approx(max([density(body), *sums(body)]), rel=1e-6)
        assert inner.density == pytest.approx(density(body), rel=1e-9)
