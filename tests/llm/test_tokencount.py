import random

import pytest

from mosaiq.llm import queries, tokencount


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


def random_texts(n):
    rng, some = random.Random(3), ["the", "Zürich", " ", "  ", "▁", "▁▁", "\n", "\r\n", "\t", "7", "42", "<s>", "</s>", "<0x0A>", "<unk>", "é", "日本", "😀", "\x00", "xqzj", ".", "...", "ing", " and", " ", " ", "ﬁ"]
    return ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("span,remembered,merged", [(1 << 20, 200_000, 4096), (7, 5, 2)])
def test_counts_are_the_encoders(library, monkeypatch, span, remembered, merged):
    for name, value in (("SPAN", span), ("REMEMBERED", remembered), ("MERGED", merged)):
        monkeypatch.setattr(tokencount, name, value)
    with open(queries.tokenizer_path(), "rb") as f:
        counter = tokencount.Counter(f.read())
    texts = [*random_texts(3000), "", " ", "\n", "▁", "a" * 5000, " " * 300 + "x", "wordword" * 2000]
    assert counter.count(texts) == [len(library.encode(t)) for t in texts]
    assert len(counter.known) - len(counter.whole) <= max(remembered, 2000)


def test_whole_tokens_are_proved(library):
    with open(queries.tokenizer_path(), "rb") as f:
        counter = tokencount.Counter(f.read())
    assert len(counter.whole) > 30_000
    assert all(len(library.encode("\n" + unit)) == 3 for unit in random.Random(1).sample(sorted(counter.whole), 500) if unit != "\n")


def test_rows_and_nulls(spark, docs, library):
    got = tokencount.token_counts(docs.drop("n_chars").withColumn("n_tokens", docs.begin), queries.tokenizer_path(), 600).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 600) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.over_limit for r in got} == {True, False}
    assert tokencount.token_counts(docs.limit(0), queries.tokenizer_path(), 600).count() == 0


def test_query_over_the_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op13_token_counts"](spark, folder).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in rows}
