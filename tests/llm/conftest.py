import pytest


@pytest.fixture
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, copies, shared passages, and extra columns."""
    passage = " ".join(f"shared{k}" for k in range(60))
    long_ = " ".join(f"w{k % 977}" for k in range(30_000))
    base = " ".join(f"base{k}" for k in range(120))
    rows = [(1, base, "s0"), (2, base, "s0"), (3, base.replace("base7 ", "BASE7 "), "s1"), (4, base.replace("base50 ", "other "), "s0"), (5, None, None), (6, "", "s0"), (7, " \t\n", "s1"), (8, "a b", "s0"), (9, "A  B", "s0"), (10, long_, "s2"), (11, "front " + passage + " tail", "s0"), (12, "head " + passage + " end é", "s3"), (12, "head " + passage + " end é", "s3"), (None, "null id text", "s0"), (14, "x" * 700, "s4")]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, begin int")
