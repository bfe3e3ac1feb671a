from collections import defaultdict

import corpus_pipeline
from mosaiq.llm import queries


def tables(spark, folder):
    """Near copies of different sources among other texts, some of them without an id."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(k, text("a").replace("a30 ", f"x{k} "), f"s{k}") for k in range(3)]
    rows += [(None, text("É"), "t0"), (None, text("é").replace("é59", "y"), "t1"), (8, text("b"), "u0"), (9, text("c"), "u1"), (10, "", "u2"), (11, None, "u3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return docs


def check(got):
    assert got.count() == 9
    near = defaultdict(list)
    for r in got.collect():
        near["a" if r.doc_id is not None and r.doc_id < 3 else "e" if r.doc_id is None else "other"].append((r.shard, r.bin))
    assert len(set(near["a"])) == 3 and len(set(near["e"])) == 2 and len(set(near["other"])) == 1


def test_near_copies_do_not_share_a_sequence(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    check(queries.op7_best_fit_packing(spark, str(tmp_path)))
    check(corpus_pipeline.packed(spark, docs, str(tmp_path)))
