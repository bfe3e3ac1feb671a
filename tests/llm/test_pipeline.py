import corpus_pipeline


def words(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def near(spark, rows):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    got = corpus_pipeline.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    return sorted(r.k for r in got.collect())


def test_near_duplicates_of_rows_without_an_id(spark):
    a = words("a")
    rows = [(None, words("u")), (None, a), (7, a.replace("a30 ", "x ")), (None, words("v")), (None, words("v")), (None, ""), (None, None), (3, words("w"))]
    got = near(spark, rows)
    assert got in ([0, 2, 3, 5, 6, 7], [0, 2, 4, 5, 6, 7])


def test_near_duplicates_of_texts_under_one_id(spark):
    a, b = words("a"), words("b")
    rows = [(1, a), (5, a.replace("a59", "x")), (5, b), (5, words("c")), (9, b), (12, words("d")), (12, words("d")), (13, ""), (13, ""), (13, None), (14, " ")]
    got = near(spark, rows)
    assert [k for k in got if k not in (5, 6, 7, 8)] == [0, 2, 3, 9, 10]
    assert len([k for k in got if k in (5, 6)]) == 1 and len([k for k in got if k in (7, 8)]) == 1


def test_near_duplicates_of_single_ids(spark):
    a = words("a")
    assert near(spark, [(4, a), (2, a.replace("a59", "x")), (3, words("b")), (6, ""), (8, None)]) == [1, 2, 3, 4]
