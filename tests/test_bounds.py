import datetime

from mosaiq.operators import pairing
from mosaiq.plans import catalog


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_values_beyond_the_broadcast_bound(spark):
    assert pairing.distribute(spark.range(2), spark.range(10_001).toDF("v")).count() == 20_002


def test_types_and_labels_beyond_the_broadcast_bound(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    write(spark, tmp_path, "events", [(k, k % 7, at, f"type{k}", 1.0) for k in range(1_001)], "event_id long, user_id long, ts timestamp, event_type string, value double")
    write(spark, tmp_path, "documents", [(k, f"lang{k}") for k in range(1_001)], "doc_id long, lang string")
    write(spark, tmp_path, "embeddings", [(k, k, [float(k)] * 2) for k in range(10_001)], "vec_id long, label int, embedding array<float>")
    t = catalog.Tables(spark, str(tmp_path))
    assert t.series().count() == 1_001
    assert catalog._paired(t).count() == 10_001
    assert catalog.QUERIES["modality_pairs"](spark, str(tmp_path)).count() == 1_001 * 1_000


def test_examples_beyond_the_broadcast_bound(spark, monkeypatch):
    want = catalog.QUERIES["cross_modal_scores"](spark, "/root/testdata/sf0.001").orderBy("mod_from", "mod_to").collect()
    monkeypatch.setattr(pairing, "small", lambda df, most, f=pairing.small: f(df, 1))
    assert catalog.QUERIES["cross_modal_scores"](spark, "/root/testdata/sf0.001").orderBy("mod_from", "mod_to").collect() == want
