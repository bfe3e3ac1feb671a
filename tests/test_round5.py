import numpy as np
import plain_geometry
from pyspark.sql import functions as F

from mosaiq.functions import transforms
from mosaiq.operators import series, windows

COALESCED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}


def test_numbers_where_sorts_of_fewer_columns_have_other_ranges(spark):
    """Wide rows stay in several partitions, of which Spark makes one when it counts them."""
    before = {k: spark.conf.get(k) for k in COALESCED}
    try:
        for k, v in COALESCED.items():
            spark.conf.set(k, v)
        rows = spark.range(4000).select(F.col("id").alias("k"), F.lit(0).alias("line"), F.col("id").cast("double").alias("start"), (F.col("id") + 1).cast("double").alias("end"), F.lit(1.0).alias("rate"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.rand(3) + j).alias("samples"))
        got = [(r.k, r.rn) for r in series.ranked(rows, "k").select("k", "rn", F.size("samples")).collect()]
        assert sorted(got) == [(k, k + 1) for k in range(4000)]
        cuts = spark.createDataFrame([(0, 0, 100.0, 3900.0)], "line int, cut int, ts double, te double")
        parts = windows.cut(rows.drop("k", "rate"), cuts, "line", 16.0, samples=False)
        assert sorted(r.start for r in parts.select("start", "samples").collect()) == [100.0, *map(float, range(100, 3900))]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_euler_matrix_is_compiled(spark):
    rows = spark.createDataFrame([(0.3, -1.2, 2.5), (None, 1.0, 2.0)], "x double, y double, z double")
    m = rows.select(transforms.euler_matrix(F.col("x"), F.col("y"), F.col("z")).alias("m"))
    assert "lambda" not in m._jdf.queryExecution().optimizedPlan().toString()
    first, none = (r.m for r in m.collect())
    assert np.allclose(first, plain_geometry.euler_matrix(0.3, -1.2, 2.5))
    assert all(none[i][j] is None for i in range(3) for j in range(3))


def test_cells_of_intervals_are_not_broadcast(spark, tmp_path):
    def stored(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    points = stored(spark.createDataFrame([(0, float(t)) for t in range(50)], "g int, t double"), "points")
    spans = stored(spark.createDataFrame([(0, 0.0, 10.0), (0, 10.0, 40.0)], "g int, start double, end double"), "spans")
    got = windows.lookup(points, "t", spans, "g", 1.0)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 41
