"""Grids of experiments as tables of jobs, run several at once and resumed where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Fixed values of the grid: numbers of components, runs of each, pairs of modalities, and sets of image descriptors.
COMPONENTS = (5, 10, 15, 20, 30, 40, 50, 75, 100, 200)
RUNS = 20
PAIRS = (("motion", "sound"), ("image", "sound"), ("image", "motion"))
TRIPLE = ("image", "motion", "sound")
DESCRIPTORS = (("SURF",), ("color",), ("SURF_pairs",), ("color_pairs",), ("color_triplets",), ("SURF", "color"), ("SURF_pairs", "color_pairs"), ("SURF_pairs", "color_triplets"), ("SURF", "color", "SURF_pairs", "color_pairs", "color_triplets"))

JOB = "name string, modalities array<string>, descriptors array<string>, k int, run int"
SCORE = "key string, score double"


def grid(spark: SparkSession, modalities: Iterable[tuple[str, ...]], descriptors: Iterable[tuple[str, ...]], components: Iterable[int], runs: int) -> DataFrame:
    """A job for each combination; its name says all of its settings."""
    axes = {"modalities": list(map(list, modalities)), "descriptors": list(map(list, descriptors)), "k": list(components)}
    rows = spark.range(runs).select(F.col("id").cast("int").alias("run"))
    for name, values in axes.items():
        kind = "array<array<string>>" if name != "k" else "array<int>"
        rows = rows.withColumn(name, F.explode(F.array(*(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values)).cast(kind)))
    # The descriptors are named where they are an axis.
    part = F.concat(F.lit("_feats_"), F.array_join("descriptors", "_")) if len(axes["descriptors"]) > 1 else F.lit("")
    return rows.withColumn("name", F.concat(F.array_join("modalities", "_"), part, F.lit("_"), F.col("k"), F.lit("_"), F.col("run"))).select("name", "modalities", "descriptors", "k", "run")


def full_grid(spark: SparkSession) -> DataFrame:
    """All 980 jobs: pairs and the triple by number of components, and sets of descriptors, each 20 times."""
    image = [("SURF", "color")]
    parts = [grid(spark, PAIRS, image, COMPONENTS, RUNS), grid(spark, [TRIPLE], image, COMPONENTS, RUNS), grid(spark, [("image", "sound")], DESCRIPTORS, (50,), RUNS)]
    return reduce(DataFrame.unionByName, parts)


def results(spark: SparkSession, store: str) -> DataFrame:
    """``name, key, score`` of all jobs that ended."""
    empty = spark.createDataFrame([], f"name string, {SCORE}")
    try:
        found = spark.read.schema(f"{SCORE}, name string").option("basePath", store).parquet(f"{store}/name=*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    return empty.unionByName(found.select("name", "key", "score"))


def left(jobs: DataFrame, store: str) -> DataFrame:
    """The jobs without stored results."""
    return jobs.join(results(jobs.sparkSession, store).select("name").distinct(), "name", "left_anti")


def status(jobs: DataFrame, store: str) -> DataFrame:
    """``state, n``: how many jobs are done, and how many are left."""
    done = results(jobs.sparkSession, store).select("name").distinct().withColumn("done", F.lit(True))
    return jobs.join(done, "name", "left").groupBy(F.when(F.col("done"), "done").otherwise("left").alias("state")).agg(F.count("*").alias("n"))


def run(jobs: DataFrame, store: str, f: Callable[[SparkSession, Row], dict[str, float]], at_once: int = 4, most: int | None = None) -> DataFrame:
    """Runs the jobs that are left, ``at_once`` of them at a time in scheduler pools of their own: ``name, error`` of each that was run.

    ``f`` makes a job's scores by key, with Spark jobs of its own. They are stored under the job's name
    when it ends, in a folder that is written whole or not at all, so that a run that is stopped goes on
    where it was; ``store`` is a folder that Spark writes. A job that fails is reported and left for the next run,
    and the others go on. ``most`` ends a run after so many jobs. With fair scheduling
    (``spark.scheduler.mode``) the pools share the cluster, else the jobs' tasks queue one behind another.
    """
    spark = jobs.sparkSession
    todo = left(jobs, store).orderBy("name").collect()[:most]  # a grid is a list of settings, not data

    def one(job: Row) -> tuple[str, str | None]:
        out: list[str | None] = [None]

        def work() -> None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", job["name"])
            try:
                scores = [(k, float(v)) for k, v in f(spark, job).items()]
                spark.createDataFrame(scores, SCORE).coalesce(1).write.mode("overwrite").parquet(f"{store}/name={job['name']}")
            except Exception as e:  # reported with the job's name
                out[0] = f"{type(e).__name__}: {e}"

        thread = InheritableThread(target=work)
        thread.start()
        thread.join()
        return job["name"], out[0]

    with ThreadPoolExecutor(at_once) as pool:
        found = [x.result() for x in as_completed([pool.submit(one, job) for job in todo])]
    return spark.createDataFrame(sorted(found), "name string, error string")


def statistics(jobs: DataFrame, store: str) -> DataFrame:
    """``modalities, descriptors, k, key, n, avg, std``: mean and population deviation over the runs of a setting."""
    each = results(jobs.sparkSession, store).join(jobs, "name")
    return each.groupBy("modalities", "descriptors", "k", "key").agg(F.count("*").alias("n"), F.avg("score").alias("avg"), F.stddev_pop("score").alias("std"))
