"""A training corpus from the documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import jaccard, packing, quality, suffix, toxicity
from mosaiq.llm.scratch import keep

#: Bytes of a packed sequence.
SEQUENCE = 8192


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the factorization machine scores at 0.7 or more."""
    machine = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.only_clean(docs, machine)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the attention model scores below 0.5."""
    model = quality.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.only_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates, the one with the smallest id.

    Where an id is null or repeated, every row is a node of its own, so that rows without an id and
    different texts under one id are compared by their texts like all others. Of a component the smallest
    id stays, then the smallest hash of the text; a row without an id stays only where none has one. Rows
    without words are nobody's copy: they go only as repeats of a row with the same id and text.
    """
    rule = jaccard.Rule(size=5, percent=80)
    rows, key = jaccard.numbered(docs)
    if key == "doc_id":
        found = jaccard.jaccard_components(docs, rule)
        first = keep(found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id"), "first")
        return docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    found = jaccard.jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"), rule)
    found = found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("component"), (F.col("n_shingles") > 0).alias("words"))
    keyed = rows.select("__row", "doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha")).join(found, "__row")
    # A row without words shares a group only with rows of its id and text; null texts hash as "none".
    alone = F.when(F.col("doc_id").isNull(), F.col("__row").cast("string")).otherwise(F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("sha", F.lit("none"))))
    group = F.when(F.col("words"), F.col("component").cast("string")).otherwise(alone)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "__row")
    first = keep(keyed.groupBy("words", group.alias("group")).agg(F.min(order).getField("__row").alias("__row")).select("__row"), "first")
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out the bytes under strings of 200 bytes that occur more than once; ``n_chars`` follows the text."""
    cut = suffix.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 8,192 bytes; sources, and texts that are near copies since spans were cut, don't share one."""
    return packing.packed_apart(docs, F.octet_length("text"), SEQUENCE)


STAGES = [("toxicity", toxic), ("quality", good), ("near duplicates", one_of_each), ("repeated spans", without_repeats), ("packing", packed)]
#: No stage's decisions can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
