"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only in a local session where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mosaiq-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/mosaiq-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``keep`` returned; only where all that is made from them is written already."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.__dict__["_kept_at"])
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach(left: DataFrame, right: DataFrame, on, how: str, right_bytes: float) -> DataFrame:
    """Join with ``right``, which was counted before: broadcast only up to ``BROADCAST_BYTES``, else shuffled."""
    return left.join(F.broadcast(right) if right_bytes <= BROADCAST_BYTES else right, on, how)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of ended jobs now; it does so only after the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
