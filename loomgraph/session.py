"""Session helpers of the graph side."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    The cluster names it in spark.checkpoint.dir; a session on one machine
    (master local) without that setting gets a temporary one, on a cluster the
    setting is required.
    """
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder.

    Iterative operators call this each round: plans stay short and a lost
    executor costs no recomputation.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut_lineage, but as compressed Parquet, of which discard() can free the room."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these, and lets Spark delete the shuffles that nothing refers to any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    tidy(frames[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Spark's cleaner follows the driver's garbage collection, which a driver that only plans hardly ever needs."""
    gc.collect()
    spark._jvm.System.gc()
