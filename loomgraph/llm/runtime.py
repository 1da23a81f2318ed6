"""What the corpus operators need from the session: checkpoints, sizes and Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that lost executors cost no recomputation.

    The cluster names the folder in spark.checkpoint.dir; only a session on one
    machine (master local, as in tests) without that setting gets a temporary
    one.  On a cluster a folder of each machine's own would lose data, so there
    a missing setting is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The cluster's shuffle width; all fan-outs derive from it, so they grow with the deployment."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes and rows of an Arrow batch between Spark and a worker, where the session leaves Spark's defaults.
BATCH_BYTES, BATCH_ROWS = "8m", "2000"


def modest_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's defaults of 10,000 rows: texts are long, and each core holds a batch on either side."""
    for name, value, default in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, None)):
        name = f"spark.sql.execution.arrow.{name}"
        if default is None or spark.conf.get(name, default) == default:
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(batches: Iterable[dict], schema: pa.Schema):
    """Dicts of columns to Arrow batches of the schema."""
    for columns in batches:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns; a name that is there twice is an error of Spark's own, others may clash freely."""
    return df.select(*[F.col(n) for n in names])


def fold(key: Column, parts: int) -> Column:
    """A part number from 0 to parts - 1 that depends on the value of key only."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
