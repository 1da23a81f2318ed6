"""Incremental extraction: new files of a folder flow into the cache as they arrive.

The batch build's only increment is its cache; this keeps the cache up to date
by Structured Streaming, so that a later build finds everything extracted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..sources.extract import parsed


def watch(spark: SparkSession, root: str, cache: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Extracts each new file under root once and appends it to the cache (path, hash, nodes, edges, calls).

    With once, everything there is processed and the query ends.  The
    checkpoint remembers the files that are done, across runs.
    """
    whole = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    start = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = root.rstrip("/")
    wanted = files.classified(whole.select(F.substring(start, len(base) + 2, 2147483647).alias("path"), "content")).where("file_type in ('code', 'document')")

    def add(batch: DataFrame, _: int) -> None:
        own = files.hashed(batch.select("path", "content"))
        parsed(own).join(own.select("path", "hash"), "path").write.mode("append").parquet(cache)

    writer = wanted.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
