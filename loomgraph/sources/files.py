"""Files as DataFrames: scan, classification, the corpus's size, and the cache of what has been extracted."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, fixed

IGNORE_FILE = ".loomgraphignore"


def ignore_patterns(root: str) -> list[str]:
    """Patterns of the ignore files in root and the folders above it, up to one that holds .git."""
    out: list[str] = []
    at = os.path.abspath(root)
    while True:
        name = os.path.join(at, IGNORE_FILE)
        if os.path.isfile(name):
            with open(name, encoding="utf-8") as f:
                out += [line.strip() for line in f if line.strip() and not line.strip().startswith("#")]
        if os.path.isdir(os.path.join(at, ".git")) or os.path.dirname(at) == at:
            return out
        at = os.path.dirname(at)


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Files of no bytes under root, which Spark's reader leaves out; they are files of a project all the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            out.append(f.getPath().toString())
    return out


def read(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), content, size: all files under root that Spark lists, and empty ones."""
    base = root.rstrip("/")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "content", F.col("length").alias("size"))
    none = spark.createDataFrame([(p, bytearray(), 0) for p in empty_files(spark, base)], "path string, content binary, size long")
    start = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return whole.unionAll(none).select(F.substring(start, len(os.path.abspath(base)) + 2, 2147483647).alias("path"), "content", "size")


def symlinks(root: str) -> list[str]:
    """Symbolic links under a local root, relative to it; none for a root elsewhere."""
    out = []
    for folder, dirs, names in os.walk(root):
        out += [os.path.relpath(p, root) for p in (os.path.join(folder, n) for n in [*dirs, *names]) if os.path.islink(p)]
    return sorted(out)


def classified(files: DataFrame, patterns: list[str] | None = None, more: bool = False, links: list[str] | None = None) -> DataFrame:
    """files (path, content) with file_type, words, and skipped: why a file is left out, or null.

    links: paths of symbolic links, which are never followed.

    Paths decide before contents are looked at; only documents are read as
    papers, and videos have no words.
    """
    path, text = F.col("path"), F.col("content").cast("string")
    kind = exprs.classify(path, exprs.paper_score(text) >= fixed.PAPER_HITS, more)
    skipped = (
        F.when(exprs.is_hidden(path), "hidden")
        .when(exprs.in_noise_dir(path), "noise")
        .when(exprs.is_under(path, links or []), "link")
        .when(exprs.is_ignored(path, patterns or []), "ignored")
        .when(exprs.is_sensitive(path), "sensitive")
        .when(kind.isNull(), "unknown")
    )
    words = F.when(kind.isin("video", "image"), F.lit(0)).otherwise(exprs.word_count(text)).cast("long")
    return files.withColumn("skipped", skipped).withColumn("file_type", F.when(F.col("skipped").isNull(), kind)).withColumn("words", F.when(F.col("skipped").isNull(), words).otherwise(0))


def collect(spark: SparkSession, root: str, more: bool = False) -> DataFrame:
    """The scan of a folder: kept files, in order of type and path within it, and skipped ones with the reason."""
    return classified(read(spark, root), ignore_patterns(root), more, symlinks(root))


def verdict(files: DataFrame) -> DataFrame:
    """total_files, total_words, needs_graph and verdict (small, large or empty) of files (file_type, words)."""
    own = files.where(F.col("file_type").isNotNull()).agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"))
    w = F.col("total_words")
    word = F.when(w < fixed.WORDS_FOR_GRAPH, "small").when((w >= fixed.WORDS_LARGE) | (F.col("total_files") >= fixed.FILES_LARGE), "large").otherwise("")
    return own.select("total_files", "total_words", (w >= fixed.WORDS_FOR_GRAPH).alias("needs_graph"), word.alias("verdict"))


def hashed(files: DataFrame) -> DataFrame:
    """files with hash, of content (a Markdown file's body)."""
    text = F.col("content").cast("string")
    front = (exprs.extension(F.col("path")) == ".md") & F.startswith(text, F.lit("---"))
    return files.withColumn("hash", F.when(front, F.sha2(exprs.body(text).cast("binary"), 256)).otherwise(F.sha2("content", 256)))


def probe(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that the cache (path, hash) knows, and those it doesn't. Path and content both count: ids depend on the path."""
    known = cache.select("path", "hash").distinct()
    return files.join(known, ["path", "hash"], "left_semi"), files.join(known, ["path", "hash"], "left_anti")


def probe_counts(files: DataFrame, known: DataFrame) -> DataFrame:
    """hits and misses by content alone."""
    got = files.select("hash").join(known.select("hash").distinct().withColumn("hit", F.lit(True)), "hash", "left")
    return got.agg(F.count_if(F.col("hit").isNotNull()).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


class Cache:
    """Extractions as Parquet (path, hash, nodes, edges), appended to; each hit saves a parse."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, schema: str) -> DataFrame:
        path, fs = self._path()
        return self.spark.read.schema(schema).parquet(self.folder) if fs.exists(path) else self.spark.createDataFrame([], schema)

    def add(self, extracted: DataFrame) -> None:
        extracted.write.mode("append").parquet(self.folder)

    def hashes(self, schema: str) -> DataFrame:
        return self.read(schema).select("hash").distinct()

    def clear(self) -> None:
        path, fs = self._path()
        fs.delete(path, True)
