"""The corpus pipeline: language, near copies, repeated passages, packing.

Each stage takes what its predecessor kept, in the columns of documents, and
returns the same columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import langid, neardup, packing, substrings
from loomgraph.llm.runtime import checkpointed, modest_batches, table

#: Percent of common shingles from which documents are near copies.
NEAR = 80
#: A text whose best language is less alike than this is in none of the languages learned.
LEAST_ALIKE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in one of the languages learned from docs; those without letters or like no profile go."""
    modest_batches(spark)
    model = langid.learn(docs.where(~langid.held_out(docs["doc_id"])))
    made = langid.predict(docs.select(docs["text"].alias("__read"), *[docs[c].alias(f"own_{c}") for c in docs.columns]), model, text="__read", keep=tuple(f"own_{c}" for c in docs.columns))
    good = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_ALIKE)
    return made.where(good).select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; of rows that share a doc_id, one. Rows without a doc_id stay.

    A doc_id names a document: rows that share one are taken as its versions,
    so only one of them can stay, whatever their texts.
    """
    found = checkpointed(neardup.groups(docs.select("doc_id", "text"), NEAR))
    kept = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows__"))
    single = docs.join(kept.where("rows__ = 1").select("doc_id"), "doc_id", "left_semi")
    several = docs.join(kept.where("rows__ > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(several).unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur elsewhere too; texts that have none stay as they are. n_chars follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    made = substrings.marked(docs, keep=others, prefix="own_", verbatim=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(f"own_{c}") for c in others}
    return made.select(*[new[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of 4096 tokens."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL has no form for a stage of these; tests/llm hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
