"""Graphs from JSON: extraction records, and graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g

NODE = "struct<id:string,label:string,type:string,source_file:string,file:string>"
EDGE = "struct<source:string,target:string,relation:string,confidence:string,weight:double>"


def from_records(records: DataFrame, column: str = "record") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON texts (record_id, record), later ones overriding; items of the wrong form are left out."""
    listed = lambda name: F.from_json(F.get_json_object(column, f"$.{name}"), "array<string>")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    order = F.struct("record_id", "pos").alias("ord")
    n = records.select("record_id", F.posexplode(listed("nodes")).alias("pos", "item")).select("record_id", "pos", F.from_json("item", NODE).alias("n"))
    n = n.where("n.id is not null").select(F.col("n.id").alias("id"), empty("n.label").alias("label"), empty("n.type").alias("type"), F.coalesce("n.source_file", "n.file", F.lit("")).alias("file"), order)
    e = records.select("record_id", F.posexplode(listed("edges")).alias("pos", "item")).select("record_id", "pos", F.from_json("item", EDGE).alias("e"))
    e = e.where("e.source is not null and e.target is not null").select("e.source", "e.target", empty("e.relation").alias("relation"), empty("e.confidence").alias("confidence"), F.coalesce("e.weight", F.lit(1.0)).alias("weight"), order)
    return g.last_nodes(n), g.last_edges(e)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph.json, or of a folder with nodes.parquet and edges.parquet."""
    if not path.endswith(".json"):
        return spark.read.parquet(f"{path}/nodes.parquet").select("id", "label", "type", "file"), spark.read.parquet(f"{path}/edges.parquet")
    schema = f"nodes array<{NODE}>, links array<{EDGE}>"
    whole = spark.read.schema(schema).option("multiLine", "true").json(path)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    nodes = whole.select(F.explode("nodes").alias("n")).select("n.id", empty("n.label").alias("label"), empty("n.type").alias("type"), empty("n.file").alias("file"))
    edges = whole.select(F.explode("links").alias("e")).select("e.source", "e.target", empty("e.relation").alias("relation"), empty("e.confidence").alias("confidence"), F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    return nodes, edges
