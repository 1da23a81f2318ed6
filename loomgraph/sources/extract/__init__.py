"""Extraction of graphs from source files, in parallel over files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import graph as g
from .languages import extract

SCHEMA = "path string, nodes array<struct<id:string,label:string,type:string,line:int>>, edges array<struct<source:string,target:string,relation:string>>, calls array<struct<caller:string,callee:string>>"


def parsed(files: DataFrame) -> DataFrame:
    """path, nodes, edges and calls of files (path, content); files of unknown languages give none. One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                found = extract(path, bytes(content or b"").decode("utf-8", "replace"))
                if found:
                    rows.append((path, [dict(zip(("id", "label", "type", "line"), n)) for n in found.nodes], [dict(zip(("source", "target", "relation"), e)) for e in found.edges], [dict(zip(("caller", "callee"), c)) for c in found.calls]))
            yield pd.DataFrame(rows, columns=["path", "nodes", "edges", "calls"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def graph(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges over all extracted files: calls resolved and types inferred per file, then the last mention counts, in order of path."""
    nodes = extracted.select("path", F.posexplode("nodes").alias("seq", "n")).select(F.col("path").alias("scope"), "seq", "n.id", "n.label", "n.type", F.col("path").alias("file"))
    edges = extracted.select("path", F.posexplode("edges").alias("seq", "e")).select(F.col("path").alias("scope"), "seq", "e.source", "e.target", "e.relation")
    calls = extracted.select(F.col("path").alias("scope"), F.explode("calls").alias("c")).select("scope", "c.caller", "c.callee")
    made = g.resolve_calls(nodes.select("scope", "id", "label", "seq"), calls).select("scope", F.lit(2_000_000_000).alias("seq"), "source", "target", F.lit("calls").alias("relation"))
    every = edges.unionByName(made)
    typed = g.infer_types(nodes.select("scope", "id", "label", "type", "file"), edges.select("scope", "source", "target", "relation", F.col("seq").alias("ord")))
    typed = typed.join(nodes.select("scope", "id", "seq"), ["scope", "id"])
    merged = g.last_nodes(typed.select("id", "label", "type", "file", F.struct(F.col("scope"), F.col("seq")).alias("ord")))
    order = F.struct(F.col("scope"), F.col("seq"))
    return merged, g.last_edges(every.select("source", "target", "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"), order.alias("ord")))
