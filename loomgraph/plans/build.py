"""From a folder of sources to a graph, its communities, analyses and files."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, cluster, export, graph, layers, patterns, report
from ..sources import files
from ..sources.extract import SCHEMA, parsed
from ..sources.extract import graph as merged
from ..session import cut_lineage

CACHED = SCHEMA + ", hash string"


def extracted(spark: SparkSession, scan: DataFrame, cache: files.Cache | None) -> tuple[DataFrame, dict]:
    """Extractions of the scan's code and documents, new ones added to the cache; how many hit and missed."""
    wanted = files.hashed(scan.where("file_type in ('code', 'document')").select("path", "content"))
    if cache is None:
        return cut_lineage(parsed(wanted)), {"hits": 0, "misses": wanted.count()}
    known = cache.read(CACHED)
    hit, miss = files.probe(wanted, known)
    new = cut_lineage(parsed(miss).join(miss.select("path", "hash"), "path"))
    old = cut_lineage(known.join(hit.select("path", "hash"), ["path", "hash"], "left_semi").select(*new.columns))
    cache.add(new)
    return old.unionByName(new).drop("hash"), {"hits": old.count(), "misses": miss.count()}


def communities(nodes: DataFrame, edges: DataFrame, most: int = 100, least: int = 3) -> DataFrame:
    """Clustered, large ones split, tiny ones merged: id, community."""
    first = cut_lineage(cluster.louvain(nodes, edges))
    return cut_lineage(cluster.merge_tiny(cut_lineage(cluster.split_large(first, nodes, edges, most)), edges, least))


def docstring(text: str, name: str) -> str:
    """The comment of three slashes that a file begins with, or the one above the class or mixin of that name."""
    lines = text.split("\n")[:301]
    block = lambda at, step: [x.strip()[3:].strip() for x in _run(lines, at, step)]
    if lines and lines[0].strip().startswith("///"):
        return " ".join(block(0, 1)[:8])
    for i, x in enumerate(lines):
        if re.search(rf"\b(class|mixin) {re.escape(name)}\b", x):
            return " ".join(block(i - 1, -1)[::-1][:8])
    return ""


def _run(lines: list[str], at: int, step: int) -> list[str]:
    out = []
    while 0 <= at < len(lines) and lines[at].strip().startswith("///"):
        out.append(lines[at])
        at += step
    return out


def docstrings(gods: list[dict], scan: DataFrame, edges: DataFrame) -> None:
    """Adds docstrings to the few central nodes, from the file that contains each; tests don't count where another does."""
    ids = [g["id"] for g in gods]
    if not ids:
        return
    from ..functions import exprs

    holders = edges.where((F.col("relation") == "contains") & F.col("target").isin(ids)).select("source", "target")
    found = scan.select("path", F.col("content").cast("string").alias("text")).withColumn("source", exprs.make_id(F.col("path")))
    rows = holders.join(found, "source").select("target", "path", "text").collect()
    test = re.compile(r"test|benchmark|example")
    for g in gods:
        own = sorted((bool(test.search(r["path"])), r["path"], r["text"]) for r in rows if r["target"] == g["id"])
        g["docstring"] = next((d for _, _, text in own if (d := docstring(text, g["label"]))), "")


def analyse(nodes: DataFrame, edges: DataFrame, membership: DataFrame, stats: dict, scan: DataFrame | None = None) -> dict:
    """Everything the report says, as plain values; each list is a few rows by the operators' own limits."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    gods = cut_lineage(analysis.god_nodes(nodes, edges))
    found = layers.layers(nodes, edges)
    labels = cluster.community_labels(membership, nodes, edges)
    listing = cluster.community_listing(membership, nodes).join(labels, "community").join(cluster.cohesion(membership, edges).select("community", "cohesion"), "community").orderBy("community")
    candidates = analysis.with_communities(analysis.surprise_candidates(nodes, edges), membership)
    out = stats | graph.counts(nodes, edges).first().asDict() | {
        "communities": membership.select("community").distinct().count(), "singletons": cluster.singletons(membership).first()[0],
        "confidence": analysis.confidence_mix(edges).first().asDict(), "god_nodes": rows(analysis.god_node_details(gods, nodes, edges).orderBy(F.desc("degree"), "id")),
        "trees": rows(analysis.inheritance_trees(gods, nodes, edges)), "surprises": analysis.surprising(analysis.surprise(candidates)),
        "patterns": rows(patterns.all_patterns(nodes, edges)), "enums": rows(analysis.enums(nodes, edges)), "key_files": rows(analysis.key_files(nodes, edges)),
        "runtime_deps": rows(analysis.runtime_deps(nodes, edges)), "directory_stats": rows(analysis.directory_stats(nodes)),
        "layers": found | {"directory_deps": rows(found["directory_deps"]), "source_deps": rows(found["source_deps"])},
        "listing": rows(listing), "ambiguous": rows(analysis.ambiguous_edges(nodes, edges).orderBy("source", "target")),
    }
    if scan is not None:
        docstrings(out["god_nodes"], scan, edges)
    return out


def build(spark: SparkSession, root: str, out: str, more_languages: bool = False) -> dict:
    """Scans root and writes to out: tables (graph), graph.json, graph.html, graph.cypher, graph.graphml and REPORT.md. Returns the analysis and cache counts."""
    scan = files.collect(spark, root, more_languages)
    stats = files.verdict(scan).first().asDict()
    found, cached = extracted(spark, scan, files.Cache(spark, os.path.join(out, "cache")))
    nodes, edges = (cut_lineage(x) for x in merged(found))
    membership = communities(nodes, edges)
    result = analyse(nodes, edges, membership, stats, scan)
    os.makedirs(out, exist_ok=True)
    export.write_tables(nodes, edges, membership, os.path.join(out, "graph"))
    export.to_json(nodes, edges, membership, os.path.join(out, "graph.json"))
    export.lines_to_file(export.cypher(nodes, edges), os.path.join(out, "graph.cypher"))
    export.lines_to_file(export.graphml(nodes, edges, membership), os.path.join(out, "graph.graphml"), export.GRAPHML_HEAD, export.GRAPHML_TAIL)
    export.to_html(nodes, edges, membership, cluster.community_labels(membership, nodes, edges), os.path.join(out, "graph.html"))
    with open(os.path.join(out, "REPORT.md"), "w", encoding="utf-8") as f:
        f.write(report.generate(result))
    return result | cached
