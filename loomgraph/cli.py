"""Command line: build a graph of a folder, and ask it questions.

    python -m loomgraph build ROOT [--out DIR] [--verbose] [--more-languages]
    python -m loomgraph query [--dfs] [--budget N] [--dir DIR] "QUESTION"
    python -m loomgraph path A B [--dir DIR]
    python -m loomgraph explain NODE [--dir DIR]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import export, traverse
from .operators import graph as g
from .sources.records import read_graph

OUT = "loomgraph-out"


def session() -> SparkSession:
    return SparkSession.builder.appName("loomgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def answer(nodes: DataFrame, edges: DataFrame, question: str, dfs: bool = False, budget: int = 2000) -> str:
    """The subgraph that a question leads to, as text within a budget of tokens of 4 bytes."""
    terms = traverse.question_terms(question)
    start = traverse.seeds(nodes, terms).collect()
    if not start:
        some = traverse.most_linked(nodes, edges).collect()
        return "No node matches. Most linked nodes:\n" + "".join(f"  {r['label']} ({r['degree']})\n" for r in some)
    spark = nodes.sparkSession
    if dfs:
        ids, links = traverse.depth_first(edges, [r["id"] for r in start])
        reached = spark.createDataFrame([(i,) for i in ids], "id string")
        used = spark.createDataFrame(links, "source string, target string, relation string, confidence string")
    else:
        reached, used = traverse.neighbourhood(edges, spark.createDataFrame([(r["id"],) for r in start], "id string"))
    n_nodes, n_edges = reached.count(), used.count()
    head = f"Query: {question}\nMode: {'DFS' if dfs else 'BFS'} | Start: {', '.join(r['label'] for r in start)} | Subgraph: {n_nodes} nodes, {n_edges} edges\n\nNodes:\n"
    lines = traverse.relevance(nodes, reached, terms).select("id", "score", export.node_line().alias("line"))
    shown = traverse.within_budget(lines, [F.desc("score"), "id"], budget, len(head.encode())).orderBy(F.desc("score"), "id").collect()
    out = head + "".join(r["line"] for r in shown)
    if len(shown) < n_nodes:
        out += f"  ... ({n_nodes - len(shown)} more nodes truncated)\n"
    out += "\nEdges:\n"
    named = g.with_end(g.with_end(used, nodes, "source", "left"), nodes, "target", "left").select("source", "target", F.coalesce("source_label", "source").alias("source_label"), F.coalesce("target_label", "target").alias("target_label"), "relation", "confidence")
    rows = traverse.within_budget(named.select("source", "target", export.edge_line().alias("line")), ["source", "target"], budget, len(out.encode())).orderBy("source", "target").collect()
    out += "".join(r["line"] for r in rows)
    return out + (f"  ... (truncated at ~{budget} token budget)\n" if len(rows) < n_edges else "")


def path_text(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> str:
    """A shortest path as text; an unknown name is an error, no path is an answer."""
    found = [traverse.find_node(nodes, name).first() for name in (a, b)]
    for name, r in zip((a, b), found):
        if r is None:
            raise LookupError(f"no node matches {name!r}")
    steps = traverse.shortest_path(edges, found[0]["id"], found[1]["id"])
    if steps is None:
        return f"No path between {found[0]['label']} and {found[1]['label']}.\n"
    ids = [found[0]["id"], *(s["to"] for s in steps)]
    labels = {r["id"]: r["label"] for r in nodes.where(F.col("id").isin(ids)).select("id", "label").collect()}
    out = f"Shortest path ({len(steps)} hops):\n  {labels.get(ids[0], ids[0])}\n"
    for s in steps:
        arrow = f"--{s['relation']}-->" if s["forward"] else f"<--{s['relation']}--"
        out += f"    {arrow} [{s['confidence']}]\n  {labels.get(s['to'], s['to'])}\n"
    return out


def explain_text(nodes: DataFrame, edges: DataFrame, name: str) -> str:
    found = traverse.find_node(nodes, name).first()
    if found is None:
        raise LookupError(f"no node matches {name!r}")
    own = nodes.where(F.col("id") == found["id"]).first()
    out = f"{own['label']}\n  type: {own['type']}\n  file: {own['file']}\n"
    last = None
    for r in traverse.explain(nodes, edges, found["id"]).collect():
        if (r["direction"], r["relation"]) != last:
            last = (r["direction"], r["relation"])
            out += f"\n{'->' if r['direction'] == 'out' else '<-'} {r['relation']}:\n"
        out += f"  {r['label']} ({r['file']}) [{r['confidence']}]\n"
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="verb", required=True)
    b = sub.add_parser("build")
    b.add_argument("root")
    b.add_argument("--out", default=OUT)
    b.add_argument("--verbose", action="store_true")
    b.add_argument("--more-languages", action="store_true", help="also R, Haskell and Elm")
    q = sub.add_parser("query")
    q.add_argument("question")
    q.add_argument("--dfs", action="store_true")
    q.add_argument("--budget", type=int, default=2000)
    h = sub.add_parser("path")
    h.add_argument("a")
    h.add_argument("b")
    e = sub.add_parser("explain")
    e.add_argument("node")
    for x in (q, h, e):
        x.add_argument("--dir", default=OUT)
    a = p.parse_args(args)
    spark = session()
    try:
        if a.verb == "build":
            from .plans.build import build

            r = build(spark, a.root, a.out, a.more_languages)
            print(f"{r['total_files']} files, {r['node_count']} nodes, {r['edge_count']} edges, {r['communities']} communities -> {a.out}")
            if a.verbose:
                print(f"cache: {r['hits']} hits, {r['misses']} misses")
            return 0
        nodes, edges = (x.cache() for x in read_graph(spark, f"{a.dir}/graph"))
        text = answer(nodes, edges, a.question, a.dfs, a.budget) if a.verb == "query" else path_text(nodes, edges, a.a, a.b) if a.verb == "path" else explain_text(nodes, edges, a.node)
        print(text, end="")
        return 0
    except LookupError as error:
        print(f"Error: {error.args[0]}", file=sys.stderr)
        return 1
