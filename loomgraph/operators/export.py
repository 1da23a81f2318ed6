"""Writing graphs: lines for other tools as distributed text, and single files made on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def node_line() -> Column:
    """A node's line in the answer to a question; columns label, type, file."""
    return F.concat(F.lit("  "), "label", F.lit(" [type="), "type", F.lit(" file="), "file", F.lit("]\n"))


def edge_line() -> Column:
    """An edge's line there; columns source_label, target_label, relation, confidence."""
    return F.concat(F.lit("  "), "source_label", F.lit(" --"), "relation", F.lit("--> "), "target_label", F.lit(" ["), "confidence", F.lit("]\n"))


def _cypher_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit(" "))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: a MERGE for each node and edge. Ids and labels are escaped; relations keep letters, digits and "_"."""
    q = _cypher_text
    n = nodes.select(F.concat(F.lit("MERGE (n:Node {id: '"), q(F.col("id")), F.lit("', label: '"), q(F.col("label")), F.lit("'})")).alias("line"))
    relation = F.regexp_replace("relation", "[^A-Za-z0-9_]", "_")
    e = edges.select(F.concat(F.lit("MATCH (a:Node), (b:Node) WHERE a.id = '"), q(F.col("source")), F.lit("' AND b.id = '"), q(F.col("target")), F.lit("' MERGE (a)-[r:"), relation, F.lit("]->(b)")))
    return n.unionAll(e)


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """line: a node or edge element; a node without a community is in 0."""
    n = nodes.select("id").join(membership.select("id", "community"), "id", "left")
    n = n.select(F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="community">'), F.coalesce("community", F.lit(0)).cast("string"), F.lit("</data></node>")).alias("line"))
    return n.unionAll(edges.select(F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('"/>'))))


GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="community" for="node" attr.name="community" attr.type="int"/>\n<graph id="G" edgedefault="undirected">'
GRAPHML_TAIL = "</graph>\n</graphml>"


def lines_to_file(lines: DataFrame, path: str, head: str = "", tail: str = "") -> None:
    """Streams the lines into one local file; for large graphs, write lines as text instead."""
    with open(path, "w", encoding="utf-8") as f:
        if head:
            f.write(head + "\n")
        for row in lines.toLocalIterator():
            f.write(row["line"] + "\n")
        f.write(tail)


def write_tables(nodes: DataFrame, edges: DataFrame, membership: DataFrame, folder: str) -> None:
    """The graph as Parquet: nodes (with community) and edges (with confidence and weight)."""
    nodes.join(membership, "id", "left").withColumn("community", F.coalesce("community", F.lit(0))).write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    edges.write.mode("overwrite").parquet(f"{folder}/edges.parquet")


def to_json(nodes: DataFrame, edges: DataFrame, membership: DataFrame, path: str) -> None:
    """One JSON file with nodes and links, in order of their keys."""
    n = nodes.join(membership, "id", "left").select("id", "label", "type", "file", F.coalesce("community", F.lit(0)).alias("community")).orderBy("id")
    e = edges.select("source", "target", "relation", "confidence", "weight").orderBy("source", "target")

    def items(df: DataFrame) -> Iterable[str]:
        return ("    " + json.dumps(r.asDict(), ensure_ascii=False) for r in df.toLocalIterator())

    with open(path, "w", encoding="utf-8") as f:
        for key, df, end in (("nodes", n, ","), ("links", e, "")):
            f.write(("{\n" if key == "nodes" else "") + f'  "{key}": [')
            for i, line in enumerate(items(df)):
                f.write((",\n" if i else "\n") + line)
            f.write(f"\n  ]{end}\n")
        f.write("}\n")


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Graph</title>
<style>
 body { margin: 0; font: 14px sans-serif; display: flex; height: 100vh }
 canvas { flex: 1 } aside { width: 260px; padding: 12px; overflow: auto; border-left: 1px solid #ccc }
 li { list-style: none } b { display: inline-block; width: 12px; height: 12px; margin-right: 6px }
</style></head><body><canvas id="c"></canvas>
<aside><input id="q" placeholder="search"><ul id="hits"></ul><ul id="legend"></ul></aside>
<script>
const G = __DATA__, C = document.getElementById('c'), X = C.getContext('2d'), P = {};
function size() { C.width = C.clientWidth; C.height = C.clientHeight; draw(); }
G.nodes.forEach((n, i) => { const a = i * 2.399963, r = 9 * Math.sqrt(i); P[n.id] = [r * Math.cos(a), r * Math.sin(a)]; });
function draw(hit) {
  X.setTransform(1, 0, 0, 1, C.width / 2, C.height / 2); X.clearRect(-C.width, -C.height, 2 * C.width, 2 * C.height);
  X.strokeStyle = '#ddd'; X.beginPath();
  for (const e of G.links) { const a = P[e.source], b = P[e.target]; if (a && b) { X.moveTo(...a); X.lineTo(...b); } }
  X.stroke();
  for (const n of G.nodes) { X.fillStyle = G.palette[n.community % G.palette.length]; X.beginPath(); X.arc(...P[n.id], hit === n.id ? 9 : 4, 0, 7); X.fill(); }
}
for (const [k, label, size] of G.legend) { const li = document.createElement('li'), b = document.createElement('b'); b.style.background = G.palette[k % G.palette.length]; li.append(b, `${label} (${size})`); document.getElementById('legend').append(li); }
document.getElementById('q').oninput = e => { const hits = document.getElementById('hits'), w = e.target.value.toLowerCase(); hits.textContent = ''; if (!w) return draw();
  const found = G.nodes.filter(n => n.label.toLowerCase().includes(w)).slice(0, 20); found.forEach(n => { const li = document.createElement('li'); li.textContent = n.label + ' - ' + n.file; li.onclick = () => draw(n.id); hits.append(li); }); draw(found[0] && found[0].id); };
onresize = size; size();
</script></body></html>
"""


def to_html(nodes: DataFrame, edges: DataFrame, membership: DataFrame, labels: DataFrame, path: str) -> None:
    """A page that shows the graph, coloured by community, with a legend by falling size and a search. Its rows are streamed into one local file."""
    parts = {
        "nodes": nodes.join(membership, "id", "left").select("id", "label", "type", "file", F.coalesce("community", F.lit(0)).alias("community")).orderBy("id"),
        "links": edges.select("source", "target", "relation").orderBy("source", "target"),
        "legend": membership.groupBy("community").agg(F.count(F.lit(1)).alias("n")).join(labels, "community").orderBy(F.desc("n"), "community").select("community", "label", "n"),
    }
    safe = lambda x: json.dumps(x, ensure_ascii=False).replace("</", "<\\/")
    before, after = PAGE.split("__DATA__")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{before}{{"palette": {safe(fixed.PALETTE)}')
        for key, df in parts.items():
            f.write(f', "{key}": [')
            for i, r in enumerate(df.toLocalIterator()):
                f.write((", " if i else "") + safe(list(r) if key == "legend" else r.asDict()))
            f.write("]")
        f.write("}" + after)
