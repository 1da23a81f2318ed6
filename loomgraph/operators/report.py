"""The Markdown report: fixed order of sections, optional ones only where there is something to say."""

from __future__ import annotations

from ..functions import fixed


def number(n: int) -> str:
    return f"{n:,}"


def cut(names: list[str], most: int) -> str:
    return ", ".join(names[:most]) + (f" (+{len(names) - most} more)" if len(names) > most else "")


def tree_lines(tree: dict, most: int = 10) -> list[str]:
    """A hierarchy with box-drawing prefixes; at most so many children are shown."""
    out = [tree["root"]]
    kids = tree["children"]
    shown = kids[:most]
    for i, k in enumerate(shown):
        last = i == len(shown) - 1 and len(kids) <= most
        note = f" ({k['method_count']} methods)" if k["method_count"] else ""
        out.append(("└── " if last else "├── ") + k["label"] + note)
        for j, g in enumerate(k["children"][:most]):
            end = j == min(len(k["children"]), most) - 1
            out.append(("    " if last else "│   ") + ("└── " if end else "├── ") + g)
    if len(kids) > most:
        out.append(f"└── ... (+{len(kids) - most} more)")
    return out


def summary(a: dict) -> str:
    """The executive summary's sentences."""
    communities, lone = a["communities"], a["singletons"]
    text = f"{a['total_files']} files became {a['node_count']} nodes and {a['edge_count']} edges in {communities - lone} communities"
    parts = [text + (f", and {lone} nodes stand alone" if lone else "") + "."]
    if a["directory_stats"]:
        parts.append("Most nodes are in " + "; ".join(f"{d['directory']} ({d['file_count']} files, {d['node_count']} nodes)" for d in a["directory_stats"][:4]) + ".")
    if a["god_nodes"]:
        parts.append("Most linked: " + ", ".join(g["label"] for g in a["god_nodes"][:3]) + ".")
    rings = a["layers"]["cycles"]
    parts.append(f"Directories depend on each other in {len(rings)} cycle(s)." if rings else "No directories depend on each other in a cycle.")
    if a["patterns"]:
        parts.append("Patterns found: " + ", ".join(f"{p['name']} ({p['anchor_node']})" for p in a["patterns"]) + ".")
    return " ".join(parts)


def generate(a: dict, title: str = "Graph report") -> str:
    """The report of an analysis (plans.build.analyse)."""
    out = [f"# {title}", "", f"- Files: {number(a['total_files'])} · words: {number(a['total_words'])}"]
    if a["verdict"]:
        out.append({"small": "- The corpus is small; a graph may not be needed.", "large": "- The corpus is large; expect a large graph."}[a["verdict"]])
    out += [f"- {number(a['node_count'])} nodes · {number(a['edge_count'])} edges · {number(a['communities'])} communities", "- Confidence: " + " · ".join(f"{a['confidence'][c.lower() + '_pct']}% {c}" for c in fixed.CONFIDENCES)]

    def section(name: str, lines: list[str]) -> None:
        if lines:
            out.extend(["", f"## {name}", *lines])

    section("Executive Summary", [summary(a)])
    layers = a["layers"]
    deps = [f"- {d['from_dir']} -> {d['to_dir']} ({d['count']})" for d in layers["source_deps"][:10]]
    order = [" -> ".join(layers["source_layer_order"])] if layers["source_layer_order"] else []
    section("Architecture", order + deps + [f"- {v}" for v in layers["violations"]])
    section("Design Patterns", [x for p in a["patterns"] for x in (f"- **{p['name']}**: {p['anchor_node']} ({p['anchor_file']}), {p['participants']} participants", *(f"  - {e}" for e in p["evidence"]))])
    section("Enums", [f"- {e['label']} ({e['case_count']}): {cut(e['cases'], 6)} - {e['file']}" for e in a["enums"]])
    section("Project Structure", [f"- {d['directory']}: {d['file_count']} files, {d['node_count']} nodes" for d in a["directory_stats"]])
    section("Key Files", [f"- {k['path']}: degree {k['total_degree']}, {k['node_count']} nodes, {k['class_count']} classes, {k['method_count']} methods" + (f" - {cut(k['class_names'], 4)}" if k["class_names"] else "") for k in a["key_files"]])
    section("Runtime Dependencies", [f"- {d['from_file']} -> {d['to_file']} ({d['count']} calls)" for d in a["runtime_deps"]])
    gods = []
    for i, g in enumerate(a["god_nodes"], 1):
        gods.append(f"{i}. {g['label']} - {g['degree']} links" + (f", extends {g['parent_class']}" if g["parent_class"] else "") + (f", {g['method_count']} methods" if g["method_count"] else ""))
        if g["inheritor_count"]:
            gods.append(f"   - inherited by {g['inheritor_count']}: {cut(g['inheritor_names'], 4)}")
        if g.get("docstring"):
            gods.append(f"   - {g['docstring']}")
    section("God Nodes", gods)
    section("Hierarchies", [x for t in a["trees"] for x in ("```", *tree_lines(t), "```")])
    section("Surprising Connections", [f"- {s['source_label']} -> {s['target_label']} [{s['confidence']}] {s['relation']} (score {s['score']}): {s['why']}" for s in a["surprises"]])
    out += ["", "---"]
    groups = [f"*+ {a['singletons']} isolated nodes omitted*"] if a["singletons"] else []
    for c in a["listing"]:
        groups += ["", f"### Community {c['community']} - \"{c['label']}\"", f"Cohesion: {c['cohesion']:.2f}", f"Nodes ({c['size']}): {c['members']}"]
    section("Communities", groups)
    section("Ambiguous Edges", [f"- `{e['source_label']}` -> `{e['target_label']}` ({e['relation']})" for e in a["ambiguous"]])
    return "\n".join(out) + "\n"
