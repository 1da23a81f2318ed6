"""What the extractors share: blanking comments and strings, matching blocks, and collecting nodes, edges and calls.

An extractor reads one file's text and fills a Found.  It decides what is
declared where; who a call means, which types nodes have and how files merge is
left to joins over all files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


def make_id(*parts: str) -> str:
    """The same as functions.exprs.make_id."""
    return re.sub(r"[^a-zA-Z0-9]+", "_", "_".join(parts)).strip("_").lower()


@dataclass
class Found:
    path: str
    nodes: list[tuple[str, str, str, int]] = field(default_factory=list)  # id, label, type, line
    edges: list[tuple[str, str, str]] = field(default_factory=list)  # source, target, relation
    calls: list[tuple[str, str]] = field(default_factory=list)  # caller's id, callee as written
    seen: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.file = make_id(self.path)
        self.node(self.file, self.path.rsplit("/", 1)[-1], 1)

    def node(self, nid: str, label: str, line: int, kind: str = "") -> str:
        if nid not in self.seen:  # within a file, the first counts
            self.seen.add(nid)
            self.nodes.append((nid, label, kind, line))
        return nid

    def edge(self, source: str, target: str, relation: str) -> None:
        self.edges.append((source, target, relation))

    def module(self, name: str, line: int, kind: str = "") -> None:
        if make_id(name):
            self.edge(self.file, self.node(make_id(name), name, line, kind), "imports")

    def cls(self, name: str, line: int, parent: str | None = None, kind: str = "") -> str:
        nid = self.node(make_id(name), name, line, kind)
        self.edge(parent or self.file, nid, "contains")
        return nid

    def base(self, nid: str, name: str, line: int, kind: str = "") -> None:
        if make_id(name):
            self.edge(nid, self.node(make_id(name), name, line, kind), "inherits")

    def method(self, owner: str, owner_name: str, name: str, line: int, kind: str = "") -> str:
        nid = self.node(make_id(owner_name, name), f".{name}()", line, kind)
        self.edge(owner, nid, "method")
        return nid

    def function(self, name: str, line: int, label: str | None = None, nid: str | None = None, kind: str = "") -> str:
        nid = self.node(nid or make_id(name), label or f"{name}()", line, kind)
        self.edge(self.file, nid, "contains")
        return nid


def blank(text: str, line: tuple[str, ...] = ("//",), block: tuple[tuple[str, str], ...] = (("/*", "*/"),), quotes: str = "\"'", long: tuple[str, ...] = ()) -> str:
    """text with the insides of comments and strings as blanks; places and line ends stay.

    long: quotes of several characters that may span lines.  An apostrophe that
    isn't closed within its line (or a few characters on, for languages with
    character literals only) is left alone.
    """
    starts = [(re.escape(q), "long") for q in sorted(long, key=len, reverse=True)] + [(re.escape(a), "block") for a, _ in block] + [(re.escape(x), "line") for x in sorted(line, key=len, reverse=True)] + [(re.escape(q), "quote") for q in quotes]
    if not starts:
        return text
    find = re.compile("|".join(f"({s})" for s, _ in starts))
    ends = {a: b for a, b in block}
    out, at = [], 0
    while m := find.search(text, at):
        out.append(text[at : m.start()])
        kind, mark = starts[m.lastindex - 1][1], m[0]
        if kind == "line":
            to = text.find("\n", m.end())
            to = len(text) if to < 0 else to
            inside = (m.start(), to)
        elif kind in ("block", "long"):
            close = ends.get(mark, mark) if kind == "block" else mark
            to = text.find(close, m.end())
            to = len(text) if to < 0 else to + len(close)
            inside = (m.start(), to)
        else:
            to = m.end()
            while to < len(text) and text[to] not in (mark, "\n"):
                to += 2 if text[to] == "\\" else 1
            if to >= len(text) or text[to] == "\n":  # not closed: an apostrophe or a lifetime
                out.append(mark)
                at = m.end()
                continue
            to += 1
            inside = (m.start() + 1, to - 1)
            out.append(mark)
        out.append(re.sub(r"[^\n]", " ", text[inside[0] : inside[1]]))
        if kind == "quote":
            out.append(mark)
        at = to
    out.append(text[at:])
    return "".join(out)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """Place after the bracket that closes the one at text[at]; the end of the text if none does."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(text)


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def body_after(text: str, at: int, stop: str = ";") -> tuple[int, int] | None:
    """The block in braces after a declaration's head, past parentheses; None if a stop or a closing brace comes first."""
    while m := re.compile(r"[({\[;}]" if stop == ";" else r"[({\[}]").search(text, at):
        if m[0] == "{":
            return m.start(), closing(text, m.start())
        if m[0] == "(":
            at = closing(text, m.start(), "()")
        elif m[0] == "[":
            at = closing(text, m.start(), "[]")
        else:
            return None
    return None


def called(body: str, keywords: frozenset[str], pattern: str = r"([A-Za-z_$][\w$]*)\s*[!?]?\s*\(") -> Iterator[str]:
    """Names before an opening parenthesis; of a chain, the last one."""
    for m in re.finditer(pattern, body):
        if m[1] not in keywords:
            yield m[1]


KEYWORDS = frozenset(
    "if for while switch catch return function sizeof new throw super this await typeof match when else do foreach using lock until unless elseif elif and or not in is as case guard let var fn func def end self assert yield defer try with select from where".split()
)
