"""Extractors by language: what each declares, imports, inherits and calls.

Most languages with braces differ only in how a class, a function and an import
are written, so they are tables of patterns for one scanner; the others have
functions of their own.  Python is parsed by the standard library.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from .base import KEYWORDS, Found, blank, body_after, called, closing, line_of, make_id

Extractor = Callable[[Found, str], None]
NAME = r"[A-Za-z_]\w*"


def python(f: Found, text: str) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return

    def calls(nid: str, node: ast.AST) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                name = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else ""
                if name:
                    f.calls.append((nid, name))

    def walk(body: list[ast.stmt], owner: tuple[str, str] | None) -> None:
        for x in body:
            if isinstance(x, ast.ClassDef):
                nid = f.cls(x.name, x.lineno, owner[0] if owner else None)
                for b in x.bases:
                    name = b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else ""
                    f.base(nid, name, x.lineno)
                walk(x.body, (nid, x.name))
            elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                nid = f.method(*owner, x.name, x.lineno) if owner else f.function(x.name, x.lineno)
                for part in x.body:
                    calls(nid, part)
            elif isinstance(x, ast.Import) and not owner:
                for a in x.names:
                    f.module(a.asname or a.name.rsplit(".", 1)[-1], x.lineno)
            elif isinstance(x, ast.ImportFrom) and not owner and x.module:
                f.module(x.module.rsplit(".", 1)[-1], x.lineno)
            elif isinstance(x, ast.If | ast.Try) and not owner:
                walk(x.body, owner)

    walk(tree.body, None)


@dataclass(frozen=True)
class Braces:
    """A language of blocks in braces. Patterns have groups name and, for classes, bases (text to take names from)."""

    cls: str = ""
    fn: str = ""
    imports: str = ""  # group name
    last: str = ""  # separators: of an import, what follows the last one
    comments: tuple = (("//",), (("/*", "*/"),))
    quotes: str = "\"'"
    long: tuple = ()
    bases: Callable[[str], list[str]] = lambda head: []
    prototypes: bool = False
    call: str = r"([A-Za-z_$][\w$]*)\s*\("
    drop: str = ""  # of an import's name
    raw_imports: bool = True  # imports are in strings
    stop: str = ";"


def names(text: str) -> list[str]:
    """Names in a list of types, without arguments in angle brackets or calls."""
    flat = text
    for _ in range(6):
        flat = re.sub(r"<[^<>]*>|\([^()]*\)", "", flat)
    out = []
    for part in flat.split(","):
        words = re.findall(NAME + r"(?:\s*(?:\.|::|\\)\s*" + NAME + ")*", re.sub(r"\b(public|private|protected|virtual|with|implements|extends|where.*)\b", " ", part))
        if words:
            out.append(re.split(r"\.|::|\\", words[0].replace(" ", ""))[-1])
    return out


def after(*marks: str) -> Callable[[str], list[str]]:
    """Names that follow one of the words or signs in a head."""
    split = re.compile("|".join(rf"\b{m}\b" if m.isalpha() else rf"(?<!:){re.escape(m)}(?!:)" for m in marks))

    def take(head: str) -> list[str]:
        return [n for part in split.split(head)[1:] for n in names(part)]

    return take


def braces(rule: Braces) -> Extractor:
    def run(f: Found, text: str) -> None:
        s = blank(text, *rule.comments, rule.quotes, rule.long)
        if rule.imports:
            for m in re.finditer(rule.imports, text if rule.raw_imports else s, re.M):
                if rule.raw_imports and s[m.start()] != text[m.start()]:
                    continue  # in a comment
                name = m["name"].strip()
                for mark in rule.last:
                    name = name.rsplit(mark, 1)[-1]
                f.module(re.sub(rule.drop, "", name) if rule.drop else name, line_of(s, m.start()))
        classes: list[tuple[int, int, str, str]] = []
        for m in re.finditer(rule.cls, s, re.M) if rule.cls else ():
            body = body_after(s, m.end(), rule.stop)
            if body is None and s[m.end() : m.end() + 1] not in (";", "", "\n", "(", " "):
                continue
            head = s[m.end() : body[0] if body else s.find("\n", m.end())]
            line = line_of(s, m.start())
            nid = f.cls(m["name"], line)
            for b in rule.bases(head):
                f.base(nid, b, line)
            if body:
                classes.append((*body, nid, m["name"]))
        done = 0
        for m in re.finditer(rule.fn, s, re.M) if rule.fn else ():
            if m["name"] in KEYWORDS or m.start() < done:
                continue  # inside another function
            body = body_after(s, m.end("name"), rule.stop)
            if body is None and not rule.prototypes and not any(a <= m.start() < b for a, b, *_ in classes):
                continue
            owner = max((c for c in classes if c[0] <= m.start() < c[1]), default=None)
            line = line_of(s, m.start())
            nid = f.method(owner[2], owner[3], m["name"], line) if owner else f.function(m["name"], line)
            if body and (owner is None or body[1] <= owner[1]):
                f.calls += [(nid, c) for c in called(s[body[0] : body[1]], KEYWORDS, rule.call)]
                done = body[1]

    return run


MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|partial|readonly|synchronized|native|default|open|data|inner|inline|suspend|operator|export|fileprivate|mutating|nonmutating|convenience|required|dynamic|lazy|weak|unsafe|extern|const|pub(?:\([^)]*\))?|case|implicit|infix|tailrec|external|actual|expect|annotation|value|indirect|class(?=\s+func))\s+)*"
TYPE = r"[\w.<>\[\],?&*\s:]+?[\s*&>\]]"

go_pair = r"^func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)"


def go(f: Found, text: str) -> None:
    s = blank(text, quotes="\"'`")
    pkg = re.search(r"^package\s+(\w+)", s, re.M)
    pkg = pkg[1] if pkg else ""
    stem = f.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for m in re.finditer(r"^import\s*(?:\((?P<many>[^)]*)\)|(?P<one>[^\n]*))", text, re.M):
        for p in re.findall(r'"([^"]+)"', m["many"] or m["one"] or ""):
            f.edge(f.file, make_id(p.rsplit("/", 1)[-1]), "imports_from")  # no node: the package is elsewhere
    heads = [m for m in re.finditer(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+\S", s, re.M)]
    grouped = [(x[1], m.start()) for m in re.finditer(r"^type\s*\(([^)]*)\)", s, re.M) for x in re.finditer(r"^\s+(\w+)\s+\S", m[1], re.M)]
    for name, at in [(m[1], m.start()) for m in heads] + grouped:
        nid = f.node(make_id(pkg, name), name, line_of(s, at))
        f.edge(f.file, nid, "contains")
    for m in re.finditer(go_pair, s, re.M):
        line = line_of(s, m.start())
        if m["recv"]:
            owner = make_id(pkg, m["recv"])
            nid = f.node(make_id(pkg, m["recv"], m["name"]), f".{m['name']}()", line)
            f.edge(owner, nid, "method")
        else:
            nid = f.function(m["name"], line, nid=make_id(stem, m["name"]))
        body = body_after(s, m.end(), "")
        if body:
            f.calls += [(nid, c) for c in called(s[body[0] : body[1]], KEYWORDS) if c.lower() != m["name"].lower()]
    f.edges = [e for e in f.edges if e[0] in f.seen and (e[1] in f.seen or e[2] == "imports_from")]


def javascript(f: Found, text: str) -> None:
    s = blank(text, quotes="\"'`")
    for m in re.finditer(r"""^\s*(?:import|export)\b[^;'"]*?['"](?P<a>[^'"]+)['"]|\brequire\(\s*['"](?P<b>[^'"]+)['"]""", text, re.M):
        if m["a"] and s[m.start("a") - 1] == text[m.start("a") - 1]:
            f.module(m["a"], line_of(s, m.start()))
    braces(Braces(cls=rf"\bclass\s+(?P<name>{NAME})", fn=rf"(?:^|[\s;{{}}])(?:function\s*\*?\s*|(?:const|let|var)\s+(?={NAME}\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{NAME}\s*=>))|(?<=[\n{{}};])[ \t]*(?:(?:async|static|get|set|public|private|protected|readonly|\*)\s+)*(?={NAME}\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{{;]+)?\{{))(?P<name>{NAME})", quotes="\"'`"))(f, text)


def elixir(f: Found, text: str) -> None:
    s = blank(text, ("#",), (), "\"", ('"""',))
    for m in re.finditer(r"^\s*(alias|import|use|require|defmodule|defp?)\s+([\w.?!]+)", s, re.M):
        word, name, line = m[1], m[2], line_of(s, m.start())
        if word == "defmodule":
            f.cls(name, line)
        elif word == "alias":
            f.module(name.rsplit(".", 1)[-1], line)
        elif word == "import":
            f.module(name, line)
        elif word in ("def", "defp"):
            nid = f.function(name, line, label=name)
            stop = re.compile(rf"^{re.match(r'[ \t]*', s[s.rfind(chr(10), 0, m.start(2)) + 1 :])[0]}end\b", re.M).search(s, m.end())
            one = re.match(r"[^\n]*,\s*do:", s[m.start() :].lstrip())
            to = s.find("\n", m.end()) if one or not stop else stop.start()
            whole = s[m.start(2) : to if to > 0 else len(s)]  # the head is part of it, so a parameterised function calls itself
            f.calls += [(nid, c) for c in called(whole, KEYWORDS, r"([a-z_]\w*[?!]?)\s*\(")]


def _ended(s: str, at: int, opens: str, close: str = r"\bend\b") -> int:
    """Place after the end that closes the block opened by the word at at."""
    depth = 0
    for m in re.compile(f"({opens})|{close}", re.M).finditer(s, at):
        depth += 1 if m[1] else -1
        if depth <= 0:
            return m.end()
    return len(s)


RUBY_OPENS = r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?=\s*(?:\|[^|]*\|)?\s*$)|=\s*(?:if|case|begin|unless)\b"


def ruby(f: Found, text: str) -> None:
    s = blank(text, ("#",), (("=begin", "=end"),), "\"'")
    for m in re.finditer(r"""^\s*require\s+['"]([^'"]+)['"]""", text, re.M):
        f.module(m[1], line_of(s, m.start()))
    owners: list[tuple[int, int, str, str]] = []
    for m in re.finditer(r"^[ \t]*(class|module)\s+([A-Z][\w:]*)|^[ \t]*def\s+((?:self\.)?[A-Za-z_]\w*[?!=]?)", s, re.M):
        line, to = line_of(s, m.start()), _ended(s, m.start(), RUBY_OPENS)
        if m[1]:
            owners.append((m.start(), to, f.cls(m[2].rsplit("::", 1)[-1], line), m[2].rsplit("::", 1)[-1]))
            continue
        name = m[3].removeprefix("self.")
        owner = max((o for o in owners if o[0] < m.start() < o[1]), default=None)
        nid = f.method(owner[2], owner[3], name, line) if owner else f.function(name, line)
        f.calls += [(nid, c) for c in called(s[m.end() : to], KEYWORDS, r"([A-Za-z_]\w*[?!]?)\s*\(")]


LUA_OPENS = r"\b(?:function|do|then|repeat)\b"


def lua(f: Found, text: str) -> None:
    s = blank(text, ("--",), (("--[[", "]]"), ("[[", "]]")), "\"'")
    for m in re.finditer(r"\blocal\s+(\w+)\s*=\s*(require\b|\{\s*\})?", s):
        if m[2] and m[2].startswith("require"):
            f.module(m[1], line_of(s, m.start()))
        elif m[2]:
            f.cls(m[1], line_of(s, m.start()))
    done = 0
    for m in re.finditer(r"\bfunction\s+([\w.]+(?::\w+)?)\s*\(", s):
        if m.start() < done:
            continue
        depth, to = 0, len(s)
        for x in re.finditer(r"\b(function|do|then|repeat|elseif|end|until)\b", s[m.start() :]):
            depth += {"end": -1, "until": -1, "elseif": -1}.get(x[1], 1)
            if depth == 0:
                to = m.start() + x.end()
                break
        nid = f.function(m[1], line_of(s, m.start()))
        f.calls += [(nid, c) for c in called(s[m.end() : to], KEYWORDS)]
        done = to


JULIA_OPENS = r"^\s*(?:function|module|baremodule|struct|mutable\s+struct|if|for|while|begin|let|try|macro|quote|abstract\s+type|primitive\s+type)\b|\bdo\b"


def julia(f: Found, text: str) -> None:
    s = blank(text, ("#",), (("#=", "=#"),), "\"", ('"""',))
    for m in re.finditer(r"^\s*(using|import)\s+([^\n]+)", s, re.M):
        for part in m[2].split(":")[0].split(","):
            f.module(part.strip().rsplit(".", 1)[-1], line_of(s, m.start()))
    for m in re.finditer(rf"^\s*(?:(?:mutable\s+)?struct|abstract\s+type|module)\s+({NAME})", s, re.M):
        f.cls(m[1], line_of(s, m.start()))
    for m in re.finditer(rf"^[ \t]*(?:function\s+(?P<a>{NAME}[!]?)|(?P<b>{NAME}[!]?)\([^)=\n]*\)\s*(?:::\s*\w+\s*)?=(?!=))", s, re.M):
        name = m["a"] or m["b"]
        to = _ended(s, m.start(), JULIA_OPENS) if m["a"] else s.find("\n", m.end())
        nid = f.function(name, line_of(s, m.start()))
        start = m.start("a") if m["a"] else m.start("b")
        f.calls += [(nid, c) for c in called(s[start : to if to > 0 else len(s)], KEYWORDS, r"([A-Za-z_]\w*!?)\s*\(")]  # the head is part of it


def zig(f: Found, text: str) -> None:
    s = blank(text, ("//",), (), "\"")
    for m in re.finditer(r"\bconst\s+(\w+)\s*=\s*(@import\b|(?:extern\s+|packed\s+)?(?:struct|enum|union)\b)", s):
        if m[2] == "@import":
            f.module(m[1], line_of(s, m.start()))
        else:
            f.cls(m[1], line_of(s, m.start()))
    for m in re.finditer(r"\bfn\s+(\w+)\s*\(", s):
        nid = f.function(m[1], line_of(s, m.start()))
        body = body_after(s, m.end(1))
        if body:
            f.calls += [(nid, c) for c in called(s[body[0] : body[1]], KEYWORDS)]


def powershell(f: Found, text: str) -> None:
    s = blank(text, ("#",), (("<#", "#>"),), "\"'")
    for m in re.finditer(r"^\s*(?:using\s+(?:namespace|module)|Import-Module)\s+(?:-Name\s+)?([\w.\\/-]+)", text, re.M | re.I):
        f.module(m[1].rsplit(".", 1)[-1], line_of(s, m.start()))
    for m in re.finditer(rf"^\s*class\s+({NAME})\s*(?::\s*([\w.,\s]+))?", s, re.M | re.I):
        nid = f.cls(m[1], line_of(s, m.start()))
        body = body_after(s, m.end(1), "")
        if body:
            for x in re.finditer(rf"^\s*(?:static\s+|hidden\s+)*(?:\[[\w.\[\]]+\]\s*)?({NAME})\s*\([^)]*\)\s*\{{", s[body[0] + 1 : body[1]], re.M):
                if x[1].lower() not in ("if", "while", "for", "foreach", "switch"):
                    f.method(nid, m[1], x[1], line_of(s, body[0] + 1 + x.start()))
    for m in re.finditer(r"^\s*function\s+([\w-]+)", s, re.M | re.I):
        nid = f.function(m[1], line_of(s, m.start()), label=m[1])
        body = body_after(s, m.end(), "")
        if body:
            f.calls += [(nid, c) for c in re.findall(r"(?<![\w$-])([A-Za-z]\w*-[\w-]+)", s[body[0] : body[1]])]


def objc(f: Found, text: str) -> None:
    s = blank(text)
    for m in re.finditer(r"""^\s*#\s*(?:import|include)\s*[<"]([^>"]+)[>"]""", text, re.M):
        f.module(re.sub(r"\.h$", "", m[1].rsplit("/", 1)[-1]), line_of(s, m.start()))
    for m in re.finditer(rf"^@(interface|implementation|protocol)\s+({NAME})(?:\s*\([^)]*\))?(?:\s*:\s*({NAME}))?(?:\s*<([^>\n]*)>)?", s, re.M):
        end = s.find("@end", m.end())
        if m[1] == "protocol" and ";" in s[m.end() : m.end() + 2]:
            continue
        line = line_of(s, m.start())
        nid = f.cls(m[2], line)
        for b in [m[3], *re.findall(NAME, m[4] or "")]:
            if b:
                f.base(nid, b, line)
        part = s[m.end() : end if end > 0 else len(s)]
        for x in re.finditer(rf"^[ \t]*[-+]\s*(?:\([^)]*\))?\s*({NAME})", part, re.M):
            at = m.end() + x.start()
            own = f.method(nid, m[2], x[1], line_of(s, at))
            body = body_after(s, m.end() + x.end())
            if body:
                inside = s[body[0] : body[1]]
                f.calls += [(own, c) for c in called(inside, KEYWORDS)] + [(own, c) for c in re.findall(rf"\[[^\[\]]*?\s({NAME})\s*[:\]]", inside)]


def r(f: Found, text: str) -> None:
    s = blank(text, ("#",), (), "\"'")
    for m in re.finditer(r"""\b(?:library|require)\s*\(\s*['"]?([\w.]+)""", text):
        f.module(m[1], line_of(s, m.start()))
    done = 0
    for m in re.finditer(r"^\s*([A-Za-z.][\w.]*)\s*(?:<-|=)\s*function\s*\(", s, re.M):
        if m.start() < done:
            continue
        nid = f.function(m[1], line_of(s, m.start()))
        body = body_after(s, m.end() - 1, "")
        if body:
            f.calls += [(nid, c) for c in called(s[body[0] : body[1]], KEYWORDS, r"([A-Za-z.][\w.]*)\s*\(")]
            done = body[1]


def _layout(f: Found, s: str, heads: list[tuple[str, int]], call: Callable[[str], list[str]]) -> None:
    """Functions whose definitions start at the margin: each ends where the next line at the margin begins."""
    edges = [m.start() for m in re.finditer(r"^\S", s, re.M)] + [len(s)]
    for name, at in heads:
        nid = make_id(name)
        if nid not in f.seen:
            f.function(name, line_of(s, at))
        to = next(e for e in edges if e > at)
        f.calls += [(nid, c) for c in call(s[at + len(name) : to])]


def haskell(f: Found, text: str) -> None:
    s = blank(text, ("--",), (("{-", "-}"),), "\"")
    for m in re.finditer(r"^import\s+(?:qualified\s+)?([\w.]+)", s, re.M):
        f.module(m[1], line_of(s, m.start()))
    for m in re.finditer(r"^(?:data|type|newtype)\s+(?:family\s+|instance\s+)?([A-Z]\w*)", s, re.M):
        f.cls(m[1], line_of(s, m.start()))
    words = frozenset("import module data type newtype class instance where infixl infixr infix deriving default foreign".split())
    heads = [(m[1], m.start()) for m in re.finditer(r"^([a-z_]\w*'*)(?=[^\n]*(?:::|=|\|))", s, re.M) if m[1] not in words]
    _layout(f, s, heads, lambda b: [] if re.match(r"\s*::", b) else re.findall(r"(?<![\w.'])([a-z_]\w*'*)(?=\s+[\w(\[\"])", b.split("=", 1)[-1]))


def elm(f: Found, text: str) -> None:
    s = blank(text, ("--",), (("{-", "-}"),), "\"")
    for m in re.finditer(r"^import\s+([\w.]+)", s, re.M):
        f.module(m[1], line_of(s, m.start()))
    words = frozenset("import module type port effect case of let in if then else msg".split())
    heads = [(m[1], m.start()) for m in re.finditer(r"^([a-z]\w*)(?=[^\n]*(?::|=))", s, re.M) if m[1] not in words]
    _layout(f, s, heads, lambda b: [] if re.match(r"\s*:", b) else re.findall(r"(?<![\w.])([a-z]\w*)(?=\s+[\w(\[\"])", b.split("=", 1)[-1]) + re.findall(r"=\s*([a-z]\w*)\s*[,}]", b))


def swift(f: Found, text: str) -> None:
    s = blank(text, quotes="\"", long=('"""',))
    for m in re.finditer(r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|func|enum|protocol|typealias|var|let)\s+)?(\w+)", s, re.M):
        f.module(m[1], line_of(s, m.start()))
    owners = []
    for m in re.finditer(rf"\b(class|struct|enum|actor|extension|protocol)\s+(?!func\b|var\b|let\b)({NAME})", s):
        body = body_after(s, m.end(), "")
        if not body:
            continue
        line = line_of(s, m.start())
        nid = f.cls(m[2], line)
        for b in after(":")(re.sub(r"\bwhere\b.*", "", s[m.end() : body[0]], flags=re.S)):
            f.base(nid, b, line)
        owners.append((*body, nid, m[2], m[1]))
    for a, b, nid, name, word in owners:
        if word == "enum":
            for m in re.finditer(r"^\s*(?:indirect\s+)?case\s+([^\n{]+)", s[a + 1 : b], re.M):
                if m[1].rstrip().endswith(":") or m[1].lstrip().startswith("."):
                    continue  # of a switch
                for c in re.findall(rf"(?:^|,)\s*({NAME})", re.sub(r"\([^)]*\)", "", m[1])):
                    f.edge(nid, f.node(make_id(name, c), f".{c}", line_of(s, a + 1 + m.start())), "case_of")
    done = 0
    for m in re.finditer(rf"\bfunc\s+({NAME}|[^\s\w(]+)\s*(?:<[^>]*>)?\s*\(|\b(init)[?!]?\s*(?:<[^>]*>)?\s*\(|\b(deinit)\b|\b(subscript)\s*\(", s):
        if m.start() < done or s[m.start() - 1 : m.start()] == ".":
            continue
        owner = max((o for o in owners if o[0] <= m.start() < o[1]), default=None)
        name = m[1] or m[2] or m[3] or m[4]
        if not owner and not m[1]:
            continue
        line = line_of(s, m.start())
        nid = f.method(owner[2], owner[3], name, line) if owner else f.function(name, line)
        at = m.start() + len(m[0].rstrip("("))
        body = body_after(s, at, "") if not (owner and owner[4] == "protocol") else None
        if body and (not owner or body[1] <= owner[1]):
            f.calls += [(nid, c) for c in called(s[body[0] : body[1]], KEYWORDS)]
            done = body[1]


def dart(f: Found, text: str) -> None:
    f.nodes[0] = (*f.nodes[0][:2], "file", 1)
    s = blank(text, long=('"""', "'''"))
    for m in re.finditer(r"""^\s*(?:import|export|part)\s+(?!of\b)['"]([^'"]+)['"]""", text, re.M):
        f.module(re.sub(r"\.dart$", "", m[1].rsplit("/", 1)[-1]).replace(":", "_"), line_of(s, m.start()), "module")
    owners = []
    for m in re.finditer(rf"^\s*(?:(?:abstract|base|final|sealed|interface)\s+)*(class|mixin(?:\s+class)?|extension(?:\s+type)?|enum)\s+({NAME})", s, re.M):
        body = body_after(s, m.end())
        if not body:
            continue
        kind, line = m[1].split()[0], line_of(s, m.start())
        nid = f.cls(m[2], line, kind=kind)
        if kind in ("class", "mixin", "enum"):
            for b in after("extends", "with", "implements")(s[m.end() : body[0]]):
                f.base(nid, b, line, "class")
        owners.append((*body, nid, m[2], kind))
        if kind == "enum":
            cases = s[body[0] + 1 : body[1] - 1].split(";")[0]
            for c in re.finditer(rf"(?:^|,)\s*({NAME})", re.sub(r"\([^)]*\)", lambda x: " " * len(x[0]), cases)):
                f.edge(nid, f.node(make_id(m[2], c[1]), f".{c[1]}", line_of(s, body[0] + 1 + c.start(1)), "enum_value"), "case_of")
    done = 0
    head = rf"(?:^|(?<=[{{}};]))[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:static|external|const|factory|late|final|covariant|abstract)\s+)*(?:(?:{NAME}(?:\.{NAME})?(?:<[^;{{}}()]*>)?\??|void|\([^()]*\))\s+)?(?:(?:get|set|operator)\s+)?({NAME}(?:\.{NAME})?)\s*(?:<[^>;{{}}]*>)?\s*(\(|=>|\{{)"
    for m in re.finditer(head, s, re.M):
        if m.start(1) < done or m[1] in KEYWORDS:
            continue
        owner = max((o for o in owners if o[0] < m.start(1) < o[1]), default=None)
        if m[2] == "(":
            close = closing(s, m.start(2), "()")
            rest = re.match(r"\s*(?:async\*?|sync\*)?\s*(?::[^{;]*)?(\{|=>|;)", s[close:])
            if not rest or rest[1] == ";" and not owner:
                continue
            at = close + rest.start(1)
        elif m[2] == "{" and not re.search(r"\bget\s+$", s[m.start() : m.start(1)]):
            continue
        else:
            at = m.start(2)
        name = m[1]
        if owner:
            name = name.split(".", 1)[-1] if name.startswith(owner[3] + ".") else name
            nid = f.method(owner[2], owner[3], name, line_of(s, m.start(1)), "method")
        else:
            nid = f.function(name, line_of(s, m.start(1)), nid=make_id(f.file, name), kind="function")
        to = closing(s, at) if s[at] == "{" else s.find(";", at) if s[at] == "=" else at
        to = len(s) if to < 0 else to
        f.calls += [(nid, c) for c in called(s[at:to], KEYWORDS)]
        done = to
    spans = [(a, b) for a, b, *_ in owners]
    for m in re.finditer(rf"^(?:(?:const|final|late|var)\s+)+(?:[\w<>?,. ]+\s+)?({NAME})\s*=|^{NAME}(?:<[^;=]*>)?\??\s+({NAME})\s*(?:=(?!>)|;)", s, re.M):
        name = m[1] or m[2]
        if not any(a <= m.start() < b for a, b in spans) and name not in KEYWORDS and m[0].split()[0] not in ("import", "export", "part", "library", "return", "typedef"):
            f.node(make_id(f.file, name), name, line_of(s, m.start()), "variable")
            f.edge(f.file, make_id(f.file, name), "contains")


def rust(f: Found, text: str) -> None:
    s = blank(text, quotes="\"")
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", s, re.M):
        found = re.findall(NAME, re.sub(r"\bas\s+\w+", "", m[1]))
        if found:
            f.module(found[-1], line_of(s, m.start()))
    owners = []
    for m in re.finditer(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(struct|enum|trait|mod|union|impl)\b(?:\s*<[^{{;]*?>)?\s+(?:[^{{;]*?\bfor\s+)?(?:\w+::)*({NAME})", s, re.M):
        nid = f.cls(m[2], line_of(s, m.start()))
        body = body_after(s, m.end())
        if body and m[1] in ("impl", "trait"):
            owners.append((*body, nid, m[2]))
    done = 0
    for m in re.finditer(rf"\bfn\s+({NAME})", s):
        if m.start() < done:
            continue
        owner = max((o for o in owners if o[0] <= m.start() < o[1]), default=None)
        nid = f.method(owner[2], owner[3], m[1], line_of(s, m.start())) if owner else f.function(m[1], line_of(s, m.start()))
        body = body_after(s, m.end())
        if body:
            f.calls += [(nid, c) for c in called(s[body[0] : body[1]], KEYWORDS, r"([A-Za-z_]\w*)\s*!?\s*\(")]
            done = body[1]


C_FN = rf"^(?!\s*(?:return|else|typedef|using|#)\b)[ \t]*(?:{TYPE})?(?P<name>~?{NAME}|operator\s*[^\s(]+)\s*\((?=[^;{{}}]*\)\s*(?:const|noexcept|override|final|->[^{{;]+|:[^{{;]+|\s)*[;{{])"
INCLUDE = r"""^\s*#\s*include\s*[<"](?P<name>[^>"]+)[>"]"""

EXTRACTORS: dict[str, Extractor] = {
    "python": python,
    "go": go,
    "javascript": javascript,
    "java": braces(Braces(
        cls=rf"\b(?:class|interface|enum|record)\s+(?P<name>{NAME})", bases=after("extends", "implements"), imports=r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+)", last=".",
        fn=rf"(?:^|(?<=[{{;}}]))[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{MOD}(?:<[^>]*>\s*)?(?:(?!return\b|new\b|else\b|throw\b)[\w.<>\[\],?\s]+?\s)?(?P<name>{NAME})\s*\((?=[^;{{}}]*\)\s*(?:throws\s[\w.,\s]+)?[{{;])",
    )),
    "c": braces(Braces(fn=C_FN.replace("~?", "").replace(r"|operator\s*[^\s(]+", ""), imports=INCLUDE, last="/", drop=r"\.h$", prototypes=True)),
    "cpp": braces(Braces(cls=rf"\b(?:class|struct)\s+(?P<name>{NAME})(?=\s*(?:final\s*)?[:{{])", bases=after(":"), fn=C_FN, imports=INCLUDE, last="/", drop=r"\.h(?:pp)?$")),
    "csharp": None,
    "php": braces(Braces(cls=rf"\b(?:class|interface|trait)\s+(?P<name>{NAME})", fn=rf"\bfunction\s+&?(?P<name>{NAME})", imports=r"^\s*use\s+(?:function\s+|const\s+)?(?P<name>[\w\\]+)(?:\s+as\s+\w+)?\s*;", last="\\", comments=(("//", "#"), (("/*", "*/"),)), call=r"(?<!::)\b([A-Za-z_]\w*)\s*\(")),
    "ruby": ruby,
    "swift": swift,
    "kotlin": braces(Braces(cls=rf"\b(?:class|interface|object)\s+(?P<name>{NAME})", fn=rf"\bfun\s+(?:<[^>]*>\s*)?(?:{NAME}(?:<[^>]*>)?\.)?(?P<name>{NAME})", imports=r"^\s*import\s+(?P<name>[\w.]+)", last=".", long=('"""',), stop="", quotes='"')),
    "dart": dart,
    "scala": braces(Braces(cls=rf"\b(?:class|object|trait)\s+(?P<name>{NAME})", fn=rf"\bdef\s+(?P<name>{NAME})", imports=r"^\s*import\s+(?P<name>[\w.]+)", last=".", long=('"""',), stop="", quotes='"')),
    "rust": rust,
    "elixir": elixir,
    "zig": zig,
    "julia": julia,
    "lua": lua,
    "powershell": powershell,
    "objc": objc,
    "r": r,
    "haskell": haskell,
    "elm": elm,
}

_csharp = braces(Braces(
    cls=rf"\b(?:class|interface)\s+(?P<name>{NAME})", bases=after(":"), imports=r"^\s*using\s+(?:static\s+)?(?P<name>[\w.]+)\s*;", last=".",
    fn=rf"(?:^|(?<=[{{;}}]))[ \t]*(?:\[[^\]]*\]\s*)*{MOD}(?!return\b|new\b|else\b|throw\b|await\b)(?:[\w.<>\[\],?]+\s+)(?P<name>{NAME})\s*(?:<[^>]*>)?\((?=[^;{{}}]*\)\s*(?:where\s[^{{;]+)?(?:=>|[{{;]))",
))


def csharp(f: Found, text: str) -> None:
    s = blank(text)
    for m in re.finditer(r"^\s*namespace\s+([\w.]+)", s, re.M):
        f.cls(m[1], line_of(s, m.start()))
    _csharp(f, text)


EXTRACTORS["csharp"] = csharp

LANGUAGES = {
    ".py": "python", ".go": "go", ".js": "javascript", ".ts": "javascript", ".tsx": "javascript", ".jsx": "javascript", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin",
    ".dart": "dart", ".scala": "scala", ".rs": "rust", ".ex": "elixir", ".exs": "elixir", ".zig": "zig", ".jl": "julia", ".lua": "lua", ".ps1": "powershell",
    ".m": "objc", ".mm": "objc", ".r": "r", ".hs": "haskell", ".elm": "elm",
}


def extract(path: str, text: str) -> Found | None:
    """Nodes, edges and calls of one file; None if its language has no extractor."""
    name = path.rsplit("/", 1)[-1].lower()
    language = LANGUAGES.get("." + name.rsplit(".", 1)[-1]) if "." in name else None
    if language is None:
        return None
    found = Found(path)
    EXTRACTORS[language](found, text)
    return found
