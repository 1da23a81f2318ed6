import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import fixed
from loomgraph.plans.build import build, docstring
from loomgraph.sources import files, records
from loomgraph.sources.extract.base import blank
from loomgraph.sources.extract.languages import EXTRACTORS, LANGUAGES, extract

# For each language: a file, labels it must give, edges (source id, target id, relation), and calls (caller id, callee).
CASES = {
    "m.py": ("import os.path as p\nfrom a.b import c\nclass K(Base, x.Other):\n    def f(self):\n        go()\n    class In:\n        pass\ndef go():\n    return K().f()\n", {"p", "b", "K", ".f()", "In", "go()", "Base", "Other"}, {("k", "base", "inherits"), ("k", "other", "inherits"), ("k", "in", "contains")}, {("k_f", "go"), ("go", "f")}),
    "m.go": ('package srv\nimport (\n "net/http"\n)\ntype S struct { a int }\nfunc (s *S) Run() { helper() }\nfunc helper() {}\n', {"S", ".Run()", "helper()"}, {("m_go", "http", "imports_from"), ("srv_s", "srv_s_run", "method")}, {("srv_s_run", "helper")}),
    "m.ts": ("import { a } from './mod';\nexport class K {\n  async f(x: string) { go(); }\n}\nconst go = (x) => { K.f(); };\nfunction top() { go(); }\n", {"./mod", "K", ".f()", "go()", "top()"}, set(), {("k_f", "go"), ("top", "go"), ("go", "f")}),
    "m.java": ("import java.util.List;\npublic class K extends Base implements I, J {\n  public K() { init(); }\n  void run(int a) { this.go(); }\n}\ninterface I { void x(); }\nenum E { A, B }\n", {"List", "K", ".K()", ".run()", "I", ".x()", "E"}, {("k", "base", "inherits"), ("k", "j", "inherits")}, {("k_k", "init"), ("k_run", "go")}),
    "m.c": ('#include <stdio.h>\n#include "x/y.h"\nint f(int a);\nstatic char *g(void) {\n  return f(1) ? "f(" : 0; /* h() */\n}\n', {"stdio", "y", "f()", "g()"}, set(), {("g", "f")}),
    "m.cpp": ("#include <vector>\nnamespace n {\nclass K : public Base, private Other {\n public:\n  K() { init(); }\n  int get(int a) const { return a; }\n  void later();\n};\n}\nint main() { K k; k.get(1); }\n", {"vector", "K", ".get()", ".later()", "main()"}, {("k", "base", "inherits"), ("k", "other", "inherits")}, {("main", "get")}),
    "m.cs": ("using System.Net.Http;\nnamespace N.M {\npublic class K : Base, I<int> {\n  public async Task<int> Run(int a) { Go(); return 1; }\n}\n}\n", {"Http", "N.M", "K", ".Run()"}, {("k", "base", "inherits"), ("k", "i", "inherits")}, {("k_run", "Go")}),
    "m.php": ("<?php\nuse A\\B\\C;\nclass K {\n  public function f() { $this->g(); }\n  function g() {}\n}\nfunction top() { f(); }\n", {"C", "K", ".f()", ".g()", "top()"}, set(), {("k_f", "g"), ("top", "f")}),
    "m.rb": ("require 'json'\nmodule M\n  class K\n    def f(a)\n      if a then g(a) end\n    end\n    def g(x)\n    end\n  end\nend\ndef top\n  f(1)\nend\n", {"json", "M", "K", ".f()", ".g()", "top()"}, set(), {("k_f", "g"), ("top", "f")}),
    "m.swift": ("import UIKit\nprotocol P { func a() }\nclass K: Base, P {\n  init(x: Int) { go() }\n  func a() { b() }\n}\nenum E: Int {\n  case one, two\n  case three(Int)\n}\nfunc top() { K() }\n", {"UIKit", "P", "K", ".init()", ".a()", "E", ".one", ".two", ".three", "top()"}, {("k", "base", "inherits"), ("k", "p", "inherits"), ("e", "e_two", "case_of")}, {("k_init", "go"), ("k_a", "b")}),
    "m.kt": ("import a.b.C\nclass K(val x: Int) {\n  fun f(): Int { return g() }\n  private fun g() = 1\n}\nfun top() { K(1).f() }\n", {"C", "K", ".f()", ".g()", "top()"}, set(), {("k_f", "g"), ("top", "f")}),
    "m.dart": ("import 'package:a/b.dart';\nabstract class P {\n  void p();\n}\nclass K extends P with M {\n  K(this.a);\n  factory K.of(x) { return K(x); }\n  @override\n  void p() { q(); }\n  int get z => q();\n}\nmixin M {}\nenum E { one, two, three }\nvoid top() => K(1);\n", {"b", "P", "K", ".K()", ".of()", ".p()", "M", "E", ".one", "top()"}, {("k", "p", "inherits"), ("k", "m", "inherits"), ("e", "e_one", "case_of")}, {("k_p", "q"), ("m_dart_top", "K")}),
    "m.scala": ("import a.b.C\nclass K(x: Int) {\n  def f(a: Int): Int = { g(a) }\n}\nobject O { def g(a: Int) = { a } }\n", {"C", "K", ".f()", "O", ".g()"}, set(), {("k_f", "g")}),
    "m.rs": ("use std::collections::HashMap;\npub struct K { a: i32 }\nenum E { A }\ntrait T { fn t(&self); }\nimpl K {\n  fn f(&self) { go(); println!(\"x\"); }\n}\nfn go() {}\n", {"HashMap", "K", "E", "T", ".f()", "go()"}, set(), {("k_f", "go"), ("k_f", "println")}),
    "m.ex": ("defmodule A.B do\n  alias X.Y\n  import Z.W\n  def f(a) do\n    g(a)\n  end\n  defp g(x), do: x\nend\n", {"A.B", "Y", "Z.W", "f", "g"}, set(), {("f", "g"), ("f", "f")}),
    "m.zig": ('const std = @import("std");\nconst K = struct {\n  pub fn f(a: i32) i32 { return g(a); }\n};\nfn g(a: i32) i32 { return a; }\n', {"std", "K", "f()", "g()"}, set(), {("f", "g")}),
    "m.jl": ("using A, B\nstruct K <: Base\n  x\nend\nfunction f(a)\n  if a\n    g(a)\n  end\nend\ng(x) = x + 1\n", {"A", "B", "K", "f()", "g()"}, set(), {("f", "g"), ("g", "g")}),
    "m.lua": ('local http = require("http")\nlocal K = {}\nfunction K:f(a)\n  if a then self:g() end\nend\nfunction K.h() end\nlocal function top() K:f() end\n', {"http", "K", "K:f()", "K.h()", "top()"}, set(), {("k_f", "g"), ("top", "f")}),
    "m.ps1": ("using module My\nfunction Get-A {\n  Set-B -x 1\n}\nfunction Set-B { }\nclass K {\n  [int] Run() { return 1 }\n}\n", {"My", "Get-A", "Set-B", "K", ".Run()"}, set(), {("get_a", "Set-B")}),
    "m.m": ('#import "A.h"\n@interface K : Base <P>\n- (void)f:(int)a;\n@end\n@implementation K\n- (void)f:(int)a { [self g]; h(); }\n- (void)g { }\n@end\n', {"A", "K", ".f()", ".g()"}, {("k", "base", "inherits"), ("k", "p", "inherits")}, {("k_f", "h")}),
    "m.r": ("library(dplyr)\nf <- function(a) {\n  g(a)\n}\ng <- function(x) { x }\n", {"dplyr", "f()", "g()"}, set(), {("f", "g")}),
    "m.hs": ("module M where\nimport Data.Map\ndata K = K\nf :: Int -> Int\nf x = g x\ng :: Int -> Int\ng x = x\n", {"Data.Map", "K", "f()", "g()"}, set(), {("f", "g")}),
    "m.elm": ("module M exposing (..)\nimport Html\nf : Int -> Int\nf x =\n    g x\ng : Int -> Int\ng x =\n    x\n", {"Html", "f()", "g()"}, set(), {("f", "g")}),
}


@pytest.mark.parametrize("path", CASES)
def test_language(path):
    text, labels, edges, calls = CASES[path]
    f = extract(path, text)
    assert labels <= {n[1] for n in f.nodes}
    assert edges <= set(f.edges) and calls <= set(f.calls)
    ids = {n[0] for n in f.nodes}
    assert all(e[0] in ids for e in f.edges) and all(c[0] in ids for c in f.calls)
    assert len({n[0] for n in f.nodes}) == len(f.nodes)


def test_every_language_has_a_case_and_survives_noise():
    assert {LANGUAGES["." + p.split(".")[-1]] for p in CASES} == set(EXTRACTORS) and len(EXTRACTORS) == 23
    for path, (text, *_) in CASES.items():
        for noise in ("", "\n\n", "}}}{{{(((", text[: len(text) // 2], text + "'\"/*", "\x00\xff" * 10):
            assert extract(path, noise) is not None
    assert extract("a.md", "x") is None and extract("Makefile", "") is None and extract("a.vue", "") is None


def test_blanking_keeps_places():
    text = 'a "b // c" // d\n/* e\nf */ g \'h\''
    made = blank(text)
    assert len(made) == len(text) and made.count("\n") == 2 and "b" not in made and "f" not in made and "g" in made


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    for name, text in {
        "lib/src/a.py": CASES["m.py"][0], "lib/b.go": CASES["m.go"][0], "lib/c.dart": "/// Doc of\n/// c.\n" + CASES["m.dart"][0], "README.md": "---\nt: 1\n---\nhello world", "node_modules/x.py": "import z",
        ".hidden/y.py": "", "token.txt": "", "img/a.png": "x", "skip/me.py": "x = 1", "data.bin": "", ".loomgraphignore": "# no\nskip/\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan(spark, project):
    (project / "linked.py").symlink_to(project / "lib/src/a.py")
    (project / "linked").symlink_to(project / "lib")
    rows = {r["path"]: r for r in files.collect(spark, str(project)).drop("content").collect()}
    kinds = {p: r["file_type"] for p, r in rows.items() if r["file_type"]}
    assert kinds == {"lib/src/a.py": "code", "lib/b.go": "code", "lib/c.dart": "code", "README.md": "document", "img/a.png": "image"}
    assert rows["README.md"]["words"] == 6 and rows["skip/me.py"]["skipped"] == "ignored" and rows["token.txt"]["skipped"] == "sensitive"
    assert {r["skipped"] for p, r in rows.items() if p.startswith("linked")} <= {"link"}


def test_build_and_cache(spark, project, tmp_path):
    out = str(tmp_path / "out")
    first = build(spark, str(project), out)
    assert (first["hits"], first["misses"]) == (0, 4) and first["total_files"] == 5
    again = build(spark, str(project), out)
    assert (again["hits"], again["misses"]) == (3, 1) or again["hits"] + again["misses"] == 4
    report = (tmp_path / "out/REPORT.md").read_text()
    at = [report.index(f"## {s}") for s in ("Executive Summary", "Enums", "Project Structure", "God Nodes", "Communities")]
    assert at == sorted(at)
    made = json.loads((tmp_path / "out/graph.json").read_text())
    assert {n["id"] for n in made["nodes"]} >= {"k", "e_one"} and all("confidence" in e for e in made["links"])
    import xml.dom.minidom

    xml.dom.minidom.parse(str(tmp_path / "out/graph.graphml"))
    nodes, edges = records.read_graph(spark, out + "/graph.json")
    table_nodes, table_edges = records.read_graph(spark, out + "/graph")
    assert nodes.count() == table_nodes.count() == first["node_count"] and edges.count() == table_edges.count() == first["edge_count"]
    assert "MERGE" in (tmp_path / "out/graph.cypher").read_text() and "vis" not in (tmp_path / "out/graph.html").read_text()[:20]


def test_stream_fills_the_cache(spark, project, tmp_path):
    from loomgraph.plans.build import CACHED
    from loomgraph.streaming.ingest import watch

    cache, mark = str(tmp_path / "cache"), str(tmp_path / "mark")
    for new in (None, "lib/new.py"):
        if new:
            (project / new).write_text("def added():\n    pass\n")
        watch(spark, str(project), cache, mark).awaitTermination()
    paths = [r["path"] for r in files.Cache(spark, cache).read(CACHED).select("path").collect()]
    assert sorted(p for p in paths if p.endswith(".py")) == ["lib/new.py", "lib/src/a.py", "skip/me.py"]


def test_records(spark):
    rows = [(1, '{"nodes": [{"id": "a", "label": "A", "source_file": "a.py"}, 7, {"label": "x"}], "edges": [{"source": "a", "target": "b", "relation": "implements", "confidence": "INFERRED", "weight": 0.8}]}'), (2, '{"nodes": [{"id": "a", "label": "Z"}]}'), (3, "no json")]
    n, e = records.from_records(spark.createDataFrame(rows, "record_id int, record string"))
    assert [tuple(r) for r in n.collect()] == [("a", "Z", "", "")] and [tuple(r) for r in e.collect()] == [("a", "b", "implements", "INFERRED", 0.8)]


def test_hashes_and_verdict(spark):
    f = spark.createDataFrame([("a.md", bytearray(b"---\nx\n---\nbody")), ("b.md", bytearray(b"---\ny\n---\nbody")), ("c.md", bytearray(b"---")), ("d.py", bytearray(b"\xff\x00"))], "path string, content binary")
    import hashlib

    got = {r["path"]: r["hash"] for r in files.hashed(f).collect()}
    assert got["a.md"] == got["b.md"] != got["c.md"] and got["d.py"] == hashlib.sha256(b"\xff\x00").hexdigest()
    sized = lambda w, n=1: files.verdict(spark.range(n).select(F.lit(w).cast("long").alias("words"), F.lit("code").alias("file_type"))).first()["verdict"]
    assert sized(10) == "small" and sized(60_000) == "" and sized(fixed.WORDS_LARGE) == "large" and sized(1000, 300) == "large"


def test_docstrings():
    assert docstring("/// One.\n/// Two.\nclass A {}", "B") == "One. Two."
    assert docstring("x\n/// About A.\nclass AB {}\n/// Right.\nclass A {}", "A") == "Right."
