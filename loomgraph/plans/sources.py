"""Extraction queries: one for each language, over a file made for every supplier.

A file is a template in which § stands for the supplier's key.  What it must
give is written beside it, by the rules of the language, as nodes
(id=label, with ~type where the extractor knows it), edges
(source>target:relation) and calls (caller>callee); F is the file's own node,
whose id and label follow from its path.  The oracle spells the same rows out
for every supplier, so extra rows count as much as missing ones.  Comments and
strings hold declarations that must not be found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.extract import parsed
from . import projection as p


@dataclass(frozen=True)
class Case:
    ending: str
    text: str
    nodes: str
    edges: str
    calls: str

    def rows(self) -> list[tuple[str, str, str, str]]:
        """kind, a, b, c with § in place of the key."""
        own = f"src_f§_{self.ending}"
        name = lambda x: own if x == "F" else x
        out = [("node", own, f"f§.{self.ending}", "file" if self.ending == "dart" else "")]
        for x in self.nodes.split():
            (nid, label), kind = x.split("~")[0].split("=", 1), (x.split("~") + [""])[1]
            out.append(("node", nid, label, kind))
        for x in self.edges.split():
            (a, b), relation = x.split(":")[0].split(">"), x.split(":")[1]
            out.append(("edge", name(a), name(b), relation))
        return out + [("call", *x.split(">"), "") for x in self.calls.split()]


CASES = {
    "python": Case(
        "py",
        'import os.path as p§\nfrom a.b§ import c\nclass K§(Base§, x.Other):\n    def f(self):\n        go§()\n    class In§:\n        pass\n    async def g(self):\n        await self.f()\n# def not(): pass\ndef go§():\n    """def no(): pass"""\n    return K§().f()\n',
        "p§=p§ b§=b§ k§=K§ base§=Base§ other=Other k§_f=.f() in§=In§ k§_g=.g() go§=go§()",
        "F>p§:imports F>b§:imports F>k§:contains k§>base§:inherits k§>other:inherits k§>k§_f:method k§>in§:contains k§>k§_g:method F>go§:contains",
        "k§_f>go§ k§_g>f go§>f go§>K§",
    ),
    "go": Case(
        "go",
        'package srv§\n\nimport (\n\t"fmt"\n\t"net/http§"\n)\n\ntype S§ struct {\n\ta int\n}\n\ntype I§ interface{ Run() }\n\n// func no() {}\nfunc (s *S§) Run() {\n\thelper§("no()")\n\tfmt.Println(s)\n}\n\nfunc helper§() {}\n',
        "srv§_s§=S§ srv§_i§=I§ srv§_s§_run=.Run() f§_helper§=helper§()",
        "F>fmt:imports_from F>http§:imports_from F>srv§_s§:contains F>srv§_i§:contains srv§_s§>srv§_s§_run:method F>f§_helper§:contains",
        "srv§_s§_run>helper§ srv§_s§_run>Println",
    ),
    "javascript": Case(
        "js",
        "import { a } from './mod§';\nconst b = require('lib§');\nexport class K§ {\n  constructor(x) { this.x = x; }\n  async f(x) { go§(); }\n}\n// function no() {}\nconst go§ = (x) => { K§.f(); };\nfunction top§() { go§(\"no()\"); }\n",
        "mod§=./mod§ k§=K§ k§_constructor=.constructor() k§_f=.f() go§=go§() top§=top§()",
        "F>mod§:imports F>k§:contains k§>k§_constructor:method k§>k§_f:method F>go§:contains F>top§:contains",
        "k§_f>go§ go§>f top§>go§",
    ),
    "typescript": Case(
        "ts",
        "import { a } from './mod§';\nexport class K§ {\n  private n: number = 0;\n  async f(x: string): Promise<void> { go§(x); }\n}\nconst go§ = (x: string) => { top§(x); };\nexport function top§(x: string): void { /* no() */ }\n",
        "mod§=./mod§ k§=K§ k§_f=.f() go§=go§() top§=top§()",
        "F>mod§:imports F>k§:contains k§>k§_f:method F>go§:contains F>top§:contains",
        "k§_f>go§ go§>top§",
    ),
    "java": Case(
        "java",
        "package a.b;\nimport java.util.List§;\npublic class K§ extends Base§ implements I§, J§ {\n  private int n = 0;\n  public K§() { init§(); }\n  @Override\n  void run(int a) { this.go§(); /* no(); */ }\n}\ninterface I§ { void x(); }\nenum E§ { A, B }\n",
        "list§=List§ k§=K§ base§=Base§ i§=I§ j§=J§ e§=E§ k§_k§=.K§() k§_run=.run() i§_x=.x()",
        "F>list§:imports F>k§:contains k§>base§:inherits k§>i§:inherits k§>j§:inherits F>i§:contains F>e§:contains k§>k§_k§:method k§>k§_run:method i§>i§_x:method",
        "k§_k§>init§ k§_run>go§",
    ),
    "c": Case(
        "c",
        '#include <stdio§.h>\n#include "x/y§.h"\nint f§(int a);\nstatic char *g§(void) {\n  return f§(1) ? "no(" : 0; /* no() */\n}\n',
        "stdio§=stdio§ y§=y§ f§=f§() g§=g§()",
        "F>stdio§:imports F>y§:imports F>f§:contains F>g§:contains",
        "g§>f§",
    ),
    "cpp": Case(
        "cpp",
        "#include <vector§>\nnamespace n {\nclass K§ : public Base§, private Other§ {\n public:\n  K§() { init§(); }\n  int get(int a) const { return a; }\n  void later();\n};\n}\nint main§() { K§ k; return k.get(1); }\n",
        "vector§=vector§ k§=K§ base§=Base§ other§=Other§ k§_k§=.K§() k§_get=.get() k§_later=.later() main§=main§()",
        "F>vector§:imports F>k§:contains k§>base§:inherits k§>other§:inherits k§>k§_k§:method k§>k§_get:method k§>k§_later:method F>main§:contains",
        "k§_k§>init§ main§>get",
    ),
    "csharp": Case(
        "cs",
        "using System.Net.Http§;\nnamespace N.M§ {\npublic class K§ : Base§, I§<int> {\n  public async Task<int> Run(int a) { Go§(); return 1; }\n  // void No() {}\n}\npublic interface I§<T> { int Stop(int a); }\n}\n",
        "n_m§=N.M§ http§=Http§ k§=K§ base§=Base§ i§=I§ k§_run=.Run() i§_stop=.Stop()",
        "F>n_m§:contains F>http§:imports F>k§:contains k§>base§:inherits k§>i§:inherits F>i§:contains k§>k§_run:method i§>i§_stop:method",
        "k§_run>Go§",
    ),
    "php": Case(
        "php",
        "<?php\nuse A\\B\\C§;\nclass K§ {\n  public function f() { $this->g(); }\n  function g() {}\n}\n# function no() {}\nfunction top§() { helper§('no()'); }\n",
        "c§=C§ k§=K§ k§_f=.f() k§_g=.g() top§=top§()",
        "F>c§:imports F>k§:contains k§>k§_f:method k§>k§_g:method F>top§:contains",
        "k§_f>g top§>helper§",
    ),
    "ruby": Case(
        "rb",
        "require 'json§'\nmodule M§\n  class K§\n    def f(a)\n      if a then g(a) end\n    end\n    def self.g(x)\n    end\n  end\nend\n# def no\ndef top§\n  go§(1)\nend\n",
        "json§=json§ m§=M§ k§=K§ k§_f=.f() k§_g=.g() top§=top§()",
        "F>json§:imports F>m§:contains F>k§:contains k§>k§_f:method k§>k§_g:method F>top§:contains",
        "k§_f>g top§>go§",
    ),
    "swift": Case(
        "swift",
        "import UIKit§\nprotocol P§ { func a() }\nclass K§: Base§, P§ {\n  init(x: Int) { go§() }\n  func a() { b§() }\n}\nenum E§: Int {\n  case one, two\n  case three(Int)\n}\n// func no() {}\nfunc top§() { K§() }\n",
        "uikit§=UIKit§ p§=P§ k§=K§ base§=Base§ e§=E§ int=Int e§_one=.one e§_two=.two e§_three=.three p§_a=.a() k§_init=.init() k§_a=.a() top§=top§()",
        "F>uikit§:imports F>p§:contains F>k§:contains k§>base§:inherits k§>p§:inherits F>e§:contains e§>int:inherits e§>e§_one:case_of e§>e§_two:case_of e§>e§_three:case_of p§>p§_a:method k§>k§_init:method k§>k§_a:method F>top§:contains",
        "k§_init>go§ k§_a>b§ top§>K§",
    ),
    "kotlin": Case(
        "kt",
        "import a.b.C§\nclass K§(val x: Int) {\n  fun f(): Int { return g() }\n  private fun g() = 1\n}\nobject O§ { fun h() { top§() } }\n// fun no() {}\nfun top§() { K§(1).f() }\n",
        "c§=C§ k§=K§ o§=O§ k§_f=.f() k§_g=.g() o§_h=.h() top§=top§()",
        "F>c§:imports F>k§:contains F>o§:contains k§>k§_f:method k§>k§_g:method o§>o§_h:method F>top§:contains",
        "k§_f>g o§_h>top§ top§>K§ top§>f",
    ),
    "dart": Case(
        "dart",
        "import 'package:a/b§.dart';\nabstract class P§ {\n  void p();\n}\nclass K§ extends P§ with M§ {\n  K§(this.a);\n  factory K§.of(x) { return make§(x); }\n  @override\n  void p() { q§(); }\n}\nmixin M§ {}\nenum E§ { one, two }\n// void no() {}\nfinal limit§ = 3;\nvoid top§() => K§(1);\n",
        "b§=b§~module p§=P§~class k§=K§~class m§=M§~class e§=E§~enum e§_one=.one~enum_value e§_two=.two~enum_value p§_p=.p()~method k§_k§=.K§()~method k§_of=.of()~method k§_p=.p()~method src_f§_dart_top§=top§()~function src_f§_dart_limit§=limit§~variable",
        "F>b§:imports F>p§:contains F>k§:contains k§>p§:inherits k§>m§:inherits F>m§:contains F>e§:contains e§>e§_one:case_of e§>e§_two:case_of p§>p§_p:method k§>k§_k§:method k§>k§_of:method k§>k§_p:method F>src_f§_dart_top§:contains F>src_f§_dart_limit§:contains",
        "k§_of>make§ k§_p>q§ src_f§_dart_top§>K§",
    ),
    "scala": Case(
        "scala",
        "import a.b.C§\nclass K§(x: Int) {\n  def f(a: Int): Int = { g§(a) }\n}\ntrait T§ { def t(a: Int): Int = { a } }\nobject O§ {\n  def h(a: Int) = { a }\n}\n",
        "c§=C§ k§=K§ t§=T§ o§=O§ k§_f=.f() t§_t=.t() o§_h=.h()",
        "F>c§:imports F>k§:contains F>t§:contains F>o§:contains k§>k§_f:method t§>t§_t:method o§>o§_h:method",
        "k§_f>g§",
    ),
    "rust": Case(
        "rs",
        'use std::collections::HashMap§;\npub struct K§ { a: i32 }\nenum E§ { A }\ntrait T§ { fn t(&self); }\nimpl K§ {\n  pub fn f(&self) { go§(); println!("no()"); }\n}\n// fn no() {}\nfn go§() {}\n',
        "hashmap§=HashMap§ k§=K§ e§=E§ t§=T§ t§_t=.t() k§_f=.f() go§=go§()",
        "F>hashmap§:imports F>k§:contains F>e§:contains F>t§:contains t§>t§_t:method k§>k§_f:method F>go§:contains",
        "k§_f>go§ k§_f>println",
    ),
    "elixir": Case(
        "ex",
        "defmodule A.B§ do\n  alias X.Y§\n  import Z.W§\n  def f§(a) do\n    g§(a)\n  end\n  defp g§(x), do: x\n  # def no(x), do: x\nend\n",
        "a_b§=A.B§ y§=Y§ z_w§=Z.W§ f§=f§ g§=g§",
        "F>a_b§:contains F>y§:imports F>z_w§:imports F>f§:contains F>g§:contains",
        "f§>f§ f§>g§ g§>g§",
    ),
    "zig": Case(
        "zig",
        'const std§ = @import("std");\nconst K§ = struct {\n  pub fn f§(a: i32) i32 { return g§(a); }\n};\n// fn no() void {}\nfn g§(a: i32) i32 { return a; }\n',
        "std§=std§ k§=K§ f§=f§() g§=g§()",
        "F>std§:imports F>k§:contains F>f§:contains F>g§:contains",
        "f§>g§",
    ),
    "julia": Case(
        "jl",
        "using A§, B§\nstruct K§ <: Base\n  x\nend\nfunction f§(a)\n  if a\n    g§(a)\n  end\nend\n# function no() end\ng§(x) = h§(x) + 1\n",
        "a§=A§ b§=B§ k§=K§ f§=f§() g§=g§()",
        "F>a§:imports F>b§:imports F>k§:contains F>f§:contains F>g§:contains",
        "f§>f§ f§>g§ g§>g§ g§>h§",
    ),
    "lua": Case(
        "lua",
        'local http§ = require("http")\nlocal K§ = {}\nfunction K§:f(a)\n  if a then self:g() end\nend\nfunction K§.h() end\n-- function no() end\nlocal function top§() go§() end\n',
        "http§=http§ k§=K§ k§_f=K§:f() k§_h=K§.h() top§=top§()",
        "F>http§:imports F>k§:contains F>k§_f:contains F>k§_h:contains F>top§:contains",
        "k§_f>g top§>go§",
    ),
    "powershell": Case(
        "ps1",
        "using module My§\nfunction Get-A§ {\n  Set-B§ -x 1\n}\nfunction Set-B§ { }\n# function No-C { }\nclass K§ {\n  [int] Run() { return 1 }\n}\n",
        "my§=My§ k§=K§ k§_run=.Run() get_a§=Get-A§ set_b§=Set-B§",
        "F>my§:imports F>k§:contains k§>k§_run:method F>get_a§:contains F>set_b§:contains",
        "get_a§>Set-B§",
    ),
    "objc": Case(
        "m",
        '#import "A§.h"\n@interface K§ : Base§ <P§>\n- (void)f:(int)a;\n@end\n@implementation K§\n- (void)f:(int)a { [self g]; h§(); }\n- (void)g { }\n// - (void)no { }\n@end\n',
        "a§=A§ k§=K§ base§=Base§ p§=P§ k§_f=.f() k§_g=.g()",
        "F>a§:imports F>k§:contains k§>base§:inherits k§>p§:inherits k§>k§_f:method k§>k§_g:method",
        "k§_f>h§ k§_f>g",
    ),
    "r": Case("r", "library(dplyr§)\nf§ <- function(a) {\n  g§(a)\n}\n# no <- function(a) { }\ng§ <- function(x) { x }\n", "dplyr§=dplyr§ f§=f§() g§=g§()", "F>dplyr§:imports F>f§:contains F>g§:contains", "f§>g§"),
    "haskell": Case(
        "hs",
        "module M where\nimport Data.Map§\ndata K§ = K§\nf§ :: Int -> Int\nf§ x = g§ x\n-- no x = x\ng§ :: Int -> Int\ng§ x = x\n",
        "data_map§=Data.Map§ k§=K§ f§=f§() g§=g§()",
        "F>data_map§:imports F>k§:contains F>f§:contains F>g§:contains",
        "f§>g§",
    ),
    "elm": Case("elm", "module M exposing (..)\nimport Html§\nf§ : Int -> Int\nf§ x =\n    g§ x\n-- no x = x\ng§ : Int -> Int\ng§ x =\n    x\n", "html§=Html§ f§=f§() g§=g§()", "F>html§:imports F>f§:contains F>g§:contains", "f§>g§"),
}


def extracted(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    """kind, path, a, b, c of all nodes, edges and calls (distinct) of every supplier's file."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        key = F.col("s_suppkey").cast("string")
        files = p.read(spark, d, "supplier").select(F.concat(F.lit("src/f"), key, F.lit(f".{case.ending}")).alias("path"), F.replace(F.lit(case.text), F.lit("§"), key).cast("binary").alias("content"))
        row = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))
        every = F.concat(
            F.transform("nodes", lambda x: row("node", x["id"], x["label"], x["type"])),
            F.transform("edges", lambda x: row("edge", x["source"], x["target"], x["relation"])),
            F.transform("calls", lambda x: row("call", x["caller"], x["callee"], F.lit(""))),
        )
        return parsed(files).select("path", F.explode(every).alias("x")).select("x.kind", "path", "x.a", "x.b", "x.c").distinct()

    return run


def oracle(case: Case) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(map(quoted, r))})" for r in case.rows())
    key = "CAST(s_suppkey AS VARCHAR)"
    columns = ", ".join(f"replace({c}, '§', {key}) AS {c}" for c in "abc")
    return f"SELECT DISTINCT kind, 'src/f' || {key} || '.{case.ending}' AS path, {columns} FROM supplier CROSS JOIN (VALUES {rows}) AS v(kind, a, b, c)"


QUERIES = {f"extract_{name}": extracted(case) for name, case in CASES.items()}
ORACLES = {f"extract_{name}": oracle(case) for name, case in CASES.items()}
