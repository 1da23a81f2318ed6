import pytest
from pyspark.sql import functions as F

from loomgraph.operators import analysis, cluster, export, graph, layers, patterns, traverse, validate

NODE, EDGE = "id string, label string, type string, file string", "source string, target string, relation string, confidence string, weight double"


def nodes(spark, rows):
    return spark.createDataFrame([r if len(r) == 4 else (r[0], r[0], r[1], f"src/{r[0]}.py") for r in rows], NODE)


def edges(spark, rows):
    return spark.createDataFrame([(*r, "EXTRACTED", 1.0) if len(r) == 3 else (*r, 1.0) for r in rows], EDGE)


def test_last_mention_counts(spark):
    m = spark.createDataFrame([("a", "x", "class", "1.py", 1), ("a", "y", "", "2.py", 2), ("b", "z", "", "", 1)], NODE + ", ord int")
    assert sorted(map(tuple, graph.last_nodes(m).collect())) == [("a", "y", "", "2.py"), ("b", "z", "", "")]
    e = spark.createDataFrame([("a", "b", "contains", "EXTRACTED", 1.0, 1), ("a", "b", "calls", "INFERRED", 2.0, 2)], EDGE + ", ord int")
    assert [tuple(r) for r in graph.last_edges(e).collect()] == [("a", "b", "calls", "INFERRED", 2.0)]


def test_degrees(spark):
    e = edges(spark, [("a", "a", "calls"), ("a", "b", "calls"), ("b", "a", "calls"), ("a", "gone", "calls")])
    assert {r["id"]: r["degree"] for r in graph.degree(e).collect()} == {"a": 3, "b": 1, "gone": 1}
    assert {r["id"]: r["degree"] for r in graph.raw_degree(e).collect()} == {"a": 5, "b": 2, "gone": 1}


def test_empty_graph(spark):
    n, e = nodes(spark, []), edges(spark, [])
    assert graph.counts(n, e).first() == (0, 0)
    for made in (analysis.god_nodes(n, e), analysis.key_files(n, e), analysis.enums(n, e), patterns.all_patterns(n, e), cluster.louvain(n, e), analysis.directory_deps(n, e)):
        assert made.count() == 0
    assert tuple(analysis.confidence_mix(e).first()) == (0, 0, 0)


def test_types_by_hints(spark):
    n = spark.createDataFrame([("f", i, lab, "", "x/f.py") for i, lab in [("file", "f.py"), ("m", ".m()"), ("g", "g()"), ("c", "C"), ("v", "odd"), ("b", "base")]], "scope string, " + NODE)
    e = spark.createDataFrame([("f", "c", "v", "case_of", 1), ("f", "c", "b", "imports", 2), ("f", "c", "b", "inherits", 3)], "scope string, source string, target string, relation string, ord int")
    assert {r["id"]: r["type"] for r in graph.infer_types(n, e).collect()} == {"file": "file", "m": "method", "g": "function", "c": "class", "v": "enum_value", "b": "module"}


def test_calls_by_label(spark):
    labels = spark.createDataFrame([("f", "run", "run()", 1), ("f", "a_run", ".run()", 2), ("f", "c_new", "C:new()", 3), ("g", "go", "go()", 1)], "scope string, id string, label string, seq int")
    calls = spark.createDataFrame([("f", "x", "Run"), ("f", "x", "new"), ("f", "x", "go"), ("f", "run", "run")], "scope string, caller string, callee string")
    assert sorted((r["source"], r["target"]) for r in graph.resolve_calls(labels, calls).collect()) == [("run", "a_run"), ("x", "a_run"), ("x", "c_new")]


def family(spark, base_methods, child_methods, n=3):
    ns = [("Base", "class")] + [(f"C{i}", "class") for i in range(n)]
    es = [(f"C{i}", "Base", "inherits") for i in range(n)] + [("Base", "Other", "calls")]
    for owner, names in [("Base", base_methods)] + [(f"C{i}", child_methods) for i in range(n)]:
        for m in names:
            ns.append((f"{owner}_{m}", f".{m}()", "method", "src/a.py"))
            es.append((owner, f"{owner}_{m}", "method"))
    return nodes(spark, ns), edges(spark, es)


def test_command_and_builder_and_observer(spark):
    n, e = family(spark, ["execute"], ["execute"])
    assert [(r["anchor_id"], r["participants"]) for r in patterns.command(n, e).collect()] == [("Base", 4)]
    n, e = family(spark, [], ["runAll"])
    assert [r["evidence"][0] for r in patterns.command(n, e).collect()] == ["3 subclasses share run() method"]
    n, e = family(spark, ["createX", "buildY"], [], 2)
    assert [(r["anchor_id"], r["participants"]) for r in patterns.builder_factory(n, e).collect()] == [("Base", 3)]
    n, e = family(spark, ["addListener", "removeListener", "notifyAll"], [], 0)
    assert [(r["anchor_id"], r["participants"]) for r in patterns.observer(n, e).collect()] == [("Base", 4)]


def test_strategy(spark):
    ns, es = [], []
    for c in "ABCD":
        ns.append((c, "class"))
        for m in ("draw", "move", "end"):
            ns.append((f"{c}{m}", f".{m}()", "method", "src/a.py"))
            es.append((c, f"{c}{m}", "method"))
    found = patterns.strategy(nodes(spark, ns), edges(spark, es)).collect()
    assert [(r["anchor_node"], r["participants"]) for r in found] == [("A", 4)]
    tied = edges(spark, [*es, ("A", "B", "inherits")])
    assert {(r["a"], r["b"]) for r in patterns.strategy_pairs(nodes(spark, ns), tied).collect()} == {("A", "C"), ("A", "D"), ("B", "C"), ("B", "D"), ("C", "D")}


def test_strategy_groups_are_those_of_the_pairs(spark):
    """Interfaces with copies, common and rare names, and ties between classes, against the passing pairs one by one."""
    import random

    some = random.Random(3)
    base = [sorted(some.sample(range(12), some.randint(3, 7))) for _ in range(14)]
    ns, es, own = [], [], {}
    for i in range(70):
        c = f"K{i}"
        names = set(some.choice(base))
        if i % 3 == 0:
            names ^= {some.randrange(14)}
        own[c] = {f"m{j}" for j in names}
        ns.append((c, "class"))
        for m in own[c]:
            ns.append((f"{c}{m}", f".{m}()", "method", "src/a.py"))
            es.append((c, f"{c}{m}", "method"))
    for _ in range(150):
        es.append((*some.sample(sorted(own), 2), some.choice(["calls", "inherits"])))
    es = list({x[:2]: x for x in es}.values())
    n, e = nodes(spark, ns), edges(spark, es)
    expected = {}
    for r in patterns.strategy_pairs(n, e).where("pass").collect():
        expected.setdefault(",".join(sorted(own[r["a"]] & own[r["b"]])), set()).update((r["a"], r["b"]))
    expected = {k: sorted(v) for k, v in expected.items() if len(v) >= 3}
    assert len(expected) > 5 and {r["names"]: r["classes"] for r in patterns.strategy_groups(n, e).collect()} == expected


def test_strategy_ties_within_one_interface(spark):
    """A class tied to all others of its interface is in no group of it."""
    ns, es = [], []
    for c in "ABCD":
        ns.append((c, "class"))
        for m in ("draw", "move", "end"):
            ns.append((f"{c}{m}", f".{m}()", "method", "src/a.py"))
            es.append((c, f"{c}{m}", "method"))
    tied = [*es, ("A", "B", "calls"), ("C", "A", "calls"), ("A", "D", "calls"), ("D", "A", "calls")]
    assert [r["classes"] for r in patterns.strategy_groups(nodes(spark, ns), edges(spark, tied)).collect()] == [["B", "C", "D"]]


def test_page_of_any_size(spark, tmp_path):
    import json

    n, e = auth(spark)
    m = n.select("id", F.lit(0).cast("long").alias("community"))
    n = n.unionAll(nodes(spark, [("s", "</script>", "class", "s.py")]))
    export.to_html(n, e, m, m.select("community", F.lit("all").alias("label")).distinct(), str(tmp_path / "g.html"))
    text = (tmp_path / "g.html").read_text()
    data = json.loads(text.split("const G = ")[1].split(", C = document")[0])
    assert [x["id"] for x in data["nodes"]] == ["n1", "n2", "n3", "n4", "n5", "s"] and len(data["links"]) == 3 and data["legend"] == [[0, "all", 5]] and text.count("</script>") == 1


def test_external_types_and_gods(spark):
    n = nodes(spark, [("E", "class"), ("P", "class"), ("Q", "class"), ("q.py", "q.py", "file", "src/q.py"), ("mod", "mod", "module", "src/q.py")])
    e = edges(spark, [("P", "E", "inherits"), ("Q", "E", "inherits"), ("P", "Q", "calls"), ("q.py", "P", "contains"), ("q.py", "mod", "imports")])
    assert [r["id"] for r in graph.external_types(n, e).collect()] == ["E"]
    gods = analysis.god_nodes(n, e)
    assert [(r["id"], r["degree"]) for r in gods.collect()] == [("P", 3), ("Q", 2)]
    d = {r["id"]: r for r in analysis.god_node_details(gods, n, e).collect()}
    assert d["P"]["parent_class"] == "E" and d["Q"]["inheritor_count"] == 0


def test_surprises_walk_and_windows_agree(spark):
    n = nodes(spark, [(f"n{i}", f"L{i % 5}", "function", f"{'ab'[i % 2]}/f{i}.py") for i in range(12)])
    e = edges(spark, [(f"n{i}", f"n{(i * 5 + 1) % 12}", "calls", ("AMBIGUOUS", "INFERRED", "EXTRACTED")[i % 3]) for i in range(12)])
    m = n.select("id", F.lit(0).alias("community"))
    scored = analysis.surprise(analysis.with_communities(analysis.surprise_candidates(n, e), m))
    walk = [(r["source"], r["target"]) for r in analysis.surprising(scored)]
    assert walk and walk == [(r["source"], r["target"]) for r in analysis.surprising_top(scored).collect()]


@pytest.mark.parametrize(("adj", "rings", "order"), [
    ({"a": ["b"], "b": ["c"], "c": []}, [], ["a", "b", "c"]),
    ({"b": ["c"], "c": ["a"], "a": ["b"]}, [["a", "b", "c", "a"]], ["a", "b", "c"]),
    ({"x": ["a"], "a": ["b"], "b": ["a"]}, [["a", "b", "a"]], ["x", "a", "b"]),
    ({"a": ["a"]}, [["a", "a"]], ["a"]),
    ({}, [], []),
])
def test_layers(adj, rings, order):
    assert layers.cycles(dict(sorted(adj.items()))) == rings and layers.layer_order(adj) == order


def cliques(k, n=2):
    e = [(f"{c}{i}", f"{c}{j}", "calls") for c in "xyz"[:n] for i in range(k) for j in range(i)]
    return [(f"{c}{i}", "class") for c in "xyz"[:n] for i in range(k)], [*e, ("x0", "y0", "calls")]


def test_louvain_and_split(spark):
    ns, es = cliques(6)
    n, e = nodes(spark, [*ns, ("lone", "class")]), edges(spark, es)
    groups = {}
    for r in cluster.louvain(n, e).collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [["lone"], [f"x{i}" for i in range(6)], [f"y{i}" for i in range(6)]]
    one = n.select("id", F.lit(0).cast("long").alias("community"))
    parts = [r["n"] for r in cluster.split_large(one, n, e, 4).groupBy("community").agg(F.count("id").alias("n")).collect()]
    assert sum(parts) == 13 and max(parts) == 6
    q = cluster.modularity(cluster.louvain(n, e), e).first()[0]
    assert q > cluster.modularity(n.select("id", F.col("id").alias("community")), e).first()[0] and q > 0.4


def test_numbers_go_on_across_ranges(spark):
    """Numbers by falling size, then smallest id, without gaps, over many partitions; none for no rows."""
    rows = [(f"n{i:03}", f"c{i % 37}" if i < 200 else f"s{i}") for i in range(300)]
    m = spark.createDataFrame(rows, "id string, community string").repartition(7)
    groups = {}
    for i, c in rows:
        groups.setdefault(c, []).append(i)
    order = sorted(groups.values(), key=lambda ids: (-len(ids), min(ids)))
    assert {r["id"]: r["community"] for r in cluster.numbered(m).collect()} == {i: k for k, ids in enumerate(order) for i in ids}
    assert cluster.numbered(m.limit(0)).count() == 0


def test_budget_takes_the_first_lines(spark):
    lines = spark.createDataFrame([(i, "x" * (i % 3 + 1)) for i in range(50)], "i int, line string")
    assert [r["i"] for r in traverse.within_budget(lines, ["i"], 3, 2).orderBy("i").collect()] == [0, 1, 2, 3, 4]
    assert traverse.within_budget(lines, ["i"], 3, 40).count() == 0


def test_large_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TASK_EDGES", 5)
    ns, es = cliques(6)
    n, e = nodes(spark, ns), edges(spark, es)
    found = cluster.louvain(n, e)
    assert found.count() == 12 and cluster.modularity(found, e).first()[0] > 0.2


def test_merge_and_cohesion(spark):
    ns, es = cliques(4, 1)
    n, e = nodes(spark, [*ns, ("p", "class"), ("lone", "class")]), edges(spark, [*es[:-1], ("x0", "p", "calls")])
    m = n.select("id", F.when(F.col("id") == "p", 1).when(F.col("id") == "lone", 2).otherwise(0).cast("long").alias("community"))
    assert sorted(r["n"] for r in cluster.merge_tiny(m, e).groupBy("community").agg(F.count("id").alias("n")).collect()) == [1, 5]
    alone = n.select("id", F.monotonically_increasing_id().alias("community"))
    sizes = [r["n"] for r in cluster.merge_tiny(alone, e).groupBy("community").agg(F.count("id").alias("n")).collect()]
    assert sum(sizes) == 6 and all(s >= 3 or s == 1 for s in sizes)
    assert {r["community"]: r["cohesion"] for r in cluster.cohesion(m, e).collect()} == {0: 1.0, 1: 1.0, 2: 1.0}


def auth(spark):
    n = spark.createDataFrame([("n1", "AuthService", "class", "auth.go"), ("n2", "UserRepo", "class", "user.go"), ("n3", ".login()", "method", "auth.go"), ("n4", "Database", "class", "db.go"), ("n5", "Alone", "class", "x.go")], NODE)
    return n, edges(spark, [("n1", "n3", "method"), ("n1", "n2", "calls"), ("n2", "n4", "calls")])


def test_paths_and_questions(spark):
    from loomgraph import cli

    n, e = auth(spark)
    assert len(traverse.shortest_path(e, "n1", "n4")) == 2 and traverse.shortest_path(e, "n1", "n5") is None and traverse.shortest_path(e, "n1", "n1") == []
    back = traverse.shortest_path(e, "n4", "n3")
    assert [s["forward"] for s in back] == [False, False, True]
    assert traverse.find_node(n, "authservice").first()["id"] == "n1" and traverse.find_node(n, "user").first()["id"] == "n2" and traverse.find_node(n, "zzz").first() is None
    text = cli.answer(n, e, "how does authservice work")
    assert "AuthService [type=class file=auth.go]" in text and "--calls--> UserRepo [EXTRACTED]" in text
    assert "truncated" in cli.answer(n, e, "authservice", budget=40) and "No node matches" in cli.answer(n, e, "zzz")
    assert "2 hops" in cli.path_text(n, e, "AuthService", "Database") and "No path" in cli.path_text(n, e, "Alone", "Database")
    with pytest.raises(LookupError):
        cli.path_text(n, e, "zzz", "Database")
    assert "-> calls:" in cli.explain_text(n, e, "AuthService") and "DFS" in cli.answer(n, e, "authservice", dfs=True)


def test_walk_is_by_depth(spark):
    e = edges(spark, [(f"n{i}", f"n{i + 1}", "calls") for i in range(9)] + [("n0", "m", "calls")])
    seen, links = traverse.depth_first(e, ["n0"])
    assert seen == ["n0", "n1", "n2", "n3", "n4", "m"] and ("n4", "n5") in {x[:2] for x in links}


def test_validation(spark):
    records = spark.createDataFrame([
        (1, '{"nodes": [{"id": "a", "label": "A", "file_type": "code", "source_file": "a.py"}], "edges": []}'),
        (2, '{"edges": {}}'),
        (3, '{"nodes": [3, {"label": "x", "file_type": "video"}, {"id": "b", "label": "", "file_type": "code", "source_file": ""}], "edges": [{"source": "b", "target": "zz", "relation": "calls", "confidence": "MAYBE", "source_file": ""}]}'),
    ], "record_id int, record string")
    found = sorted((r["record_id"], r["error"]) for r in validate.errors(records).collect())
    assert [x for x in found if x[0] == 1] == []
    assert [x[1] for x in found if x[0] == 2] == ["'edges' must be a list", "Missing required key 'nodes'"]
    assert [x[1] for x in found if x[0] == 3] == ["Edge 0 has invalid confidence 'MAYBE'", "Edge 0 target 'zz' does not match any node id", 'Node 0 must be an object', 'Node 1 (id="?") has invalid file_type \'video\'', "Node 1 (id=\"?\") missing required field 'id'", "Node 1 (id=\"?\") missing required field 'source_file'"]


def test_dangling(spark):
    n, e = nodes(spark, [("a", "class")]), edges(spark, [("a", "b", "calls"), ("c", "a", "calls")])
    assert sorted(r["id"] for r in validate.dangling(n, e).collect()) == ["b", "c"] and validate.dangling(n.limit(0), e).count() == 0
