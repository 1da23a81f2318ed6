"""Queries whose job was once cut, held against SQL or brute force over the whole of it."""

import duckdb

from loomgraph.operators import cluster, traverse
from loomgraph.plans import catalogue
from loomgraph.plans import projection as p

SF = "/root/testdata/sf0.001"


def duck(sql):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c.execute(sql).fetchall()


def test_ids_are_made_of_whole_texts(spark):
    want = duck(p.sql("paths") + " SELECT doc_id, " + catalogue.MAKE_ID.format("path || text") + " FROM paths")
    made = catalogue.QUERIES["make_id_multilingual"](spark, SF).select("doc_id", "node_id").collect()
    assert sorted(map(tuple, made)) == sorted(want) and max(len(r["node_id"]) for r in made) > 1000


def test_walk_beyond_one_batch_is_whole(spark, monkeypatch):
    monkeypatch.setattr(traverse, "WALK_LINKS", 3)
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "calls", "EXTRACTED", 1.0) for i in range(9)] + [("n0", "m", "imports", "EXTRACTED", 1.0)], "source string, target string, relation string, confidence string, weight double")
    seen, links = traverse.depth_first(e, ["n0"])
    assert seen == ["n0", "n1", "n2", "n3", "n4", "m"] and ("n4", "n5", "calls", "EXTRACTED") in links


def gaining(label, pairs):
    """Nodes that would gain by a move to a neighbour's community, by brute force."""
    near, m = {v: [] for v in label}, len(pairs)
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    size = {}
    for v, c in label.items():
        size[c] = size.get(c, 0) + len(near[v])
    gain = lambda v, c: sum(label[u] == c for u in near[v]) - (size[c] - len(near[v]) * (label[v] == c)) * len(near[v]) / (2 * m)
    return [v for v in label if any(gain(v, label[u]) > gain(v, label[v]) + 1e-9 for u in near[v])]


def test_no_node_gains_after_rounds(spark):
    pairs = sorted({tuple(sorted((f"n{i:03}", f"n{(i * k + k) % 40:03}"))) for i in range(40) for k in (1, 7) if i != (i * k + k) % 40})
    e = spark.createDataFrame(pairs, "a string, b string")
    level, moved = cluster._level(e.selectExpr("'p' as part", "a", "b", "1.0D as w", f"{len(pairs)}.0D as total"), 1.0)
    assert moved and gaining({r["id"]: r["community"] for r in level.collect()}, pairs) == []


def test_paths_have_no_longest_length(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "calls", "EXTRACTED", 1.0) for i in range(66)], "source string, target string, relation string, confidence string, weight double")
    assert len(traverse.shortest_path(e, "n000", "n066")) == 66


def test_tiny_communities_merge_along_chains_of_any_length(spark):
    n = 45  # beyond any small number of rounds
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "calls", "EXTRACTED", 1.0) for i in range(n - 1)], "source string, target string, relation string, confidence string, weight double")
    alone = spark.createDataFrame([(f"n{i:03}", i) for i in range(n)] + [("far", n)], "id string, community long")
    made = {r["id"]: r["community"] for r in cluster.merge_tiny(alone, e).collect()}
    sizes = {c: list(made.values()).count(c) for c in made.values()}
    assert set(made) == {f"n{i:03}" for i in range(n)} | {"far"} and sizes[made["far"]] == 1
    assert all(sizes[made[f"n{i:03}"]] >= 3 for i in range(n))


def test_depth_first_is_the_plain_walk(spark):
    import random

    r = random.Random(4)
    links = sorted({(f"n{r.randrange(30):02}", f"n{r.randrange(30):02}", "calls") for _ in range(60)})
    e = spark.createDataFrame([(*x, "EXTRACTED", 1.0) for x in links], "source string, target string, relation string, confidence string, weight double")
    met, stack = [], [("n03", 0)]
    while stack:
        node, depth = stack.pop()
        if node in met or depth > 4:
            continue
        met.append(node)
        far = [t for s, t, _ in links if s == node] + [s for s, t, _ in links if t == node]
        stack += [(x, depth + 1) for x in far if x not in met]
    assert traverse.depth_first(e, ["n03"])[0] == met
