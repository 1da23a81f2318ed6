"""Queries of scans, JSON records, validation, paths, patterns, communities' invariants and small tools, with their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..operators import cluster, graph, patterns, report, traverse, validate
from ..sources import files, records
from . import catalogue as c
from . import projection as p

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, needs: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = (p.sql(*needs) + "\n" if needs else "") + oracle
        return f

    return add


def _text(column) -> F.Column:
    return F.col(column).cast("string")


# Scans

PLACES = ("", ".hid/", "a/node_modules/", "linked/x/", "skip/", "b/.c/", "node_modules2/", "skipper/", "Build/")
PATTERNS, LINKS = ("skip", "*.tar.gz"), ("linked",)
PLACE = "([" + ", ".join(f"'{x}'" for x in PLACES) + f"])[CAST(doc_id % {len(PLACES)} + 1 AS INTEGER)]"
SCANNED = f"(SELECT s.doc_id, s.text, {PLACE.replace('doc_id', 's.doc_id')} || CASE WHEN s.doc_id % 13 = 0 THEN 'id_rsa' ELSE m.path END AS path FROM {c.SIGNED} s JOIN {c.MADE_PATHS} m ON m.doc_id = s.doc_id)"
DIRS = "string_split(path, '/')[1:len(string_split(path, '/')) - 1]"
SKIPPED = f"""CASE WHEN starts_with(path, '.') OR contains(path, '/.') THEN 'hidden' WHEN list_has_any({DIRS}, [{", ".join(f"'{x}'" for x in fixed.NOISE_DIRS)}]) THEN 'noise'
  WHEN path = 'linked' OR starts_with(path, 'linked/') THEN 'link' WHEN ends_with(path, '.tar.gz') OR starts_with(path, 'skip/') THEN 'ignored'
  WHEN {" OR ".join(f"regexp_extract(path, '[^/]*$') GLOB '{g}'" for g in fixed.SENSITIVE_NAMES)} THEN 'sensitive' WHEN kind IS NULL THEN 'unknown' END"""


@query(
    f"""WITH made AS (SELECT *, {c._kinds("path", f"({c.PAPER}) >= {fixed.PAPER_HITS}")} AS kind, {c.WORDS} AS w FROM (SELECT *, CASE WHEN strlen(text) = length(text) THEN left(text, {fixed.PAPER_BYTES}) ELSE text END AS head FROM {SCANNED.replace("FROM paths)", f"FROM ({p.CTES['paths']}))")})),
told AS (SELECT *, {SKIPPED} AS skipped FROM made)
SELECT doc_id, path, skipped, CASE WHEN skipped IS NULL THEN kind END AS file_type, CAST(CASE WHEN skipped IS NULL AND kind NOT IN ('video', 'image') THEN w ELSE 0 END AS BIGINT) AS words FROM told"""
)
def scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files, some in hidden, noisy, linked or ignored places: what is kept, as what, and why others are not."""
    place = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("doc_id") % len(PLACES) + 1).cast("int"))
    own = c._signed(spark, d).select("doc_id", "text").join(c._made_paths(spark, d), "doc_id")
    path = F.concat(place, F.when(F.col("doc_id") % 13 == 0, "id_rsa").otherwise(F.col("path")))
    made = files.classified(own.select("doc_id", path.alias("path"), F.col("text").cast("binary").alias("content")), list(PATTERNS), links=list(LINKS))
    return made.select("doc_id", "path", "skipped", "file_type", "words")


# JSON records: each supplier's record mentions it, its nation, and things that are no nodes or edges

RECORD = ("""{"nodes": [{"id": "supplier_§", "label": "L§", "type": "class", "source_file": "a/§.py"}, {"id": "nation_¤", "label": "seen by §"}, "junk", {"label": "none"}, 7], """
          """"edges": [{"source": "supplier_§", "target": "nation_¤", "relation": "inherits", "confidence": "EXTRACTED", "weight": 2.5}, {"source": "nation_¤", "target": "hub", "relation": "r§"}, {"target": "x"}, "y"]}""")  # fmt: skip


def _filled(text: str):
    return F.replace(F.replace(F.lit(text), F.lit("§"), _text("s_suppkey")), F.lit("¤"), _text("s_nationkey"))


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return records.from_records(p.read(spark, d, "supplier").select(F.col("s_suppkey").alias("record_id"), _filled(RECORD).alias("record")))


@query("SELECT 'supplier_' || s_suppkey AS id, 'L' || s_suppkey AS label, 'class' AS type, 'a/' || s_suppkey || '.py' AS file FROM supplier UNION ALL SELECT 'nation_' || s_nationkey, 'seen by ' || max(s_suppkey), '', '' FROM supplier GROUP BY s_nationkey")
def record_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)[0].select("id", "label", "type", "file")


@query("SELECT 'supplier_' || s_suppkey AS source, 'nation_' || s_nationkey AS target, 'inherits' AS relation, 'EXTRACTED' AS confidence, CAST(2.5 AS DOUBLE) AS weight FROM supplier UNION ALL SELECT 'nation_' || s_nationkey, 'hub', 'r' || max(s_suppkey), '', 1.0 FROM supplier GROUP BY s_nationkey")
def record_edges(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)[1].select("source", "target", "relation", "confidence", "weight")


# Validation: records by the remainder of the supplier's key, and the faults each must show

FAULTY = (
    '{"other": []}',
    '{"nodes": {"id": "a"}, "edges": 5}',
    '{"nodes": ["x", {"id": "a§"}, 3], "edges": [[]]}',
    '{"nodes": [{"id": "a§", "label": "l", "file_type": "code", "source_file": "f"}], "edges": [{"source": "a§", "target": "b§", "relation": "calls", "confidence": "GUESSED", "source_file": "f"}, {"source": "z§", "target": "a§"}]}',
    '{"nodes": [{"id": "a§", "label": "l", "file_type": "code", "source_file": "f", "more": 1}, {"id": "b§", "label": "m", "file_type": "paper", "source_file": "f"}], "edges": [{"source": "a§", "target": "b§", "relation": "calls", "confidence": "INFERRED", "source_file": "f"}]}',
    '{"nodes": [{"id": "a§", "label": "l", "file_type": "video", "source_file": "f"}, {"label": "l", "file_type": "code", "source_file": "f"}], "edges": []}',
)
FAULTS = (
    [("nodes", -1, "Missing required key 'nodes'"), ("edges", -1, "Missing required key 'edges'")],
    [("nodes", -1, "'nodes' must be a list"), ("edges", -1, "'edges' must be a list")],
    [("nodes", 0, "Node 0 must be an object"), ("nodes", 2, "Node 2 must be an object"), ("edges", 0, "Edge 0 must be an object"), *[("nodes", 1, f'Node 1 (id="a§") missing required field \'{f}\'') for f in ("label", "file_type", "source_file")]],
    [("edges", 0, "Edge 0 has invalid confidence 'GUESSED'"), ("edges", 0, "Edge 0 target 'b§' does not match any node id"), ("edges", 1, "Edge 1 source 'z§' does not match any node id"), *[("edges", 1, f"Edge 1 missing required field '{f}'") for f in ("relation", "confidence", "source_file")]],
    [],
    [("nodes", 0, "Node 0 (id=\"a§\") has invalid file_type 'video'"), ("nodes", 1, "Node 1 (id=\"?\") missing required field 'id'")],
)
FAULT_ROWS = ", ".join("({}, '{}', {}, '{}')".format(k, part, index, error.replace("'", "''")) for k, rows in enumerate(FAULTS) for part, index, error in rows)


@query(f"SELECT s_suppkey AS record_id, part, index, replace(error, '§', CAST(s_suppkey AS VARCHAR)) AS error FROM supplier JOIN (VALUES {FAULT_ROWS}) AS v(k, part, index, error) ON s_suppkey % {len(FAULTY)} = k")
def validate_json(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, FAULTY)), (F.col("s_suppkey") % len(FAULTY) + 1).cast("int"))
    return validate.errors(p.read(spark, d, "supplier").select(F.col("s_suppkey").alias("record_id"), F.replace(text, F.lit("§"), _text("s_suppkey")).alias("record")))


# Paths

WALK = ", ".join(
    ["s0 AS MATERIALIZED (SELECT 'customer_1' AS id)", "t0 AS (SELECT id FROM s0)"]
    + [f"s{k} AS MATERIALIZED (SELECT DISTINCT other AS id FROM und WHERE id IN (SELECT id FROM s{k - 1}) AND other NOT IN (SELECT id FROM t{k - 1})), t{k} AS MATERIALIZED (SELECT id FROM t{k - 1} UNION ALL SELECT id FROM s{k})" for k in range(1, 6)]
    + ["lev AS (" + " UNION ALL ".join(f"SELECT id, {k} AS level FROM s{k}" for k in range(6)) + ")"]
)


@query(
    f""", {WALK}, links AS (SELECT target AS id, source AS parent, relation, confidence, TRUE AS forward FROM edges UNION ALL SELECT source, target, relation, confidence, FALSE FROM edges),
best AS MATERIALIZED (SELECT x.id, x.level, k.parent, k.relation, k.confidence, k.forward, row_number() OVER (PARTITION BY x.id ORDER BY NOT k.forward, k.parent, k.relation, k.confidence) AS r
  FROM lev x JOIN links k ON k.id = x.id JOIN lev y ON y.id = k.parent AND y.level = x.level - 1),
back AS (SELECT id, level, parent, relation, confidence, forward FROM best WHERE id = 'part_5' AND r = 1 UNION ALL SELECT b.id, b.level, b.parent, b.relation, b.confidence, b.forward FROM back JOIN best b ON b.id = back.parent AND b.r = 1)
SELECT level AS step, parent AS "from", id AS "to", relation, confidence, forward, CASE WHEN forward THEN '--' || relation || '-->' ELSE '<--' || relation || '--' END AS arrow FROM back""",
    ("und",),
)
def shortest_path_steps(spark: SparkSession, d: str) -> DataFrame:
    """The path itself: its nodes in order, relations, and which way each link points."""
    steps = traverse.shortest_path(p.graph(spark, d)[1], "customer_1", "part_5") or []
    rows = [(k, s["from"], s["to"], s["relation"], s["confidence"], s["forward"], f"--{s['relation']}-->" if s["forward"] else f"<--{s['relation']}--") for k, s in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "step int, from string, to string, relation string, confidence string, forward boolean, arrow string")


@query("SELECT id, label, type, file FROM nodes WHERE id IN ('nation_8', 'customer_1', 'nowhere')", ("nodes",))
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    return p.graph(spark, d)[0].where(F.col("id").isin("nation_8", "customer_1", "nowhere"))


# Patterns on classes that share interfaces: four methods a group of suppliers, one more for those with an even key

GROUP = "'m' || (s_suppkey % 3) || '_'"
METHODS = ", ".join(f"{GROUP} || {j}" for j in range(4))


def _implementers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = p.read(spark, d, "supplier").select(_text("s_suppkey").alias("k"), "s_suppkey")
    group = F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string"), F.lit("_"))
    names = F.array(*[F.concat(group, F.lit(str(j))) for j in range(4)], *[F.when(F.col("s_suppkey") % 2 == 0, F.concat(group, F.lit("even")))])
    has = s.select(F.concat(F.lit("c"), "k").alias("owner"), F.explode(F.filter(names, lambda x: x.isNotNull())).alias("name"))
    method = F.concat("owner", F.lit("_"), "name")
    nodes = s.select(F.concat(F.lit("c"), "k").alias("id"), F.concat(F.lit("C"), "k").alias("label"), F.lit("class").alias("type"), F.concat(F.lit("src/"), "k", F.lit(".py")).alias("file"))
    nodes = nodes.unionAll(has.select(method, F.concat(F.lit("."), "name", F.lit("()")), F.lit("method"), F.lit("src/x.py")))
    edges = has.select(F.col("owner").alias("source"), method.alias("target"), F.lit("method").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"))
    return nodes, edges


# A pair of even keys shares five names, any other pair of a group four.
GROUPS = f"""WITH own AS (SELECT s_suppkey AS k, s_suppkey % 3 AS g, s_suppkey % 2 = 0 AS even FROM supplier), n AS (SELECT g, count(*) AS n, count(*) FILTER (even) AS evens FROM own GROUP BY g),
groups AS (SELECT 'm' || g || '_0,m' || g || '_1,m' || g || '_2,m' || g || '_3' AS names, k FROM own JOIN n USING (g) WHERE n.n >= 2 AND n.evens < n.n
  UNION ALL SELECT 'm' || g || '_0,m' || g || '_1,m' || g || '_2,m' || g || '_3,m' || g || '_even', k FROM own JOIN n USING (g) WHERE even AND n.evens >= 2),
sized AS (SELECT names, string_agg('C' || k, ',' ORDER BY 'C' || k) AS classes, min('c' || k) AS anchor_id, CAST(count(*) AS BIGINT) AS size FROM groups GROUP BY names HAVING count(*) >= 3)"""


@query(f"{GROUPS} SELECT names, classes, anchor_id, size, 'src/' || substr(anchor_id, 2) || '.py' AS file FROM sized")
def strategy_groups(spark: SparkSession, d: str) -> DataFrame:
    made = patterns.strategy_groups(*_implementers(spark, d))
    return made.select("names", F.array_join("classes", ",").alias("classes"), "anchor_id", "size", "file")


@query(f"{GROUPS} SELECT 'Strategy' AS name, anchor_id, split_part(classes, ',', 1) AS anchor_node, size AS participants FROM sized WHERE NOT contains(names, 'even') OR replace(names, ',' || split_part(names, ',', 5), '') NOT IN (SELECT names FROM sized)")
def strategy_pattern(spark: SparkSession, d: str) -> DataFrame:
    """The greedy choice: of a group and one inside it, only the larger."""
    return patterns.strategy(*_implementers(spark, d)).select("name", "anchor_id", "anchor_node", "participants")


@query(f"{GROUPS}, chosen AS (SELECT * FROM sized WHERE NOT contains(names, 'even') OR replace(names, ',' || split_part(names, ',', 5), '') NOT IN (SELECT names FROM sized)) SELECT 'Strategy' AS name, anchor_id, size AS participants FROM chosen")
def all_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Every detector over classes of which only interfaces can be said."""
    return patterns.all_patterns(*_implementers(spark, d)).select("name", "anchor_id", "participants")


# Communities found, by what must hold of them

@query(
    """
SELECT CAST((SELECT count(*) FROM nodes) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM nodes) AS BIGINT) AS ids, TRUE AS numbered_by_size, TRUE AS no_worse_than_by_nation, TRUE AS inside_components, TRUE AS tiny_have_no_neighbours""",
    ("nodes", "edges"),
)
def community_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of the communities of the whole graph: every node once, numbered by falling size, modularity at least that of the nations (whatever
    has none by itself), none across components, and after merging, none of fewer than three members with a neighbour outside."""
    n, e = p.nodes(spark, d), p.ties(spark, d)
    found = c.cut_lineage(cluster.louvain(n, e))
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.select(F.col("community").alias("a"), F.col("n").alias("na")).join(sizes.select((F.col("community") - 1).alias("a"), F.col("n").alias("nb")), "a")
    falling = pairs.agg(F.coalesce(F.bool_and(F.col("na") >= F.col("nb")), F.lit(True)).alias("numbered_by_size"))
    given = n.select("id").join(c._by_nation(spark, d), "id", "left").select("id", F.coalesce(_text("community"), "id").alias("community"))
    better = cluster.modularity(found, e).select(F.col("modularity").alias("q")).join(cluster.modularity(given, e)).select((F.col("q") >= F.col("modularity")).alias("no_worse_than_by_nation"))
    whole = cluster.components(n.select("id"), e.toDF("a", "b"))
    across = found.join(whole, "id").groupBy("community").agg(F.min("component").alias("x"), F.max("component").alias("y")).agg(F.coalesce(F.bool_and(F.col("x") == F.col("y")), F.lit(True)).alias("inside_components"))
    merged = c.cut_lineage(cluster.merge_tiny(found, e))
    small = merged.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n < 3").select("community")
    out = cluster.neighbours(merged, e).select(F.explode(F.array("a", "b")).alias("community")).join(small, "community", "left_semi")
    alone = out.agg((F.count(F.lit(1)) == 0).alias("tiny_have_no_neighbours"))
    counted = found.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("id").alias("ids"))
    return reduce(lambda a, b: a.join(b), [falling, better, across, alone], counted).select("nodes", "ids", "numbered_by_size", "no_worse_than_by_nation", "inside_components", "tiny_have_no_neighbours")


# Small tools

@query("""SELECT page_id, CASE WHEN name = '' THEN 'unnamed' ELSE name END AS name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(raw, '[\\[\\]\\\\/*?:"<>|#^]', '', 'g'), '\\r\\n|\\r|\\n', ' ', 'g'), '\\.(md|mdx|markdown)$', '')) AS name
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'a' || chr(10) || 'b: ' || page_id || '?.md' WHEN 2 THEN '<' || page_id || '>|^#.markdown' ELSE '[*?]' END AS raw FROM pages))""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """Names for files, from addresses, titles of several lines, and marks only."""
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("a\nb: "), _text("page_id"), F.lit("?.md"))).when(k == 2, F.concat(F.lit("<"), _text("page_id"), F.lit(">|^#.markdown"))).otherwise("[*?]")
    return p.read(spark, d, "pages").select("page_id", exprs.safe_name(raw).alias("name"))


@query(f"SELECT s.n AS size, CAST(count(*) AS BIGINT) AS communities FROM (WITH {c.BY_NATION} SELECT CAST(count(*) AS BIGINT) AS n FROM mem GROUP BY community) s GROUP BY s.n ORDER BY s.n DESC")
def sizes_falling(spark: SparkSession, d: str) -> DataFrame:
    sizes = c._by_nation(spark, d).groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("communities")).orderBy(F.desc("size"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS line, CASE WHEN n_nationkey = (SELECT max(n_nationkey) FROM nation) AND (SELECT count(*) FROM nation) <= 10 THEN '└── ' ELSE '├── ' END || n_name || CASE WHEN n_nationkey % 3 > 0 THEN ' (' || (n_nationkey % 3) || ' methods)' ELSE '' END AS text FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10) UNION ALL SELECT 10, '└── ... (+' || (count(*) - 10) || ' more)' FROM nation HAVING count(*) > 10")
def tree_text(spark: SparkSession, d: str) -> DataFrame:
    """The lines under a root with the nations as children."""
    rows = p.read(spark, d, "nation").orderBy("n_nationkey").limit(1000).collect()
    lines = report.tree_lines({"root": "root", "children": [{"label": r["n_name"], "method_count": r["n_nationkey"] % 3, "children": []} for r in rows]})
    return spark.createDataFrame(list(enumerate(lines[1:])), "line int, text string")


@query("SELECT e.relation, CAST(count(*) AS BIGINT) AS n FROM edges e GROUP BY e.relation", ("edges",))
def edge_scan(spark: SparkSession, d: str) -> DataFrame:
    """All edges, counted by relation."""
    return p.graph(spark, d)[1].groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'f' || page_id AS path, sha256(html) AS hash, 'page_' || page_id AS id FROM pages WHERE page_id % 2 = 0")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files, of which those with an even id have been extracted before: what the probe gives back."""
    own = p.read(spark, d, "pages").select(F.concat(F.lit("f"), _text("page_id")).alias("path"), F.sha2(F.col("html").cast("binary"), 256).alias("hash"), "page_id")
    known = own.where("page_id % 2 = 0").select("path", "hash", F.concat(F.lit("page_"), _text("page_id")).alias("id"))
    hit, _ = files.probe(own.select("path", "hash"), known)
    return known.join(hit, ["path", "hash"], "left_semi").select("path", "hash", "id")


__all__ = ["ORACLES", "QUERIES", "graph"]
