"""The driver's tables as a graph: as DataFrames for the engine and as SQL for the oracle.

Branches of the unions carry their type or relation as a literal, so a filter
on it prunes the other branches and their scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import last_by

VERBS = ("execute", "run", "handle", "create", "build", "make", "notify", "subscribe")
ORDER = ("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, type, file."""
    t = lambda n: read(spark, sf_dir, n)
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    sets = [
        t("region").select(_id("region", "r_regionkey"), "r_name", F.lit("module"), F.lit("")),
        nation.select(_id("nation", "n_nationkey"), "n_name", F.lit("class"), cat("lib/geo/", F.col("r_name"), "/", F.col("n_name"), ".py")),
        t("customer").select(_id("customer", "c_custkey"), "c_name", F.lit("class"), cat("app/crm/", F.col("c_mktsegment"), ".py")),
        t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(_id("supplier", "s_suppkey"), "s_name", F.lit("class"), cat("src/supply/", F.col("n_name"), ".py")),
        t("part").select(_id("part", "p_partkey"), cat(".", verb, "_", F.replace("p_name", F.lit(" "), F.lit("_")), "()"), F.lit("method"), cat("pkg/catalog/", F.col("p_brand"), ".py")),
        t("orders").select(_id("order", "o_orderkey"), cat(_id("order", "o_orderkey"), "()"), F.lit("function"), cat("sales/", F.lower(F.substring("o_orderpriority", 1, 1)), "/", F.col("o_orderstatus"), ".py")),
        t("part").select("p_type").distinct().select(cat("enum_", F.col("p_type")), "p_type", F.lit("enum"), F.lit("pkg/catalog/types.py")),
        t("part").select("p_type", "p_brand").distinct().select(cat("enumval_", F.col("p_type"), "_", F.col("p_brand")), cat(".", F.col("p_brand")), F.lit("enum_value"), F.lit("pkg/catalog/types.py")),
    ]
    return reduce(DataFrame.unionAll, [s.toDF("id", "label", "type", "file") for s in sets])


def _confidence() -> Column:
    return F.when(F.col("l_returnflag") == "A", "AMBIGUOUS").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("EXTRACTED")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-to-part calls as they are mentioned, one row a line item: source, target, relation, confidence, weight, ord."""
    return read(spark, sf_dir, "lineitem").select(_id("order", "l_orderkey").alias("source"), _id("part", "l_partkey").alias("target"), F.lit("calls").alias("relation"), _confidence().alias("confidence"), F.col("l_quantity").alias("weight"), F.struct(*ORDER).alias("ord"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation, confidence, weight; one row an ordered pair."""
    t = lambda n: read(spark, sf_dir, n)
    sure = (F.lit("EXTRACTED"), F.lit(1.0))
    state = F.when(F.col("o_orderstatus") == "P", "AMBIGUOUS").when(F.col("o_orderstatus") == "O", "INFERRED").otherwise("EXTRACTED")
    items = t("lineitem")
    # The merge runs on the tables' own numbers; ids are made of its result.
    calls = last_by(items.select("l_orderkey", "l_partkey", _confidence().alias("confidence"), "l_quantity", F.struct(*ORDER).alias("ord")), ["l_orderkey", "l_partkey"], ["confidence", "l_quantity"])
    sets = [
        t("nation").where("n_regionkey <> 0").select(_id("region", "n_regionkey"), _id("nation", "n_nationkey"), F.lit("contains"), *sure),
        t("customer").select(_id("customer", "c_custkey"), _id("nation", "c_nationkey"), F.lit("inherits"), *sure),
        t("supplier").select(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), F.lit("inherits"), *sure),
        items.select("l_suppkey", "l_partkey").distinct().select(_id("supplier", "l_suppkey"), _id("part", "l_partkey"), F.lit("method"), *sure),
        t("orders").select(_id("customer", "o_custkey"), _id("order", "o_orderkey"), F.lit("calls"), state, F.lit(1.0)),
        calls.select(_id("order", "l_orderkey"), _id("part", "l_partkey"), F.lit("calls"), "confidence", F.col("l_quantity")),
        items.select("l_orderkey", "l_suppkey").distinct().select(_id("order", "l_orderkey"), _id("supplier", "l_suppkey"), F.lit("imports"), *sure),
        t("part").select("p_type", "p_brand").distinct().select(F.concat(F.lit("enum_"), "p_type"), F.concat(F.lit("enumval_"), "p_type", F.lit("_"), "p_brand"), F.lit("case_of"), *sure),
    ]
    return reduce(DataFrame.unionAll, [s.toDF("source", "target", "relation", "confidence", "weight") for s in sets])


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target of all edges, as often as the tables mention them: for operators that make pairs distinct themselves."""
    t = lambda n: read(spark, sf_dir, n)
    order, part, supplier = _id("order", "l_orderkey"), _id("part", "l_partkey"), _id("supplier", "l_suppkey")
    pair = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    sets = [
        t("nation").where("n_regionkey <> 0").select(_id("region", "n_regionkey"), _id("nation", "n_nationkey")),
        t("customer").select(_id("customer", "c_custkey"), _id("nation", "c_nationkey")),
        t("supplier").select(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey")),
        t("orders").select(_id("customer", "o_custkey"), _id("order", "o_orderkey")),
        t("lineitem").select(F.explode(F.array(pair(supplier, part), pair(order, part), pair(order, supplier))).alias("e")).select("e.*"),
        t("part").select(F.concat(F.lit("enum_"), "p_type"), F.concat(F.lit("enumval_"), "p_type", F.lit("_"), "p_brand")),
    ]
    return reduce(DataFrame.unionAll, [s.toDF("source", "target") for s in sets])


_KEPT: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, kept by the session (in memory, else on disk): a graph is made once and asked many times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        for old in [k for k in _KEPT if k[0] != key[0]]:  # of a session that has ended
            del _KEPT[old]
        _KEPT[key] = nodes(spark, sf_dir).persist(), edges(spark, sf_dir).persist()
    return _KEPT[key]


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, text."""
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", "doc_id")


def sql(*wanted: str) -> str:
    """WITH clauses for the oracle: nodes, edges, mentions, paths, and those derived from them."""
    names = list(wanted)
    needs = {"und": ["edges"], "degree": ["und"], "ext": ["nodes", "edges"], "edges": ["mentions"], "cls": ["nodes", "ext"], "methods": ["nodes", "edges"], "inh": ["nodes", "edges"]}
    order: list[str] = []

    def add(n: str) -> None:
        for m in needs.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)


_VERB = "[" + ", ".join(f"'{v}'" for v in VERBS) + "]"
CTES = {
    "nodes": f"""
  SELECT 'region_' || r_regionkey AS id, r_name AS label, 'module' AS type, '' AS file FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'class', 'lib/geo/' || r_name || '/' || n_name || '.py' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer_' || c_custkey, c_name, 'class', 'app/crm/' || c_mktsegment || '.py' FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, s_name, 'class', 'src/supply/' || n_name || '.py' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part_' || p_partkey, '.' || ({_VERB})[CAST(p_partkey % 8 + 1 AS INTEGER)] || '_' || replace(p_name, ' ', '_') || '()', 'method', 'pkg/catalog/' || p_brand || '.py' FROM part
  UNION ALL SELECT 'order_' || o_orderkey, 'order_' || o_orderkey || '()', 'function', 'sales/' || lower(substr(o_orderpriority, 1, 1)) || '/' || o_orderstatus || '.py' FROM orders
  UNION ALL SELECT DISTINCT 'enum_' || p_type, p_type, 'enum', 'pkg/catalog/types.py' FROM part
  UNION ALL SELECT DISTINCT 'enumval_' || p_type || '_' || p_brand, '.' || p_brand, 'enum_value', 'pkg/catalog/types.py' FROM part""",
    "mentions": """
  SELECT 'order_' || l_orderkey AS source, 'part_' || l_partkey AS target,
         CASE l_returnflag WHEN 'A' THEN 'AMBIGUOUS' WHEN 'R' THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, l_quantity AS weight,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) AS age
  FROM lineitem""",
    "edges": """
  SELECT 'region_' || n_regionkey AS source, 'nation_' || n_nationkey AS target, 'contains' AS relation, 'EXTRACTED' AS confidence, CAST(1.0 AS DOUBLE) AS weight FROM nation WHERE n_regionkey <> 0
  UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'inherits', 'EXTRACTED', 1.0 FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'inherits', 'EXTRACTED', 1.0 FROM supplier
  UNION ALL SELECT DISTINCT 'supplier_' || l_suppkey, 'part_' || l_partkey, 'method', 'EXTRACTED', 1.0 FROM lineitem
  UNION ALL SELECT 'customer_' || o_custkey, 'order_' || o_orderkey, 'calls', CASE o_orderstatus WHEN 'P' THEN 'AMBIGUOUS' WHEN 'O' THEN 'INFERRED' ELSE 'EXTRACTED' END, 1.0 FROM orders
  UNION ALL SELECT source, target, 'calls', confidence, weight FROM mentions WHERE age = 1
  UNION ALL SELECT DISTINCT 'order_' || l_orderkey, 'supplier_' || l_suppkey, 'imports', 'EXTRACTED', 1.0 FROM lineitem
  UNION ALL SELECT DISTINCT 'enum_' || p_type, 'enumval_' || p_type || '_' || p_brand, 'case_of', 'EXTRACTED', 1.0 FROM part""",
    "paths": "SELECT 'docs/' || source || '/' || lang || '/' || doc_id || '.md' AS path, text, doc_id FROM documents",
    "und": "SELECT source AS id, target AS other FROM edges UNION SELECT target, source FROM edges",
    "degree": "SELECT id, CAST(count(*) AS BIGINT) AS degree FROM und GROUP BY id",
    "ext": """
  SELECT n.id FROM nodes n JOIN edges e ON e.target = n.id
  WHERE n.type = 'class' AND n.id NOT IN (SELECT source FROM edges)
  GROUP BY n.id HAVING bool_and(e.relation = 'inherits')""",
    "cls": "SELECT id, label, file FROM nodes WHERE type = 'class' AND id NOT IN (SELECT id FROM ext)",
    "methods": "SELECT e.source AS id, n.label, lower(regexp_replace(regexp_replace(n.label, '^\\.', ''), '\\(\\)$', '')) AS name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.relation = 'method'",
    "inh": "SELECT e.target AS id, e.source AS child, n.label FROM edges e JOIN nodes n ON n.id = e.source WHERE e.relation = 'inherits'",
}
