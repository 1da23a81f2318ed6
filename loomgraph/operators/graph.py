"""Building a graph from mentions, and reading it.

Nodes are id, label, type, file; edges source, target, relation, confidence,
weight.  Missing strings are empty, never null.  An edge's ends need not be
nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by(mentions: DataFrame, keys: list[str], value: list[str]) -> DataFrame:
    """One row for each combination of keys: the values of its last mention (by ord, then by those). Combines before the shuffle."""
    last = mentions.groupBy(*keys).agg(F.max(F.struct(F.col("ord"), F.struct(*value).alias("value"))).alias("last"))
    return last.select(*keys, *[F.col(f"last.value.{v}") for v in value])


def last_nodes(mentions: DataFrame) -> DataFrame:
    """One row an id: the label, type and file of its last mention."""
    return last_by(mentions, ["id"], ["label", "type", "file"])


def last_edges(mentions: DataFrame) -> DataFrame:
    """One row an ordered pair: the relation, confidence and weight of its last mention."""
    return last_by(mentions, ["source", "target"], ["relation", "confidence", "weight"])


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_count and edge_count."""
    n = nodes.select(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    e = edges.select(F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("e"))
    return n.unionAll(e).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"))


def both_ways(edges: DataFrame) -> DataFrame:
    """id, other: each edge from either end, with multiplicity."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"))))
    return edges.select(ends.alias("e")).select("e.id", "e.other")


def undirected(edges: DataFrame) -> DataFrame:
    """a, b: distinct pairs with a <= b, loops included."""
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    one, two = F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))
    return pairs.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, two))).alias("e")).select("e.id", "e.other")


def neighbours(edges: DataFrame) -> DataFrame:
    """id, other: distinct, both ways; a self-loop makes a node its own neighbour.

    Pairs are made distinct before they are doubled, so half as many rows are
    shuffled.
    """
    return _ends(undirected(edges))


def degree(edges: DataFrame) -> DataFrame:
    """id, degree: number of distinct neighbours."""
    return neighbours(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def raw_degree(edges: DataFrame) -> DataFrame:
    """id, degree: number of edge ends; a self-loop counts twice."""
    return both_ways(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def lookup(edges: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The edges between given ordered pairs."""
    from functools import reduce

    return edges.where(reduce(lambda a, b: a | b, [(F.col("source") == s) & (F.col("target") == t) for s, t in pairs], F.lit(False)))


def external_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of classes that have incoming edges, all of them inherits, and no outgoing ones."""
    into = edges.groupBy("target").agg(F.bool_and(F.col("relation") == "inherits").alias("pure")).where("pure").select(F.col("target").alias("id"))
    classes = nodes.where("type = 'class'").select("id")
    return classes.join(into, "id", "left_semi").join(edges.select(F.col("source").alias("id")), "id", "left_anti")


def project_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes that aren't external."""
    return nodes.where("type = 'class'").join(external_types(nodes, edges), "id", "left_anti")


def with_end(edges: DataFrame, nodes: DataFrame, end: str, how: str = "inner") -> DataFrame:
    """edges with {end}_label, {end}_type and {end}_file."""
    side = nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"), F.col("type").alias(f"{end}_type"), F.col("file").alias(f"{end}_file"))
    return edges.join(side, end, how)


def infer_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with types filled in where empty, from the edges of their file.

    nodes: scope, id, label, type, file; edges: scope, source, target,
    relation, ord.  Of `method` and `case_of` the later one counts and beats
    everything; else the first of `inherits` and `imports`; else the label.
    """
    from ..functions import exprs

    strong = F.when(F.col("relation") == "method", "method").when(F.col("relation") == "case_of", "enum_value")
    weak = F.when(F.col("relation") == "inherits", "class").when(F.col("relation") == "imports", "module")
    hints = edges.where("relation in ('method', 'case_of', 'inherits', 'imports')").groupBy("scope", F.col("target").alias("id")).agg(
        F.max_by(strong, F.when(strong.isNotNull(), F.col("ord"))).alias("strong"), F.min_by(weak, F.when(weak.isNotNull(), F.col("ord"))).alias("weak")
    )
    label = F.col("label")
    guess = (
        F.when(label == exprs.basename(F.col("file")), "file")
        .when(F.startswith(label, F.lit(".")) & F.endswith(label, F.lit("()")), "method")
        .when(F.endswith(label, F.lit("()")), "function")
        .when(label.rlike("^[A-Z]"), "class")
        .otherwise("")
    )
    kind = F.when(F.col("type") != "", F.col("type")).otherwise(F.coalesce("strong", "weak", guess))
    return nodes.join(hints, ["scope", "id"], "left").select("scope", "id", "label", kind.alias("type"), "file")


def resolve_calls(labels: DataFrame, calls: DataFrame) -> DataFrame:
    """scope, source, target of calls whose callee names a node of the same file.

    labels: scope, id, label, seq; calls: scope, caller, callee (names as
    written, any case).  A node is known by its label in lower case without dot
    and parentheses, and by what follows a colon there; the last of equal names
    counts.  Self-calls stay.
    """
    from ..functions import exprs

    plain = F.lower(exprs.method_name(F.col("label")))
    names = F.explode(F.array_distinct(F.when(F.contains(plain, F.lit(":")), F.array(plain, F.substring_index(plain, ":", -1))).otherwise(F.array(plain))))
    known = labels.select("scope", "id", "seq", names.alias("name")).groupBy("scope", "name").agg(F.max_by("id", F.struct("seq", "id")).alias("target"))
    wanted = calls.select("scope", F.col("caller").alias("source"), F.lower("callee").alias("name")).distinct()
    return wanted.join(known, ["scope", "name"]).select("scope", "source", "target").distinct()
