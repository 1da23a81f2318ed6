"""What a graph says about its project: central nodes, surprising links, hierarchies, files and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from . import graph as g


def ranked(df: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """df's first n rows in an order given by column names, those with a minus falling."""
    out = df.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in by])
    return out if n is None else out.limit(n)


def god_nodes(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes with most neighbours that are no files, concepts or external types: id, label, degree, file."""
    plain = nodes.where(~exprs.is_file_node(F.col("label"), F.col("type"), F.col("file")) & ~exprs.is_concept(F.col("type"), F.col("file")))
    # External types are few; only the few best candidates need the test, but which these are is known after it.
    own = plain.join(g.external_types(nodes, edges), "id", "left_anti").join(g.degree(edges), "id", "left")
    return ranked(own.select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"), "file"), ["-degree", "id"], n)


def god_node_details(gods: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """gods with parent_class (first by label), method_count, inheritor_count and inheritor_names (sorted)."""
    ids = gods.select("id")
    out = edges.where("relation in ('inherits', 'method')").join(F.broadcast(ids.withColumnRenamed("id", "source")), "source", "left_semi")
    out = g.with_end(out, nodes, "target", "left").groupBy(F.col("source").alias("id")).agg(F.min(F.when(F.col("relation") == "inherits", F.col("target_label"))).alias("parent_class"), F.count_if(F.col("relation") == "method").alias("method_count"))
    into = edges.where("relation = 'inherits'").join(F.broadcast(ids.withColumnRenamed("id", "target")), "target", "left_semi")
    into = g.with_end(into, nodes, "source").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("inheritor_count"), F.array_sort(F.collect_list("source_label")).alias("inheritor_names"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return gods.join(out, "id", "left").join(into, "id", "left").select("id", "label", "degree", "file", F.coalesce("parent_class", F.lit("")).alias("parent_class"), zero("method_count"), zero("inheritor_count"), F.coalesce("inheritor_names", F.array().cast("array<string>")).alias("inheritor_names"))


def inheritance_trees(gods: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """The n largest hierarchies under gods with three inheritors or more: root, root_file, depth, children (label, file, method_count, children)."""
    inherits = edges.where("relation = 'inherits'").select(F.col("source").alias("child"), F.col("target").alias("parent"))
    kids = inherits.join(F.broadcast(gods.select(F.col("id").alias("parent"), F.col("label").alias("root"), F.col("file").alias("root_file"))), "parent")
    methods = edges.where("relation = 'method'").groupBy(F.col("source").alias("child")).agg(F.count(F.lit(1)).alias("method_count"))
    names = nodes.select(F.col("id").alias("child"), "label", "file")
    grand = inherits.join(names.select("child", "label"), "child").groupBy(F.col("parent").alias("child")).agg(F.array_sort(F.collect_list("label")).alias("children"))
    full = kids.join(names, "child").join(methods, "child", "left").join(grand, "child", "left")
    child = F.struct((-F.coalesce(F.size("children"), F.lit(0))).alias("order"), "label", "file", F.coalesce("method_count", F.lit(0)).alias("method_count"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    trees = full.groupBy("parent", "root", "root_file").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(child)).alias("kids")).where("size >= 3")
    drop_order = F.transform("kids", lambda k: F.struct(k["label"].alias("label"), k["file"].alias("file"), k["method_count"].alias("method_count"), k["children"].alias("children")))
    depth = F.when(F.exists("kids", lambda k: F.size(k["children"]) > 0), 2).otherwise(1)
    return ranked(trees.select("parent", "root", "root_file", "size", depth.alias("depth"), drop_order.alias("children")), ["-size", "parent"], n)


def surprise_candidates(nodes: DataFrame, edges: DataFrame, hub: int = 5) -> DataFrame:
    """Edges that could surprise, with both ends' label and file and degree."""
    degree = g.degree(edges)
    plain = nodes.where(~exprs.is_file_node(F.col("label"), F.col("type"), F.col("file")) & ~exprs.is_concept(F.col("type"), F.col("file"))).join(g.external_types(nodes, edges), "id", "left_anti")
    side = lambda end: plain.join(degree, "id", "left").select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"), F.col("file").alias(f"{end}_file"), F.coalesce("degree", F.lit(0)).alias(f"{end}_degree"))
    free = edges.where(~F.col("relation").isin(*fixed.STRUCTURAL))
    both = free.join(side("source"), "source").join(side("target"), "target")
    return both.where((F.col("source_file") != F.col("target_file")) & ((F.col("relation") != "inherits") | (F.col("target_degree") <= hub)))


def surprise(candidates: DataFrame) -> DataFrame:
    """candidates with score and why; source_community and target_community are theirs or null."""
    confidence, relation = F.col("confidence"), F.col("relation")
    a, b = exprs.file_category(F.col("source_file")), exprs.file_category(F.col("target_file"))
    low, high = F.least("source_degree", "target_degree"), F.greatest("source_degree", "target_degree")
    far = ~F.col("source_community").eqNullSafe(F.col("target_community"))
    tests: list[tuple[Column, int, Column | str]] = [
        (relation == "calls", 2, "runtime call dependency"),
        (a != b, 2, F.concat(F.lit("crosses file types ("), a, F.lit(" <-> "), b, F.lit(")"))),
        (exprs.top_level_dir(F.col("source_file")) != exprs.top_level_dir(F.col("target_file")), 2, "connects across different repos/directories"),
        (far, 1, "bridges separate communities"),
        ((low <= 2) & (high >= 5), 1, "peripheral node reaches hub"),
    ]
    score = F.when(confidence == "AMBIGUOUS", 3).when(confidence == "INFERRED", 2).when(confidence == "EXTRACTED", 1).otherwise(0)
    reasons = [F.when(confidence.isin("AMBIGUOUS", "INFERRED"), F.concat(confidence, F.lit(" connection - not explicitly stated in source")))]
    for test, points, reason in tests:
        score = score + F.when(test, points).otherwise(0)
        reasons.append(F.when(test, F.lit(reason) if isinstance(reason, str) else reason))
    return candidates.withColumns({"score": score.cast("long"), "why": F.concat_ws("; ", *reasons)})


def with_communities(candidates: DataFrame, membership: DataFrame) -> DataFrame:
    """candidates with the communities of both ends; membership: id, community."""
    for end in ("source", "target"):
        candidates = candidates.join(membership.select(F.col("id").alias(end), F.col("community").alias(f"{end}_community")), end, "left")
    return candidates


def surprising(scored: DataFrame, n: int = 10, each: int = 2) -> list[dict]:
    """The n most surprising links, on the driver: no pair of labels twice, at most each a target and relation.

    The walk is in order of score and stops at n.  What it has to see is
    bounded by taking, of each pair and of each target and relation, only the
    rows that could still be chosen.
    """
    seen: set[tuple] = set()
    used: dict[tuple, int] = {}
    out: list[dict] = []
    order = [F.desc("score"), "source", "target"]
    for row in scored.orderBy(*order).toLocalIterator():
        key = tuple(sorted((row["source_label"], row["target_label"])))
        what = (row["target_label"], row["relation"])
        if key in seen or used.get(what, 0) >= each:
            continue
        seen.add(key)
        used[what] = used.get(what, 0) + 1
        out.append(row.asDict())
        if len(out) == n:
            break
    return out


def surprising_top(scored: DataFrame, n: int = 10, each: int = 2) -> DataFrame:
    """The same by two windows, as a DataFrame.

    Differs from surprising() only if a pair's best row falls to the limit of
    its target while its reverse, with another target, would not.
    """
    order = [F.desc("score"), "source", "target"]
    pair = Window.partitionBy(F.least("source_label", "target_label"), F.greatest("source_label", "target_label")).orderBy(*order)
    once = scored.withColumn("r", F.row_number().over(pair)).where("r = 1")
    few = once.withColumn("r", F.row_number().over(Window.partitionBy("target_label", "relation").orderBy(*order))).where(F.col("r") <= each)
    return few.orderBy(*order).limit(n).select("source", "target", "source_label", "target_label", "source_file", "target_file", "relation", "confidence", "score", "why")


def enums(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Enums of three cases or more: id, label, file, case_count, cases (sorted)."""
    cases = edges.where("relation = 'case_of'").select(F.col("source").alias("id"), "target")
    cases = cases.join(nodes.select(F.col("id").alias("target"), F.col("label").alias("case")), "target")
    grouped = cases.groupBy("id").agg(F.count(F.lit(1)).alias("case_count"), F.array_sort(F.collect_list("case")).alias("cases")).where(F.col("case_count") >= least)
    return ranked(nodes.where("type = 'enum'").select("id", "label", "file").join(grouped, "id"), ["-case_count", "id"])


def key_files(nodes: DataFrame, edges: DataFrame, n: int = 8, least: int = 10, all_languages: bool = False) -> DataFrame:
    """Files whose nodes have most edges: path, total_degree, node_count, class_count, method_count, class_names (sorted)."""
    own = nodes.where(F.col("file") != "")
    if not all_languages:
        own = own.where(~exprs.is_non_source(F.col("file")))
    classy = F.col("type").isin("class", "mixin", "extension")
    files = own.join(g.raw_degree(edges), "id", "left").groupBy(F.col("file").alias("path")).agg(
        F.coalesce(F.sum("degree"), F.lit(0)).alias("total_degree"), F.count(F.lit(1)).alias("node_count"), F.count_if(classy).alias("class_count"),
        F.count_if(F.col("type") == "method").alias("method_count"), F.array_sort(F.collect_list(F.when(classy, F.col("label")))).alias("class_names"),
    )
    return ranked(files.where(F.col("total_degree") >= least), ["-total_degree", "path"], n)


def runtime_deps(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Calls between source files: from_file, to_file, count."""
    files = nodes.where((F.col("file") != "") & ~exprs.is_non_source(F.col("file"))).select("id", "file")
    calls = edges.where("relation = 'calls'").select("source", "target")
    both = calls.join(files.select(F.col("id").alias("source"), F.col("file").alias("from_file")), "source").join(files.select(F.col("id").alias("target"), F.col("file").alias("to_file")), "target")
    return ranked(both.where("from_file <> to_file").groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("count")), ["-count", "from_file", "to_file"], n)


def directory_deps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports and calls between directories: from_dir, to_dir, count."""
    dirs = nodes.select("id", exprs.second_level_dir(F.col("file")).alias("dir")).where("dir <> ''")
    used = edges.where("relation in ('imports', 'imports_from', 'calls')").select("source", "target")
    both = used.join(dirs.select(F.col("id").alias("source"), F.col("dir").alias("from_dir")), "source").join(dirs.select(F.col("id").alias("target"), F.col("dir").alias("to_dir")), "target")
    return ranked(both.where("from_dir <> to_dir").groupBy("from_dir", "to_dir").agg(F.count(F.lit(1)).alias("count")), ["-count", "from_dir", "to_dir"])


def source_deps(deps: DataFrame) -> DataFrame:
    """deps without the directories of tests, benchmarks and examples."""
    return deps.where(~F.col("from_dir").isin(*fixed.TEST_DIRS) & ~F.col("to_dir").isin(*fixed.TEST_DIRS))


def directory_stats(nodes: DataFrame) -> DataFrame:
    """directory, file_count, node_count."""
    own = nodes.select(exprs.second_level_dir(F.col("file")).alias("directory"), "file").where("directory <> ''")
    # Files first: a distinct count over all nodes would expand every row.
    files = own.groupBy("directory", "file").agg(F.count(F.lit(1)).alias("nodes"))
    return ranked(files.groupBy("directory").agg(F.count(F.lit(1)).alias("file_count"), F.sum("nodes").alias("node_count")), ["-node_count", "directory"])


def confidence_mix(edges: DataFrame) -> DataFrame:
    """Whole percent of each confidence; 0 where there is no edge."""
    of = lambda c: F.count_if(F.col("confidence") == c)
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    row = edges.agg(*[F.struct(of(c).alias("n"), total.alias("of")).alias(c) for c in fixed.CONFIDENCES])
    return row.select(*[F.expr(f"{c}.n * 100 div {c}.of").cast("long").alias(f"{c.lower()}_pct") for c in fixed.CONFIDENCES])


def ambiguous_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, relation and both labels (an id where there is no node) of edges marked AMBIGUOUS."""
    some = edges.where("confidence = 'AMBIGUOUS'").select("source", "target", "relation")
    both = g.with_end(g.with_end(some, nodes, "source", "left"), nodes, "target", "left")
    return both.select("source", "target", "relation", F.coalesce("source_label", "source").alias("source_label"), F.coalesce("target_label", "target").alias("target_label"))
