"""Design patterns, recognised by methods and inheritance.

Methods and inheritors are found once by joins; every detector reads those
instead of looking at each class's edges.  Where a choice is open, the order of
the fixed lists decides, then the alphabet.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..session import cut_lineage, tidy
from . import graph as g

#: Classes of a block of strategy_pairs; names that a block's table holds at once.
BLOCK_CLASSES = 1000
BLOCK_NAMES = 4096

COLUMNS = ("name", "anchor_id", "anchor_node", "anchor_file", "evidence", "participants")


def methods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the owner, label and name (lower case, bare) of each method edge whose target is a node."""
    own = edges.where("relation = 'method'").select(F.col("source").alias("id"), "target")
    labels = nodes.select(F.col("id").alias("target"), "label")
    return own.join(labels, "target").select("id", "label", F.lower(exprs.method_name(F.col("label"))).alias("name"))


def inheritors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the base, child and its label (the id where it is no node)."""
    into = edges.where("relation = 'inherits'").select(F.col("target").alias("id"), F.col("source").alias("child"))
    return into.join(nodes.select(F.col("id").alias("child"), "label"), "child", "left").select("id", "child", "label")


def _begins(name: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(name, F.lit(p)) for p in prefixes])


def _result(df: DataFrame, name: str, evidence: list[Column], participants: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.col("id").alias("anchor_id"), F.col("label").alias("anchor_node"), F.col("file").alias("anchor_file"), F.array(*evidence).alias("evidence"), participants.cast("long").alias("participants"))


def command(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes with three inheritors or more that have one of the verbs, which they have themselves or three inheritors share."""
    inh, own = inheritors(nodes, edges), methods(nodes, edges)
    verbs = own.select("id", F.explode(F.array(*[F.when(F.startswith("name", F.lit(v)), F.lit(i)) for i, v in enumerate(fixed.COMMAND_VERBS)])).alias("verb")).where("verb is not null").distinct()
    sizes = inh.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    shared = inh.join(verbs.select(F.col("id").alias("child"), "verb"), "child").groupBy("id", "verb").agg(F.count(F.lit(1)).alias("having"), F.array_sort(F.collect_list("label")).alias("names"))
    # The base's own first verb, or else the first that three inheritors share.
    base = verbs.groupBy("id").agg(F.min("verb").alias("own"))
    common = shared.where("having >= 3").groupBy("id").agg(F.min("verb").alias("common"))
    chosen = g.project_classes(nodes, edges).join(sizes, "id").join(base, "id", "left").join(common, "id", "left").withColumn("verb", F.coalesce("own", "common"))
    found = chosen.join(shared, ["id", "verb"]).where("having >= 3")
    verb = F.element_at(F.array(*map(F.lit, fixed.COMMAND_VERBS)), F.col("verb") + 1)
    evidence = [F.concat(F.col("n").cast("string"), F.lit(" subclasses share "), verb, F.lit("() method")), F.concat(F.array_join(exprs.truncated(F.col("names"), 5), ", "), F.lit(f" {fixed.COMMAND_EVIDENCE}"))]
    return _result(found, "Command", evidence, F.col("having") + 1)


def builder_factory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes with two inheritors or more and factory methods of their own, or else such that two inheritors share."""
    inh = inheritors(nodes, edges)
    made = methods(nodes, edges).where(_begins(F.col("name"), fixed.FACTORY_PREFIXES))
    sizes = inh.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("label")).alias("subclasses")).where("n >= 2")
    base = made.groupBy("id").agg(F.array_sort(F.collect_list("label")).alias("own"))
    per_child = inh.join(made.select(F.col("id").alias("child"), F.lower("label").alias("low")), "child")
    common = per_child.groupBy("id", "low").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").groupBy("id").agg(F.array_sort(F.collect_list("low")).alias("common"))
    found = g.project_classes(nodes, edges).join(sizes, "id").join(base, "id", "left").join(common, "id", "left").withColumn("matched", F.coalesce("own", "common")).where("matched is not null")
    evidence = [F.concat(F.lit("factory methods: "), F.array_join("matched", ", ")), F.concat(F.lit("subclasses: "), F.array_join(exprs.truncated(F.col("subclasses"), 5), ", "))]
    return _result(found, "Builder/Factory", evidence, F.col("n") + 1)


def observer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes with two methods or more that listen or notify."""
    heard = methods(nodes, edges).where(_begins(F.col("name"), fixed.OBSERVER_PREFIXES)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("label")).alias("matched")).where("n >= 2")
    return _result(g.project_classes(nodes, edges).join(heard, "id"), "Observer", [F.concat(F.lit("observer methods: "), F.array_join("matched", ", "))], F.col("n") + 1)


def _interfaces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and names (distinct, sorted) of classes with three method edges or more."""
    own = methods(nodes, edges).join(g.project_classes(nodes, edges).select("id"), "id", "left_semi")
    return own.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("name")).alias("names")).where("n >= 3").select("id", "names")


def _block_pairs(table: pa.Table) -> pa.Table:
    """Rows of strategy_pairs between the classes of two blocks (or of one), by products of their tables of names; ties are rows with an other id."""
    bx, by = table.column("bx")[0].as_py(), table.column("by")[0].as_py()
    other = table.column("other")
    ties = table.filter(pc.is_valid(other))
    rows = table.filter(pc.is_null(other)).sort_by("id").combine_chunks()
    block = rows.column("block").to_numpy()
    lists = rows.column("codes").combine_chunks()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    codes, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
    x, y = np.flatnonzero(block == bx), np.flatnonzero(block == by)
    mine = lambda who: np.isin(owner, who)
    common = np.intersect1d(codes[mine(x)], codes[mine(y)])
    at = np.searchsorted(common, codes)
    known = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == codes) if len(common) else np.zeros(len(codes), dtype=bool)
    shared = np.zeros((len(x), len(y)), dtype=np.int64)
    for lo in range(0, len(common), BLOCK_NAMES):
        cut = known & (at >= lo) & (at < lo + BLOCK_NAMES)
        has = np.zeros((len(size), min(BLOCK_NAMES, len(common) - lo)), dtype=np.float32)
        has[owner[cut], at[cut] - lo] = 1
        shared += (has[x] @ has[y].T).astype(np.int64)
    if bx == by:
        shared = np.triu(shared, 1)
    ids = rows.column("id").combine_chunks()
    place = lambda column: pc.index_in(column, ids).to_numpy(zero_copy_only=False)
    if ties.num_rows:
        one, two = place(ties.column("id")), place(ties.column("other"))
        for p, q in ((one, two), (two, one)):
            ok = np.isin(p, x) & np.isin(q, y)
            shared[np.searchsorted(x, p[ok]), np.searchsorted(y, q[ok])] = 0
    i, j = np.nonzero(shared)
    n = shared[i, j]
    i, j = x[i], y[j]
    whole = size[i] + size[j] - n
    percent = n * 100 // whole
    return pa.table([ids.take(pa.array(np.minimum(i, j))), ids.take(pa.array(np.maximum(i, j))), n, whole, percent, (n >= 3) & (percent >= 60)], names=["a", "b", "shared", "all", "percent", "pass"])


def strategy_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of classes that share a method: a, b, shared, all, percent, pass.

    Classes have three methods or more and no edge between them.  They are
    dealt to blocks, and any two blocks are compared in one task, so no row is
    made for a name that two classes share, only for the pairs themselves.
    """
    sets = cut_lineage(_interfaces(nodes, edges))
    tidy(sets.sparkSession)
    blocks = sets.count() // BLOCK_CLASSES + 1
    block = lambda id: F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int")
    named = sets.select("id", F.explode("names").alias("name"))
    numbers = cut_lineage(named.select("name").distinct().withColumn("code", F.monotonically_increasing_id()))
    coded = cut_lineage(named.join(numbers, "name").groupBy("id").agg(F.collect_list("code").alias("codes")).withColumn("block", block("id")))
    far = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("far")
    dealt = coded.select(F.lit(None).cast("string").alias("other"), "id", "block", "codes", far)
    tied = edges.join(sets.select(F.col("id").alias("source")), "source", "left_semi").join(sets.select(F.col("id").alias("target")), "target", "left_semi").where("source <> target")
    ties = tied.select(F.col("target").alias("other"), F.col("source").alias("id"), block("source").alias("block"), F.lit(None).cast("array<bigint>").alias("codes"), block("target").alias("far"))
    rows = dealt.unionByName(ties).select("other", "id", "block", "codes", F.least("block", "far").alias("bx"), F.greatest("block", "far").alias("by"))
    return rows.repartition(max(1, blocks * (blocks + 1) // 2), "bx", "by").groupBy("bx", "by").applyInArrow(_block_pairs, "a string, b string, shared long, all long, percent long, pass boolean")


def _alike(faces: DataFrame) -> DataFrame:
    """x, y, names: pairs of interfaces (k, names) that share three names or more and 60 percent of all theirs, and what they share.

    An interface of n names that is alike another shares 3 n / 5 with it (and
    three), so two such have a name in common among the rarest ones that are
    left when all but one of these are put aside.  Only there do interfaces
    meet; a name that very many have is hardly ever among them.
    """
    named = faces.select("k", F.size("names").alias("size"), F.explode("names").alias("name"))
    seen = named.groupBy("name").agg(F.count(F.lit(1)).alias("seen"))
    ordered = named.join(seen, "name").groupBy("k", "size").agg(F.array_sort(F.collect_list(F.struct("seen", "name"))).alias("names"))
    rarest = F.slice("names", F.lit(1), F.expr("int(size - greatest(3, (3 * size + 4) div 5) + 1)"))
    first = ordered.select("k", "size", F.explode(rarest).alias("one")).where("one.seen > 1").select("k", "size", F.col("one.name").alias("name"))
    side = lambda end: first.select(F.col("k").alias(end), F.col("size").alias(f"n{end}"), "name")
    met = side("x").join(side("y"), "name").where("x < y and 5 * least(nx, ny) >= 3 * greatest(nx, ny)").select("x", "y").distinct()
    whole = lambda end: faces.select(F.col("k").alias(end), F.col("names").alias(f"{end}_names"))
    both = met.join(whole("x"), "x").join(whole("y"), "y").withColumn("names", F.array_intersect("x_names", "y_names"))
    return both.where("size(names) >= 3 and 5 * size(names) >= 3 * (size(x_names) + size(y_names) - size(names))").select("x", "y", "names")


def strategy_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exact shared sets of methods with three classes or more: names, classes (labels, sorted), size, file; largest first.

    The groups are those that the passing rows of strategy_pairs make, without
    making these rows: classes with one interface are taken together, and a
    class belongs to what its interface shares with another if that has a
    class that no edge ties to it.
    """
    sets = cut_lineage(_interfaces(nodes, edges).where("size(names) >= 3"))
    faces = cut_lineage(sets.groupBy("names").agg(F.count(F.lit(1)).alias("many")).withColumn("k", F.monotonically_increasing_id()))
    members = cut_lineage(sets.join(faces, "names").select("id", "k"))
    pairs = _alike(faces.select("k", "names"))
    many = faces.select(F.col("k").alias("far"), "many")
    links = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("k"), F.col("y").alias("far")), F.struct(F.col("y").alias("k"), F.col("x").alias("far")))).alias("e"), "names").select("e.*", "names").join(many, "far")
    links = links.select("k", "far", "names", "many").unionByName(faces.where("many > 1").select("k", F.col("k").alias("far"), "names", (F.col("many") - 1).alias("many")))
    near = g.neighbours(edges.join(members.select(F.col("id").alias("source")), "source", "left_semi").where("source <> target"))
    ties = near.join(members, "id").select("other", F.col("k").alias("far")).join(members.select(F.col("id").alias("other")), "other", "left_semi")
    ties = ties.groupBy(F.col("other").alias("id"), "far").agg(F.count(F.lit(1)).alias("tied"))
    names = F.array_join(F.array_sort("names"), ",")
    held = members.join(links, "k").join(ties, ["id", "far"], "left").where("coalesce(tied, 0) < many").select(names.alias("names"), F.col("id").alias("member")).distinct()
    grouped = held.join(nodes.select(F.col("id").alias("member"), "label", "file"), "member").groupBy("names").agg(F.array_sort(F.collect_set("label")).alias("classes"), F.min_by("file", "member").alias("file"), F.min("member").alias("anchor_id"))
    return grouped.withColumn("size", F.size("classes").cast("long")).where("size >= 3").orderBy(F.desc("size"), "names")


def strategy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups, largest first, that have two classes or more which no larger group had.

    The choice is sequential, so it walks over the groups on the driver; they
    are grouped sets of methods, not classes or pairs.
    """
    seen: set[str] = set()
    rows = []
    for r in strategy_groups(nodes, edges).toLocalIterator():
        if len(set(r["classes"]) - seen) < 2:
            continue
        seen.update(r["classes"])
        cut = lambda names: names if len(names) <= 5 else [*names[:5], f"(+{len(names) - 5} more)"]
        names = r["names"].split(",")
        rows.append(("Strategy", r["anchor_id"], r["classes"][0], r["file"], [f"{r['size']} classes share interface: {', '.join(cut(names))}", f"implementations: {', '.join(cut(r['classes']))}"], r["size"]))
    return nodes.sparkSession.createDataFrame(rows, "name string, anchor_id string, anchor_node string, anchor_file string, evidence array<string>, participants long")


def all_patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All of them, by falling number of participants."""
    found = [f(nodes, edges) for f in (command, builder_factory, observer, strategy)]
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("participants"), "name", "anchor_id")
