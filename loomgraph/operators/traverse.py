"""Questions to a graph: neighbourhoods, paths, and one node's links."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..session import cut_lineage, discard, stored
from . import graph as g

#: Links that the depth-first walk collects at once.
WALK_LINKS = 500_000


def question_terms(question: str) -> list[str]:
    """exprs.terms for a question at hand."""
    return [w for w in question.lower().split() if len(w.encode()) > 2 and w not in fixed.STOPWORDS]


def _wanted(terms: list[str]):
    return F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")


def seeds(nodes: DataFrame, terms: list[str], n: int = 3) -> DataFrame:
    """id, label, score of the n nodes that match best; files and modules are 2 points worse."""
    score = exprs.match_score(F.col("label"), _wanted(terms)) - F.when(F.col("type").isin("file", "module"), 2).otherwise(0)
    return nodes.select("id", "label", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(n)


def most_linked(nodes: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """id, label, degree: what a question without a match falls back to."""
    return g.raw_degree(edges).join(nodes.select("id", "label"), "id").select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(n)


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Breadth-first: (id, level) within depth steps of start (id), both ways, and the edges whose far end was new when its level began."""
    seen = cut_lineage(start.select("id").distinct().withColumn("level", F.lit(0)))
    used: DataFrame | None = None
    for level in range(1, depth + 1):
        front = seen.where(F.col("level") == level - 1).select("id")
        near = edges.join(front.withColumnRenamed("id", "source"), "source", "left_semi").withColumn("far", F.col("target"))
        near = near.unionByName(edges.join(front.withColumnRenamed("id", "target"), "target", "left_semi").withColumn("far", F.col("source")))
        new = cut_lineage(near.join(seen.select(F.col("id").alias("far")), "far", "left_anti"))
        used = new.drop("far") if used is None else used.unionByName(new.drop("far"))
        seen = cut_lineage(seen.unionByName(new.select(F.col("far").alias("id")).distinct().withColumn("level", F.lit(level))))
    return seen, (used if used is not None else edges.limit(0)).distinct()


def depth_first(edges: DataFrame, start: list[str], depth: int = 4) -> tuple[list[str], list[tuple]]:
    """Ids in the order a depth-first walk meets them, and the links it pushed whose far end was new then.

    The order of a stack is sequential, so the walk is on the driver, over the
    links that start reaches in depth steps.  They come in batches of about
    WALK_LINKS and are kept as numbers.
    """
    ids = edges.sparkSession.createDataFrame([(s,) for s in start], "id string")
    reach, _ = neighbourhood(edges, ids, depth)
    ends = reach.select("id")
    fields = ["source", "target", "relation", "confidence"]
    own = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(ends.withColumnRenamed("id", "target"), "target", "left_semi"))
    own = cut_lineage(own.select(*fields).distinct())
    batches = own.count() // WALK_LINKS + 1
    codes: tuple[dict, dict] = ({s: i for i, s in enumerate(dict.fromkeys(start))}, {})
    parts = []
    for b in range(batches):
        got = own.where(F.pmod(F.xxhash64("source", "target"), F.lit(batches)) == b).toArrow()
        parts.append(np.array([[c.setdefault(v, len(c)) for v in got.column(f).to_pylist()] for f, c in zip(fields, (codes[0], codes[0], codes[1], codes[1]))], dtype=np.int32))
    # Numbers in the order of what they stand for.
    names, words = sorted(codes[0]), sorted(codes[1])
    rank = lambda c, known: np.argsort(np.array([c[v] for v in known], dtype=np.int64))
    ends_rank, words_rank = rank(codes[0], names), rank(codes[1], words)
    cols = np.concatenate(parts, axis=1)
    cols = np.stack([ends_rank[cols[0]], ends_rank[cols[1]], words_rank[cols[2]], words_rank[cols[3]]])
    cols = cols[:, np.lexsort(cols[::-1])]
    back = np.argsort(cols[1], kind="stable")
    out_at = np.searchsorted(cols[0], np.arange(len(names) + 1))
    in_at = np.searchsorted(cols[1][back], np.arange(len(names) + 1))
    met = np.zeros(len(names), dtype=bool)
    place = {v: i for i, v in enumerate(names)}
    order: list[int] = []
    pushed: list[np.ndarray] = []
    stack = [(np.array([place[s] for s in reversed(start)], dtype=np.int64), 0)] if start else []
    while stack:
        far, d = stack.pop()
        node, rest = far[-1], far[:-1]
        if len(rest):
            stack.append((rest, d))
        if met[node] or d > depth:
            continue
        met[node] = True
        order.append(int(node))
        links = np.concatenate([np.arange(out_at[node], out_at[node + 1]), back[in_at[node] : in_at[node + 1]]])
        far = np.concatenate([cols[1][out_at[node] : out_at[node + 1]], cols[0][back[in_at[node] : in_at[node + 1]]]])
        new = ~met[far]
        if new.any():
            stack.append((far[new], d + 1))
            pushed.append(links[new])
    took = dict.fromkeys(np.concatenate(pushed).tolist()) if pushed else {}
    return [names[i] for i in order], [(names[cols[0][i]], names[cols[1][i]], words[cols[2][i]], words[cols[3][i]]) for i in took]


def _walked(start: list[int], depth: int):
    """Rows (place, number) of nodes, in the order of their ids, and (source, target) of links as numbers, to the numbers a walk meets, in one task."""

    def run(batches):
        kinds: tuple[list, list] = ([], [])
        for batch in batches:
            link, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for kind, held in zip((False, True), kinds):
                if (link == kind).any():
                    held.append((x[link == kind], y[link == kind]))
        if not kinds[0]:
            return
        place, number = (np.concatenate(c) for c in zip(*kinds[0]))
        number = number[np.argsort(place)]
        by = np.argsort(number)
        known = number[by]
        rank = lambda v: by[np.searchsorted(known, v)].astype(np.int32)
        ends = [np.concatenate([rank(pair[i]) for pair in kinds[1]]) if kinds[1] else np.zeros(0, np.int32) for i in (0, 1)]
        kinds[1].clear()
        at, far = [], []
        for a, b in (ends, ends[::-1]):
            key = a.astype(np.int64) << 32 | b
            key.sort()
            at.append(np.searchsorted(key, np.arange(len(number) + 1, dtype=np.int64) << 32))
            far.append((key & 0xFFFFFFFF).astype(np.int32))
            del key
        met = np.zeros(len(number), dtype=bool)
        order: list[int] = []
        stack = [rank(np.array(start[::-1], dtype=np.int64)).tolist()]  # of each depth, what is left
        while stack:
            if not stack[-1]:
                stack.pop()
                continue
            node = stack[-1].pop()
            if met[node]:
                continue
            met[node] = True
            order.append(node)
            if len(stack) <= depth:
                near = np.concatenate([f[t[node] : t[node + 1]] for f, t in zip(far, at)])
                stack.append(near[~met[near]].tolist())
        for i in range(0, len(order), 100_000):
            some = order[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(some)), pa.int32()), pa.array(number[some])], ["position", "n"])

    return run


def walk(links: DataFrame, start: list[str], depth: int = 4) -> DataFrame:
    """position, id: nodes in the order a depth-first walk over links (source, target; repeated or not) meets them, as depth_first does.

    The order of a stack is sequential, so one task walks, over the links as
    numbers; the driver gets none.
    """
    spark = links.sparkSession
    if not start:
        return spark.createDataFrame([], "position int, id string")
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).unionAll(spark.createDataFrame([(s,) for s in start], "id string"))
    for turn in count():
        number = lambda id: F.xxhash64(F.lit(turn), id)  # noqa: B023, E731
        ids = stored(ends.distinct().orderBy("id").select("id", number(F.col("id")).alias("n"), F.monotonically_increasing_id().alias("place")))
        if ids.select("n").distinct().count() == ids.count():
            break
        discard(ids)  # two ids of one number
    first = {r["id"]: r["n"] for r in ids.where(F.col("id").isin(start)).collect()}
    rows = ids.select(F.lit(False).alias("link"), F.col("place").alias("x"), F.col("n").alias("y")).unionAll(links.select(F.lit(True), number(F.col("source")), number(F.col("target"))))
    met = stored(rows.coalesce(1).mapInArrow(_walked([first[s] for s in start], depth), "position int, n long"))
    out = stored(met.join(ids, "n").select("position", "id"))
    discard(ids, met)
    return out


def relevance(nodes: DataFrame, ids: DataFrame, terms: list[str]) -> DataFrame:
    """Nodes among ids, most relevant first: id, label, type, file, score."""
    own = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    return own.select("id", "label", "type", "file", exprs.match_score(F.col("label"), _wanted(terms)).alias("score")).orderBy(F.desc("score"), "id")


def within_budget(lines: DataFrame, order: list, budget: int, used: int = 0) -> DataFrame:
    """The first lines (column line) whose bytes, after used ones, stay within 4 a token. Lines are not empty, so no more than there are bytes are added up."""
    lines = lines.orderBy(*order).limit(max(4 * budget - used, 0))
    total = F.sum(F.octet_length("line")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("bytes", total + used).where(F.col("bytes") <= 4 * budget)


def find_node(nodes: DataFrame, name: str) -> DataFrame:
    """id, label of the node with this label in any case, else of the one with the shortest label that contains it."""
    low = F.lower("label")
    some = nodes.where(F.contains(low, F.lit(name.lower())))
    return some.orderBy(F.desc(low == name.lower()), F.octet_length("label"), "id").limit(1).select("id", "label")


def shortest_path(edges: DataFrame, start: str, end: str, most: int | None = None) -> list[dict] | None:
    """Steps (from, to, relation, confidence, forward) of a shortest path either way, or None.

    Level by level until nothing new is met (or most levels, if given); parents
    prefer forward links, then the smallest id.  Only the path itself comes to
    the driver.
    """
    spark = edges.sparkSession
    if start == end:
        return []
    seen = cut_lineage(spark.createDataFrame([(start, 0, None, None, None, None)], "id string, level int, parent string, relation string, confidence string, forward boolean"))
    for level in count(1) if most is None else range(1, most + 1):
        front = seen.where(F.col("level") == level - 1).select(F.col("id").alias("parent"))
        out = edges.join(front, edges["source"] == front["parent"]).select(F.col("target").alias("id"), "parent", "relation", "confidence", F.lit(True).alias("forward"))
        into = edges.join(front, edges["target"] == front["parent"]).select(F.col("source").alias("id"), "parent", "relation", "confidence", F.lit(False).alias("forward"))
        best = out.unionByName(into).join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct((~F.col("forward")).alias("back"), "parent", "relation", "confidence")).alias("b"))
        new = cut_lineage(best.select("id", F.lit(level).alias("level"), "b.parent", "b.relation", "b.confidence", (~F.col("b.back")).alias("forward")))
        if new.isEmpty():
            return None
        seen = cut_lineage(seen.unionByName(new))
        if not new.where(F.col("id") == end).isEmpty():
            steps, at = [], end
            while at != start:
                r = seen.where(F.col("id") == at).first()
                steps.append({"from": r["parent"], "to": at, "relation": r["relation"], "confidence": r["confidence"], "forward": r["forward"]})
                at = r["parent"]
            return steps[::-1]
    return None


def path_length(edges: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """hops: of a shortest path, null if there is none."""
    path = shortest_path(edges, start, end, most)
    return edges.sparkSession.createDataFrame([(None if path is None else len(path),)], "hops long")


def explain(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Every link of a node: direction, relation, id, label (the id where there is no node), file, confidence. A loop counts both ways."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("id"), "confidence")
    into = edges.where(F.col("target") == node).select(F.lit("in").alias("direction"), "relation", F.col("source").alias("id"), "confidence")
    far = out.unionAll(into).join(nodes.select("id", "label", "file"), "id", "left")
    return far.select("direction", "relation", "id", F.coalesce("label", "id").alias("label"), F.coalesce("file", F.lit("")).alias("file"), "confidence").orderBy("direction", "relation", "id")
