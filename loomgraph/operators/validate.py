"""Checks of extraction records that come as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def errors(records: DataFrame, column: str = "record") -> DataFrame:
    """record_id, part, index, error of each fault of JSON texts (record_id, record); a valid one has no rows.

    Lists are read as arrays of raw JSON, so that an element of the wrong type
    is a fault of its own, not of its whole list.
    """
    part = lambda name: F.get_json_object(column, f"$.{name}")
    listed = lambda name: F.from_json(part(name), "array<string>")
    found = None
    base = records.select("record_id", column)
    for name, fields in (("nodes", fixed.NODE_FIELDS), ("edges", fixed.EDGE_FIELDS)):
        missing = base.where(part(name).isNull()).select("record_id", F.lit(name).alias("part"), F.lit(-1).alias("index"), F.lit(f"Missing required key '{name}'").alias("error"))
        wrong = base.where(part(name).isNotNull() & ~F.startswith(part(name), F.lit("["))).select("record_id", F.lit(name), F.lit(-1), F.lit(f"'{name}' must be a list"))
        items = base.where(F.startswith(part(name), F.lit("["))).select("record_id", F.posexplode(listed(name)).alias("index", "item"))
        kind = name[:-1].capitalize()
        bad = ~F.startswith(F.coalesce("item", F.lit("")), F.lit("{"))
        at = F.concat(F.lit(f"{kind} "), F.col("index").cast("string"))
        objects = items.where(bad).select("record_id", F.lit(name), "index", F.concat(at, F.lit(" must be an object")))
        value = F.from_json("item", "map<string,string>")
        own = items.where(~bad).withColumn("o", value)
        who = F.concat(at, F.lit(" (id="), _q(F.coalesce(F.col("o")["id"], F.lit("?"))), F.lit(")")) if name == "nodes" else at
        lacks = own.select("record_id", F.lit(name), "index", F.explode(F.array(*[F.when(~F.map_contains_key("o", F.lit(f)), F.concat(who, F.lit(f" missing required field '{f}'"))) for f in fields])).alias("error")).where("error is not null")
        field, allowed = ("file_type", fixed.FILE_TYPES) if name == "nodes" else ("confidence", fixed.CONFIDENCES)
        invalid = own.where(F.col("o")[field].isNotNull() & ~F.col("o")[field].isin(*allowed)).select("record_id", F.lit(name), "index", F.concat(who, F.lit(f" has invalid {field} '"), F.col("o")[field], F.lit("'")))
        for more in (wrong, objects, lacks, invalid):
            missing = missing.union(more)
        found = missing if found is None else found.union(missing)
    ids = base.select("record_id", F.explode(listed("nodes")).alias("item")).select("record_id", F.get_json_object("item", "$.id").alias("id")).where("id is not null").distinct()
    ends = base.where(F.startswith(part("edges"), F.lit("["))).select("record_id", F.posexplode(listed("edges")).alias("index", "item"))
    ends = ends.select("record_id", "index", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.get_json_object("item", f"$.{e}").alias("id")) for e in ("source", "target")])).alias("x")).select("record_id", "index", "x.end", "x.id").where("id is not null")
    loose = ends.join(ids.select("record_id").distinct(), "record_id", "left_semi").join(ids, ["record_id", "id"], "left_anti")
    loose = loose.select("record_id", F.lit("edges"), "index", F.concat(F.lit("Edge "), F.col("index").cast("string"), F.lit(" "), F.col("end"), F.lit(" '"), F.col("id"), F.lit("' does not match any node id")))
    return found.union(loose)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, end, id of edge ends that are no nodes; none if there are no nodes at all."""
    ids = nodes.select("id").distinct()
    ends = edges.select("source", "target", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source").alias("id")), F.struct(F.lit("target").alias("end"), F.col("target").alias("id")))).alias("x")).select("source", "target", "x.end", "x.id")
    some = ids.limit(1).select(F.lit(True).alias("some"))
    return ends.join(ids, "id", "left_anti").join(F.broadcast(some)).select("source", "target", "end", "id")


def bad_fields(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, key, field, value of fields that are missing (null) or outside their vocabulary, for tables of nodes and edges."""

    def of(df: DataFrame, name: str, key: Column, fields: tuple[str, ...], closed: dict[str, tuple[str, ...]]) -> DataFrame:
        tests = [F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"), F.lit("missing").alias("value"))) for f in fields if f in df.columns]
        tests += [F.when(F.col(f).isNotNull() & ~F.col(f).isin(*ok), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f, ok in closed.items() if f in df.columns]
        return df.select(F.lit(name).alias("part"), key.alias("key"), F.explode(F.array(*tests)).alias("x")).where("x is not null").select("part", "key", "x.field", "x.value")

    a = of(nodes, "nodes", F.coalesce("id", F.lit("?")), fixed.NODE_FIELDS, {"file_type": fixed.FILE_TYPES})
    b = of(edges, "edges", F.concat_ws("->", "source", "target"), fixed.EDGE_FIELDS, {"confidence": fixed.CONFIDENCES})
    return a.unionAll(b)
