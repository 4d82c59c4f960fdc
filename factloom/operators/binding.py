"""Bindings over a typed graph: roots, roles that are arrays of nodes, the edges walked, projections, and the replay of a walk.

A relation has a row for each binding: ``binding`` (its root), a column of sorted node ids for each role, and ``walk``, the edges
that led there. Roles grow by one aggregate a step; no step lists paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_WALK = "array<struct<src:string,rel:string,dst:string>>"


def scan(nodes: DataFrame, kind: str, role: str, where: Column | None = None) -> DataFrame:
    """A binding for each node of a kind, as the only node of its role."""
    rows = nodes.where(F.col("kind") == kind)
    rows = rows if where is None else rows.where(where)
    return rows.select(F.col("id").alias("binding"), F.array("id").alias(role), F.array().cast(_WALK).alias("walk"))


def expand(bound: DataFrame, edges: DataFrame, start: str, rel: str, role: str, forward: bool = True, least: int = 1) -> DataFrame:
    """The bindings with the nodes that ``rel`` leads to from the nodes of ``start`` as a new role; those with fewer than ``least`` go."""
    here, there = ("src", "dst") if forward else ("dst", "src")
    steps = bound.select("binding", F.explode(start).alias("_at")).join(edges.where(F.col("rel") == rel), F.col("_at") == F.col(here))
    found = steps.groupBy("binding").agg(F.array_sort(F.collect_set(there)).alias(role), F.array_sort(F.collect_set(F.struct("src", "rel", "dst"))).alias("_more"))
    out = bound.join(found, "binding", "left" if not least else "inner")
    empty = F.array()
    out = out.withColumn(role, F.coalesce(role, empty.cast("array<string>"))).withColumn("walk", F.array_union("walk", F.coalesce("_more", empty.cast(_WALK)))).drop("_more")
    return out.where(F.size(role) >= least)


def project(bound: DataFrame, facts: DataFrame, role: str, fields: list[str], shape: str = "records") -> DataFrame:
    """(binding, answer, count): the fields of a role's nodes in ``facts`` (id, fields) as sorted records, or the first of them as a
    record; a binding without any has no answer and goes."""
    rows = bound.select("binding", F.explode(role).alias("id")).join(facts, "id")
    found = rows.groupBy("binding").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("answer"))
    out = found.withColumn("count", F.size("answer").cast("long"))
    return out if shape == "records" else out.withColumn("answer", F.col("answer")[0])


def provenance(bound: DataFrame, fact_role: str, raw_role: str, rel: str) -> DataFrame:
    """(binding, fact, raws): the raw nodes that walked edges of ``rel`` tie to each fact, whichever way the edge runs."""
    e = bound.select("binding", F.col(fact_role).alias("f"), F.col(raw_role).alias("r"), F.explode("walk").alias("e")).where(F.col("e.rel") == rel)
    ahead = F.array_contains("f", F.col("e.src")) & F.array_contains("r", F.col("e.dst"))
    back = F.array_contains("f", F.col("e.dst")) & F.array_contains("r", F.col("e.src"))
    e = e.where(ahead | back).select("binding", F.when(ahead, F.col("e.src")).otherwise(F.col("e.dst")).alias("fact"), F.when(ahead, F.col("e.dst")).otherwise(F.col("e.src")).alias("raw"))
    return e.groupBy("binding", "fact").agg(F.array_sort(F.collect_set("raw")).alias("raws"))


def replay(bound: DataFrame, nodes: DataFrame, edges: DataFrame, roles: list[str]) -> DataFrame:
    """(binding, missing_nodes, missing_edges, passed): what of each stored binding a graph does not hold."""
    named = bound.select("binding", F.explode(F.array_distinct(F.flatten(F.array(*roles)))).alias("_id"))
    lost = named.join(nodes.select(F.col("id").alias("_id")).distinct(), "_id", "left_anti").groupBy("binding").agg(F.count(F.lit(1)).alias("missing_nodes"))
    walked = bound.select("binding", F.explode("walk").alias("e")).select("binding", "e.*").join(edges.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti")
    broken = walked.groupBy("binding").agg(F.count(F.lit(1)).alias("missing_edges"))
    out = bound.select("binding").join(lost, "binding", "left").join(broken, "binding", "left").fillna(0, ["missing_nodes", "missing_edges"])
    return out.withColumn("passed", (F.col("missing_nodes") == 0) & (F.col("missing_edges") == 0))


def covered(bound: DataFrame, expected: str, represented: list[str]) -> DataFrame:
    """(binding, covered): whether each of the ``represented`` sets of entities is that of ``expected`` and not empty."""
    same = F.size(expected) > 0
    for c in represented:
        same = same & (F.array_sort(F.array_distinct(c)) == F.array_sort(F.array_distinct(expected)))
    return bound.select("binding", F.coalesce(same, F.lit(False)).alias("covered"))
