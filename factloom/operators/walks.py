"""Walks over the types of a graph: its relation schema, the cheapest typed paths, and how many walks of a path there are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .. import scratch


def relation_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, rel, direction, other, n): which kinds a relation joins, from either end, and over how many edges."""
    kinds = nodes.select("id", "kind").distinct()
    one, two = kinds.select(F.col("id").alias("src"), F.col("kind").alias("a")), kinds.select(F.col("id").alias("dst"), F.col("kind").alias("b"))
    n = edges.join(one, "src").join(two, "dst").groupBy("a", "rel", "b").agg(F.count(F.lit(1)).alias("n"))
    ends = F.array(F.struct(F.col("a").alias("kind"), F.lit("out").alias("direction"), F.col("b").alias("other")), F.struct(F.col("b").alias("kind"), F.lit("in").alias("direction"), F.col("a").alias("other")))
    return n.select("rel", "n", F.explode(ends).alias("e")).select("e.kind", "rel", "e.direction", "e.other", "n")


def typed_paths(schema: DataFrame, costs: Mapping[str, int], depth: int, beam: int = 100, limit: int = 3) -> DataFrame:
    """(start, finish, path, cost, place): for each pair of kinds its ``limit`` cheapest paths that meet no kind twice.

    The beam goes level by level and keeps the ``beam`` cheapest unfinished paths of each start. All tables here are as large as the
    schema to the power of the depth, at most ``beam`` times the number of kinds; the graph itself is not read.
    """
    cost = F.coalesce(*[F.when(F.col("rel") == r, F.lit(c)) for r, c in sorted(costs.items())], F.lit(1))
    step = F.concat_ws(" ", "rel", "direction", "other")
    steps = scratch.stored(schema.select("kind", "other", step.alias("step"), cost.cast("long").alias("step_cost")), "schema")
    found = level = steps.select(F.col("kind").alias("start"), F.col("other").alias("at"), F.array("kind", "other").alias("seen"), F.col("step").alias("path"), F.col("step_cost").alias("cost")).where("start <> at")
    rank = F.row_number().over(Window.partitionBy("start").orderBy("cost", "path"))
    for _ in range(depth - 1):
        level = level.withColumn("k", rank).where(F.col("k") <= beam).drop("k")
        level = level.join(steps, F.col("at") == F.col("kind")).where(~F.array_contains("seen", F.col("other"))).select(
            "start", F.col("other").alias("at"), F.array_append("seen", F.col("other")).alias("seen"), F.concat_ws(" > ", "path", "step").alias("path"), (F.col("cost") + F.col("step_cost")).alias("cost")
        )
        found = found.unionByName(level)
    place = F.row_number().over(Window.partitionBy("start", "at").orderBy("cost", "path"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("start", F.col("at").alias("finish"), "path", "cost", "place")


def walked(nodes: DataFrame, edges: DataFrame, kind: str, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """(root, end, walks) along (relation, direction) steps from every node of a kind.

    Walks are counted by root and end after each step, so no walk is ever listed and a step's table has at most a row for each pair.
    """
    at = nodes.where(F.col("kind") == kind).select(F.col("id").alias("root"), F.col("id").alias("end"), F.lit(1).cast("long").alias("walks"))
    for rel, direction in steps:
        near, far = ("src", "dst") if direction == "out" else ("dst", "src")
        e = edges.where(F.col("rel") == rel).select(F.col(near).alias("end"), F.col(far).alias("next"))
        at = at.join(e, "end").groupBy("root", F.col("next").alias("end")).agg(F.sum("walks").alias("walks"))
    return at


def support(walks: DataFrame) -> DataFrame:
    """(roots, ends, pairs, walks) of a path: what a mined motif is scored by."""
    return walks.agg(F.count_distinct("root").alias("roots"), F.count_distinct("end").alias("ends"), F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("walks"), F.lit(0)).cast("long").alias("walks"))
