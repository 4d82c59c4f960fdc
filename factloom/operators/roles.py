"""Checks and rewrites of bound roles: rows (binding, role, key columns) instead of nested node lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components

ORDERING = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def predicate(field: Column, op: str, value=None) -> Column:
    """A role predicate; what cannot be compared is false, never null."""
    if op == "exists":
        return field.isNotNull()
    if op == "truthy":
        text = F.lower(field.cast("string"))
        return field.isNotNull() & ~text.isin("", "0", "0.0", "false")
    if op == "in":
        return F.coalesce(field.isin(list(value)), F.lit(False))
    if op == "not_in":
        return F.coalesce(~field.isin(list(value)), F.lit(True))
    if op in ("eq", "ne"):
        same = field.eqNullSafe(F.lit(value))
        return same if op == "eq" else ~same
    if op not in ORDERING:
        raise ValueError(f"unknown predicate {op}")
    return F.coalesce(getattr(field, ORDERING[op])(F.lit(value)), F.lit(False))


def keep(df: DataFrame, role: str, test: Column, required: bool = True) -> DataFrame:
    """Filter one role's rows; a binding that loses its last row of a required role goes."""
    left = df.where((F.col("role") != role) | test)
    return left.join(left.where(F.col("role") == role).select("binding").distinct(), "binding", "left_semi") if required else left


def unique(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each role and key of a binding, that with the smallest ``order``."""
    w = Window.partitionBy("binding", "role", *keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def key_sets(df: DataFrame, roles: Iterable[str], key: Column) -> DataFrame:
    """(binding, one array of sorted distinct keys a role)."""
    sets = [F.array_sort(F.collect_set(F.when(F.col("role") == r, key))).alias(r) for r in roles]
    return df.where(F.col("role").isin(list(roles))).groupBy("binding").agg(*sets)


def equal_keys(df: DataFrame, left: str, right: str, key: Column, least_common: int | None = None) -> DataFrame:
    """(binding, passed): equal key sets, or with ``least_common`` that many shared keys."""
    s = key_sets(df, (left, right), key)
    ok = (F.col(left) == F.col(right)) & (F.size(left) > 0) if least_common is None else F.size(F.array_intersect(left, right)) >= least_common
    return s.select("binding", ok.alias("passed"))


def contiguous(df: DataFrame, roles: list[str], group: str, period: str, least: int) -> DataFrame:
    """(binding, passed): in each group every role has the same gapless periods, and ``least`` of them."""
    per = df.where(F.col("role").isin(roles)).groupBy("binding", group).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col(period)))).alias(f"p{k}") for k, r in enumerate(roles)]
    )
    n = F.size("p0")
    ok = (n >= least) & (F.element_at("p0", -1) - F.element_at("p0", 1) + 1 == n)
    for k in range(1, len(roles)):
        ok = ok & (F.col(f"p{k}") == F.col("p0"))
    return per.groupBy("binding").agg(F.bool_and(F.when(n > 0, ok).otherwise(False)).alias("passed"))


def previous_by(df: DataFrame, left: str, right: str, group: str, period: str, back: int) -> DataFrame:
    """(binding, period): the latest one that ``left`` has, and ``right`` has ``back`` before it, in every group of the binding."""
    a = df.where(F.col("role") == left).select("binding", group, F.col(period).alias("period")).distinct()
    b = df.where(F.col("role") == right).select("binding", group, (F.col(period) + back).alias("period")).distinct()
    total = df.where(F.col("role").isin(left, right)).groupBy("binding").agg(F.count_distinct(group).alias("groups"))
    per = a.join(b, ["binding", group, "period"]).groupBy("binding", "period").agg(F.count(F.lit(1)).alias("n"))
    return per.join(total, "binding").where("n = groups").groupBy("binding").agg(F.max("period").alias("period"))


def constraints(df: DataFrame, keys: list[str], tests: dict[str, Column]) -> DataFrame:
    """(keys, every test as a column, passed): group-level assertions in one aggregate."""
    out = df.groupBy(*keys).agg(*[F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()])
    ok = F.lit(True)
    for n in tests:
        ok = ok & F.col(n)
    return out.withColumn("passed", ok)


def same(field: Column, missing: bool = False) -> Column:
    """One value in the group, whatever its case and outer blanks; a missing value counts as one more unless allowed."""
    text = F.lower(F.trim(field.cast("string")))
    return F.count_distinct(F.nullif(text, F.lit(""))) <= 1 if missing else (F.count_distinct(F.coalesce(text, F.lit(""))) == 1) & (F.max(F.coalesce(text, F.lit(""))) != "")


def held_out(df: DataFrame, id: str, key: str, seed: Column) -> DataFrame:
    """(id, component, held) of integer ids linked by shared keys; one seed holds its whole component out.

    Each row is linked with the smallest id of its key only, so a key of any size adds as many links as it has rows.
    """
    rows = df.select(F.col(id).cast("long").alias("_id"), F.col(key).alias("_key"), seed.alias("_seed"))
    root = rows.groupBy("_key").agg(F.min("_id").alias("_root"))
    found = components(rows.join(root, "_key").select(F.col("_id").alias("a"), F.col("_root").alias("b")))
    own = rows.groupBy("_id").agg(F.bool_or("_seed").alias("_seed")).join(found, F.col("_id") == F.col("id"), "left")
    own = own.select("_id", F.coalesce("component", "_id").alias("component"), "_seed")
    held = own.groupBy("component").agg(F.bool_or("_seed").alias("held"))
    return own.join(held, "component").select(F.col("_id").alias(id), "component", "held")


def evidence(edges: DataFrame, seeds: DataFrame, required: list[str], context: list[str]) -> DataFrame:
    """Edges (src, rel, dst) with their part: required at a seed, context by relation or next to required nodes, else discarded."""
    mark = lambda name: seeds.select("id", F.lit(True).alias(name))
    e = edges.join(mark("_s"), F.col("src") == F.col("id"), "left").drop("id").join(mark("_d"), F.col("dst") == F.col("id"), "left").drop("id")
    at_seed = F.col("_s").isNotNull() | F.col("_d").isNotNull()
    e = e.withColumn("_required", F.col("rel").isin(required) & at_seed)
    nodes = e.where("_required").select(F.explode(F.array("src", "dst")).alias("id")).unionByName(seeds).distinct()
    near = lambda name: nodes.select("id", F.lit(True).alias(name))
    e = e.join(near("_ns"), F.col("src") == F.col("id"), "left").drop("id").join(near("_nd"), F.col("dst") == F.col("id"), "left").drop("id")
    touching = F.col("rel").isin(context) | F.col("_ns").isNotNull() | F.col("_nd").isNotNull()
    return e.select("src", "rel", "dst", F.when(F.col("_required"), "required").when(touching, "context").otherwise("discarded").alias("part"))
