"""Typed property graph as two DataFrames, and what is asked of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .components import components


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def build(t) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and distinct edges (src, rel, dst) over the tables."""
    nodes = [
        (t.region, "region", "r_regionkey", "Region"), (t.nation, "nation", "n_nationkey", "Nation"), (t.customer, "customer", "c_custkey", "Customer"),
        (t.orders, "order", "o_orderkey", "Order"), (t.supplier, "supplier", "s_suppkey", "Supplier"),
    ]
    edges = [
        (t.nation, ("region", "n_regionkey"), "CONTAINS", ("nation", "n_nationkey")), (t.customer, ("nation", "c_nationkey"), "HAS_CUSTOMER", ("customer", "c_custkey")),
        (t.supplier, ("nation", "s_nationkey"), "HAS_SUPPLIER", ("supplier", "s_suppkey")), (t.orders, ("customer", "o_custkey"), "PLACED", ("order", "o_orderkey")),
    ]
    n = [df.select(_id(k, c).alias("id"), F.lit(label).alias("kind")) for df, k, c, label in nodes]
    e = [df.select(_id(*a).alias("src"), F.lit(r).alias("rel"), _id(*b).alias("dst")) for df, a, r, b in edges]
    # only line items repeat an edge; the others are keyed by their row
    e.append(t.lineitem.select("l_orderkey", "l_suppkey").distinct().select(_id("order", "l_orderkey").alias("src"), F.lit("SUPPLIED_BY").alias("rel"), _id("supplier", "l_suppkey").alias("dst")))
    return _union(n), _union(e)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(rel, neighbour, direction) of one node, as two filters rather than an OR."""
    out = edges.where(F.col("src") == node).select("rel", F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("dst") == node).select("rel", F.col("src").alias("neighbour"), F.lit("in").alias("direction")))


def expand(nodes: DataFrame, edges: DataFrame, rel: str, required: bool = True, least: int = 0) -> DataFrame:
    """Nodes with the sorted array of what they reach over a relation."""
    near = edges.where(F.col("rel") == rel).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("related"))
    out = nodes.join(near, "id", "inner" if required else "left")
    return out.withColumn("related", F.coalesce("related", F.array().cast("array<string>"))).where(F.size("related") >= least)


def dangling(sources: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each relation with an end that is not there."""
    s, d = sources.select(F.col("id").alias("src"), F.lit(1).alias("s")), targets.select(F.col("id").alias("dst"), F.lit(1).alias("d"))
    bad = F.col("s").isNull() | F.col("d").isNull()
    return edges.join(s, "src", "left").join(d, "dst", "left").groupBy("rel").agg(F.sum(bad.cast("long")).alias("dangling"))


def motifs(edges: DataFrame) -> DataFrame:
    """Two-step paths and their roots by relation pair; degrees are multiplied, not paths listed."""
    second = edges.groupBy(F.col("src").alias("mid"), F.col("rel").alias("second")).agg(F.count(F.lit(1)).alias("k"))
    paths = edges.join(second, F.col("dst") == F.col("mid"))
    return paths.groupBy(F.col("rel").alias("first"), "second").agg(F.sum("k").alias("n"), F.count_distinct("src").alias("roots"))


def components_of(links: DataFrame) -> DataFrame:
    """(id, component) with the component itself among the ids."""
    found = components(links)
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()).distinct()


def _shape(links: list[tuple[str, str]]) -> tuple[int, int, int]:
    """Nodes, the largest pseudo-diameter of a component, and nodes with more than two neighbours."""
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def levels(start: str) -> list[set[str]]:
        """The nodes at each distance from ``start``."""
        found, seen = [{start}], {start}
        while ahead := set().union(*(near[x] for x in found[-1])) - seen:
            seen |= ahead
            found.append(ahead)
        return found

    widest, left = 0, set(near)
    while left:
        first = levels(min(left))
        left.difference_update(*first)
        widest = max(widest, len(levels(max(first[-1]))) - 1)  # swept again from the last of the farthest nodes
    return len(near), widest, sum(len(v) > 2 for v in near.values())


def shapes(edges: DataFrame) -> DataFrame:
    """(sample, n_nodes, diameter, branches) of each sample's small graph (sample, a, b), over all its components; edges with an empty
    end are left out, and a sample without others gives no row."""

    def shape(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *_shape(list(zip(pdf["a"], pdf["b"], strict=True))))], columns=["sample", "n_nodes", "diameter", "branches"])

    return edges.where("a <> '' and b <> ''").select("sample", "a", "b").distinct().groupBy("sample").applyInPandas(shape, "sample long, n_nodes long, diameter long, branches long")
