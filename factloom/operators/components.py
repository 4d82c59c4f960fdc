"""Connected components of links held in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import scratch


def _least(edges: DataFrame, by: str, of: str) -> DataFrame:
    return edges.groupBy(F.col(by).alias("_k")).agg(F.min(of).alias("_m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _least(both, "a", "b").withColumn("_m", F.least("_m", "_k"))
    return both.join(near, both["a"] == near["_k"]).where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _least(down, "a", "b")
    met = down.join(near, down["a"] == near["_k"])
    return met.select("b", F.col("_m").alias("m")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        near.select(F.col("_k").alias("a"), F.col("_m").alias("b"))
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in the links (a, b); the component is its smallest id."""
    edges = scratch.stored(links.where("a <> b").select("a", "b").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        step = scratch.stored(_small(_large(edges)).where("a <> b").distinct(), "stars")
        now = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        edges = step
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
