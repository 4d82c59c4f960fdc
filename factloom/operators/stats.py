"""Statistics of datasets: distances of distributions, intervals, percentiles, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Two-sided 95 % point of the normal distribution.
Z = 1.959963984540054


def distribution(df: DataFrame, category: Column) -> DataFrame:
    """(category, n, share)."""
    n = df.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """Total variation distance and Jensen-Shannon divergence (base 2) of two distributions."""
    j = a.select("category", F.col("share").alias("p")).join(b.select("category", F.col("share").alias("q")), "category", "full").fillna(0.0)
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return j.agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 4).alias("tvd"), F.round(F.sum(kl("p") + kl("q")) / 2, 4).alias("jsd"))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval."""
    p, z2 = hits / n, Z * Z
    middle, half = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return tuple(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (middle + s * half) / (1 + z2 / n))), 6) for s in (-1, 1))


def nearest_rank(df: DataFrame, keys: list[str], value: str, order: list[str], points: dict[str, float]) -> DataFrame:
    """Values at rank round-half-even((n - 1) q) of each key."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(value, *order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return r.groupBy(*keys).agg(*[F.max(F.when(F.col("_r") == F.bround((F.col("_n") - 1) * q, 0).cast("long"), F.col(value))).alias(name) for name, q in points.items()])
