"""What judges' issues say about the parts that made a sample, and splits of whole components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def hotspots(samples: DataFrame, calls: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, issue, flagged, agreed, confirmed, total, rate) by each of a sample's dimensions.

    ``samples`` holds (sample, dimensions...), ``calls`` (sample, role, issues, confirms). A sample is flagged for an issue by any role,
    agreed by two or more, and confirmed where a call says so; calls of samples that are not there go.
    """
    arms = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    s = samples.select("sample", F.explode(arms).alias("a")).select("sample", "a.*")
    found = calls.select("sample", "role", "confirms", F.explode(F.array_distinct("issues")).alias("issue"))
    found = found.groupBy("sample", "issue").agg((F.count_distinct("role") > 1).alias("agreed"), F.bool_or("confirms").alias("confirmed"))
    total = s.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("total"))
    g = s.join(found, "sample").groupBy("dimension", "value", "issue").agg(F.count(F.lit(1)).alias("flagged"), F.count_if("agreed").alias("agreed"), F.count_if("confirmed").alias("confirmed"))
    return g.join(total, ["dimension", "value"]).withColumn("rate", F.round(F.col("flagged") / F.col("total"), 6))


def component_splits(samples: DataFrame, holdouts: Sequence[str], train: int = 70, dev: int = 10, most: float = 0.2, seed: str = "0") -> DataFrame:
    """(component, n, split) of samples (component, holdout): the first hold-out of the list that any of its samples asks for, else a
    hash bucket of 100; a component of more than ``most`` of all samples goes to train, so that it can't swallow a test split."""
    rank = F.coalesce(*[F.when(F.col("holdout") == h, F.lit(k)) for k, h in enumerate(holdouts)])
    c = samples.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("wish"))
    bucket = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("component").cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    drawn = F.when(bucket < train, "train").when(bucket < train + dev, "dev").otherwise("test")
    wish = F.try_element_at(F.array(*[F.lit(f"test_{h}") for h in holdouts]), (F.col("wish") + 1).cast("int"))
    whole = c.agg(F.sum("n").alias("all"))
    large = F.col("n") > F.col("all") * most
    return c.join(whole, how="cross").select("component", "n", F.when(large, "train").when(F.col("wish").isNotNull(), wish).otherwise(drawn).alias("split"))  # one row beside
