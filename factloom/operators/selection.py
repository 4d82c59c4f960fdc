"""Quotas and balanced selections. What is sequential runs over cells of the quota grid, never over all rows."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import column_like


def largest_remainder(shares: Mapping[str, float], size: int) -> dict[str, int]:
    """Whole counts near ``size`` times each share; the largest remainders get what is left, ties by name."""
    exact = {k: v * size for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(shares, key=lambda k: (out[k] - exact[k], k))[: max(0, size - sum(out.values()))]:
        out[k] += 1
    return dict(sorted(out.items()))


def stratum_quotas(strata: DataFrame, stratum: str, n: str, budget: int, least: int = 1) -> DataFrame:
    """(stratum, quota): ``budget`` shared among strata of ``n`` rows, as an allocation over the small table of strata.

    Each stratum first gets ``least`` rows, or all it has; where the budget does not reach that far, the largest strata get one row
    each. What is left goes in proportion to the rows that are left, in whole numbers, and the rows lost by that to the largest
    remainders. No quota is above its stratum's rows.
    """
    every = Window.partitionBy(F.lit(0))
    total = lambda c: F.sum(c).over(every)
    t = strata.where(F.col(n) > 0).select(stratum, F.col(n).cast("long").alias("have")).withColumn("floor", F.least(F.lit(max(least, 0)), "have"))
    t = t.withColumn("budget", F.least(F.lit(max(budget, 0)), total("have"))).withColumn("short", total("floor") > F.col("budget"))
    t = t.withColumn("place", F.row_number().over(every.orderBy(F.desc("have"), stratum)))
    t = t.withColumn("rest", F.col("have") - F.col("floor")).withColumn("spare", F.col("budget") - total("floor"))
    exact = F.coalesce(F.try_divide(F.col("spare") * F.col("rest"), total("rest")), F.lit(0.0))
    t = t.withColumn("exact", exact).withColumn("whole", F.col("floor") + F.least("rest", F.floor("exact")))
    full = F.col("whole") >= F.col("have")
    t = t.withColumn("turn", F.row_number().over(every.orderBy(full, F.floor("exact") - F.col("exact"), stratum))).withColumn("lost", F.col("budget") - total("whole"))
    some = F.col("whole") + (~full & (F.col("turn") <= F.col("lost"))).cast("long")
    return t.select(stratum, F.when(F.col("short"), (F.col("place") <= F.col("budget")).cast("long")).otherwise(some).alias("quota"))


def take_quotas(df: DataFrame, stratum: str, quotas: DataFrame, order: list[str]) -> DataFrame:
    """The first rows of each stratum, as many as its quota in (stratum, quota)."""
    place, own, quota = (column_like(c, df.columns) for c in ("_place", "_stratum", "_quota"))
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    side = quotas.select(F.col(stratum).alias(own), F.col("quota").alias(quota))
    return ranked.join(side, F.col(stratum) == F.col(own)).where(F.col(place) <= F.col(quota)).drop(place, own, quota)


def round_robin(df: DataFrame, stratum: str, order: list[str], size: int) -> DataFrame:
    """``size`` rows, one of each stratum in turn."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_rn") <= size)
    return ranked.orderBy("_rn", stratum).limit(size).drop("_rn")


def release(df: DataFrame, key: str, score: str, targets: Mapping[str, Mapping[str, float]], size: int) -> DataFrame:
    """``size`` rows that fill the quotas of several columns at once, scarcest cells first.

    A row's turn depends only on its cell (its values in the quota columns), then on score and key. So a cell's rows are ranked in
    Spark, at most a cell's smallest quota of them can ever be taken, and the turns are played on the driver over that many rows a
    cell: no more than ``size`` times the number of cells, whatever the table's size.
    """
    names = list(targets)
    left = {n: largest_remainder(targets[n], size) for n in names}
    cells = df.where(F.col(key).isNotNull() & ~F.greatest(*[F.col(n).isNull() for n in names], F.lit(False)))
    for n in names:
        cells = cells.where(F.col(n).cast("string").isin([k for k, v in left[n].items() if v > 0]))
    most = F.least(*[F.create_map(*[F.lit(x) for kv in left[n].items() for x in kv])[F.col(n).cast("string")] for n in names], F.lit(size))
    w = Window.partitionBy(*names)
    ranked = cells.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc(score), key)))
    heads: dict[tuple, list] = {}
    count: dict[tuple, int] = {}
    for r in ranked.where(F.col("_rn") <= most).select(*[F.col(n).cast("string") for n in names], "_n", F.col(score).cast("double").alias("_s"), F.col(key).alias("_k"), "_rn").orderBy("_rn").collect():
        cell = tuple(r[: len(names)])
        heads.setdefault(cell, []).append((-r["_s"] if r["_s"] is not None else math.inf, r["_k"]))
        count[cell] = r["_n"]
    at, taken = dict.fromkeys(heads, 0), []
    while len(taken) < size:
        live = [c for c in heads if at[c] < len(heads[c]) and all(left[n].get(v, 0) > 0 for n, v in zip(names, c))]
        if not live:
            break
        supply: dict[tuple, int] = {}
        for c in live:
            for n, v in zip(names, c):
                supply[n, v] = supply.get((n, v), 0) + count[c] - at[c]
        best = min(live, key=lambda c: (-sum(left[n][v] / supply[n, v] for n, v in zip(names, c)), *heads[c][at[c]]))
        taken.append(heads[best][at[best]][1])
        at[best] += 1
        for n, v in zip(names, best):
            left[n][v] -= 1
    chosen = df.sparkSession.createDataFrame([(k,) for k in taken], df.select(key).schema)
    return df.join(chosen, key, "left_semi")
