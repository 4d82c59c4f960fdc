"""The fact view: entity, metric, period, value; and scalar rules on facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import column_like

#: Metric formulas over a line item; addends are decimals, so sums do not depend on order.
METRICS = {
    "revenue": "l_extendedprice * (1 - l_discount)",
    "gross_value": "l_extendedprice",
    "discount_value": "l_extendedprice * l_discount",
    "tax_value": "l_extendedprice * l_tax",
    "quantity": "l_quantity",
}


def lines(t) -> DataFrame:
    """Line items with the nation and region of their customer and the order's date."""
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyers = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def annual(t) -> DataFrame:
    """(entity_id, industry, metric_id, fiscal_year, value)."""
    sums = [F.sum(F.expr(f"cast({x} as decimal(18,4))")).cast("double").alias(m) for m, x in METRICS.items()]
    wide = lines(t).groupBy(F.col("n_name").alias("entity_id"), F.col("r_name").alias("industry"), F.year("o_orderdate").alias("fiscal_year")).agg(*sums)
    return wide.unpivot(["entity_id", "industry", "fiscal_year"], list(METRICS), "metric_id", "value")


def quarterly(t) -> DataFrame:
    """(entity_id, fiscal_year, quarter, period_index, value) of revenue."""
    out = lines(t).groupBy(F.col("n_name").alias("entity_id"), F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("quarter")).agg(
        F.sum(F.expr(f"cast({METRICS['revenue']} as decimal(18,4))")).cast("double").alias("value")
    )
    return out.withColumn("period_index", F.col("fiscal_year") * 4 + F.col("quarter"))


def daily(t) -> DataFrame:
    """(series, day, value): events summed by type and day."""
    return t.events.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value")
    )


def tolerance(value: Column) -> Column:
    """Relative tolerance of a comparison, with a floor."""
    return F.greatest(F.lit(1e-6), F.abs(value) * 1e-6)


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    place = column_like("_place", df.columns)
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) == 1).drop(place)


def latest_window(df: DataFrame, keys: list[str], index: str, least: int, most: int) -> DataFrame:
    """The latest run of consecutive indexes of each key, if long enough, cut to its last ``most``."""
    w = Window.partitionBy(*keys).orderBy(index)
    runs = df.withColumn("_island", F.col(index) - F.row_number().over(w))
    of_run = Window.partitionBy(*keys, "_island")
    runs = runs.withColumn("_n", F.count(F.lit(1)).over(of_run)).where(F.col("_n") >= least)
    runs = runs.withColumn("_last", F.max("_island").over(Window.partitionBy(*keys))).where("_island = _last")
    back = Window.partitionBy(*keys).orderBy(F.desc(index))
    return runs.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= most).drop("_island", "_n", "_last", "_rn")
