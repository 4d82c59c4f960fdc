"""Derived facts: lags, ratios, rankings, shares, window extrema, returns and screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RATIOS = {"net_share": ("revenue", "gross_value"), "discount_rate": ("discount_value", "gross_value"), "tax_rate": ("tax_value", "gross_value")}


def change(facts: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Difference and growth against exactly the previous index; growth is null over zero."""
    w = Window.partitionBy(*keys).orderBy(index)
    d = facts.withColumn("prior", F.lag("value").over(w)).withColumn("prior_index", F.lag(index).over(w)).where(F.col("prior_index") == F.col(index) - 1)
    return d.withColumn("difference", F.col("value") - F.col("prior")).withColumn(
        "growth", F.when(F.col("prior") != 0, F.col("difference") / F.abs("prior") * 100)
    )


def ratios(facts: DataFrame) -> DataFrame:
    """Ratios in percent of metrics of one entity and year; zero denominators are skipped."""
    wide = facts.groupBy("entity_id", "fiscal_year").pivot("metric_id", ["revenue", "gross_value", "discount_value", "tax_value"]).agg(F.max("value"))
    cols = [F.when(F.col(b) != 0, F.col(a) / F.col(b) * 100).alias(r) for r, (a, b) in RATIOS.items()]
    return wide.select("entity_id", "fiscal_year", *cols).unpivot(["entity_id", "fiscal_year"], list(RATIOS), "ratio_id", "value").where("value is not null")


def ranked(facts: DataFrame, scope: list[str], top: int | None = None, least: int = 2) -> DataFrame:
    """Entities of each scope by falling value; ties by entity. Scopes of fewer entities drop out."""
    per = facts.groupBy(*scope, "entity_id").agg(F.max("value").alias("value"))
    w = Window.partitionBy(*scope)
    out = per.withColumn("rank", F.row_number().over(w.orderBy(F.desc("value"), "entity_id"))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= least)
    return out.where(F.col("rank") <= top) if top else out


def shares(facts: DataFrame, scope: list[str]) -> DataFrame:
    """Percent of the scope's sum of positive values, two entities at least."""
    w = Window.partitionBy(*scope)
    pos = facts.where("value > 0").withColumn("_sum", F.sum(F.col("value").cast("decimal(28,4)")).over(w).cast("double")).withColumn("_n", F.count(F.lit(1)).over(w))
    return pos.where("_n >= 2").withColumn("share", F.col("value") / F.col("_sum") * 100).drop("_sum", "_n")


def window_extrema(facts: DataFrame, keys: list[str], index: str, length: int) -> DataFrame:
    """Largest and smallest value in the complete window that ends at the key's last index; the
    earliest index wins a tie."""
    last = facts.withColumn("_last", F.max(index).over(Window.partitionBy(*keys))).where(F.col(index) > F.col("_last") - length)
    return last.groupBy(*keys).agg(
        F.count_distinct(index).alias("_n"),
        F.max(F.struct("value", (-F.col(index)).alias("i"))).alias("_hi"),
        F.min(F.struct("value", F.col(index).alias("i"))).alias("_lo"),
    ).where(F.col("_n") == length).select(*keys, (-F.col("_hi.i")).alias("argmax"), F.col("_hi.value").alias("max_value"), F.col("_lo.i").alias("argmin"), F.col("_lo.value").alias("min_value"))


def series_extrema(series: DataFrame, least: int) -> DataFrame:
    """Extrema over each whole series of enough observations; the earliest day wins a tie."""
    day = F.datediff("day", F.lit("1970-01-01"))
    agg = series.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("value", (-day).alias("d"))).alias("hi"), F.min(F.struct("value", day.alias("d"))).alias("lo"))
    as_date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c)
    return agg.where(F.col("n") >= least).select("series", "n", as_date(-F.col("hi.d")).alias("argmax"), F.col("hi.value").alias("max_value"), as_date(F.col("lo.d")).alias("argmin"), F.col("lo.value").alias("min_value"))


def rolling_extrema(series: DataFrame, last: int) -> DataFrame:
    """Extrema over the latest observations of each series that has so many."""
    w = Window.partitionBy("series").orderBy(F.desc("day"))
    return series.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last).groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("rolling_max"), F.min("value").alias("rolling_min")
    ).where(F.col("n") == last)


def nearest_return(series: DataFrame, back_days: int, within: int) -> DataFrame:
    """Percent return from the observation nearest to the end less ``back_days``; ties go to the
    earlier day. An as-of join on a bounded range of days, so nothing is crossed."""
    ends = series.groupBy("series").agg(F.max(F.struct("day", "value")).alias("e")).select("series", F.col("e.day").alias("end_day"), F.col("e.value").alias("end_value"))
    gap = F.abs(F.datediff("day", F.date_sub("end_day", back_days)))
    near = series.join(ends, "series").where((gap <= within) & (F.col("day") < F.col("end_day")))
    start = near.groupBy("series", "end_day", "end_value").agg(F.min(F.struct(gap.alias("gap"), "day", "value")).alias("s"))
    return start.where(F.col("s.value") != 0).select("series", F.col("s.day").alias("start_day"), "end_day", F.round((F.col("end_value") / F.col("s.value") - 1) * 100, 4).alias("return_pct"))


def screening(facts: DataFrame) -> DataFrame:
    """Entities of a year with growing revenue and a positive tax value."""
    grown = change(facts.where("metric_id = 'revenue'"), ["entity_id"], "fiscal_year").where("growth > 0").select("entity_id", "fiscal_year", "growth")
    taxed = facts.where("metric_id = 'tax_value' and value > 0").select("entity_id", "fiscal_year")
    return grown.join(taxed, ["entity_id", "fiscal_year"])
