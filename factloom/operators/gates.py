"""Gates and audits: rules that name what is wrong with a row, and counts that decide whether a build passes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Statuses of facts that may enter the graph.
READY_STATUSES = ("single_source", "cross_verified")
# Metrics that are never, and usually not, negative, and the ranges of percentages.
NEVER_NEGATIVE = ("total_assets", "total_liabilities")
USUALLY_NOT_NEGATIVE = (
    "revenue", "gross_profit", "cost_of_revenue", "cash_and_cash_equivalents", "inventory", "accounts_receivable_net", "shareholders_equity",
    "population_total", "money_supply_m2",
)
PERCENT_RANGES = {
    "unemployment_rate": (-10, 100), "labor_force_participation_rate": (0, 100), "employment_population_ratio": (0, 100), "inflation_rate_cpi": (-100, 1000),
    "real_gdp_growth_pct": (-100, 1000), "current_account_balance_pct_gdp": (-300, 300), "government_expense_pct_gdp": (0, 300),
    "tax_revenue_pct_gdp": (0, 200), "government_consumption_pct_gdp": (0, 200), "gross_capital_formation_pct_gdp": (-100, 300),
    "government_gross_debt_pct_gdp": (0, 1000), "government_net_lending_pct_gdp": (-300, 300), "share_of_world_gdp_ppp": (0, 100),
    "broad_money_pct_gdp": (0, 1000), "domestic_credit_private_sector_pct_gdp": (0, 1000),
}
OTHER_PERCENT = (-1000, 1000)
# Fixed value: least tolerance of a compared number.
LEAST_TOLERANCE = 1e-6


def ready_reason() -> Column:
    """Why a fact may not enter the graph, comma-separated, or ``ready``; over the columns of a standardised fact."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    status = F.col("verification_status")
    unit = F.lower(F.when(empty("normalized_unit"), F.col("unit")).otherwise(F.col("normalized_unit")))
    reasons = F.concat_ws(
        ",",
        F.when(empty("entity_id"), "missing_entity"), F.when(empty("metric_id"), "missing_metric"), F.when(F.col("normalized_value").isNull(), "null_value"),
        F.when(empty("period_end"), "missing_period_end"), F.when(empty("source_id"), "missing_source"), F.when(empty("source_definition_id"), "missing_source_definition"),
        F.when(unit == "document", "document_fact"),
        F.when(~F.coalesce(status.isin(*READY_STATUSES), F.lit(False)), F.concat(F.lit("status_"), F.when(empty("verification_status"), "missing").otherwise(status))),
    )
    return F.when(reasons == "", "ready").otherwise(reasons)


def basic_checks() -> Column:
    """An array of (check, status) of a fact: number, sign, percentage range, time; a fact without a value has the first only."""
    value, metric = F.col("normalized_value"), F.col("metric_id")
    table = F.create_map(*[F.lit(x) for k, (lo, hi) in PERCENT_RANGES.items() for x in (k, f"{lo},{hi}")])
    ends = F.split(F.coalesce(table[metric], F.lit(",".join(map(str, OTHER_PERCENT)))), ",").cast("array<double>")
    percent = F.coalesce(F.col("normalized_unit") == "percent", F.lit(False)) | F.lower(F.coalesce("default_unit", F.lit(""))).isin("percent", "%")
    timed = F.col("period_type").isin("point_in_time", "period_flow")
    one = lambda name, status: F.struct(F.lit(name).alias("check"), status.alias("status"))
    found = F.array(
        one("numeric_value", F.lit("passed")),
        F.when(metric.isin(*NEVER_NEGATIVE), one("non_negative", F.when(value < 0, "failed").otherwise("passed"))),
        F.when(metric.isin(*USUALLY_NOT_NEGATIVE) & (value < 0), one("usually_non_negative", F.lit("warning"))),
        F.when(percent, one("percentage_range", F.when((value < ends[0]) | (value > ends[1]), "warning").otherwise("passed"))),
        one("time_completeness", F.when(timed & F.col("period_end").isNull(), "failed").otherwise("passed")),
    )
    return F.when(value.isNull(), F.array(one("numeric_value", F.lit("failed")))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def fact_report(facts: DataFrame) -> DataFrame:
    """(name, value) of the counts and ratios that gates are set on, by one aggregate over the facts."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    n, ready = F.count(F.lit(1)), F.count_if(ready_reason() == "ready")
    counts = {f"missing_{k}_count": F.count_if(empty(c)) for k, c in (("entity", "entity_id"), ("metric", "metric_id"), ("period_end", "period_end"), ("source", "source_id"), ("source_definition", "source_definition_id"))}
    counts |= {f"{s}_count": F.count_if(F.col("verification_status") == s) for s in ("rejected", "conflict", "cross_verified", "single_source")}
    counts |= {"null_value_count": F.count_if(F.col("normalized_value").isNull()), "document_fact_count": F.count_if(F.lower("normalized_unit") == "document"), "graph_ready_count": ready, "fact_count": n}
    ratio = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
    counts |= {"cross_verified_ratio": ratio(F.count_if(F.col("verification_status") == "cross_verified")), "graph_ready_ratio": ratio(ready)}
    one = facts.agg(*[c.cast("double").alias(k) for k, c in counts.items()])
    return one.withColumn("of", F.lit(0)).unpivot(["of"], list(counts), "name", "value").drop("of")


def judged(report: DataFrame, most: Mapping[str, float], least: Mapping[str, float]) -> DataFrame:
    """(name, value, bound, passed) of a report's gated values."""
    bounds = {**{k: (v, True) for k, v in most.items()}, **{k: (v, False) for k, v in least.items()}}
    bound = F.create_map(*[F.lit(x) for k, (v, _) in bounds.items() for x in (k, float(v))])[F.col("name")]
    upper = F.col("name").isin(*most)
    return report.withColumn("bound", bound).where("bound is not null").withColumn("passed", F.when(upper, F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound")))


def overlaps(rows: DataFrame, train: list[str], checks: Mapping[str, tuple[Column, str | None]], split: str = "split") -> DataFrame:
    """(check, train_keys, target_keys, overlap, rate) of keys that stand on both sides of a split.

    A check is an array of keys of a row and the split that it guards; None for all splits but those of ``train``, and ``*`` for keys
    that stand in any two splits. Rows become (check, key, split) once, and one aggregate by key answers all checks.
    """
    side = F.col(split)
    def named(name: str, keys: Column) -> Column:
        there = F.filter(F.coalesce(keys.cast("array<string>"), F.array().cast("array<string>")), lambda x: x != "")
        return F.transform(F.array_distinct(there), lambda k: F.struct(F.lit(name).alias("check"), k.alias("key")))

    arrays = [named(name, keys) for name, (keys, _) in checks.items()]
    flat = rows.select(side.alias("side"), F.explode(F.concat(*arrays)).alias("k")).select("side", "k.check", "k.key").distinct()
    guarded = F.create_map(*[F.lit(x) for name, (_, target) in checks.items() for x in (name, target or "")])[F.col("check")]
    is_train = F.col("side").isin(*train)
    in_target = F.when(guarded == "", ~is_train).otherwise(F.col("side") == guarded)
    per = flat.groupBy("check", "key").agg(F.bool_or(is_train).alias("a"), F.bool_or(in_target).alias("b"), F.count_distinct("side").alias("sides"), F.first(guarded).alias("guarded"))
    any_two = F.col("guarded") == "*"
    out = per.groupBy("check").agg(
        F.count_if(F.col("a") & ~any_two).alias("train_keys"), F.count_if(any_two | F.col("b")).alias("target_keys"),
        F.count_if(F.when(any_two, F.col("sides") > 1).otherwise(F.col("a") & F.col("b"))).alias("overlap"),
    )
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide("overlap", "target_keys"), F.lit(0.0)), 6))


def tolerance(target: Column, absolute: float = 0.0, relative: float = 0.0, places: int | None = None) -> Column:
    """How far an answer may be from its target: the widest of an absolute, a relative and half a unit of the places asked for."""
    fixed = max(absolute, 0.5 * 10.0**-places if places is not None else 0.0, LEAST_TOLERANCE)
    return F.greatest(F.lit(fixed), F.abs(target) * relative)


def number_matches(target: Column, value: Column, percent: bool = False, **bounds) -> Column:
    """Whether a number answers its target; with ``percent`` also where one is the other's percentage. A missing number never does."""
    off = F.abs(target - value)
    if percent:
        off = F.least(off, F.abs(target - value * 100), F.abs(target - value / 100))
    return F.coalesce(off <= tolerance(target, **bounds), F.lit(False))


def token_matches(left: Column, right: Column) -> Column:
    """Whether two unit names are the same but for case and punctuation."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9%]+", "")
    return plain(left) == plain(right)


def period_matches(expected: Column, actual: Column) -> Column:
    """Whether a period text answers the expected one; a year also in a text that names it and no other year."""
    expected, actual = F.trim(expected.cast("string")), F.trim(actual.cast("string"))
    years = F.regexp_extract_all(actual, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1)
    return F.coalesce((expected == actual) | (expected.rlike(r"^(19|20)[0-9]{2}$") & (years == F.array(expected))), F.lit(False))


def tables_match(expected: Column, observed: Column, ordered: bool = False) -> Column:
    """Whether two arrays of comparable rows are equal, in their order or as multisets."""
    same = expected == observed if ordered else F.array_sort(expected) == F.array_sort(observed)
    return F.coalesce(same, F.lit(False))


def calculate(operation: Column, a: Column, b: Column) -> Column:
    """difference a - b, ratio a / b, percent_change from a to b, mean of both; null where the divisor is zero or the operation is none of these."""
    return (
        F.when(operation == "difference", a - b).when(operation == "ratio", F.try_divide(a, b))
        .when(operation == "percent_change", F.try_divide((b - a) * 100, F.abs(a))).when(operation == "mean", (a + b) / 2)
    )


def graph_counters(nodes: DataFrame, edges: DataFrame, required: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """(name, n) of a graph's counters that must be zero: repeated nodes and edges, loops, dangling ends, and nodes of a kind without a
    relation that ``required`` (relation: kind, whether the node is the source) asks of them."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    known = nodes.select(F.col("id").alias("end")).distinct()
    out = [
        counted(nodes.groupBy("id").count().where("count > 1"), "repeated_nodes"),
        counted(edges.groupBy("src", "rel", "dst").count().where("count > 1"), "repeated_edges"), counted(edges.where("src = dst"), "loops"),
        counted(edges.join(known, F.col("src") == F.col("end"), "left_anti"), "dangling_sources"), counted(edges.join(known, F.col("dst") == F.col("end"), "left_anti"), "dangling_targets"),
    ]
    for rel, (kind, source) in required.items():
        ends = edges.where(F.col("rel") == rel).select(F.col("src" if source else "dst").alias("end")).distinct()
        out.append(counted(nodes.where(F.col("kind") == kind).join(ends, F.col("id") == F.col("end"), "left_anti"), f"{kind}_without_{rel}"))
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_
