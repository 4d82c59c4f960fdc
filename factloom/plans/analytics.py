"""Derived facts, selection, joins, quality passes, signals and serving."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import derived as D, facts as X
from ..registry import Registry
from .sqlviews import CHANGE, DAILY, FACTS, LINES, QUARTERS

R = Registry()


def r4(name, alias=None):
    return F.round(F.col(name) if isinstance(name, str) else name, 4).alias(alias or name)


@R.query("derived_difference", f"WITH {CHANGE} SELECT entity_id, metric_id, fiscal_year, round(difference, 4) difference FROM chg")
def _(t):
    return D.change(X.annual(t), ["entity_id", "metric_id"], "fiscal_year").select("entity_id", "metric_id", "fiscal_year", r4("difference"))


@R.query("derived_yoy_growth", f"WITH {CHANGE} SELECT entity_id, fiscal_year, round(growth, 4) growth FROM chg WHERE metric_id = 'revenue' AND growth IS NOT NULL")
def _(t):
    return D.change(X.annual(t).where("metric_id = 'revenue'"), ["entity_id"], "fiscal_year").where("growth is not null").select("entity_id", "fiscal_year", r4("growth"))


@R.query("derived_qoq_growth", f"""WITH {QUARTERS}, c AS (SELECT *, lag(value) OVER w p, lag(period_index) OVER w pi FROM quarters WINDOW w AS (PARTITION BY entity_id ORDER BY period_index))
SELECT entity_id, fiscal_year, quarter, round((value - p) / abs(p) * 100, 4) growth FROM c WHERE pi = period_index - 1 AND p <> 0""")
def _(t):
    return D.change(X.quarterly(t), ["entity_id"], "period_index").where("growth is not null").select("entity_id", "fiscal_year", "quarter", r4("growth"))


@R.query("derived_ratio", f"""WITH {FACTS} SELECT entity_id, fiscal_year, 'net_share' ratio_id, round(revenue / gross_value * 100, 4) AS value FROM wide WHERE gross_value <> 0
UNION ALL SELECT entity_id, fiscal_year, 'discount_rate', round(discount_value / gross_value * 100, 4) FROM wide WHERE gross_value <> 0
UNION ALL SELECT entity_id, fiscal_year, 'tax_rate', round(tax_value / gross_value * 100, 4) FROM wide WHERE gross_value <> 0""")
def _(t):
    return D.ratios(X.annual(t)).select("entity_id", "fiscal_year", "ratio_id", r4("value"))


_RANK = "row_number() OVER (PARTITION BY metric_id, fiscal_year ORDER BY value DESC, entity_id)"


@R.query("derived_ranking_top10", f"WITH {FACTS} SELECT * FROM (SELECT metric_id, fiscal_year, entity_id, value, {_RANK}::INT AS rank FROM facts) WHERE rank <= 10")
def _(t):
    return D.ranked(X.annual(t), ["metric_id", "fiscal_year"], 10).select("metric_id", "fiscal_year", "entity_id", "value", "rank")


for _name, _dir in (("argmax", "DESC"), ("argmin", "ASC")):

    @R.query(f"derived_{_name}", f"WITH {FACTS} SELECT metric_id, fiscal_year, entity_id, value FROM (SELECT *, row_number() OVER (PARTITION BY metric_id, fiscal_year ORDER BY value {_dir}, entity_id) k FROM facts) WHERE k = 1")
    def _(t, _dir=_dir):
        order = F.desc("value") if _dir == "DESC" else F.asc("value")
        return X.best_by(X.annual(t), ["metric_id", "fiscal_year"], [order, F.asc("entity_id")]).select("metric_id", "fiscal_year", "entity_id", "value")


@R.query("derived_share", f"WITH {FACTS} SELECT metric_id, fiscal_year, entity_id, round(value / (sum(CAST(value AS DECIMAL(28,4))) OVER (PARTITION BY metric_id, fiscal_year))::DOUBLE * 100, 4) AS share FROM facts WHERE value > 0")
def _(t):
    return D.shares(X.annual(t), ["metric_id", "fiscal_year"]).select("metric_id", "fiscal_year", "entity_id", r4("share"))


@R.query("derived_multi_year_extrema", f"""WITH {FACTS}, w AS (SELECT * FROM (SELECT *, max(fiscal_year) OVER (PARTITION BY entity_id, metric_id) y FROM facts) WHERE fiscal_year > y - 5),
k AS (SELECT *, count(*) OVER (PARTITION BY entity_id, metric_id) n, row_number() OVER (PARTITION BY entity_id, metric_id ORDER BY value DESC, fiscal_year) hi, row_number() OVER (PARTITION BY entity_id, metric_id ORDER BY value, fiscal_year) lo FROM w)
SELECT entity_id, metric_id, max(fiscal_year) FILTER (hi = 1) argmax, max(value) FILTER (hi = 1) max_value, max(fiscal_year) FILTER (lo = 1) argmin, max(value) FILTER (lo = 1) min_value FROM k WHERE n = 5 GROUP BY ALL""")
def _(t):
    return D.window_extrema(X.annual(t), ["entity_id", "metric_id"], "fiscal_year", 5)


@R.query("derived_series_extrema", f"""WITH {DAILY}, k AS (SELECT *, count(*) OVER (PARTITION BY series) n, row_number() OVER (PARTITION BY series ORDER BY value DESC, day) hi, row_number() OVER (PARTITION BY series ORDER BY value, day) lo FROM daily)
SELECT series, n, max(day) FILTER (hi = 1) argmax, max(value) max_value, max(day) FILTER (lo = 1) argmin, min(value) min_value FROM k WHERE n >= 12 GROUP BY series, n""")
def _(t):
    return D.series_extrema(X.daily(t), 12)


@R.query("derived_rolling_extrema", f"""WITH {DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) k FROM daily)
SELECT series, count(*) n, max(value) rolling_max, min(value) rolling_min FROM k WHERE k <= 12 GROUP BY 1 HAVING count(*) = 12""")
def _(t):
    return D.rolling_extrema(X.daily(t), 12)


@R.query("derived_long_window_return", f"""WITH {DAILY}, e AS (SELECT series, max(day) end_day, arg_max(value, day) ev FROM daily GROUP BY 1),
n AS (SELECT series, day, value, end_day, ev, row_number() OVER (PARTITION BY series ORDER BY abs(day - (end_day - 20)), day) k FROM daily JOIN e USING (series) WHERE abs(day - (end_day - 20)) <= 3 AND day < end_day)
SELECT series, day start_day, end_day, round((ev / value - 1) * 100, 4) return_pct FROM n WHERE k = 1 AND value <> 0""")
def _(t):
    return D.nearest_return(X.daily(t), 20, 3)


@R.query("derived_industry_ranking", f"""WITH {FACTS}, k AS (SELECT industry, metric_id, fiscal_year, entity_id, value, row_number() OVER w AS rank, count(*) OVER (PARTITION BY industry, metric_id, fiscal_year) n FROM facts WINDOW w AS (PARTITION BY industry, metric_id, fiscal_year ORDER BY value DESC, entity_id))
SELECT industry, metric_id, fiscal_year, entity_id, value, rank::INT AS rank FROM k WHERE n >= 2 AND rank <= 10""")
def _(t):
    return D.ranked(X.annual(t), ["industry", "metric_id", "fiscal_year"], 10).select("industry", "metric_id", "fiscal_year", "entity_id", "value", "rank")


@R.query("derived_screening", f"WITH {CHANGE} SELECT entity_id, fiscal_year, round(growth, 4) growth FROM chg c WHERE metric_id = 'revenue' AND growth > 0 AND EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = c.entity_id AND f.fiscal_year = c.fiscal_year AND f.metric_id = 'tax_value' AND f.value > 0)")
def _(t):
    return D.screening(X.annual(t)).select("entity_id", "fiscal_year", r4("growth"))


# selection and quality

@R.query("dedupe_best_score", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END DESC, l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) k FROM lineitem) WHERE k = 1")
def _(t):
    score = F.when(F.col("l_linestatus") == "F", 2).otherwise(1)
    order = [score.desc(), F.desc("l_extendedprice"), F.desc("l_orderkey"), F.desc("l_linenumber")]
    return X.best_by(t.lineitem, ["l_partkey", "l_suppkey"], order).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@R.query("latest_retrieval", "SELECT user_id, event_type, max(ts) ts, max(event_id) FILTER (k = 1) event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) k FROM events) GROUP BY ALL")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"))


_READY = "CASE WHEN l_quantity IS NULL THEN 'value_missing' END, CASE WHEN l_discount > 0.09 THEN 'discount_out_of_range' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_shipdate < DATE '1995-06-01' THEN 'too_early' END"


@R.query("gate_graph_ready", f"SELECT coalesce(nullif(concat_ws(',', {_READY}), ''), 'ready') reason, count(*) n FROM lineitem GROUP BY 1")
def _(t):
    reason = F.concat_ws(",", F.when(F.col("l_quantity").isNull(), "value_missing"), F.when(F.col("l_discount") > 0.09, "discount_out_of_range"), F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp"), "too_early"))
    return t.lineitem.groupBy(F.when(reason == "", "ready").otherwise(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_SOURCES = """s AS (SELECT o_orderkey k, 'orders' source, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE v FROM orders UNION ALL
SELECT l_orderkey, 'lines', sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,4)))::DOUBLE FROM lineitem GROUP BY 1)"""


def _sources(t):
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.lit("orders").alias("source"), F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("v"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.expr("cast(l_extendedprice * (1 - l_discount) * (1 + l_tax) as decimal(18,4))")).cast("double").alias("v"))
    return a.unionByName(b.select("k", F.lit("lines").alias("source"), "v"))


_STATUS = "CASE WHEN count(*) < 2 THEN 'single_source' WHEN max(v) - min(v) > greatest(1e-6, max(abs(v)) * 1e-6) THEN 'conflict' WHEN count(DISTINCT source) > 1 THEN 'cross_verified' ELSE 'single_source' END"


@R.query("equivalence_conflict", f"WITH {_SOURCES} SELECT k, {_STATUS} status FROM s GROUP BY 1")
def _(t):
    wide = F.max("v") - F.min("v") > F.greatest(F.lit(1e-6), F.max(F.abs("v")) * 1e-6)
    status = F.when(F.count(F.lit(1)) < 2, "single_source").when(wide, "conflict").when(F.count_distinct("source") > 1, "cross_verified").otherwise("single_source")
    return _sources(t).groupBy("k").agg(status.alias("status"))


@R.query("cross_verified_counts", f"WITH {_SOURCES}, c AS (SELECT k, round(max(v) / 1000) * 1000 b, count(DISTINCT source) n, max(v) - min(v) <= max(abs(v)) * 0.5 near FROM s GROUP BY 1) SELECT n sources, near, count(*) n FROM c GROUP BY ALL")
def _(t):
    per = _sources(t).groupBy("k").agg(F.count_distinct("source").alias("sources"), (F.max("v") - F.min("v") <= F.max(F.abs("v")) * 0.5).alias("near"))
    return per.groupBy("sources", "near").agg(F.count(F.lit(1)).alias("n"))


@R.query("large_change", f"WITH {QUARTERS} SELECT entity_id, period_index, value, round(ch, 4) change FROM (SELECT *, abs((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0)) ch FROM quarters WINDOW w AS (PARTITION BY entity_id ORDER BY period_index)) WHERE ch > 0.5")
def _(t):
    prior = F.lag("value").over(Window.partitionBy("entity_id").orderBy("period_index"))
    q = X.quarterly(t).withColumn("change", F.abs((F.col("value") - prior) / F.nullif(prior, F.lit(0.0))))
    return q.where("change > 0.5").select("entity_id", "period_index", "value", r4("change"))


@R.query("accounting_identity", f"WITH {FACTS} SELECT entity_id, fiscal_year, abs(gross_value - (revenue + discount_value)) <= greatest(1, abs(gross_value) * 1e-6) holds FROM wide")
def _(t):
    w = X.annual(t).groupBy("entity_id", "fiscal_year").pivot("metric_id", ["revenue", "gross_value", "discount_value"]).agg(F.max("value")).dropna()
    return w.select("entity_id", "fiscal_year", (F.abs(F.col("gross_value") - F.col("revenue") - F.col("discount_value")) <= F.greatest(F.lit(1.0), F.abs("gross_value") * 1e-6)).alias("holds"))


# joins

@R.query("join_cross_metric", f"WITH {FACTS} SELECT a.entity_id, a.fiscal_year, round(a.value - b.value, 4) spread FROM facts a JOIN facts b ON a.entity_id IS NOT DISTINCT FROM b.entity_id AND a.fiscal_year IS NOT DISTINCT FROM b.fiscal_year WHERE a.metric_id = 'revenue' AND b.metric_id = 'tax_value'")
def _(t):
    f = X.annual(t)
    a, b = f.where("metric_id = 'revenue'").alias("a"), f.where("metric_id = 'tax_value'").alias("b")
    on = F.col("a.entity_id").eqNullSafe(F.col("b.entity_id")) & F.col("a.fiscal_year").eqNullSafe(F.col("b.fiscal_year"))
    return a.join(b, on).select("a.entity_id", "a.fiscal_year", F.round(F.col("a.value") - F.col("b.value"), 4).alias("spread"))


@R.query("join_pairwise_entities", f"""WITH {FACTS}, k AS (SELECT *, (row_number() OVER (PARTITION BY industry, metric_id, fiscal_year ORDER BY entity_id) - 1) // 2 pair FROM facts)
SELECT industry, metric_id, fiscal_year, k.pair::INT AS pair, min(entity_id) first_entity, max(entity_id) second_entity, round(arg_min(value, entity_id) - arg_max(value, entity_id), 4) difference FROM k GROUP BY industry, metric_id, fiscal_year, k.pair HAVING count(*) = 2""")
def _(t):
    keys = ["industry", "metric_id", "fiscal_year"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("entity_id"))
    p = X.annual(t).withColumn("pair", F.floor((place - 1) / 2).cast("int")).groupBy(*keys, "pair").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("entity_id", "value")).alias("a"), F.max(F.struct("entity_id", "value")).alias("b"))
    return p.where("n = 2").select(*keys, "pair", F.col("a.entity_id").alias("first_entity"), F.col("b.entity_id").alias("second_entity"), F.round(F.col("a.value") - F.col("b.value"), 4).alias("difference"))


@R.query("join_semi_evidence", "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(t):
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@R.query("join_anti_missing", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@R.query("join_complete_case", f"""WITH {FACTS}, w AS (SELECT * FROM wide WHERE revenue IS NOT NULL AND tax_value IS NOT NULL AND discount_value IS NOT NULL)
SELECT industry, fiscal_year, count(*) n, round(sum(CAST(revenue AS DECIMAL(28,4)))::DOUBLE, 4) revenue FROM w GROUP BY ALL HAVING count(*) >= 3""")
def _(t):
    w = X.annual(t).groupBy("industry", "fiscal_year", "entity_id").pivot("metric_id", ["revenue", "tax_value", "discount_value"]).agg(F.max("value")).dropna()
    return w.groupBy("industry", "fiscal_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("revenue").cast("decimal(28,4)")).cast("double"), 4).alias("revenue")).where("n >= 3")


_SCOPE = CHANGE + ", m AS (SELECT c.industry, c.fiscal_year, c.entity_id, c.growth, w.discount_value / w.gross_value * 100 rate, w.tax_value / w.revenue * 100 margin FROM chg c JOIN wide w USING (entity_id, fiscal_year) WHERE c.metric_id = 'revenue')"


def _scope(t):
    f = X.annual(t)
    g = D.change(f.where("metric_id = 'revenue'"), ["entity_id"], "fiscal_year").select("industry", "entity_id", "fiscal_year", "growth")
    w = f.groupBy("entity_id", "fiscal_year").pivot("metric_id", ["revenue", "gross_value", "discount_value", "tax_value"]).agg(F.max("value"))
    return g.join(w, ["entity_id", "fiscal_year"]).select("industry", "fiscal_year", "entity_id", "growth", (F.col("discount_value") / F.col("gross_value") * 100).alias("rate"), (F.col("tax_value") / F.col("revenue") * 100).alias("margin"))


@R.query("scope_growth_filter_rank", f"WITH {_SCOPE} SELECT * FROM (SELECT industry, fiscal_year, entity_id, round(margin, 4) margin, (row_number() OVER (PARTITION BY industry, fiscal_year ORDER BY margin DESC, entity_id))::INT AS rank FROM m WHERE growth > 10) WHERE rank <= 3")
def _(t):
    w = Window.partitionBy("industry", "fiscal_year").orderBy(F.desc("margin"), "entity_id")
    return _scope(t).where("growth > 10").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("industry", "fiscal_year", "entity_id", r4("margin"), "rank")


@R.query("scope_rank_lookup", f"WITH {FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY industry, fiscal_year ORDER BY revenue DESC, entity_id) r FROM wide) SELECT industry, fiscal_year, r::INT AS rank, entity_id, quantity FROM k WHERE r <= 2")
def _(t):
    f = X.annual(t)
    top = D.ranked(f.where("metric_id = 'revenue'"), ["industry", "fiscal_year"], 2, 1).select("industry", "fiscal_year", "rank", "entity_id")
    second = f.where("metric_id = 'quantity'").select("entity_id", "fiscal_year", F.col("value").alias("quantity"))
    return top.join(second, ["entity_id", "fiscal_year"], "left").select("industry", "fiscal_year", "rank", "entity_id", "quantity")


@R.query("scope_multi_factor", f"WITH {_SCOPE}, a AS (SELECT *, avg(margin) OVER (PARTITION BY industry, fiscal_year) mean FROM m) SELECT industry, fiscal_year, entity_id, round(growth, 4) growth, round(margin, 4) margin FROM a WHERE growth > 0 AND rate < 70 AND margin > mean")
def _(t):
    a = _scope(t).withColumn("mean", F.avg("margin").over(Window.partitionBy("industry", "fiscal_year")))
    return a.where("growth > 0 and rate < 70 and margin > mean").select("industry", "fiscal_year", "entity_id", r4("growth"), r4("margin"))


# series

_CUST = """y AS (SELECT o_custkey key, year(o_orderdate)::INT yr, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE v FROM orders GROUP BY ALL),
i AS (SELECT *, yr - row_number() OVER (PARTITION BY key ORDER BY yr) isl FROM y), n AS (SELECT *, count(*) OVER (PARTITION BY key, isl) c FROM i), l AS (SELECT *, max(isl) OVER (PARTITION BY key) li FROM n WHERE c >= 3),
win AS (SELECT key, yr, v FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY yr DESC) k FROM l WHERE isl = li) WHERE k <= 4)"""


def _customer_window(t):
    y = t.orders.groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("yr")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    return X.latest_window(y, ["key"], "yr", 3, 4)


@R.query("window_latest_contiguous", f"WITH {_CUST} SELECT * FROM win")
def _(t):
    return _customer_window(t)


@R.query("temporal_average", f"WITH {_CUST} SELECT key, count(*) n, round(sum(CAST(v AS DECIMAL(28,2)))::DOUBLE / count(*), 4) mean FROM win GROUP BY 1")
def _(t):
    return _customer_window(t).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v").cast("decimal(28,2)")).cast("double") / F.count(F.lit(1)), 4).alias("mean"))


@R.query("temporal_argmax_followup", f"""WITH {_CUST}, m AS (SELECT key, yr FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v DESC, yr) k FROM win) WHERE k = 1)
SELECT key, yr, count(o_orderkey) n_orders FROM m JOIN orders ON o_custkey = key AND year(o_orderdate) = yr GROUP BY ALL""")
def _(t):
    m = X.best_by(_customer_window(t), ["key"], [F.desc("v"), F.asc("yr")]).select("key", "yr")
    n = t.orders.groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n_orders"))
    return m.join(n, ["key", "yr"])


# signals

_ENDS = FACTS + ", e AS (SELECT entity_id, metric_id, min(fiscal_year) y0, max(fiscal_year) y1, arg_min(value, fiscal_year) v0, arg_max(value, fiscal_year) v1 FROM facts GROUP BY ALL), g AS (SELECT *, (v1 - v0) / abs(v0) * 100 growth FROM e WHERE v0 <> 0)"


def _ends(t):
    e = X.annual(t).groupBy("entity_id", "metric_id").agg(F.min(F.struct("fiscal_year", "value")).alias("a"), F.max(F.struct("fiscal_year", "value")).alias("b"))
    return e.where(F.col("a.value") != 0).select("entity_id", "metric_id", F.col("a.value").alias("v0"), F.col("b.value").alias("v1"), ((F.col("b.value") - F.col("a.value")) / F.abs("a.value") * 100).alias("growth"))


@R.query("signal_growth", f"WITH {_ENDS} SELECT entity_id, metric_id, round(growth, 4) growth, CASE WHEN growth > 5 THEN 'positive' WHEN growth < -5 THEN 'negative' ELSE 'neutral' END direction, CASE WHEN abs(growth) >= 15 THEN 'strong' WHEN abs(growth) >= 5 THEN 'moderate' ELSE 'weak' END strength FROM g")
def _(t):
    size = F.abs("growth")
    return _ends(t).select("entity_id", "metric_id", r4("growth"), F.when(F.col("growth") > 5, "positive").when(F.col("growth") < -5, "negative").otherwise("neutral").alias("direction"), F.when(size >= 15, "strong").when(size >= 5, "moderate").otherwise("weak").alias("strength"))


@R.query("signal_trend_consistency", f"WITH {CHANGE} SELECT entity_id, metric_id, round((sum((difference > 0)::INT) - sum((difference < 0)::INT))::DOUBLE / count(*), 4) consistency FROM chg GROUP BY ALL")
def _(t):
    c = D.change(X.annual(t), ["entity_id", "metric_id"], "fiscal_year")
    return c.groupBy("entity_id", "metric_id").agg(F.round(F.sum(F.signum("difference")) / F.count(F.lit(1)), 4).alias("consistency"))


@R.query("signal_divergence", f"WITH {_ENDS} SELECT a.entity_id, round(a.growth - b.growth, 4) spread, CASE WHEN a.growth - b.growth > 10 THEN 'negative' WHEN a.growth - b.growth < -10 THEN 'positive' ELSE 'neutral' END direction FROM g a JOIN g b USING (entity_id) WHERE a.metric_id = 'revenue' AND b.metric_id = 'quantity'")
def _(t):
    w = _ends(t).groupBy("entity_id").pivot("metric_id", ["revenue", "quantity"]).agg(F.max("growth")).dropna()
    s = F.col("revenue") - F.col("quantity")
    return w.select("entity_id", F.round(s, 4).alias("spread"), F.when(s > 10, "negative").when(s < -10, "positive").otherwise("neutral").alias("direction"))


@R.query("signal_ratio_change", f"WITH {FACTS} SELECT entity_id, round(arg_max(discount_value / gross_value * 100, fiscal_year) - arg_min(discount_value / gross_value * 100, fiscal_year), 4) change FROM wide GROUP BY 1")
def _(t):
    r = D.ratios(X.annual(t)).where("ratio_id = 'discount_rate'").groupBy("entity_id").agg(F.max(F.struct("fiscal_year", "value")).alias("b"), F.min(F.struct("fiscal_year", "value")).alias("a"))
    return r.select("entity_id", F.round(F.col("b.value") - F.col("a.value"), 4).alias("change"))


@R.query("signal_peer_percentile", f"WITH {FACTS}, k AS (SELECT industry, fiscal_year, entity_id, rank() OVER (PARTITION BY industry, fiscal_year ORDER BY value) - 1 below, count(*) OVER (PARTITION BY industry, fiscal_year, value) eq, count(*) OVER (PARTITION BY industry, fiscal_year) n FROM facts WHERE metric_id = 'revenue') SELECT industry, fiscal_year, entity_id, round((below + (eq - 1) / 2.0) / (n - 1), 4)::DOUBLE percentile FROM k WHERE n >= 2")
def _(t):
    w = Window.partitionBy("industry", "fiscal_year")
    k = X.annual(t).where("metric_id = 'revenue'").withColumn("below", F.rank().over(w.orderBy("value")) - 1).withColumn("eq", F.count(F.lit(1)).over(Window.partitionBy("industry", "fiscal_year", "value"))).withColumn("n", F.count(F.lit(1)).over(w))
    return k.where("n >= 2").select("industry", "fiscal_year", "entity_id", F.round((F.col("below") + (F.col("eq") - 1) / 2) / (F.col("n") - 1), 4).alias("percentile"))


# serving

@R.query("serve_facts", f"WITH {FACTS} SELECT fiscal_year, entity_id, metric_id, value FROM facts WHERE metric_id = 'revenue' AND fiscal_year BETWEEN 1996 AND 1999 ORDER BY fiscal_year DESC, entity_id, metric_id LIMIT 50")
def _(t):
    return X.annual(t).where("metric_id = 'revenue' and fiscal_year between 1996 and 1999").orderBy(F.desc("fiscal_year"), "entity_id", "metric_id").limit(50).select("fiscal_year", "entity_id", "metric_id", "value")


@R.query("serve_derived", f"WITH {CHANGE} SELECT entity_id, fiscal_year, round(growth, 4) growth FROM chg WHERE metric_id = 'revenue' AND entity_id = (SELECT min(n_name) FROM nation) ORDER BY fiscal_year DESC LIMIT 10")
def _(t):
    first = t.nation.agg(F.min("n_name").alias("entity_id"))
    c = D.change(X.annual(t).where("metric_id = 'revenue'"), ["entity_id"], "fiscal_year").join(first, "entity_id", "left_semi")
    return c.orderBy(F.desc("fiscal_year")).limit(10).select("entity_id", "fiscal_year", r4("growth"))


@R.query("search_names", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ar%' ORDER BY p_name, p_partkey LIMIT 20")
def _(t):
    return t.part.where(F.lower("p_name").contains("ar")).orderBy("p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@R.query("source_summary", f"WITH {LINES} SELECT l_returnflag source, count(*) n, count(DISTINCT n_name) entities, count(DISTINCT l_partkey) parts, sum((l_linestatus = 'F')::INT)::BIGINT finished, min(l_shipdate) first_date, max(l_shipdate) last_date FROM lines GROUP BY 1")
def _(t):
    return X.lines(t).groupBy(F.col("l_returnflag").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_name").alias("entities"), F.count_distinct("l_partkey").alias("parts"), F.sum((F.col("l_linestatus") == "F").cast("long")).alias("finished"), F.min("l_shipdate").alias("first_date"), F.max("l_shipdate").alias("last_date"))
