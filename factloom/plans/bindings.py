"""Operation DAGs over bound facts, group constraints, samples, quotas and splits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import facts as X
from ..registry import Registry
from .dag import Step, compile_dag
from .sqlviews import FACTS

R = Registry()

_B = FACTS + ", bound AS (SELECT industry binding, entity_id, fiscal_year, metric_id, value FROM facts)"


def _relations(t):
    """Bound relations by metric, and those of two years."""
    f = X.annual(t).withColumnRenamed("industry", "binding")
    one = lambda m, y=None: f.where((F.col("metric_id") == m) & (F.col("fiscal_year") == y if y else F.lit(True))).select("binding", "entity_id", "fiscal_year", "value")
    out = {m: one(m) for m in X.METRICS}
    return out | {f"{m}_{y}": one(m, y) for m in X.METRICS for y in (1996, 1997)}


def _dag(name, steps, sql, columns=("binding", "entity_id", "fiscal_year", "value")):
    @R.query(f"op_{name}", f"WITH {_B} {sql}")
    def _(t):
        out = compile_dag([Step(*s[:3], s[3] if len(s) > 3 else {}) for s in steps], _relations(t))
        return out.select(*[F.round(c, 4).alias(c) if c == "value" else F.col(c) for c in columns])


_REV = "SELECT * FROM bound WHERE metric_id = 'revenue'"
_dag("lookup", [("a", "lookup", ("revenue",), {"year": 1996})], "SELECT binding, entity_id, fiscal_year, round(value, 4) AS value FROM bound WHERE metric_id = 'revenue' AND fiscal_year = 1996")
_dag("mean", [("a", "mean", ("revenue",))], "SELECT binding, round(sum(CAST(value AS DECIMAL(28,4)))::DOUBLE / count(*), 4) AS value FROM bound WHERE metric_id = 'revenue' GROUP BY 1", ("binding", "value"))
for _n, _d in (("argmax", "DESC"), ("argmin", "")):
    _dag(_n, [("a", _n, ("revenue",))], f"SELECT binding, entity_id, fiscal_year, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY binding ORDER BY value {_d}, entity_id, fiscal_year) k FROM bound WHERE metric_id = 'revenue') WHERE k = 1")
_dag("rank", [("a", "rank", ("revenue_1996",), {"top_k": 3})], "SELECT * FROM (SELECT binding, entity_id, round(value, 4) AS value, (row_number() OVER (PARTITION BY binding ORDER BY value DESC, entity_id))::INT AS rank FROM bound WHERE metric_id = 'revenue' AND fiscal_year = 1996) WHERE rank <= 3", ("binding", "entity_id", "value", "rank"))
_dag("filter", [("a", "filter", ("quantity",), {"op": "gte", "value": 1000.0})], "SELECT binding, entity_id, fiscal_year, round(value, 4) AS value FROM bound WHERE metric_id = 'quantity' AND value >= 1000")
_PAIR = "(SELECT * FROM bound WHERE metric_id = 'revenue' AND fiscal_year = 1997) a JOIN (SELECT * FROM bound WHERE metric_id = 'revenue' AND fiscal_year = 1996) b ON a.binding = b.binding"
_dag("growth_by_entity", [("g", "growth_by_entity", ("revenue_1997", "revenue_1996"))], f"SELECT a.binding, a.entity_id, a.fiscal_year, round((a.value - b.value) / abs(b.value) * 100, 4) AS value FROM {_PAIR} AND a.entity_id = b.entity_id WHERE b.value <> 0")
_dag("ratio_by_entity", [("r", "ratio_by_entity", ("tax_value_1996", "revenue_1996"))], "SELECT a.binding, a.entity_id, a.fiscal_year, round(a.value / b.value * 100, 4) AS value FROM bound a JOIN bound b USING (binding, entity_id, fiscal_year) WHERE a.metric_id = 'tax_value' AND b.metric_id = 'revenue' AND fiscal_year = 1996 AND b.value <> 0")
_MAXMIN = "x AS (SELECT *, row_number() OVER (PARTITION BY binding ORDER BY value DESC, entity_id) hi, row_number() OVER (PARTITION BY binding ORDER BY value, entity_id) lo FROM bound WHERE metric_id = 'revenue' AND fiscal_year = 1996)"
_dag("difference", [("a", "argmax", ("revenue_1996",)), ("b", "argmin", ("revenue_1996",)), ("d", "difference", ("a", "b"))], f", {_MAXMIN} SELECT a.binding, a.entity_id, a.fiscal_year, round(a.value - b.value, 4) AS value FROM x a JOIN x b USING (binding) WHERE a.hi = 1 AND b.lo = 1")
_dag("compare", [("a", "argmax", ("revenue_1996",)), ("b", "argmin", ("revenue_1996",)), ("c", "compare", ("b", "a"))], f", {_MAXMIN} SELECT a.binding, CASE WHEN a.value = b.value THEN 'equal' ELSE a.entity_id END entity_id, a.fiscal_year, round(abs(a.value - b.value), 4) AS value FROM x a JOIN x b USING (binding) WHERE a.hi = 1 AND b.lo = 1")
_dag("select_by_period", [("a", "argmax", ("revenue",)), ("s", "select_by_period", ("a", "quantity"))], "SELECT b.binding, b.entity_id, b.fiscal_year, round(b.value, 4) AS value FROM bound b JOIN (SELECT binding, fiscal_year FROM (SELECT *, row_number() OVER (PARTITION BY binding ORDER BY value DESC, entity_id, fiscal_year) k FROM bound WHERE metric_id = 'revenue') WHERE k = 1) m USING (binding, fiscal_year) WHERE b.metric_id = 'quantity'")
_dag("intersect_on_entity", [("f", "filter", ("quantity_1996",), {"op": "gt", "value": 500.0}), ("i", "intersect_on_entity", ("revenue_1996", "f"))], "SELECT binding, entity_id, fiscal_year, round(value, 4) AS value FROM bound b WHERE metric_id = 'revenue' AND fiscal_year = 1996 AND EXISTS (SELECT 1 FROM bound q WHERE q.binding = b.binding AND q.entity_id = b.entity_id AND q.metric_id = 'quantity' AND q.fiscal_year = 1996 AND q.value > 500)")
_dag("lookup_ranked_entities", [("r", "rank", ("revenue_1996",), {"top_k": 3}), ("l", "lookup_ranked_entities", ("r", "quantity_1996"), {"target_ranks": [1, 3]})], "SELECT binding, entity_id, rank, round(q.value, 4) AS value FROM (SELECT *, (row_number() OVER (PARTITION BY binding ORDER BY value DESC, entity_id))::INT AS rank FROM bound WHERE metric_id = 'revenue' AND fiscal_year = 1996) k JOIN bound q USING (binding, entity_id, fiscal_year) WHERE rank IN (1, 3) AND q.metric_id = 'quantity'", ("binding", "entity_id", "rank", "value"))
_dag("multi_factor_screen", [
    ("g", "growth_by_entity", ("revenue_1997", "revenue_1996")), ("d", "ratio_by_entity", ("discount_value_1997", "gross_value_1997")),
    ("m", "ratio_by_entity", ("tax_value_1997", "revenue_1997")), ("s", "multi_factor_screen", ("g", "d", "m"), {"growth_above": 0.0, "rate_below": 70.0})],
    """, ww AS (SELECT industry binding, entity_id, max(revenue) FILTER (fiscal_year = 1997) r1, max(revenue) FILTER (fiscal_year = 1996) r0, max(discount_value / gross_value * 100) FILTER (fiscal_year = 1997) rate, max(tax_value / revenue * 100) FILTER (fiscal_year = 1997) margin FROM wide GROUP BY ALL),
    m AS (SELECT *, avg(margin) OVER (PARTITION BY binding) mean FROM ww) SELECT binding, entity_id, round(margin, 4) AS value, (row_number() OVER (PARTITION BY binding ORDER BY margin DESC, entity_id))::INT AS rank FROM m WHERE (r1 - r0) / abs(r0) * 100 > 0 AND rate < 70 AND margin > mean""",
    ("binding", "entity_id", "value", "rank"))

# group constraints


@R.query("constraint_same", "SELECT o_custkey, count(DISTINCT coalesce(lower(trim(o_orderstatus)), '')) = 1 same FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg((F.count_distinct(F.coalesce(F.lower(F.trim("o_orderstatus")), F.lit(""))) == 1).alias("same"))


@R.query("constraint_contiguous", "SELECT o_custkey, max(y) - min(y) + 1 = count(*) contiguous FROM (SELECT DISTINCT o_custkey, year(o_orderdate) y FROM orders) GROUP BY 1")
def _(t):
    y = F.year("o_orderdate")
    return t.orders.groupBy("o_custkey").agg((F.max(y) - F.min(y) + 1 == F.count_distinct(y)).alias("contiguous"))


@R.query("constraint_coverage", "WITH s AS (SELECT n_regionkey k, list_sort(list(DISTINCT n_nationkey)) m FROM nation GROUP BY 1), f AS (SELECT n_regionkey k, list_sort(list(DISTINCT c_nationkey)) m FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1) SELECT s.k, coalesce(s.m = f.m, false) covered FROM s LEFT JOIN f USING (k)")
def _(t):
    scope = t.nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_set("n_nationkey")).alias("a"))
    found = t.customer.where("c_acctbal > 9000").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_set("c_nationkey")).alias("b"))
    return scope.join(found, "k", "left").select("k", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("covered"))


@R.query("constraint_between_days", "SELECT l_returnflag, sum((l_shipdate::DATE - o_orderdate::DATE BETWEEN 0 AND 60)::INT)::BIGINT inside, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_returnflag").agg(F.sum(F.datediff("l_shipdate", "o_orderdate").between(0, 60).cast("long")).alias("inside"), F.count(F.lit(1)).alias("n"))


@R.query("constraint_registered_pair", "SELECT a.l_orderkey, count(*) n FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag < b.l_returnflag WHERE a.l_returnflag || b.l_returnflag IN ('AN', 'NR') GROUP BY 1")
def _(t):
    s = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    pairs = [F.arrays_overlap("s", F.array(F.lit(a))) & F.arrays_overlap("s", F.array(F.lit(b))) for a, b in (("A", "N"), ("N", "R"))]
    n = sum((p.cast("long") for p in pairs), F.lit(0).cast("long"))
    return s.select("l_orderkey", n.alias("n")).where("n > 0")


# samples, quotas, splits


@R.query("sample_stratified_round_robin", "WITH h AS (SELECT c_custkey, c_mktsegment, sha256(c_custkey::VARCHAR) h FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h) d FROM h) SELECT c_custkey, c_mktsegment FROM k WHERE d <= 5 ORDER BY d, sha256(c_mktsegment) LIMIT 20")
def _(t):
    h = t.customer.select("c_custkey", "c_mktsegment", F.sha2(F.col("c_custkey").cast("string"), 256).alias("h"))
    k = h.withColumn("d", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("h"))).where("d <= 5")
    return k.orderBy("d", F.sha2("c_mktsegment", 256)).limit(20).select("c_custkey", "c_mktsegment")


@R.query("sample_root_stratum", "WITH h AS (SELECT c_custkey, c_nationkey, sha256(c_custkey::VARCHAR) h FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY h) k FROM h), o AS (SELECT * FROM r ORDER BY (k > 1), h LIMIT 40) SELECT c_custkey, c_nationkey FROM o")
def _(t):
    h = t.customer.select("c_custkey", "c_nationkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("h"))
    r = h.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("h")))
    return r.orderBy(F.col("k") > 1, "h").limit(40).select("c_custkey", "c_nationkey")


@R.query("sample_freq_capped", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY sha256(event_id::VARCHAR)) k FROM events) WHERE k <= 2")
def _(t):
    w = Window.partitionBy("user_id", F.date_trunc("month", "ts")).orderBy(F.sha2(F.col("event_id").cast("string"), 256))
    return t.events.withColumn("k", F.row_number().over(w)).where("k <= 2").select("event_id")


@R.query("quota_largest_remainder", "WITH c AS (SELECT c_mktsegment g, count(*) n FROM customer GROUP BY 1), s AS (SELECT g, n * 101.0::DOUBLE / sum(n) OVER () x FROM c), f AS (SELECT g, floor(x)::BIGINT base, round(x - floor(x), 9) rest FROM s), k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, g) r, 101 - sum(base) OVER () spare FROM f) SELECT g, (base + (r <= spare)::INT)::BIGINT quota FROM k")
def _(t):
    c = t.customer.groupBy(F.col("c_mktsegment").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    x = c.join(total).withColumn("x", F.col("n") * 101.0 / F.col("total"))
    f = x.select("g", F.floor("x").alias("base"), F.round(F.col("x") - F.floor("x"), 9).alias("rest"))
    every = Window.partitionBy()
    k = f.withColumn("r", F.row_number().over(Window.orderBy(F.desc("rest"), "g"))).withColumn("spare", 101 - F.sum("base").over(every))
    return k.select("g", (F.col("base") + (F.col("r") <= F.col("spare")).cast("long")).alias("quota"))


_BUCKET = "('0x' || substr(sha1(c_custkey::VARCHAR), 1, 8))::BIGINT"


@R.query("split_hash_buckets", f"SELECT c_custkey, CASE WHEN {_BUCKET} % 20 = 0 THEN 'entity_holdout' WHEN {_BUCKET} % 100 < 80 THEN 'train' WHEN {_BUCKET} % 100 < 90 THEN 'dev' ELSE 'test' END split FROM customer")
def _(t):
    b = F.conv(F.substring(F.sha1(F.col("c_custkey").cast("string")), 1, 8), 16, 10).cast("long")
    split = F.when(b % 20 == 0, "entity_holdout").when(b % 100 < 80, "train").when(b % 100 < 90, "dev").otherwise("test")
    return t.customer.select("c_custkey", split.alias("split"))


@R.query("split_overlap_audit", "WITH s AS (SELECT o_custkey k, CASE o_orderkey % 3 WHEN 0 THEN 'test' ELSE 'train' END split FROM orders) SELECT count(*) n_keys, sum((n > 1)::INT)::BIGINT overlapping FROM (SELECT k, count(DISTINCT split) n FROM s GROUP BY 1)")
def _(t):
    s = t.orders.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("split"))
    return s.groupBy("k").agg(F.count_distinct("split").alias("n")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum((F.col("n") > 1).cast("long")).alias("overlapping"))
