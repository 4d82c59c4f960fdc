"""Dataset statistics, coverage and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as X, stats as T
from ..registry import Registry
from .sqlviews import FACTS

R = Registry()

@R.query("stat_tvd_jsd", """WITH a AS (SELECT c_mktsegment c, count(*)::DOUBLE / sum(count(*)) OVER () p FROM customer WHERE c_nationkey < 12 GROUP BY 1), b AS (SELECT c_mktsegment c, count(*)::DOUBLE / sum(count(*)) OVER () q FROM customer WHERE c_nationkey >= 12 GROUP BY 1),
j AS (SELECT coalesce(p, 0) p, coalesce(q, 0) q FROM a FULL JOIN b USING (c)) SELECT round(sum(abs(p - q)) / 2, 4) tvd, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 4) jsd FROM j""")
def _(t):
    c = F.col("c_mktsegment")
    return T.distances(T.distribution(t.customer.where("c_nationkey < 12"), c), T.distribution(t.customer.where("c_nationkey >= 12"), c))


@R.query("stat_entropy", "WITH p AS (SELECT n_name, event_type, count(*) n FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY ALL), q AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY n_name) s FROM p) SELECT n_name, round(-sum(s * log2(s)), 4) entropy, round(max(s), 4) largest FROM q GROUP BY 1")
def _(t):
    from pyspark.sql import Window

    e = t.events.join(t.nation, F.col("user_id") % 25 == F.col("n_nationkey")).groupBy("n_name", "event_type").agg(F.count(F.lit(1)).alias("n"))
    s = e.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("n_name")))
    return s.groupBy("n_name").agg(F.round(-F.sum(F.col("s") * F.log2("s")), 4).alias("entropy"), F.round(F.max("s"), 4).alias("largest"))


_W = "greatest(0, least(1, (h / n + {z} * {z} / (2 * n) {s} {z} * sqrt(h / n * (1 - h / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)))"


@R.query("stat_wilson", f"SELECT source, n::BIGINT n, h::BIGINT hits, round({_W.format(z=T.Z, s='-')}, 6) low, round({_W.format(z=T.Z, s='+')}, 6) high FROM (SELECT source, count(*)::DOUBLE n, sum(quality)::DOUBLE h FROM labels JOIN documents USING (doc_id) GROUP BY 1)")
def _(t):
    low, high = T.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    g = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("hits"))
    return g.select("source", "n", "hits", low.alias("low"), high.alias("high"))


_POINTS = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@R.query("stat_percentile_slices", "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 r, count(*) OVER (PARTITION BY event_type) n FROM events) SELECT event_type, " + ", ".join(f"max(value) FILTER (r = round_even((n - 1) * {q}::DOUBLE, 0)) {p}" for p, q in _POINTS.items()) + " FROM k GROUP BY 1")
def _(t):
    return T.nearest_rank(t.events, ["event_type"], "value", ["event_id"], _POINTS)


@R.query("stat_numeric_summary", "SELECT event_type, round(avg(value), 4) mean, round(quantile_cont(value, 0.5), 4) median, round(quantile_cont(value, 0.9), 4) p90, max(value) most FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 4).alias("p90"), F.max("value").alias("most"))


_LANGS = ["de", "en", "es", "fr"]


@R.query("stat_coverage_matrix", "WITH a AS (SELECT source, lang, count(*) n FROM documents GROUP BY ALL), b AS (SELECT source, lang, count(*) k FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT source, lang, coalesce(n, 0)::BIGINT n, coalesce(k, 0)::BIGINT labelled, coalesce(k, 0) > 0 covered FROM a FULL JOIN b USING (source, lang)")
def _(t):
    d = t.documents.select("doc_id", "source", "lang")
    a = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    b = d.join(t.labels, "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("labelled"))
    return a.join(b, ["source", "lang"], "full").fillna(0, ["n", "labelled"]).withColumn("covered", F.col("labelled") > 0)


@R.query("stat_gap_manifest", "WITH o AS (SELECT lang, source, count(*) n FROM documents GROUP BY ALL), c AS (SELECT lang, source, count(*) k FROM documents JOIN labels USING (doc_id) GROUP BY ALL), t AS (SELECT lang, source, greatest(1, round(200.0 * n / sum(n) OVER ()))::BIGINT target FROM o), g AS (SELECT lang, source, target, coalesce(k, 0)::BIGINT have, greatest(0, target - coalesce(k, 0))::BIGINT gap FROM t LEFT JOIN c USING (lang, source)) SELECT *, (gap * CASE WHEN have = 0 THEN 1.5 ELSE 1 END)::DOUBLE priority FROM g")
def _(t):
    from pyspark.sql import Window

    d = t.documents.select("doc_id", "lang", "source")
    o = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("target", F.greatest(F.lit(1), F.round(200.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))).cast("long")).drop("n")
    c = d.join(t.labels, "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("have"))
    g = o.join(c, ["lang", "source"], "left").fillna(0, ["have"]).withColumn("gap", F.greatest(F.lit(0).cast("long"), F.col("target") - F.col("have")))
    return g.withColumn("priority", F.col("gap") * F.when(F.col("have") == 0, 1.5).otherwise(1.0))


@R.query("stat_conditional_rates", "SELECT lang, count(*) n, round(avg(quality), 4) quality_rate, round(sum(toxic) FILTER (quality = 1)::DOUBLE / count(*) FILTER (quality = 1), 4) toxic_given_quality FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(t):
    good = F.col("quality") == 1
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 4).alias("quality_rate"), F.round(F.try_divide(F.sum(F.when(good, F.col("toxic"))), F.count_if(good)), 4).alias("toxic_given_quality"))


@R.query("coverage_grid_missing", "SELECT n_nationkey, y::INT AS year FROM nation, range(1995, 2003) r(y) EXCEPT SELECT c_nationkey, year(o_orderdate)::INT FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
def _(t):
    grid = t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(1995), F.lit(2002))).alias("year"))
    seen = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("year"))
    return grid.join(seen, ["n_nationkey", "year"], "left_anti")


@R.query("quality_level_case", "SELECT n_name, CASE WHEN n >= 70 THEN 'ready_high' WHEN n >= 60 THEN 'ready_medium' WHEN n > 0 THEN 'ready_low' ELSE 'missing' END AS level FROM (SELECT n_name, count(c_custkey) n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def _(t):
    n = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))
    return n.select("n_name", F.when(F.col("n") >= 70, "ready_high").when(F.col("n") >= 60, "ready_medium").when(F.col("n") > 0, "ready_low").otherwise("missing").alias("level"))


@R.query("metric_profile_coverage", f"WITH {FACTS}, m AS (SELECT entity_id, metric_id, count(DISTINCT fiscal_year) >= 5 ok FROM facts GROUP BY ALL) SELECT entity_id, sum(ok::INT)::BIGINT covered, sum(ok::INT) >= 3 AND bool_or(ok AND metric_id = 'revenue') AND bool_or(ok AND metric_id = 'quantity') passed FROM m GROUP BY 1")
def _(t):
    m = X.annual(t).groupBy("entity_id", "metric_id").agg((F.count_distinct("fiscal_year") >= 5).alias("ok"))
    one = lambda k: F.bool_or(F.col("ok") & (F.col("metric_id") == k))
    n = F.sum(F.col("ok").cast("long"))
    return m.groupBy("entity_id").agg(n.alias("covered"), ((n >= 3) & one("revenue") & one("quantity")).alias("passed"))


@R.query("multiset_digest", "SELECT count(*) n, sum(('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 12))::BIGINT)::VARCHAR digest FROM orders")
def _(t):
    h = F.conv(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("digest"))
