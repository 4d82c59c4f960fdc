"""Audits of a data set, windows and grouping sets, samples, and scans of source records."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import facts as X
from ..registry import Registry
from ..sources import scans
from .sqlviews import FACTS

R = Registry()


# scans: source records are written as JSON from the tables and read by the scanners

@R.query("scan_company_facts", """SELECT lpad(o_custkey::VARCHAR, 10, '0') cik, 'metric_' || o_orderstatus metric_id, o_orderpriority unit, strftime(o_orderdate, '%Y-%m-%d') AS "end", o_totalprice::DOUBLE val,
CASE WHEN o_orderkey % 5 = 0 THEN 'FY' WHEN o_orderkey % 3 = 0 THEN 'Q' || quarter(o_orderdate) || '_YTD' ELSE 'Q' || quarter(o_orderdate) END period_label FROM orders WHERE o_orderstatus <> 'P'""")
def _(t):
    """Every customer's orders as a company's facts: concept, unit and filed values with their periods; a concept without an alias goes."""
    quarter = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    start = F.date_sub(F.to_date("o_orderdate"), F.when(F.col("o_orderkey") % 3 == 0, 150).otherwise(90))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    value = F.struct(
        day(start).alias("start"), day("o_orderdate").alias("end"), F.col("o_totalprice").cast("decimal(38,10)").alias("val"), F.year("o_orderdate").alias("fy"),
        F.when(F.col("o_orderkey") % 5 == 0, "FY").otherwise(quarter).alias("fp"), F.lit("10-Q").alias("form"),
    )
    units = t.orders.groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(F.collect_list(value).alias("v"))
    concepts = units.groupBy("o_custkey", "o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "v"))).alias("units"))
    record = concepts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", F.struct("units")))).alias("c"))
    json = record.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.create_map(F.lit("tpch"), "c").alias("facts"))).alias("json"))
    aliases = t.spark.createDataFrame([("F", "metric_F"), ("O", "metric_O")], "concept string, metric_id string")
    return scans.company_facts(json, "json", aliases).select("cik", "metric_id", "unit", "end", F.col("val").cast("double").alias("val"), "period_label")


@R.query("scan_observations", "SELECT event_type series_id, ts::DATE period_end, count(*) n, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE total FROM events WHERE event_id % 10 <> 0 GROUP BY ALL")
def _(t):
    """Every user's events as a record of observations, a tenth of them missing and written as a dot."""
    value = F.when(F.col("event_id") % 10 == 0, ".").otherwise(F.col("value").cast("decimal(18,4)").cast("string"))
    o = t.events.groupBy("user_id", F.col("event_type").alias("series_id")).agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), value.alias("value"))).alias("observations"))
    found = scans.observations(o.select("series_id", F.to_json(F.struct("observations")).alias("json")), "json")
    return found.groupBy("series_id", "period_end").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@R.query("scan_indicators", f"WITH {FACTS} SELECT entity_id country, metric_id indicator, fiscal_year AS year, make_date(fiscal_year, 1, 1) period_start, make_date(fiscal_year, 12, 31) period_end, round(value, 2) AS value FROM facts")
def _(t):
    f = X.annual(t).select(F.struct(F.struct(F.col("entity_id").alias("id")).alias("country"), F.struct(F.col("metric_id").alias("id")).alias("indicator"), F.col("fiscal_year").cast("string").alias("date"), F.col("value").cast("decimal(28,4)").alias("value")).alias("o"))
    json = f.groupBy("o.country").agg(F.to_json(F.collect_list("o")).alias("json"))
    return scans.indicators(json, "json").withColumn("value", F.round(F.col("value").cast("double"), 2))


@R.query("scan_datamapper", f"WITH {FACTS} SELECT metric_id indicator, entity_id country, fiscal_year AS year, round(value, 2) AS value, fiscal_year >= 1997 is_forecast FROM facts")
def _(t):
    f = X.annual(t).withColumn("v", F.col("value").cast("decimal(28,4)"))
    years = f.groupBy("metric_id", "entity_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("fiscal_year").cast("string").alias("y"), "v"))).alias("m"))
    values = years.groupBy("metric_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_id", "m"))).alias("c"))
    json = values.select(F.to_json(F.struct(F.create_map("metric_id", "c").alias("values"))).alias("json"))
    return scans.datamapper(json, "json", F.lit(1997)).withColumn("value", F.round(F.col("value").cast("double"), 2))


@R.query("scan_active", "SELECT o_orderstatus, count(*) n FROM (SELECT o_orderstatus, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END is_active FROM orders) WHERE coalesce(is_active, 1) = 1 GROUP BY 1")
def _(t):
    active = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 0)
    return t.orders.where(F.coalesce(active, F.lit(1)) == 1).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@R.query("scan_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey, o_totalprice LIMIT 2000")
def _(t):
    """One page after a cursor; the page's size is the feature."""
    return t.orders.where("o_orderkey > 1000").orderBy("o_orderkey", "o_totalprice").limit(2000).select("o_orderkey", "o_totalprice")


@R.query("scan_metric_limit", f"WITH {FACTS} SELECT metric_id, entity_id, fiscal_year, value FROM (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY fiscal_year DESC, entity_id) k FROM facts) WHERE k <= 20")
def _(t):
    w = Window.partitionBy("metric_id").orderBy(F.desc("fiscal_year"), "entity_id")
    return X.annual(t).withColumn("k", F.row_number().over(w)).where("k <= 20").select("metric_id", "entity_id", "fiscal_year", "value")


@R.query("scan_document_index", "SELECT lang, source, count(*) n, count(DISTINCT sha256(coalesce(text, ''))) contents, min(doc_id) first_id FROM documents GROUP BY ALL")
def _(t):
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("contents"), F.min("doc_id").alias("first_id"))


@R.query("dedupe_content", "SELECT min(doc_id) doc_id, count(*) copies FROM documents GROUP BY source, sha256(coalesce(text, ''))")
def _(t):
    return t.documents.groupBy("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


# windows and groupings

@R.query("window_frames", f"WITH {FACTS} SELECT entity_id, fiscal_year, lead(value) OVER w AS next_value, round(avg(CAST(value AS DECIMAL(28,4))::DOUBLE) OVER (PARTITION BY entity_id ORDER BY fiscal_year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) moving, first_value(value) OVER w AS first_value FROM facts WHERE metric_id = 'quantity' WINDOW w AS (PARTITION BY entity_id ORDER BY fiscal_year)")
def _(t):
    w = Window.partitionBy("entity_id").orderBy("fiscal_year")
    f = X.annual(t).where("metric_id = 'quantity'")
    return f.select("entity_id", "fiscal_year", F.lead("value").over(w).alias("next_value"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 2).alias("moving"), F.first("value").over(w).alias("first_value"))


@R.query("window_ranks", "SELECT p_partkey, (ntile(4) OVER w)::INT AS quarter, (dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size))::INT AS dense, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) share FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)")
def _(t):
    w, ties = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"), Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(ties).alias("dense"), F.round(F.cume_dist().over(ties), 6).alias("share"))


@R.query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) n, sum(l_quantity)::DOUBLE quantity, (grouping(l_returnflag) * 2 + grouping(l_linestatus))::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"), F.grouping_id().cast("long").alias("level"))


@R.query("agg_rollup", "SELECT o_orderpriority, o_orderstatus, count(*) n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def _(t):
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@R.query("agg_grouping_sets", "SELECT o_orderpriority, o_orderstatus, year(o_orderdate)::INT yr, count(*) n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (year(o_orderdate)), ())")
def _(t):
    o = t.orders.withColumn("yr", F.year("o_orderdate"))
    return o.groupingSets([["o_orderpriority", "o_orderstatus"], ["yr"], []], "o_orderpriority", "o_orderstatus", "yr").agg(F.count(F.lit(1)).alias("n")).select("o_orderpriority", "o_orderstatus", "yr", "n")


@R.query("agg_approximate")
def _(t):
    """Sketches: distinct customers and a median of each status; tests hold them near the exact values."""
    return t.orders.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"), F.percentile_approx("o_totalprice", 0.5, 10000).alias("median"))


# samples

@R.query("sample_distractors", "SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('7|' || p_partkey), p_partkey) k FROM part) WHERE k <= 5")
def _(t):
    w = Window.partitionBy("p_brand").orderBy(F.sha2(F.concat(F.lit("7|"), F.col("p_partkey").cast("string")), 256), "p_partkey")
    return t.part.withColumn("k", F.row_number().over(w)).where("k <= 5").select("p_partkey", "p_brand")


@R.query("sample_nested_round_robin", "WITH a AS (SELECT c_custkey, c_nationkey % 3 m, c_mktsegment s, row_number() OVER (PARTITION BY c_nationkey % 3, c_mktsegment ORDER BY c_custkey) i FROM customer), b AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY i, s) j FROM a) SELECT c_custkey, m, s FROM b ORDER BY j, m LIMIT 100")
def _(t):
    """Markets in turn, within a market its segments in turn."""
    c = t.customer.select("c_custkey", (F.col("c_nationkey") % 3).alias("m"), F.col("c_mktsegment").alias("s"))
    c = c.withColumn("i", F.row_number().over(Window.partitionBy("m", "s").orderBy("c_custkey"))).where("i <= 100")
    return c.withColumn("j", F.row_number().over(Window.partitionBy("m").orderBy("i", "s"))).orderBy("j", "m").limit(100).select("c_custkey", "m", "s")


@R.query("select_family_balanced", "WITH a AS (SELECT p_partkey, p_brand f, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) k, p_size FROM part), q AS (SELECT * FROM a WHERE k <= 2), r AS (SELECT * FROM a WHERE k > 2 ORDER BY p_size DESC, p_partkey LIMIT 20) SELECT p_partkey, f FROM q UNION ALL SELECT p_partkey, f FROM r")
def _(t):
    """Two of each family, then the best of the rest."""
    a = t.part.select("p_partkey", F.col("p_brand").alias("f"), "p_size").withColumn("k", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("p_size"), "p_partkey")))
    rest = a.where("k > 2").orderBy(F.desc("p_size"), "p_partkey").limit(20)
    return a.where("k <= 2").unionByName(rest).select("p_partkey", "f")


# audits

@R.query("metric_pool_stats", f"WITH {FACTS} SELECT metric_id, count(*) n, count(DISTINCT industry) sources, count(DISTINCT entity_id) entities FROM facts GROUP BY 1")
def _(t):
    return X.annual(t).groupBy("metric_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("industry").alias("sources"), F.count_distinct("entity_id").alias("entities"))


_DIMS = {"priority": "o_orderpriority", "status": "o_orderstatus", "year": "CAST(year(o_orderdate) AS VARCHAR(10))", "size": "CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END", "market": "CAST(o_custkey % 7 AS VARCHAR(10))"}


@R.query("stat_slice_metrics", "WITH d AS (" + " UNION ALL ".join(f"SELECT '{n}' dimension, {x} slice, o_totalprice p, o_custkey c, o_orderstatus = 'F' ok FROM orders" for n, x in _DIMS.items()) + ") SELECT dimension, slice, count(*) n, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) rate, round(sum(CAST(p AS DECIMAL(18,2)))::DOUBLE / count(*), 2) mean, round(1 - count(DISTINCT c) / count(*)::DOUBLE, 6) duplicate_rate, count(*) < 30 too_small FROM d GROUP BY ALL")
def _(t):
    """Rates, means and duplicate rates of every slice of every dimension, by one pass over the rows."""
    arms = F.array(*[F.struct(F.lit(n).alias("dimension"), F.expr(x).alias("slice")) for n, x in _DIMS.items()])
    d = t.orders.select(F.explode(arms).alias("a"), "o_totalprice", "o_custkey", "o_orderstatus").select("a.*", "o_totalprice", "o_custkey", "o_orderstatus")
    n = F.count(F.lit(1))
    return d.groupBy("dimension", "slice").agg(
        n.alias("n"), F.round(F.count_if(F.col("o_orderstatus") == "F") / n, 6).alias("rate"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / n, 2).alias("mean"),
        F.round(1 - F.count_distinct("o_custkey") / n, 6).alias("duplicate_rate"), (n < 30).alias("too_small"),
    )


@R.query("stat_joint_counts", "SELECT o_orderpriority, o_orderstatus, count(*) n, round(quantile_cont(o_totalprice, 0.5), 5) median, round(quantile_cont(o_totalprice, 0.9), 5) p90, round(quantile_cont(o_totalprice, 0.95), 5) p95, max(o_totalprice) most FROM orders GROUP BY ALL")
def _(t):
    at = F.percentile("o_totalprice", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    g = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), at.alias("q"), F.max("o_totalprice").alias("most"))
    return g.select("o_orderpriority", "o_orderstatus", "n", *[F.round(F.col("q")[k], 5).alias(c) for k, c in enumerate(("median", "p90", "p95"))], "most")


_CELLS = {"task": "CASE WHEN o_orderkey % 2 = 0 THEN 'T2' ELSE 'T3' END", "topic": "o_orderpriority", "family": "o_orderstatus", "frequency": "CAST(o_custkey % 3 AS VARCHAR(5))", "span": "CASE WHEN o_totalprice > 150000 THEN 'long' ELSE 'short' END", "market": "CAST(o_custkey % 2 AS VARCHAR(5))", "answer": "CAST(month(o_orderdate) % 2 AS VARCHAR(5))"}


@R.query("stat_gap_cells", "WITH d AS (SELECT " + ", ".join(f"{x} {k}" for k, x in _CELLS.items()) + ", year(o_orderdate) < 1996 official FROM orders), o AS (SELECT * EXCLUDE official, count(*) n FROM d WHERE official GROUP BY ALL), c AS (SELECT * EXCLUDE official, count(*) m FROM d WHERE NOT official GROUP BY ALL), k AS (SELECT task, sum(n) total FROM o GROUP BY 1), g AS (SELECT o.*, coalesce(m, 0) have, greatest(1, round_even(500::DOUBLE * n / total, 0))::BIGINT target FROM o JOIN k USING (task) LEFT JOIN c USING (" + ", ".join(_CELLS) + ")) SELECT " + ", ".join(_CELLS) + ", n, have, target, greatest(target - have, 0)::BIGINT gap, (greatest(target - have, 0) * CASE WHEN have = 0 THEN 1.5 ELSE 1 END)::DOUBLE priority FROM g")
def _(t):
    """Cells of seven dimensions: how many rows the current set lacks of a target in proportion to the official one's cells."""
    d = t.orders.select(*[F.expr(x).alias(k) for k, x in _CELLS.items()], (F.year("o_orderdate") < 1996).alias("official"))
    g = d.groupBy(*_CELLS).agg(F.count_if("official").alias("n"), F.count_if(~F.col("official")).alias("have")).where("n > 0")
    share = F.col("n") * F.lit(500.0) / F.sum("n").over(Window.partitionBy("task"))
    g = g.withColumn("target", F.greatest(F.lit(1), F.bround(share, 0)).cast("long")).withColumn("gap", F.greatest(F.col("target") - F.col("have"), F.lit(0)).cast("long"))
    return g.withColumn("priority", F.col("gap") * F.when(F.col("have") == 0, 1.5).otherwise(1.0))


@R.query("diversity_funnel", "SELECT stage, count(DISTINCT o_orderpriority) patterns, count(DISTINCT o_custkey) sequences, count(DISTINCT (o_custkey, o_orderpriority)) plans, count(*) n FROM (SELECT *, unnest(list_filter(['proposed', CASE WHEN o_totalprice > 50000 THEN 'bound' END, CASE WHEN o_totalprice > 50000 AND o_orderstatus <> 'P' THEN 'passed' END, CASE WHEN o_totalprice > 50000 AND o_orderstatus = 'F' THEN 'exported' END], lambda x: x IS NOT NULL)) stage FROM orders) GROUP BY 1")
def _(t):
    bound = F.col("o_totalprice") > 50000
    stages = F.array(F.lit("proposed"), F.when(bound, "bound"), F.when(bound & (F.col("o_orderstatus") != "P"), "passed"), F.when(bound & (F.col("o_orderstatus") == "F"), "exported"))
    s = t.orders.withColumn("stage", F.explode(F.filter(stages, lambda x: x.isNotNull())))
    return s.groupBy("stage").agg(F.count_distinct("o_orderpriority").alias("patterns"), F.count_distinct("o_custkey").alias("sequences"), F.count_distinct(F.struct("o_custkey", "o_orderpriority")).alias("plans"), F.count(F.lit(1)).alias("n"))


@R.query("graph_utilisation", "WITH u AS (SELECT DISTINCT l_suppkey k FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT DISTINCT l_partkey k FROM lineitem WHERE l_returnflag = 'R') SELECT 'supplier' kind, count(*) n, count(u.k) used, round(count(u.k) / count(*)::DOUBLE, 6) share FROM supplier LEFT JOIN u ON k = s_suppkey UNION ALL SELECT 'part', count(*), count(p.k), round(count(p.k) / count(*)::DOUBLE, 6) FROM part LEFT JOIN p ON k = p_partkey")
def _(t):
    """Nodes of each kind that returned lines use, of all there are."""
    used = t.lineitem.where("l_returnflag = 'R'").select(F.explode(F.array(F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").cast("long").alias("k")), F.struct(F.lit("part").alias("kind"), F.col("l_partkey").cast("long").alias("k")))).alias("u")).select("u.*").distinct().withColumn("hit", F.lit(1))
    all_ = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("long").alias("k")).unionByName(t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").cast("long").alias("k")))
    return all_.join(used, ["kind", "k"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("used"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share"))


@R.query("entity_market_filter", "SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 4)) <@ [0, 1, 2] keep FROM lineitem GROUP BY 1")
def _(t):
    """Keeps a match only if all its entities are of the market."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set((F.col("l_suppkey") % 4).cast("int")).alias("m"))
    return g.select("l_orderkey", F.forall("m", lambda x: x.isin(0, 1, 2)).alias("keep"))


@R.query("constraint_consolidated", "WITH s AS (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_suppkey % 3 END scope, l_suppkey % 3 entity, CASE WHEN l_returnflag = 'R' THEN 'segment' WHEN l_returnflag = 'A' THEN 'consolidated_entity' END kind FROM lineitem) SELECT l_orderkey, bool_and(coalesce(kind, 'consolidated_entity') = 'consolidated_entity') consolidated, count(DISTINCT (coalesce(scope, entity), coalesce(kind, 'consolidated_entity'))) scopes FROM s GROUP BY 1")
def _(t):
    """The scope key of each fact, and whether a binding holds facts of consolidated entities only."""
    entity = F.col("l_suppkey") % 3
    scope = F.coalesce(F.when(F.col("l_linenumber") % 4 != 0, entity), entity)
    kind = F.coalesce(F.when(F.col("l_returnflag") == "R", "segment").when(F.col("l_returnflag") == "A", "consolidated_entity"), F.lit("consolidated_entity"))
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_and(kind == "consolidated_entity").alias("consolidated"), F.count_distinct(F.struct(scope.alias("s"), kind.alias("k"))).alias("scopes"))


@R.query("peer_slots", """WITH f AS (SELECT o_custkey e, year(o_orderdate) y, o_orderpriority d, max(o_totalprice) s FROM orders GROUP BY ALL), p AS (SELECT a.e, a.y, a.d, least(a.s, b.s) lo, greatest(a.s, b.s) hi, row_number() OVER (PARTITION BY a.e, a.y ORDER BY least(a.s, b.s) DESC, greatest(a.s, b.s) DESC, a.d DESC) k FROM f a JOIN f b ON a.e = b.e AND a.d = b.d AND b.y = a.y - 1)
SELECT e entity, y::INT AS year, d definition, lo least_score, hi best_score FROM p WHERE k = 1""")
def _(t):
    """For each entity and year, the definition that both it and the year before have, with the best of the lesser scores."""
    f = t.orders.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("definition")).agg(F.max("o_totalprice").alias("s"))
    before = f.select("entity", "definition", (F.col("year") + 1).alias("year"), F.col("s").alias("p"))
    pairs = f.join(before, ["entity", "definition", "year"])
    best = pairs.groupBy("entity", "year").agg(F.max(F.struct(F.least("s", "p").alias("least_score"), F.greatest("s", "p").alias("best_score"), "definition")).alias("b"))
    return best.select("entity", "year", "b.definition", "b.least_score", "b.best_score")


@R.query("derived_scope_metadata", f"WITH {FACTS}, known AS (SELECT industry, count(DISTINCT entity_id) total FROM facts GROUP BY 1) SELECT metric_id, fiscal_year, industry, CASE WHEN count(DISTINCT entity_id) = 1 THEN 'single_entity' WHEN count(DISTINCT entity_id) = max(total) THEN 'industry_universe' ELSE 'observed_graph_ready_universe' END AS scope, sha256(string_agg(DISTINCT entity_id, ',' ORDER BY entity_id)) members FROM facts JOIN known USING (industry) GROUP BY ALL")
def _(t):
    f = X.annual(t)
    known = f.groupBy(F.col("industry").alias("i")).agg(F.count_distinct("entity_id").alias("all"))
    g = f.groupBy("metric_id", "fiscal_year", "industry").agg(F.array_sort(F.collect_set("entity_id")).alias("m")).join(known, F.col("industry") == F.col("i"))
    scope = F.when(F.size("m") == 1, "single_entity").when(F.size("m") == F.col("all"), "industry_universe").otherwise("observed_graph_ready_universe")
    return g.select("metric_id", "fiscal_year", "industry", scope.alias("scope"), F.sha2(F.array_join("m", ","), 256).alias("members"))


@R.query("map_role_scopes", "SELECT l_orderkey, string_agg(k, ';' ORDER BY k) roles FROM (SELECT l_orderkey, l_returnflag || '=' || string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) k FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY 1")
def _(t):
    """A map from role to the entities bound to it."""
    r = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("m"))
    m = r.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", "m")))).alias("roles"))
    return m.select("l_orderkey", F.array_join(F.transform(F.map_entries("roles"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("roles"))
