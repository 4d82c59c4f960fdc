"""Sample evaluation, release selection and build upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E, selection as S
from ..registry import Registry

R = Registry()

_FEATURES = """f AS (SELECT l_orderkey, count(*) fact_count, count(DISTINCT l_suppkey) entity_count, count(DISTINCT l_returnflag) metric_count, count(DISTINCT year(l_shipdate) * 12 + month(l_shipdate)) period_count,
  count(DISTINCT l_linestatus) source_count, count(DISTINCT l_partkey) scope_size, max(year(l_shipdate)) - min(year(l_shipdate)) time_span_years, max(l_linenumber) % 4 operation_depth, l_orderkey % 5 base FROM lineitem GROUP BY ALL),
d AS (SELECT *, round([0.0, 1.0, 2.0, 4.0, 6.0][base + 1]::DOUBLE + least(fact_count, 10) * 0.25::DOUBLE + (entity_count - 1) * 0.6::DOUBLE + (metric_count - 1) * 0.6::DOUBLE + least(period_count - 1, 4) * 0.2::DOUBLE
  + greatest(operation_depth - 1, 0) * 1.4::DOUBLE + least(time_span_years, 10) * 0.08::DOUBLE + (source_count - 1) * 0.5::DOUBLE + log2(scope_size) * 0.2::DOUBLE, 3) score FROM f),
k AS (SELECT *, CASE WHEN score < 2.5 THEN 'easy' WHEN score < 5.5 THEN 'medium' WHEN score < 9.5 THEN 'hard' WHEN score < 18 THEN 'expert' ELSE 'research' END AS level,
  array_to_string(list_filter([CASE WHEN period_count >= 3 THEN 'period_count>=3' END, CASE WHEN operation_depth >= 2 THEN 'reasoning_operation_depth>=2' END, CASE WHEN source_count >= 2 THEN 'source_count>=2' END,
  CASE WHEN scope_size = 7 THEN 'scope_completeness' END, CASE WHEN base = 4 THEN 'structured_multi_item_answer' END, CASE WHEN entity_count >= 2 AND period_count >= 2 THEN 'multi_entity_multi_period' END], lambda x: x IS NOT NULL), ',') reasons FROM d)"""


def _samples(t):
    """One sample an order, with the features, score, level and task of a question about it."""
    ship = F.col("l_shipdate")
    f = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("fact_count"), F.count_distinct("l_suppkey").alias("entity_count"), F.count_distinct("l_returnflag").alias("metric_count"),
        F.count_distinct(F.year(ship) * 12 + F.month(ship)).alias("period_count"), F.count_distinct("l_linestatus").alias("source_count"),
        F.count_distinct("l_partkey").alias("scope_size"), (F.max(F.year(ship)) - F.min(F.year(ship))).alias("time_span_years"), (F.max("l_linenumber") % 4).alias("operation_depth"),
    )
    base = F.element_at(F.array(*[F.lit(x) for x in E.BASE_COST]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    f = f.withColumn("score", E.difficulty(f.columns, base))
    answer = F.when(base == "research", "table").otherwise("number")
    reasons = E.task_reasons(F.col("period_count"), F.col("entity_count"), F.col("operation_depth"), F.col("source_count"), F.col("scope_size") == 7, answer)
    return f.withColumns({"level": E.level(F.col("score")), "reasons": F.array_join(reasons, ",")})


@R.query("difficulty_score", f"WITH {_FEATURES} SELECT l_orderkey, score, level FROM k")
def _(t):
    return _samples(t).select("l_orderkey", "score", "level")


@R.query("task_classification", f"WITH {_FEATURES} SELECT l_orderkey, CASE WHEN reasons = '' THEN 'T2' ELSE 'T3' END task, reasons FROM k")
def _(t):
    return _samples(t).select("l_orderkey", F.when(F.col("reasons") == "", "T2").otherwise("T3").alias("task"), "reasons")


@R.query("task_difficulty_matrix", f"WITH {_FEATURES}, c AS (SELECT CASE WHEN reasons = '' THEN 'T2' ELSE 'T3' END task, level, count(*) n FROM k GROUP BY ALL) SELECT task, level, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY task), 6) share FROM c")
def _(t):
    from pyspark.sql import Window

    c = _samples(t).groupBy(F.when(F.col("reasons") == "", "T2").otherwise("T3").alias("task"), "level").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("task")), 6))


OWNERS = {"d1": "r1", "d2": "r2", "d3": "r3", "d4": "r1"}
WEIGHTS = {"d1": 0.4, "d2": 0.3, "d3": 0.2, "d4": 0.1}


@R.query("judge_decision", """WITH s AS (SELECT l_orderkey, l_linenumber, 1 + l_quantity::INT % 5 s, [0.4, 0.3, 0.2, 0.1][l_linenumber] w FROM lineitem WHERE l_linenumber <= 4),
p AS (SELECT l_orderkey, l_linenumber, w, max(s)::DOUBLE s FROM s GROUP BY ALL), j AS (SELECT l_orderkey, CASE WHEN count(*) = 4 THEN round(sum(w::DOUBLE * (s - 1) / 4) * 100, 6) END score FROM p GROUP BY 1),
o AS (SELECT l_orderkey, bool_or(l_quantity = 50 AND l_returnflag = 'R') fatal, count(*) * 20 role_value FROM lineitem GROUP BY 1)
SELECT l_orderkey, score, CASE WHEN fatal THEN 'rejected_subjective_fatal' WHEN score IS NULL THEN 'manual_review' WHEN score >= 80 THEN 'accepted' WHEN score >= 70 AND role_value >= 70 AND l_orderkey % 2 = 0 THEN 'accepted_for_coverage' WHEN score >= 60 THEN 'manual_review' ELSE 'rejected_subjective_quality' END decision
FROM o LEFT JOIN j USING (l_orderkey)""")
def _(t):
    n = F.col("l_linenumber") - 1
    rows = t.lineitem.select("l_orderkey", F.concat(F.lit("r"), n % 3 + 1).alias("role"), F.concat(F.lit("d"), n % 4 + 1).alias("dimension"), (1 + F.col("l_quantity").cast("int") % 5).alias("score"))
    judged = E.subjective_score(rows, "l_orderkey", OWNERS, WEIGHTS)
    o = t.lineitem.groupBy("l_orderkey").agg(F.bool_or((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "R")).alias("fatal"), (F.count(F.lit(1)) * 20).alias("role_value"))
    j = o.join(judged, "l_orderkey", "left")
    return j.select("l_orderkey", "score", E.decision(F.col("score"), F.col("fatal"), F.lit(False), F.col("role_value"), F.col("l_orderkey") % 2 == 0).alias("decision"))


@R.query("issue_code_report", """WITH c AS (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'adversarial_reviewer' ELSE 'r' || l_linenumber END AS role, unnest([l_returnflag, l_linestatus]) issue, l_linenumber = 7 AND l_quantity > 25 sure FROM lineitem),
p AS (SELECT l_orderkey, issue, count(DISTINCT role) roles, bool_or(sure) sure FROM c GROUP BY ALL) SELECT issue, count(*) any_judge, count(*) FILTER (roles >= 2) two_or_more, count(*) FILTER (sure) confirmed FROM p GROUP BY 1""")
def _(t):
    role = F.when(F.col("l_linenumber") == 7, "adversarial_reviewer").otherwise(F.concat(F.lit("r"), "l_linenumber"))
    calls = t.lineitem.select("l_orderkey", role.alias("role"), F.array("l_returnflag", "l_linestatus").alias("issue_codes"), (F.col("l_quantity") > 25).alias("resolved"))
    return E.issue_report(calls, "l_orderkey")


@R.query("adjudication_reasons", """WITH r AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 200000 THEN 'total_score_disagreement' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'low_confidence' END, CASE WHEN o_orderstatus = 'P' THEN 'missing_dimensions' END], lambda x: x IS NOT NULL) r FROM orders),
e AS (SELECT o_orderkey, unnest(CASE WHEN len(r) = 0 THEN ['unclassified_unresolved'] WHEN len(r) > 1 THEN list_append(r, 'multiple_reasons') ELSE r END) reason FROM r),
x AS (SELECT reason, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) examples FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY o_orderkey) k FROM e WHERE reason <> 'multiple_reasons') WHERE k <= 20 GROUP BY 1)
SELECT reason, count(*) n, any_value(examples) examples FROM e LEFT JOIN x USING (reason) GROUP BY 1""")
def _(t):
    rules = {"total_score_disagreement": F.col("o_totalprice") > 200000, "low_confidence": F.col("o_orderpriority") == "5-LOW", "missing_dimensions": F.col("o_orderstatus") == "P"}
    return E.reason_counts(t.orders, "o_orderkey", rules, "unclassified_unresolved")


@R.query("dataset_role_value", """WITH d AS (SELECT doc_id, lang, source, doc_id % 5 <> 0 train FROM documents), n AS (SELECT lang, count(*) FILTER (train) have, sum(count(*) FILTER (train)) OVER () * 0.3::DOUBLE target FROM d GROUP BY 1),
g AS (SELECT lang, CASE WHEN target <= 0 OR have >= target THEN 0.0 ELSE round(100.0 * (target - have) / target, 6) END gap FROM n), s AS (SELECT source, count(*) FILTER (train) k FROM d GROUP BY 1)
SELECT doc_id, round(0.85::DOUBLE * gap::DOUBLE + 0.1::DOUBLE * CASE WHEN k <= 40 THEN 100.0 ELSE round(4000.0::DOUBLE / k, 6) END + CASE WHEN train THEN 5 ELSE 0 END, 4) AS value FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang JOIN s ON d.source IS NOT DISTINCT FROM s.source""")
def _(t):
    from pyspark.sql import Window

    d = t.documents.select("doc_id", "lang", "source", (F.col("doc_id") % 5 != 0).alias("train"))
    have = F.count_if("train")
    n = d.groupBy(F.col("lang").alias("_l")).agg(have.alias("have")).withColumn("target", F.sum("have").over(Window.partitionBy()) * 0.3)
    g = n.select("_l", E.gap_value(F.col("target"), F.col("have")).alias("gap"))
    s = d.groupBy(F.col("source").alias("_s")).agg(have.alias("k"))
    j = d.join(g, F.col("lang").eqNullSafe(F.col("_l"))).join(s, F.col("source").eqNullSafe(F.col("_s")))
    return j.select("doc_id", F.round(0.85 * F.col("gap") + 0.1 * E.capacity_value(F.col("k"), 40) + F.when(F.col("train"), 5).otherwise(0), 4).alias("value"))


@R.query("retention_plan", """WITH b AS (SELECT n_nationkey build_id, n_nationkey % 4 <> 1 ok, n_nationkey % 3 <> 0 good, n_nationkey = 2 active, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) n_nodes FROM nation),
h AS (SELECT build_id FROM b WHERE ok AND good AND n_nodes > 0 ORDER BY build_id DESC LIMIT 2) SELECT build_id, n_nodes, CASE WHEN build_id IN (SELECT build_id FROM h) OR active OR build_id = 7 THEN 'hot' WHEN n_nodes > 0 THEN 'archive' ELSE 'empty' END AS action FROM b""")
def _(t):
    n = t.customer.groupBy(F.col("c_nationkey").alias("build_id")).agg(F.count(F.lit(1)).alias("n_nodes"))
    k = F.col("n_nationkey")
    builds = t.nation.select(
        k.alias("build_id"), F.when(k % 4 != 1, "success").otherwise("failed").alias("status"), F.when(k % 3 != 0, "passed").otherwise("failed").alias("quality_status"), F.when(k == 2, 1).otherwise(0).alias("is_active"),
        F.lit(None).cast("date").alias("completed_at"), F.date_add(F.lit("2024-01-01").cast("date"), k).alias("started_at"), F.lit(0).alias("n_edges"),
    ).join(n, "build_id", "left").fillna(0, ["n_nodes"])
    return E.retention(builds, 2, [7]).select("build_id", "n_nodes", "action")


@R.query("latest_per_key", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC NULLS LAST) k FROM conversations) WHERE k = 1")
def _(t):
    return E.latest(t.conversations, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role")


@R.query("bundle_missing_checks", "WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) s FROM lineitem GROUP BY 1) SELECT o_orderkey, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(coalesce(s, []), x)), ',') missing FROM orders LEFT JOIN s ON o_orderkey = l_orderkey")
def _(t):
    seen = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("s"))
    need = F.array(*[F.lit(x) for x in "ANR"])
    return t.orders.select("o_orderkey").join(seen, "o_orderkey", "left").select("o_orderkey", F.array_join(F.array_except(need, F.coalesce("s", F.array().cast("array<string>"))), ",").alias("missing"))


_STAGES = {"candidate": "true", "closed": "o_orderstatus = 'F'", "large": "o_orderstatus = 'F' and o_totalprice > 100000", "urgent": "o_orderstatus = 'F' and o_totalprice > 100000 and o_orderpriority = '1-URGENT'"}


@R.query("production_funnel", " UNION ALL ".join(f"SELECT '{n}' stage, count(*) n, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) of_all FROM orders WHERE {w}" for n, w in _STAGES.items()))
def _(t):
    one = t.orders.agg(*[F.count_if(F.expr(w)).alias(n) for n, w in _STAGES.items()])
    return one.withColumn("all", F.col("candidate")).unpivot(["all"], list(_STAGES), "stage", "n").select("stage", "n", F.round(F.try_divide("n", "all"), 6).alias("of_all"))


_QUOTA = """c AS (SELECT c_mktsegment || (c_nationkey % 5) g, count(*) n FROM customer GROUP BY 1), x AS (SELECT g, n, (60 - count(*) OVER ()) * (n - 1)::DOUBLE / (sum(n - 1) OVER ()) e, count(*) OVER () strata FROM c),
y AS (SELECT g, n, 1 + least(n - 1, floor(e))::BIGINT base, floor(e) - e rest FROM x), z AS (SELECT *, CASE WHEN base < n THEN row_number() OVER (ORDER BY base >= n, rest, g) END r, 60 - sum(base) OVER () spare FROM y),
q AS (SELECT g, (base + coalesce(r <= spare, false)::INT)::BIGINT quota FROM z)"""


@R.query("quota_stratum_take", f"WITH {_QUOTA} SELECT c_custkey, g FROM (SELECT c_custkey, c_mktsegment || (c_nationkey % 5) g, row_number() OVER (PARTITION BY c_mktsegment || (c_nationkey % 5) ORDER BY c_custkey) k FROM customer) JOIN q USING (g) WHERE k <= quota")
def _(t):
    c = t.customer.select("c_custkey", F.concat("c_mktsegment", (F.col("c_nationkey") % 5).cast("string")).alias("g"))
    counts = c.groupBy("g").agg(F.count(F.lit(1)).alias("n"))  # one row a stratum
    return S.take_quotas(c, "g", S.stratum_quotas(counts, "g", "n", 60), ["c_custkey"])


@R.query("sample_round_robin", "SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) k FROM part) ORDER BY k, p_brand LIMIT 50")
def _(t):
    return S.round_robin(t.part.select("p_partkey", "p_brand"), "p_brand", ["p_partkey"], 50)


@R.query("quota_release")
def _(t):
    c = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment", (F.col("c_nationkey") % 2).alias("half"))
    segments = [r[0] for r in c.select("c_mktsegment").distinct().collect()]
    return S.release(c, "c_custkey", "c_acctbal", {"c_mktsegment": {s: 1 / len(segments) for s in sorted(segments)}, "half": {"0": 0.5, "1": 0.5}}, 40)
