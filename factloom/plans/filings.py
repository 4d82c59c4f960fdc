"""Filed values, entities, names and definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filings as X
from ..registry import Registry

R = Registry()

FORMS = ("10-K", "20-F", "40-F", "10-K/A", "20-F/A", "10-Q", "10-Q/A", "8-K")
_CANDIDATES = """c AS (SELECT l_suppkey entity_id, l_returnflag metric_id, l_returnflag = 'R' point, year(l_shipdate)::INT fy, ['FY', 'Q1', 'Q2', 'Q3', 'Q4'][l_linenumber % 5 + 1] fp, l_shipdate::DATE s,
  CASE WHEN l_partkey % 11 > 0 THEN l_shipdate::DATE + (l_partkey % 400)::INT END e, ['10-K', '20-F', '40-F', '10-K/A', '20-F/A', '10-Q', '10-Q/A', '8-K'][l_quantity::INT % 8 + 1] form, l_orderkey * 10 + l_linenumber accn,
  CASE l_linenumber % 3 WHEN 1 THEN 'CY' || year(l_shipdate) WHEN 2 THEN 'cy' || year(l_shipdate) || ['FY', 'Q1', 'Q2', 'Q3', 'Q4'][l_linenumber % 5 + 1] END frame FROM lineitem),
n AS (SELECT *, e - s + 1 n FROM c), r AS (SELECT *, CASE WHEN point THEN 'instant' WHEN fp = 'FY' THEN 'annual_flow' WHEN n IS NULL THEN 'quarter_or_ytd_unknown' WHEN n <= 120 THEN 'quarter_flow' ELSE 'ytd_flow' END AS role FROM n),
k AS (SELECT *, CASE WHEN role IN ('annual_flow', 'instant') THEN CASE form WHEN '10-K' THEN 100 WHEN '20-F' THEN 95 WHEN '40-F' THEN 95 WHEN '10-K/A' THEN 75 WHEN '20-F/A' THEN 70 WHEN '10-Q' THEN 40 WHEN '10-Q/A' THEN 30 ELSE 10 END
    WHEN role = 'quarter_flow' THEN CASE form WHEN '10-Q' THEN 100 WHEN '10-Q/A' THEN 75 WHEN '10-K' THEN 20 WHEN '10-K/A' THEN 15 ELSE 10 END
    ELSE CASE form WHEN '10-Q' THEN 70 WHEN '10-Q/A' THEN 55 WHEN '10-K' THEN 50 WHEN '10-K/A' THEN 40 WHEN '20-F' THEN 45 WHEN '40-F' THEN 45 ELSE 10 END END form_score,
  CASE WHEN form LIKE '%/A' THEN -30 ELSE 0 END amended_score,
  CASE WHEN frame IS NULL THEN 5 WHEN role = 'annual_flow' AND upper(frame) = 'CY' || fy THEN 25 WHEN role = 'quarter_flow' AND upper(frame) = 'CY' || fy || fp THEN 25 WHEN contains(upper(frame), 'CY' || fy) THEN 15 ELSE 0 END frame_score,
  CASE WHEN role = 'instant' THEN 20 WHEN role = 'annual_flow' AND n BETWEEN 330 AND 380 THEN 25 WHEN role = 'quarter_flow' AND n BETWEEN 70 AND 110 THEN 25 WHEN role = 'ytd_flow' THEN 5 ELSE 0 END duration_score FROM r)"""


def _candidates(t):
    year, start = F.year("l_shipdate"), F.to_date("l_shipdate")
    fp = F.element_at(F.array(*[F.lit(x) for x in ("FY", *X.QUARTERS)]), F.col("l_linenumber") % 5 + 1)
    third = F.col("l_linenumber") % 3
    c = t.lineitem.select(
        F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("metric_id"), (F.col("l_returnflag") == "R").alias("point"), year.alias("fy"), fp.alias("fp"), start.alias("start"),
        F.when(F.col("l_partkey") % 11 > 0, F.date_add(start, (F.col("l_partkey") % 400).cast("int"))).alias("end"),
        F.element_at(F.array(*[F.lit(x) for x in FORMS]), F.col("l_quantity").cast("int") % 8 + 1).alias("form"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("accn"),
        F.when(third == 1, F.concat(F.lit("CY"), year)).when(third == 2, F.concat(F.lit("cy"), year, fp)).alias("frame"),
    )
    c = c.withColumn("role", X.period_role(F.col("point"), F.col("fp"), X.days(F.col("start"), F.col("end"))))
    return c.select("*", *X.scores({n: F.col(n) for n in ("form", "frame", "fy", "fp", "start", "end")}, F.col("role")))


@R.query("filing_canonical", f"WITH {_CANDIDATES} SELECT entity_id, metric_id, fy, fp, role, accn, form_score, frame_score, duration_score, candidates FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, metric_id, fy, fp, role ORDER BY form_score DESC, amended_score DESC, frame_score DESC, duration_score DESC, s DESC, accn DESC) i, count(*) OVER (PARTITION BY entity_id, metric_id, fy, fp, role) candidates FROM k) WHERE i = 1")
def _(t):
    best = X.canonical(_candidates(t), ["entity_id", "metric_id", "fy", "fp", "role"], ["start", "accn"])
    return best.select("entity_id", "metric_id", "fy", "fp", "role", "accn", "form_score", "frame_score", "duration_score", "candidates")


@R.query("filing_period_labels", f"WITH {_CANDIDATES} SELECT CASE role WHEN 'quarter_or_ytd_unknown' THEN fp || '_UNKNOWN_DURATION' WHEN 'ytd_flow' THEN fp || '_YTD' ELSE fp END AS label, role, count(*) n FROM k GROUP BY ALL")
def _(t):
    c = _candidates(t)
    return c.groupBy(X.period_label(F.col("role"), F.col("fp")).alias("label"), "role").agg(F.count(F.lit(1)).alias("n"))


@R.query("candidate_resolution", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey k, l_suppkey % 5 d, l_linenumber % 3 p, CASE WHEN l_partkey % 9 > 0 THEN l_suppkey % 5 % 3 END pub, l_quantity::INT % 2 v FROM lineitem),
a AS (SELECT *, min(v) OVER w lo, max(v) OVER w hi, max(p) OVER w lp FROM c WINDOW w AS (PARTITION BY k, d)), b AS (SELECT *, min(v) FILTER (p = lp) OVER w plo, max(v) FILTER (p = lp) OVER w phi, max(pub) OVER w dp FROM a WINDOW w AS (PARTITION BY k, d)),
f AS (SELECT *, lo = hi one, lo = hi OR plo = phi clear FROM b), g AS (SELECT k, min(plo) glo, max(phi) ghi, count(DISTINCT d) docs, bool_or(dp IS NULL) undated, max(dp) last FROM f WHERE clear GROUP BY 1),
h AS (SELECT f.k, min(plo) nlo, max(phi) nhi FROM f JOIN g ON f.k = g.k AND f.dp = g.last WHERE clear GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT clear THEN 'conflict' WHEN NOT one AND p < lp THEN 'superseded_same_document' WHEN glo = ghi AND docs > 1 THEN 'matched' WHEN glo = ghi THEN 'single_document' WHEN undated OR nlo <> nhi THEN 'conflict' WHEN v = nlo THEN 'latest_restated' ELSE 'superseded' END cross_check
FROM f LEFT JOIN g ON f.k = g.k LEFT JOIN h ON f.k = h.k""")
def _(t):
    c = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 5).alias("document"), (F.col("l_linenumber") % 3).alias("page"),
        F.when(F.col("l_partkey") % 9 > 0, F.col("l_suppkey") % 5 % 3).alias("published"), (F.col("l_quantity").cast("int") % 2).alias("value"),
    )
    return X.resolve(c, ["k"]).select("l_orderkey", "l_linenumber", "cross_check")


@R.query("entity_merge", "SELECT s_suppkey id, s_name AS name, 'supplier' origin FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(t):
    first = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    return X.merge_entities(first, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("origin")), "id")


@R.query("alias_index", "WITH a AS (SELECT c_custkey, unnest([c_name, lpad(c_custkey::VARCHAR, 10, '0'), 'CIK' || lpad(c_custkey::VARCHAR, 10, '0'), split_part(c_name, '#', 1)]) alias FROM customer) SELECT alias, max(c_custkey) entity, count(DISTINCT c_custkey) candidates FROM a GROUP BY 1")
def _(t):
    code = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    a = t.customer.select("c_custkey", F.explode(F.array("c_name", code, F.concat(F.lit("CIK"), code), F.split_part("c_name", F.lit("#"), F.lit(1)))).alias("alias"))
    return a.groupBy("alias").agg(F.max("c_custkey").alias("entity"), F.count_distinct("c_custkey").alias("candidates"))


_CONCEPT = "CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'us:' || p_brand WHEN 2 THEN ' ' || upper(p_brand) || ' ' ELSE 'none' END"


@R.query("definition_fallback", f"WITH d AS (SELECT p_brand k, min(p_type) definition FROM part GROUP BY 1 UNION ALL SELECT lower(p_brand), 'folded ' || min(p_type) FROM part GROUP BY p_brand), c AS (SELECT p_partkey, {_CONCEPT} concept FROM part) SELECT p_partkey, coalesce(a.definition, b.definition, e.definition) definition FROM c LEFT JOIN d a ON a.k = concept LEFT JOIN d b ON b.k = split_part(concept, ':', -1) LEFT JOIN d e ON e.k = lower(regexp_replace(concept, '\\s', '', 'g'))")
def _(t):
    by = t.part.groupBy("p_brand").agg(F.min("p_type").alias("v"))
    d = by.select(F.col("p_brand").alias("k"), F.col("v").alias("definition")).unionByName(by.select(F.lower("p_brand").alias("k"), F.concat(F.lit("folded "), "v").alias("definition")))
    c, x = t.part.select("p_partkey", F.expr(_CONCEPT).alias("concept")), F.col("concept")
    return X.lookup_in_order(c, d, [x, F.element_at(F.split(x, ":"), -1), F.lower(F.regexp_replace(x, r"\s", ""))], "k", "definition").select("p_partkey", "definition")


@R.query("longest_label", "WITH a AS (SELECT DISTINCT p_name alias, p_type metric_id FROM part WHERE p_size < 5 UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'first' FROM part WHERE p_size > 40), m AS (SELECT p_partkey, alias, metric_id, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, alias, metric_id) k FROM part JOIN a ON starts_with(lower(p_name || ' total') || ' ', lower(alias) || ' ')) SELECT p_partkey, alias, metric_id FROM m WHERE k = 1")
def _(t):
    a = t.part.where("p_size < 5").select(F.col("p_name").alias("alias"), F.col("p_type").alias("metric_id")).unionByName(
        t.part.where("p_size > 40").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("alias"), F.lit("first").alias("metric_id"))
    ).distinct()
    return X.longest_label(t.part.select("p_partkey", F.concat("p_name", F.lit(" total")).alias("label")), a, "label").select("p_partkey", "alias", "metric_id")


@R.query("upsert_status", "WITH n AS (SELECT l_orderkey k, max(l_linestatus) s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey, coalesce(s, o_orderstatus) status FROM orders LEFT JOIN n ON k = o_orderkey")
def _(t):
    new = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status"))
    return X.upsert(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), new, "o_orderkey")


@R.query("fact_ids", "SELECT o_orderkey, substr(sha1(o_custkey || '|' || coalesce(o_orderstatus, '') || '|' || strftime(o_orderdate, '%Y-%m-%d')), 1, 24) fact_id FROM orders")
def _(t):
    parts = F.concat_ws("|", F.col("o_custkey").cast("string"), F.coalesce("o_orderstatus", F.lit("")), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", F.substring(F.sha1(parts), 1, 24).alias("fact_id"))


@R.query("region_distribution", "WITH c AS (SELECT CASE WHEN n_regionkey IN (0, 1) OR n_name LIKE '%\\_2' ESCAPE '\\' THEN 'first' WHEN n_regionkey = 2 THEN 'mixed' WHEN n_regionkey < 9 THEN 'second' ELSE 'unclassified' END region, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT region, count(*) n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) share FROM c GROUP BY 1")
def _(t):
    from ..operators.stats import distribution

    r = F.col("n_regionkey")
    region = F.when(r.isin(0, 1) | F.col("n_name").endswith("_2"), "first").when(r == 2, "mixed").when(r < 9, "second").otherwise("unclassified")
    d = distribution(t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")), region)
    return d.select(F.col("category").alias("region"), "n", F.round("share", 6).alias("share"))


@R.query("schema_profile", """WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) p, list(DISTINCT o_orderstatus) st FROM orders GROUP BY 1),
m AS (SELECT o_custkey, list_filter([CASE WHEN list_has_any(p, ['1-URGENT', '2-HIGH']) AND NOT list_contains(p, '5-LOW') AND list_contains(st, 'F') THEN 'bank' END, CASE WHEN list_has_all(p, ['3-MEDIUM', '5-LOW']) AND NOT list_contains(p, '1-URGENT') THEN 'insurer' END, CASE WHEN list_has_all(p, ['1-URGENT', '5-LOW']) THEN 'general' END], lambda x: x IS NOT NULL) m FROM s)
SELECT o_custkey, CASE WHEN len(m) > 1 THEN 'ambiguous' WHEN len(m) = 1 THEN m[1] ELSE 'default' END profile FROM m""")
def _(t):
    s = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("st"))
    profiles = {
        "bank": {"any": ["1-URGENT", "2-HIGH"], "absent": ["5-LOW"], "statements": ["F"]},
        "insurer": {"all": ["3-MEDIUM", "5-LOW"], "absent": ["1-URGENT"]},
        "general": {"all": ["1-URGENT", "5-LOW"]},
    }
    return s.select("o_custkey", X.profile(F.col("p"), F.col("st"), profiles, "default").alias("profile"))


@R.query("metric_family_coverage", "WITH s AS (SELECT l_returnflag f, l_partkey p, bool_or(l_suppkey % 2 = 0) a, bool_or(l_suppkey % 2 = 1) b FROM lineitem GROUP BY ALL) SELECT f family, count(*) FILTER (a) n_a, count(*) FILTER (b) n_b, count(*) n_union, count(*) FILTER (a AND b) n_shared, round(count(*) FILTER (a AND b)::DOUBLE / count(*), 6) ratio FROM s GROUP BY 1")
def _(t):
    s = t.lineitem.groupBy(F.col("l_returnflag").alias("family"), "l_partkey").agg(F.bool_or(F.col("l_suppkey") % 2 == 0).alias("a"), F.bool_or(F.col("l_suppkey") % 2 == 1).alias("b"))
    both = F.count_if(F.col("a") & F.col("b"))
    return s.groupBy("family").agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count(F.lit(1)).alias("n_union"), both.alias("n_shared"), F.round(both / F.count(F.lit(1)), 6).alias("ratio"))


@R.query("peer_scope_hash", "SELECT n_regionkey, sha256('[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']') members, count(*) n FROM nation GROUP BY 1")
def _(t):
    g = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("m"))
    return g.select("n_regionkey", F.sha2(F.to_json("m"), 256).alias("members"), F.size("m").cast("long").alias("n"))


@R.query("multiset_jaccard", "WITH c AS (SELECT c_nationkey g, c_mktsegment x, count(*) n FROM customer GROUP BY ALL), p AS (SELECT a.n_nationkey g, b.n_nationkey h FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1), s AS (SELECT DISTINCT x FROM c) SELECT p.g, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::DOUBLE / sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))), 6) similarity FROM p CROSS JOIN s LEFT JOIN c a ON a.g = p.g AND a.x = s.x LEFT JOIN c b ON b.g = p.h AND b.x = s.x GROUP BY 1 HAVING sum(coalesce(a.n, 0) + coalesce(b.n, 0)) > 0")
def _(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return X.multiset_jaccard(c, c.select((F.col("g") - 1).alias("g"), "x", "n"), t.nation.select(F.col("n_nationkey").alias("g")).where((F.col("g") >= 0) & (F.col("g") < 24)))
