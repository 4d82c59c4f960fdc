"""Gates, split audits, answer checks and bindings over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binding as B, derived as D, facts as X, gates as G, graph
from ..registry import Registry
from .dag import Step, compile_dag, lineage
from .graphs import GRAPH
from .sqlviews import CHANGE, FACTS

R = Registry()

#: A standardised fact with every kind of gap, of each order; the same expressions serve Spark and the SQL.
_FACT = {
    "fact_id": "o_orderkey", "entity_id": "CASE WHEN o_custkey % 17 = 0 THEN '' ELSE concat('c', CAST(o_custkey AS VARCHAR(20))) END",
    "metric_id": "CASE o_orderkey % 5 WHEN 0 THEN 'revenue' WHEN 1 THEN 'total_assets' WHEN 2 THEN 'unemployment_rate' WHEN 3 THEN 'other_rate' END",
    "normalized_value": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 1000 - 50 END", "period_end": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "source_id": "CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END", "source_definition_id": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END",
    "unit": "CASE WHEN o_orderkey % 4 = 0 THEN 'Document' ELSE 'usd' END", "normalized_unit": "CASE o_orderkey % 6 WHEN 0 THEN 'percent' WHEN 1 THEN 'DOCUMENT' WHEN 2 THEN '' ELSE 'usd' END",
    "verification_status": "CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'cross_verified' WHEN o_orderstatus = 'O' THEN 'single_source' ELSE 'conflict' END",
    "default_unit": "CASE WHEN o_orderkey % 5 = 3 THEN '%' END", "period_type": "CASE o_orderkey % 3 WHEN 0 THEN 'point_in_time' WHEN 1 THEN 'period_flow' ELSE 'observation' END",
}
_STD = "std AS (SELECT " + ", ".join(f"{x} {k}" for k, x in _FACT.items()) + " FROM orders)"


def _facts(t):
    return t.orders.selectExpr(*[f"{x} as {k}" for k, x in _FACT.items()])


_REASON = """concat_ws(',', CASE WHEN coalesce(entity_id, '') = '' THEN 'missing_entity' END, CASE WHEN coalesce(metric_id, '') = '' THEN 'missing_metric' END, CASE WHEN normalized_value IS NULL THEN 'null_value' END,
 CASE WHEN period_end IS NULL THEN 'missing_period_end' END, CASE WHEN source_id IS NULL THEN 'missing_source' END, CASE WHEN source_definition_id IS NULL THEN 'missing_source_definition' END,
 CASE WHEN lower(coalesce(nullif(normalized_unit, ''), unit)) = 'document' THEN 'document_fact' END, CASE WHEN coalesce(verification_status, '') NOT IN ('single_source', 'cross_verified') THEN 'status_' || coalesce(verification_status, 'missing') END)"""


@R.query("gate_ready_reasons", f"WITH {_STD} SELECT coalesce(nullif({_REASON}, ''), 'ready') reason, count(*) n FROM std GROUP BY 1")
def _(t):
    return _facts(t).groupBy(G.ready_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.query("gate_basic_checks", f"""WITH {_STD}, c AS (SELECT unnest(CASE WHEN normalized_value IS NULL THEN [('numeric_value', 'failed')] ELSE [('numeric_value', 'passed'),
 CASE WHEN metric_id = 'total_assets' THEN ('non_negative', CASE WHEN normalized_value < 0 THEN 'failed' ELSE 'passed' END) END, CASE WHEN metric_id = 'revenue' AND normalized_value < 0 THEN ('usually_non_negative', 'warning') END,
 CASE WHEN normalized_unit = 'percent' OR default_unit = '%' THEN ('percentage_range', CASE WHEN normalized_value < CASE metric_id WHEN 'unemployment_rate' THEN -10 ELSE -1000 END OR normalized_value > CASE metric_id WHEN 'unemployment_rate' THEN 100 ELSE 1000 END THEN 'warning' ELSE 'passed' END) END,
 ('time_completeness', CASE WHEN period_type <> 'observation' AND period_end IS NULL THEN 'failed' ELSE 'passed' END)] END) c FROM std) SELECT c[1] "check", c[2] status, count(*) n FROM c WHERE c IS NOT NULL GROUP BY ALL""")
def _(t):
    return _facts(t).select(F.explode(G.basic_checks()).alias("c")).groupBy("c.check", "c.status").agg(F.count(F.lit(1)).alias("n"))


_MOST, _LEAST = {"missing_entity_count": 0, "missing_source_count": 1e9, "null_value_count": 10, "conflict_count": 1e9}, {"graph_ready_ratio": 0.2, "cross_verified_ratio": 0.99}


@R.query("gate_fact_thresholds", f"""WITH {_STD}, r AS (SELECT count(*) FILTER (coalesce(entity_id, '') = '')::DOUBLE missing_entity_count, count(*) FILTER (source_id IS NULL)::DOUBLE missing_source_count, count(*) FILTER (normalized_value IS NULL)::DOUBLE null_value_count,
 count(*) FILTER (verification_status = 'conflict')::DOUBLE conflict_count, count(*) FILTER ({_REASON} = '') / count(*)::DOUBLE graph_ready_ratio, count(*) FILTER (verification_status = 'cross_verified') / count(*)::DOUBLE cross_verified_ratio FROM std)
 SELECT name, round(value, 6) AS value, bound::DOUBLE bound, CASE WHEN name LIKE '%count' THEN value <= bound ELSE value >= bound END passed FROM (UNPIVOT r ON COLUMNS(*) INTO NAME name VALUE value)
 JOIN (VALUES ('missing_entity_count', 0), ('missing_source_count', 1e9), ('null_value_count', 10), ('conflict_count', 1e9), ('graph_ready_ratio', 0.2), ('cross_verified_ratio', 0.99)) b(name, bound) USING (name)""")
def _(t):
    return G.judged(G.fact_report(_facts(t)), _MOST, _LEAST).select("name", F.round("value", 6).alias("value"), "bound", "passed")


_QA = """qa AS (SELECT CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 = 6 THEN 'dev' WHEN o_orderkey % 10 = 7 THEN 'test_entity_holdout' WHEN o_orderkey % 10 = 8 THEN 'test_temporal_holdout' ELSE 'test_complex' END split,
 'q' || (o_custkey % 5000) cluster, o_custkey::VARCHAR entity, o_custkey || '|' || o_orderpriority series, o_custkey || '|' || o_orderpriority || '|' || year(o_orderdate) exact, o_orderpriority || o_orderstatus pattern, strftime(o_orderdate, '%Y-%m-%d') doc, (o_totalprice::BIGINT // 1000)::VARCHAR skeleton FROM orders)"""
_CHECKS = (("semantic_cluster", "cluster", "*"), ("entity_holdout_entity", "entity", "test_entity_holdout"), ("temporal_holdout_entity_metric_period", "exact", "test_temporal_holdout"), ("temporal_holdout_entity_metric_series", "series", "test_temporal_holdout"), ("complex_holdout_pattern", "pattern", "test_complex"), ("source_document", "doc", None), ("canonical_question_skeleton", "skeleton", None))


@R.query("split_overlap_checks", f"WITH {_QA}, k AS (" + " UNION ".join(f"SELECT '{n}' c, {x} k, split, '{s or ''}' target FROM qa" for n, x, s in _CHECKS) + """),
p AS (SELECT c, k, target, bool_or(split = 'train') a, bool_or(CASE target WHEN '' THEN split <> 'train' ELSE split = target END) b, count(DISTINCT split) n FROM k GROUP BY ALL)
SELECT c "check", count(*) FILTER (a AND target <> '*') train_keys, count(*) FILTER (target = '*' OR b) target_keys, count(*) FILTER (CASE target WHEN '*' THEN n > 1 ELSE a AND b END) overlap,
 round(count(*) FILTER (CASE target WHEN '*' THEN n > 1 ELSE a AND b END) / count(*) FILTER (target = '*' OR b)::DOUBLE, 6) rate FROM p GROUP BY 1""")
def _(t):
    m, cust = F.col("o_orderkey") % 10, F.col("o_custkey").cast("string")
    split = F.when(m < 6, "train").when(m == 6, "dev").when(m == 7, "test_entity_holdout").when(m == 8, "test_temporal_holdout").otherwise("test_complex")
    series = F.concat_ws("|", cust, "o_orderpriority")
    keys = {
        "cluster": F.concat(F.lit("q"), (F.col("o_custkey") % 5000).cast("string")), "entity": cust, "series": series, "exact": F.concat_ws("|", series, F.year("o_orderdate").cast("string")),
        "pattern": F.concat("o_orderpriority", "o_orderstatus"), "doc": F.date_format("o_orderdate", "yyyy-MM-dd"), "skeleton": F.floor(F.round("o_totalprice").cast("long") / 1000).cast("string"),
    }
    return G.overlaps(t.orders.withColumn("split", split), ["train"], {n: (F.array(keys[x]), s) for n, x, s in _CHECKS})


_ANSWER = "CASE l_linenumber WHEN 1 THEN l_extendedprice WHEN 2 THEN l_extendedprice * 100 WHEN 3 THEN l_extendedprice * 1.004 WHEN 4 THEN l_extendedprice + 0.4 WHEN 5 THEN l_extendedprice * 1.2 WHEN 6 THEN NULL ELSE l_extendedprice / 100 END"


@R.query("answer_number_match", f"""WITH a AS (SELECT l_linenumber, l_extendedprice t, {_ANSWER} v FROM lineitem), b AS (SELECT *, greatest(0.5, abs(t) * 0.005) tol FROM a)
SELECT l_linenumber, coalesce(abs(t - v) <= tol, false) plain, coalesce(least(abs(t - v), abs(t - v * 100), abs(t - v / 100)) <= tol, false) percent, count(*) n FROM b GROUP BY ALL""")
def _(t):
    target, value = F.col("l_extendedprice"), F.expr(_ANSWER)
    bounds = {"relative": 0.005, "places": 0}
    return t.lineitem.groupBy("l_linenumber", G.number_matches(target, value, **bounds).alias("plain"), G.number_matches(target, value, True, **bounds).alias("percent")).agg(F.count(F.lit(1)).alias("n"))


@R.query("answer_period_match", """WITH a AS (SELECT o_orderkey, year(o_orderdate)::VARCHAR e, CASE o_orderkey % 5 WHEN 0 THEN year(o_orderdate)::VARCHAR WHEN 1 THEN 'FY' || year(o_orderdate) || ' (audited)' WHEN 2 THEN year(o_orderdate) || '-' || (year(o_orderdate) + 1) WHEN 3 THEN '1' || year(o_orderdate) END a FROM orders)
SELECT o_orderkey, coalesce(trim(a) = e OR (regexp_full_match(e, '(19|20)[0-9]{2}') AND list_transform(regexp_extract_all(' ' || regexp_replace(a, '[0-9]{5,}', 'x', 'g') || ' ', '[^0-9](19|20)[0-9]{2}'), lambda x: substr(x, 2)) = [e]), false) matched FROM a""")
def _(t):
    y, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 5
    actual = F.when(k == 0, y).when(k == 1, F.concat(F.lit("FY"), y, F.lit(" (audited)"))).when(k == 2, F.concat(y, F.lit("-"), (F.year("o_orderdate") + 1).cast("string"))).when(k == 3, F.concat(F.lit("1"), y))
    return t.orders.select("o_orderkey", G.period_matches(y, actual).alias("matched"))


@R.query("answer_table_match", """WITH a AS (SELECT l_orderkey, list({'k': l_partkey, 'v': l_quantity} ORDER BY l_linenumber, l_partkey, l_quantity) x, list({'k': l_partkey, 'v': l_quantity} ORDER BY l_quantity DESC, l_linenumber, l_partkey) y FROM lineitem GROUP BY 1)
SELECT l_orderkey, x = y ordered, list_sort(x) = list_sort(y) multiset, list_sort(x) = list_sort(y[2:]) short FROM a""")
def _(t):
    row = F.struct(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v"))
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("a"), F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", row.alias("r")))).alias("b"))
    x, y = F.transform("a", lambda r: r["r"]), F.transform("b", lambda r: r["r"])
    return g.select("l_orderkey", G.tables_match(x, y, True).alias("ordered"), G.tables_match(x, y).alias("multiset"), G.tables_match(x, F.slice(y, 2, 1000)).alias("short"))


@R.query("answer_unit_match", "SELECT o_orderpriority u, regexp_replace(lower(o_orderpriority), '[^a-z0-9%]+', '', 'g') = regexp_replace(lower(CASE WHEN o_orderkey % 2 = 0 THEN replace(upper(o_orderpriority), '-', ' ') ELSE substr(o_orderpriority, 2) END), '[^a-z0-9%]+', '', 'g') same, count(*) n FROM orders GROUP BY ALL")
def _(t):
    u = F.col("o_orderpriority")
    other = F.when(F.col("o_orderkey") % 2 == 0, F.regexp_replace(F.upper(u), "-", " ")).otherwise(F.substring(u, 2, 100))
    return t.orders.groupBy(u.alias("u"), G.token_matches(u, other).alias("same")).agg(F.count(F.lit(1)).alias("n"))


_OPERATION = "CASE l_linenumber % 5 WHEN 0 THEN 'difference' WHEN 1 THEN 'ratio' WHEN 2 THEN 'percent_change' WHEN 3 THEN 'mean' ELSE 'power' END"


@R.query("calculator", f"WITH a AS (SELECT l_orderkey, l_linenumber, {_OPERATION} op, l_extendedprice a, CASE WHEN l_quantity < 5 THEN 0 ELSE l_quantity END b FROM lineitem) SELECT l_orderkey, l_linenumber, op, CASE op WHEN 'difference' THEN a - b WHEN 'ratio' THEN CASE WHEN b <> 0 THEN a / b END WHEN 'percent_change' THEN CASE WHEN a <> 0 THEN (b - a) * 100 / abs(a) END WHEN 'mean' THEN (a + b) / 2 END AS value FROM a")
def _(t):
    op, b = F.expr(_OPERATION), F.when(F.col("l_quantity") < 5, F.lit(0.0)).otherwise(F.col("l_quantity").cast("double"))
    return t.lineitem.select("l_orderkey", "l_linenumber", op.alias("op"), G.calculate(op, F.col("l_extendedprice"), b).alias("value"))


@R.query("derived_recompute", f"WITH {CHANGE} SELECT metric_id, count(*) n, 0::BIGINT mismatches FROM chg WHERE growth IS NOT NULL GROUP BY 1")
def _(t):
    """Growth by windows, computed again from a join of each year with the one before; answers that differ are mismatches."""
    f = X.annual(t)
    stored = D.change(f, ["entity_id", "metric_id"], "fiscal_year").where("growth is not null").select("entity_id", "metric_id", "fiscal_year", "growth")
    before = f.select("entity_id", "metric_id", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("value").alias("prior"))
    again = f.join(before, ["entity_id", "metric_id", "fiscal_year"]).select("entity_id", "metric_id", "fiscal_year", G.calculate(F.lit("percent_change"), F.col("prior"), F.col("value")).alias("again")).where("again is not null")
    both = stored.join(again, ["entity_id", "metric_id", "fiscal_year"], "full")
    return both.groupBy("metric_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~G.number_matches(F.col("growth"), F.col("again"), relative=1e-9)).alias("mismatches"))


# the graph: counters and bindings

@R.query("graph_gate_counters", f"""WITH {GRAPH}, e AS (SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE rel = 'CONTAINS' UNION ALL SELECT 'order:0', 'PLACED', 'order:0' UNION ALL SELECT 'customer:0', 'PLACED', 'order:-1')
SELECT 'repeated_nodes' AS name, (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY 1 HAVING count(*) > 1)) n UNION ALL SELECT 'repeated_edges', (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY src, rel, dst HAVING count(*) > 1))
UNION ALL SELECT 'loops', (SELECT count(*) FROM e WHERE src = dst) UNION ALL SELECT 'dangling_sources', (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM nodes)) UNION ALL SELECT 'dangling_targets', (SELECT count(*) FROM e WHERE dst NOT IN (SELECT id FROM nodes))
UNION ALL SELECT 'Order_without_SUPPLIED_BY', (SELECT count(*) FROM nodes WHERE kind = 'Order' AND id NOT IN (SELECT src FROM e WHERE rel = 'SUPPLIED_BY')) UNION ALL SELECT 'Customer_without_HAS_CUSTOMER', (SELECT count(*) FROM nodes WHERE kind = 'Customer' AND id NOT IN (SELECT dst FROM e WHERE rel = 'HAS_CUSTOMER'))
UNION ALL SELECT 'Nation_without_HAS_SUPPLIER', (SELECT count(*) FROM nodes WHERE kind = 'Nation' AND id NOT IN (SELECT src FROM e WHERE rel = 'HAS_SUPPLIER'))""")
def _(t):
    nodes, edges = graph.build(t)
    bad = t.spark.createDataFrame([("order:0", "PLACED", "order:0"), ("customer:0", "PLACED", "order:-1")], "src string, rel string, dst string")
    edges = edges.unionByName(edges.where("rel = 'CONTAINS'")).unionByName(bad)
    return G.graph_counters(nodes, edges, {"SUPPLIED_BY": ("Order", True), "HAS_CUSTOMER": ("Customer", False), "HAS_SUPPLIER": ("Nation", True)})


def _bound(t):
    """Customers with their orders and those orders' suppliers as roles."""
    nodes, edges = graph.build(t)
    bound = B.expand(B.scan(nodes, "Customer", "customer"), edges, "customer", "PLACED", "orders")
    return nodes, edges, B.expand(bound, edges, "orders", "SUPPLIED_BY", "suppliers")


_BOUND = GRAPH + """, po AS (SELECT src c, dst o FROM edges WHERE rel = 'PLACED'), os AS (SELECT src o, dst s FROM edges WHERE rel = 'SUPPLIED_BY'),
b AS (SELECT c binding FROM po JOIN os USING (o) GROUP BY 1)"""


@R.query("binding_scan", f"WITH {GRAPH} SELECT id binding FROM nodes WHERE kind = 'Customer'")
def _(t):
    return B.scan(graph.build(t)[0], "Customer", "customer").select("binding")


@R.query("binding_expand", f"WITH {_BOUND} SELECT binding, (SELECT count(*) FROM po WHERE c = binding) n_orders, count(DISTINCT s) n_suppliers, sha256(string_agg(DISTINCT s, ',' ORDER BY s)) suppliers, (SELECT count(*) FROM po WHERE c = binding) + count(*) walked FROM b JOIN po ON c = binding JOIN os USING (o) GROUP BY 1")
def _(t):
    size = lambda c: F.size(c).cast("long")
    return _bound(t)[2].select("binding", size("orders").alias("n_orders"), size("suppliers").alias("n_suppliers"), F.sha2(F.array_join("suppliers", ","), 256).alias("suppliers"), size("walk").alias("walked"))


_ORDERS = "SELECT c binding, o_totalprice v, o_orderkey k FROM b JOIN po ON c = binding JOIN orders ON o = 'order:' || o_orderkey"


@R.query("binding_project_records", f"WITH {_BOUND}, r AS ({_ORDERS}) SELECT binding, count(*) AS count, string_agg(k::VARCHAR, ',' ORDER BY v, k) records FROM r GROUP BY 1")
def _(t):
    facts = t.orders.select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))
    p = B.project(_bound(t)[2], facts, "orders", ["v", "k"])
    return p.select("binding", "count", F.array_join(F.transform("answer", lambda r: r["k"].cast("string")), ",").alias("records"))


@R.query("binding_project_record", f"WITH {_BOUND}, r AS ({_ORDERS}) SELECT binding, count(*) AS count, min(v) AS v, arg_min(k, (v, k)) k FROM r GROUP BY 1")
def _(t):
    facts = t.orders.select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))
    return B.project(_bound(t)[2], facts, "orders", ["v", "k"], "record").select("binding", "count", "answer.v", "answer.k")


@R.query("binding_provenance", f"WITH {_BOUND} SELECT binding, o fact, string_agg(s, ',' ORDER BY s) raws FROM b JOIN po ON c = binding JOIN os USING (o) GROUP BY ALL")
def _(t):
    return B.provenance(_bound(t)[2], "orders", "suppliers", "SUPPLIED_BY").select("binding", "fact", F.array_join("raws", ",").alias("raws"))


_LOST = "substr(s, 10)::INT % 7 = 0"


@R.query("binding_replay", f"WITH {_BOUND} SELECT binding, count(DISTINCT s) FILTER ({_LOST}) missing_nodes, count(*) FILTER ({_LOST} OR o IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) missing_edges, count(*) FILTER ({_LOST} OR o IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) = 0 passed FROM b JOIN po ON c = binding JOIN os USING (o) GROUP BY 1")
def _(t):
    """Stored bindings against a later graph that has lost some suppliers and the supply edges of urgent orders."""
    nodes, edges, bound = _bound(t)
    gone = F.col("dst").startswith("supplier:") & (F.substring("dst", 10, 20).cast("int") % 7 == 0)
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("order:"), "o_orderkey").alias("src"), F.lit("SUPPLIED_BY").alias("rel"))
    later = edges.where(~((F.col("rel") == "SUPPLIED_BY") & gone)).join(urgent, ["src", "rel"], "left_anti")
    left = nodes.where(~(F.col("id").startswith("supplier:") & (F.coalesce(F.substring("id", 10, 20).try_cast("int"), F.lit(1)) % 7 == 0)))
    return B.replay(bound, left, later, ["customer", "orders", "suppliers"])


@R.query("binding_coverage", "SELECT 'order:' || l_orderkey binding, coalesce(list_sort(list(DISTINCT l_suppkey)) = list_sort(list(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R')), false) covered FROM lineitem GROUP BY l_orderkey")
def _(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("expected"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))).alias("found"))
    out = B.covered(g.withColumn("binding", F.concat(F.lit("order:"), "l_orderkey")), "expected", ["found"])
    return out


# steps of the operation DAG that carry structure

def _sources(t):
    f = X.annual(t).withColumnRenamed("industry", "binding").withColumn("fact_id", F.concat_ws(":", "metric_id", "entity_id", F.col("fiscal_year").cast("string")))
    raw = X.lines(t).select(F.concat_ws(":", F.lit("revenue"), "n_name", F.year("o_orderdate").cast("string")).alias("fact_id"), F.col("l_returnflag").alias("raw_object_id")).where("raw_object_id <> 'N'").distinct()
    one = lambda m: f.where(F.col("metric_id") == m).select("binding", "entity_id", "fiscal_year", "value", "fact_id")
    return {"revenue": one("revenue"), "quantity": one("quantity"), "raw": raw}


_TOP = "top AS (SELECT industry binding, entity_id, fiscal_year, value FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY value DESC, entity_id, fiscal_year) k FROM facts WHERE metric_id = 'revenue') WHERE k = 1)"


@R.query("op_attach_provenance", f"WITH {FACTS}, {_TOP}, raw AS (SELECT DISTINCT n_name e, year(o_orderdate) y, l_returnflag r FROM lines WHERE l_returnflag <> 'N') SELECT binding, entity_id, fiscal_year, string_agg(r, ',' ORDER BY r) raw_object_ids FROM top JOIN raw ON e = entity_id AND y = fiscal_year GROUP BY ALL")
def _(t):
    out = compile_dag([Step("a", "argmax", ("revenue",)), Step("p", "attach_provenance", ("a", "raw"))], _sources(t))
    return out.select("binding", "entity_id", "fiscal_year", F.array_join("raw_object_ids", ",").alias("raw_object_ids"))


@R.query("op_graph_answer", f"WITH {_BOUND}, r AS ({_ORDERS}) SELECT binding, count(*) AS count, string_agg(k::VARCHAR, ',' ORDER BY v, k) records FROM r WHERE v > 100000 GROUP BY 1")
def _(t):
    """Projections of every customer's orders; those of customers without a large order are empty and give no answer."""
    bound = _bound(t)[2]
    facts = t.orders.where("o_totalprice > 100000").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))
    projected = bound.select("binding").join(B.project(bound, facts, "orders", ["v", "k"]), "binding", "left")
    out = compile_dag([Step("g", "graph_answer", ("projected",))], {"projected": projected})
    return out.select("binding", "count", F.array_join(F.transform("answer", lambda r: r["k"].cast("string")), ",").alias("records"))


@R.query("op_answer_lineage", f"WITH {FACTS}, {_TOP}, u AS (SELECT industry binding, metric_id || ':' || entity_id || ':' || fiscal_year f, entity_id, fiscal_year FROM facts WHERE metric_id IN ('revenue', 'quantity')) SELECT binding, 'a,s' step_ids, sha256(string_agg(DISTINCT f, ',' ORDER BY f)) fact_ids, count(DISTINCT entity_id) entities, count(DISTINCT fiscal_year) periods FROM u WHERE binding IN (SELECT binding FROM top) GROUP BY 1")
def _(t):
    steps, relations = [Step("x", "argmin", ("quantity",)), Step("a", "argmax", ("revenue",)), Step("s", "select_by_period", ("a", "quantity"))], _sources(t)
    found = lineage(steps, relations, compile_dag(steps, relations))
    return found.select("binding", F.array_join("step_ids", ",").alias("step_ids"), F.sha2(F.array_join("fact_ids", ","), 256).alias("fact_ids"), F.size("entities").cast("long").alias("entities"), F.size("periods").cast("long").alias("periods"))
