"""What goes into a build and comes out of it: tagged filings, peers, typed walks, chains in a budget, gates, purges, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derived as D, facts as X, feedback as K, graph as G, selection as L, universe as U, walks as W
from ..operators.components import components
from ..registry import Registry
from ..sources import xbrl
from .graphs import GRAPH
from .sqlviews import CHANGE

R = Registry()


@R.query("scan_inline_xbrl", """SELECT DISTINCT o_custkey, 'metric_' || o_orderstatus metric_id, 'tpch:' || o_orderstatus concept, (CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE 1 END * o_totalprice)::DOUBLE AS value,
 CASE WHEN o_orderkey % 4 = 0 THEN 'iso4217:EUR' ELSE 'USD/shares' END || CASE WHEN o_orderkey % 2 = 0 THEN '; scale=3' ELSE '' END || '; decimals=-3' unit,
 CASE WHEN year(o_orderdate) = 1995 THEN 'y1995' ELSE '{"context_ref":"y' || year(o_orderdate) || '","enddate":"' || year(o_orderdate) || '-12-31","startdate":"' || year(o_orderdate) || '-01-01"}' END period FROM orders WHERE o_orderstatus <> 'P'""")
def _(t):
    """A filing of every customer: its orders as tagged numbers, contexts by year but for 1995's, one unit told and one not."""
    y = F.year("o_orderdate").cast("string")
    price = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    shown = F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("("), price, F.lit(")"))).otherwise(price)
    tag = F.concat(
        F.lit('<ix:nonFraction name="tpch:'), "o_orderstatus", F.lit("\" contextRef='y"), y, F.lit("' unitRef=\""), F.when(F.col("o_orderkey") % 4 == 0, "iso4217:EUR").otherwise("u1"), F.lit('"'),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(' scale="3"')).otherwise(""), F.lit(' decimals="-3"><b>'), shown, F.lit("</b></IX:nonfraction>"),
    )
    context = F.when(y != "1995", F.concat(F.lit('<xbrli:context id="y'), y, F.lit('"><xbrli:startDate>'), y, F.lit("-01-01</xbrli:startDate><xbrli:endDate> "), y, F.lit("-12-31</xbrli:endDate></xbrli:context>")))
    unit = '<xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unit>'
    pages = t.orders.groupBy("o_custkey").agg(F.concat(F.lit(f"<html>{unit}"), F.array_join(F.collect_set(context), ""), F.array_join(F.collect_list(tag), " and <p>")).alias("html"))
    aliases = t.spark.createDataFrame([("tpch:F", "metric_F"), ("tpch:O", "metric_O")], "concept string, metric_id string")
    return xbrl.inline_facts(pages, "o_custkey", "html", aliases).drop("evidence")


# walks

_COSTS = {"CONTAINS": 1, "HAS_CUSTOMER": 2, "HAS_SUPPLIER": 2, "PLACED": 1, "SUPPLIED_BY": 3}
_COST = "CASE rel " + " ".join(f"WHEN '{r}' THEN {c}" for r, c in _COSTS.items()) + " END"


@R.query("graph_relation_schema", f"WITH {GRAPH}, s AS (SELECT a.kind a, rel, b.kind b, count(*) n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL) SELECT a kind, rel, 'out' direction, b AS other, n FROM s UNION ALL SELECT b, rel, 'in', a, n FROM s")
def _(t):
    return W.relation_schema(*G.build(t))


@R.query("graph_typed_paths", f"""WITH RECURSIVE {GRAPH}, s AS (SELECT a.kind a, rel, b.kind b FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL),
st AS (SELECT a kind, b AS other, rel || ' out ' || b step, {_COST} c FROM s UNION ALL SELECT b, a, rel || ' in ' || a, {_COST} FROM s),
p AS (SELECT kind AS start, other fin, [kind, other] seen, step path, c::BIGINT AS cost, 1 d FROM st WHERE kind <> other
 UNION ALL SELECT start, other, list_append(seen, other), path || ' > ' || step, cost + c, d + 1 FROM p JOIN st ON fin = kind WHERE NOT list_contains(seen, other) AND d < 4)
SELECT start, fin finish, path, cost, place::INT place FROM (SELECT *, row_number() OVER (PARTITION BY start, fin ORDER BY cost, path) place FROM p) WHERE place <= 3""")
def _(t):
    return W.typed_paths(W.relation_schema(*G.build(t)), _COSTS, depth=4)


@R.query("graph_walk_support", f"""WITH {GRAPH}, w AS (SELECT a.src root, d.dst fin, count(*) n FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src JOIN edges d ON c.dst = d.src
 WHERE a.rel = 'CONTAINS' AND b.rel = 'HAS_CUSTOMER' AND c.rel = 'PLACED' AND d.rel = 'SUPPLIED_BY' GROUP BY ALL) SELECT count(DISTINCT root) roots, count(DISTINCT fin) ends, count(*) pairs, sum(n)::BIGINT walks FROM w""")
def _(t):
    steps = [(r, "out") for r in ("CONTAINS", "HAS_CUSTOMER", "PLACED", "SUPPLIED_BY")]
    return W.support(W.walked(*G.build(t), "Region", steps))


# what a build takes in

_PEER = "SELECT o_custkey entity, c_mktsegment AS scope, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderpriority < '4' THEN 'revenue' ELSE 'assets' END metric, o_orderstatus definition, o_orderkey fact_id, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE o_totalprice END AS value, floor(o_totalprice / 20000) score FROM orders JOIN customer ON o_custkey = c_custkey"


@R.query("peer_universe", f"""WITH f AS ({_PEER}), n AS (SELECT * FROM f WHERE metric = 'revenue' QUALIFY row_number() OVER (PARTITION BY entity, year, definition ORDER BY score DESC, fact_id DESC) = 1),
p AS (SELECT a.entity, a.scope, a.year, a.definition, a.value v, b.value w, (a.score, a.fact_id) x, (b.score, b.fact_id) y FROM n a JOIN n b ON a.entity = b.entity AND a.definition = b.definition AND b.year = a.year - 1),
q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY CASE WHEN x < y THEN x ELSE y END DESC, CASE WHEN x < y THEN y ELSE x END DESC, definition DESC) = 1),
r AS (SELECT entity, year, value z FROM f WHERE metric = 'assets' QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY score DESC, fact_id DESC) = 1)
SELECT scope, year, sha256(string_agg(entity::VARCHAR, ',' ORDER BY entity)) members, count(*)::INT n, count(*) BETWEEN 2 AND 30 eligible FROM q JOIN r USING (entity, year) WHERE v <> 0 AND w <> 0 AND z <> 0 GROUP BY ALL""")
def _(t):
    score = F.floor(F.col("o_totalprice") / 20000)
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("entity"), F.col("c_mktsegment").alias("scope"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderpriority") < "4", "revenue").otherwise("assets").alias("metric"),
        F.col("o_orderstatus").alias("definition"), F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderkey") % 23 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("value"), score.alias("score"),
    )
    p = U.peer_universe(facts, "revenue", ["assets"], 2, 30)
    return p.withColumn("members", F.sha2(F.array_join(F.transform("members", lambda x: x.cast("string")), ","), 256))


@R.query("universe_selection")
def _(t):
    """All orders of Asia's customers, and as many of others that Asia keeps at least 30 %, by quotas of nation and priority."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", (F.col("n_regionkey") == 2).alias("home"))
    o = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "home", F.concat_ws("|", "n_name", "o_orderpriority").alias("stratum"))
    budget = o.where("home").agg(U.share_budget(F.count(F.lit(1)), 0.3).alias("b")).first()["b"]
    others = o.where("not home")
    quotas = L.stratum_quotas(others.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), "stratum", "n", budget)
    return o.where("home").unionByName(L.take_quotas(others, "stratum", quotas, ["o_orderkey"]))


@R.query("chain_cover")
def _(t):
    """Suppliers that make the chains of as many orders as possible complete, a third of all suppliers at most."""
    members = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("chain"), F.col("o_orderpriority").alias("kind"), F.col("l_suppkey").alias("fact")).distinct()
    return U.chain_cover(members, t.supplier.count() // 3, 0.5)[0]


_TASK = "CASE WHEN o_orderpriority < '3' THEN 'T2' WHEN o_orderpriority < '5' THEN 'T3' END"


@R.query("constructibility_share", f"WITH d AS (SELECT {_TASK} task, (c_nationkey % 5 = 2)::INT home FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT task, avg(home) share, count(*) n FROM d WHERE task IS NOT NULL GROUP BY 1) SELECT round(sum(share * CASE task WHEN 'T2' THEN 0.4 ELSE 0.6 END), 6) share, sum(n)::BIGINT n FROM s")
def _(t):
    """The home region's share in what each task could be made of, weighted by tasks; kinds that belong to no task stay out."""
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.expr(_TASK).alias("task"), (F.col("c_nationkey") % 5 == 2).cast("int").alias("home")).where("task is not null")
    s = d.groupBy("task").agg(F.avg("home").alias("share"), F.count(F.lit(1)).alias("n"))
    return s.agg(F.round(F.sum(F.col("share") * F.when(F.col("task") == "T2", 0.4).otherwise(0.6)), 6).alias("share"), F.sum("n").alias("n"))


# ontology and entities

@R.query("source_definitions", """WITH a AS (SELECT *, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_type END metric FROM part), d AS (SELECT p_brand source_id, p_type concept, metric, p_partkey FROM a QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1)
SELECT substr(sha1(source_id || '|' || concept || '|' || coalesce(metric, '')), 1, 24) definition_id, source_id, concept, metric metric_id, CASE WHEN source_id < 'Brand#2' THEN 'as_filed' WHEN metric IS NULL THEN 'unmapped' ELSE 'latest' END vintage_policy FROM d""")
def _(t):
    """One definition of each source's concept, the first alias that names it, with its source's policy."""
    from ..functions.scalars import fact_id

    a = t.part.select(F.col("p_brand").alias("source_id"), F.col("p_type").alias("concept"), F.when(F.col("p_size") % 9 != 0, F.col("p_type")).alias("metric"), "p_partkey")
    d = a.groupBy("source_id", "concept").agg(F.min_by(F.struct("metric"), "p_partkey").alias("m")).select("source_id", "concept", F.col("m.metric").alias("metric_id"))
    policy = F.when(F.col("source_id") < "Brand#2", "as_filed").when(F.col("metric_id").isNull(), "unmapped").otherwise("latest")
    return d.select(fact_id(F.col("source_id"), F.col("concept"), F.col("metric_id")).alias("definition_id"), "source_id", "concept", "metric_id", policy.alias("vintage_policy"))


@R.query("company_securities", "SELECT upper(replace(c_mktsegment, ' ', '')) || (c_custkey % 500) || '.' || CASE WHEN c_nationkey < 12 THEN 'HK' ELSE 'US' END security_id, min(c_custkey) company, 'company_has_security' relation, count(*) companies FROM customer GROUP BY 1")
def _(t):
    """TICKER.EXCHANGE, one equity for each; the first company keeps it."""
    ticker = F.concat(F.upper(F.regexp_replace("c_mktsegment", " ", "")), (F.col("c_custkey") % 500).cast("string"), F.lit("."), F.when(F.col("c_nationkey") < 12, "HK").otherwise("US"))
    return t.customer.groupBy(ticker.alias("security_id")).agg(F.min("c_custkey").alias("company"), F.lit("company_has_security").alias("relation"), F.count(F.lit(1)).alias("companies"))


# gates, history, feedback

_COUNTS = {"Region": "region", "Nation": "nation", "Customer": "customer", "Order": "orders", "Supplier": "supplier"}
_LINKS = {"CONTAINS": "SELECT count(*) FROM nation", "HAS_CUSTOMER": "SELECT count(*) FROM customer", "HAS_SUPPLIER": "SELECT count(*) FROM supplier", "PLACED": "SELECT count(*) FROM orders", "SUPPLIED_BY": "SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"}


@R.query("graph_gate_equalities", f"WITH {GRAPH}, a AS (SELECT kind \"check\", count(*) actual FROM nodes GROUP BY 1 UNION ALL SELECT rel, count(*) FROM edges GROUP BY 1), e AS (" + " UNION ALL ".join([f"SELECT '{k}' \"check\", count(*) expected FROM {x}" for k, x in _COUNTS.items()] + [f"SELECT '{k}', ({x})" for k, x in _LINKS.items()]) + ") SELECT \"check\", coalesce(actual, 0) actual, expected, coalesce(actual, 0) = expected passed FROM e LEFT JOIN a USING (\"check\")")
def _(t):
    """Nodes and edges of the build against the rows of the tables that it was made from."""
    nodes, edges = G.build(t)
    n = F.count(F.lit(1))
    actual = nodes.groupBy(F.col("kind").alias("check")).agg(n.alias("actual")).unionByName(edges.groupBy(F.col("rel").alias("check")).agg(n.alias("actual")))
    sources = {k: getattr(t, x) for k, x in _COUNTS.items()} | {"CONTAINS": t.nation, "HAS_CUSTOMER": t.customer, "HAS_SUPPLIER": t.supplier, "PLACED": t.orders, "SUPPLIED_BY": t.lineitem.select("l_orderkey", "l_suppkey").distinct()}
    expected = None
    for k, df in sources.items():
        one = df.agg(n.alias("expected")).select(F.lit(k).alias("check"), "expected")
        expected = one if expected is None else expected.unionByName(one)
    out = expected.join(actual, "check", "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    return out.select("check", "actual", "expected", (F.col("actual") == F.col("expected")).alias("passed"))


@R.query("raw_checksums", "SELECT CASE WHEN page_id % 13 = 0 THEN 'missing_checksum' WHEN page_id % 11 = 0 THEN 'checksum_mismatch' ELSE 'passed' END status, count(*) n, sum(octet_length(encode(coalesce(html, ''))))::BIGINT bytes FROM pages GROUP BY 1")
def _(t):
    """Recorded digests of raw objects against their content; some were lost, some are of an earlier content."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    recorded = F.when(F.col("page_id") % 13 == 0, F.lit("")).when(F.col("page_id") % 11 == 0, F.sha2(F.concat(body, F.encode(F.lit("x"), "UTF-8")), 256)).otherwise(F.sha2(body, 256))
    p = t.pages.select(recorded.alias("recorded"), F.sha2(body, 256).alias("actual"), F.octet_length(body).alias("bytes"))
    status = F.when(F.col("recorded") == "", "missing_checksum").when(F.col("recorded") != F.col("actual"), "checksum_mismatch").otherwise("passed")
    return p.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bytes").cast("long")).alias("bytes"))


@R.query("history_purge_plan", """WITH b AS (SELECT o_orderstatus AS scope, year(o_orderdate)::INT build, count(*) n, bool_or(o_orderkey % 997 = 0) pinned FROM orders GROUP BY ALL)
SELECT scope, build, n, CASE WHEN row_number() OVER (PARTITION BY scope ORDER BY build DESC) <= 2 THEN 'keep_recent' WHEN pinned THEN 'keep_pinned' ELSE 'purge' END action FROM b""")
def _(t):
    """A dry run: of each scope the two latest builds stay, and those that something is pinned to."""
    from pyspark.sql import Window

    b = t.orders.groupBy(F.col("o_orderstatus").alias("scope"), F.year("o_orderdate").alias("build")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderkey") % 997 == 0).alias("pinned"))
    recent = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("build"))) <= 2
    return b.select("scope", "build", "n", F.when(recent, "keep_recent").when(F.col("pinned"), "keep_pinned").otherwise("purge").alias("action"))


@R.query("signal_hash", f"WITH {CHANGE} SELECT entity_id, metric_id, fiscal_year, sha256('{{\"direction\":\"' || CASE WHEN growth > 0 THEN 'up' WHEN growth < 0 THEN 'down' ELSE 'flat' END || '\",\"entity_id\":\"' || entity_id || '\",\"fiscal_year\":' || fiscal_year || ',\"metric_id\":\"' || metric_id || '\"}}') hash FROM chg WHERE growth IS NOT NULL")
def _(t):
    """A digest of each signal's JSON, its fields by name."""
    c = D.change(X.annual(t), ["entity_id", "metric_id"], "fiscal_year").where("growth is not null")
    direction = F.when(F.col("growth") > 0, "up").when(F.col("growth") < 0, "down").otherwise("flat")
    return c.select("entity_id", "metric_id", "fiscal_year", F.sha2(F.to_json(F.struct(direction.alias("direction"), "entity_id", "fiscal_year", "metric_id")), 256).alias("hash"))


@R.query("claim_conclusions", f"""WITH {CHANGE}, c AS (SELECT entity_id, fiscal_year, metric_id, CASE WHEN growth > 0 THEN 'up' WHEN growth < 0 THEN 'down' ELSE 'flat' END direction FROM chg WHERE growth IS NOT NULL)
SELECT entity_id, fiscal_year, count(*) claims, 2 * count(*) evidence, CASE WHEN count(DISTINCT direction) = 1 THEN 'supported_' || min(direction) ELSE 'mixed' END conclusion,
 sha256(string_agg(metric_id || ':' || (fiscal_year - 1) || ',' || metric_id || ':' || fiscal_year, ',' ORDER BY metric_id)) bundle FROM c GROUP BY ALL""")
def _(t):
    """Claims of growth with the two facts that each rests on; a conclusion holds if all of an entity's claims of a year agree."""
    c = D.change(X.annual(t), ["entity_id", "metric_id"], "fiscal_year").where("growth is not null")
    direction = F.when(F.col("growth") > 0, "up").when(F.col("growth") < 0, "down").otherwise("flat")
    fact = lambda y: F.concat_ws(":", "metric_id", y.cast("string"))
    rests = F.concat_ws(",", fact(F.col("fiscal_year") - 1), fact(F.col("fiscal_year")))
    g = c.select("entity_id", "fiscal_year", "metric_id", direction.alias("d"), rests.alias("r")).groupBy("entity_id", "fiscal_year")
    g = g.agg(F.count(F.lit(1)).alias("claims"), F.collect_set("d").alias("d"), F.array_sort(F.collect_list(F.struct("metric_id", "r"))).alias("b"))
    conclusion = F.when(F.size("d") == 1, F.concat(F.lit("supported_"), F.col("d")[0])).otherwise("mixed")
    return g.select("entity_id", "fiscal_year", "claims", (F.col("claims") * 2).alias("evidence"), conclusion.alias("conclusion"), F.sha2(F.array_join(F.transform("b", lambda x: x["r"]), ","), 256).alias("bundle"))


@R.query("feedback_hotspots", """WITH s AS (SELECT o_custkey AS sample, min(o_orderpriority) pattern, (o_custkey % 4)::VARCHAR task FROM orders WHERE o_custkey % 9 <> 0 GROUP BY ALL), d AS (SELECT sample, 'pattern' dimension, pattern AS value FROM s UNION ALL SELECT sample, 'task', task FROM s),
c AS (SELECT o_custkey AS sample, o_orderpriority AS role, o_totalprice > 400000 confirms, unnest(['status_' || o_orderstatus, 'month_' || (month(o_orderdate) % 3)]) issue FROM orders),
i AS (SELECT sample, issue, count(DISTINCT role) > 1 agreed, bool_or(confirms) confirmed FROM c GROUP BY ALL), n AS (SELECT dimension, value, count(*) total FROM d GROUP BY ALL)
SELECT dimension, value, issue, count(*) flagged, count(*) FILTER (agreed) agreed, count(*) FILTER (confirmed) confirmed, total, round(count(*) / total::DOUBLE, 6) rate FROM d JOIN i USING (sample) JOIN n USING (dimension, value) GROUP BY dimension, value, issue, total""")
def _(t):
    samples = t.orders.where("o_custkey % 9 <> 0").groupBy(F.col("o_custkey").alias("sample")).agg(F.min("o_orderpriority").alias("pattern")).withColumn("task", F.col("sample") % 4)
    issues = F.array(F.concat(F.lit("status_"), "o_orderstatus"), F.concat(F.lit("month_"), (F.month("o_orderdate") % 3).cast("string")))
    calls = t.orders.select(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("role"), issues.alias("issues"), (F.col("o_totalprice") > 400000).alias("confirms"))
    return K.hotspots(samples, calls, ["pattern", "task"])


_HOLD = "CASE WHEN c_custkey % 1000 = 3 THEN 'peer' WHEN c_custkey % 500 = 7 THEN 'temporal' END"


@R.query("split_component_redirect", f"""WITH c AS (SELECT n_regionkey component, count(*) n, bool_or(c_custkey % 1000 = 3) peer, bool_or(c_custkey % 500 = 7) temporal, ('0x' || substr(sha256('0|' || n_regionkey), 1, 8))::BIGINT % 100 bucket FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT component, n, CASE WHEN n > 0.2 * (SELECT sum(n) FROM c) THEN 'train' WHEN peer THEN 'test_peer' WHEN temporal THEN 'test_temporal' WHEN bucket < 70 THEN 'train' WHEN bucket < 80 THEN 'dev' ELSE 'test' END split FROM c""")
def _(t):
    """Customers that share a nation or a region stay together; regions of over a fifth of all go to train."""
    keys = t.nation.select((F.col("n_nationkey").cast("long") + 1000).alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    of = components(keys).select((F.col("id") - 1000).alias("nation"), F.col("component").cast("int").alias("component"))
    samples = t.customer.join(of, F.col("c_nationkey") == F.col("nation")).select("component", F.expr(_HOLD).alias("holdout"))
    return K.component_splits(samples, ["peer", "conflict", "composition", "temporal", "entity"])
