"""Bound roles, group constraints, splits with closed components, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roles as P
from ..registry import Registry

R = Registry()

# a binding is a customer, its roles are order states, groups are priorities, periods are years
_ROWS = "b AS (SELECT o_custkey binding, o_orderstatus AS role, o_orderpriority g, year(o_orderdate)::INT AS period, o_orderkey, o_totalprice FROM orders)"


def _rows(t):
    return t.orders.select(
        F.col("o_custkey").alias("binding"), F.col("o_orderstatus").alias("role"), F.col("o_orderpriority").alias("g"), F.year("o_orderdate").alias("period"), "o_orderkey", "o_totalprice"
    )


@R.query("role_filter", f"WITH {_ROWS}, k AS (SELECT * FROM b WHERE role <> 'F' OR o_totalprice >= 150000) SELECT binding, role, count(*) n FROM k WHERE binding IN (SELECT binding FROM k WHERE role = 'F') GROUP BY ALL")
def _(t):
    kept = P.keep(_rows(t), "F", P.predicate(F.col("o_totalprice"), "gte", 150000.0))
    return kept.groupBy("binding", "role").agg(F.count(F.lit(1)).alias("n"))


@R.query("role_deduplicate", f"WITH {_ROWS} SELECT binding, role, period, min(o_orderkey) o_orderkey FROM b GROUP BY ALL")
def _(t):
    return P.unique(_rows(t), ["period"], "o_orderkey").select("binding", "role", "period", "o_orderkey")


@R.query("role_key_equal", f"WITH {_ROWS}, s AS (SELECT binding, coalesce(list_sort(list(DISTINCT g) FILTER (role = 'F')), []) f, coalesce(list_sort(list(DISTINCT g) FILTER (role = 'O')), []) o FROM b WHERE role IN ('F', 'O') GROUP BY 1) SELECT binding, f = o AND len(f) > 0 passed, len(list_intersect(f, o)) >= 2 common FROM s")
def _(t):
    rows, key = _rows(t), F.col("g")
    common = P.equal_keys(rows, "F", "O", key, 2).withColumnRenamed("passed", "common")
    return P.equal_keys(rows, "F", "O", key).join(common, "binding")


@R.query("role_contiguous", f"WITH {_ROWS}, s AS (SELECT binding, g, coalesce(list_sort(list(DISTINCT period) FILTER (role = 'F')), []) f, coalesce(list_sort(list(DISTINCT period) FILTER (role = 'O')), []) o FROM b WHERE role IN ('F', 'O') GROUP BY ALL) SELECT binding, bool_and(len(f) >= 1 AND f = o AND coalesce(f[-1] - f[1] + 1 = len(f), false)) passed FROM s GROUP BY 1")
def _(t):
    return P.contiguous(_rows(t), ["F", "O"], "g", "period", 1)


@R.query("role_previous_by", f"WITH {_ROWS}, r AS (SELECT * FROM b WHERE g IN ('1-URGENT', '2-HIGH') AND role IN ('F', 'O')), n AS (SELECT binding, count(DISTINCT g) groups FROM r GROUP BY 1), j AS (SELECT DISTINCT x.binding, x.g, x.period FROM r x JOIN r y ON x.binding = y.binding AND x.g = y.g AND y.period = x.period - 1 WHERE x.role = 'O' AND y.role = 'F'), k AS (SELECT binding, period, count(*) c FROM j GROUP BY ALL) SELECT k.binding, max(period) period FROM k JOIN n ON k.binding = n.binding AND c = groups GROUP BY 1")
def _(t):
    return P.previous_by(_rows(t).where(F.col("g").isin("1-URGENT", "2-HIGH")), "O", "F", "g", "period", 1)


@R.query("constraint_group", """WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 same_flag, count(DISTINCT l_linestatus) = 1 compatible, count(DISTINCT l_partkey) >= 3 enough, count(*) = count(DISTINCT l_suppkey) is_unique, bool_or(l_discount > 0.05) qualified, bool_and(l_quantity > 0) every FROM lineitem GROUP BY 1)
SELECT *, same_flag AND compatible AND enough AND is_unique AND qualified AND every passed FROM g""")
def _(t):
    tests = {
        "same_flag": P.same(F.col("l_returnflag")), "compatible": F.count_distinct("l_linestatus") == 1, "enough": F.count_distinct("l_partkey") >= 3,
        "is_unique": F.count(F.lit(1)) == F.count_distinct("l_suppkey"), "qualified": F.bool_or(F.col("l_discount") > 0.05), "every": F.bool_and(F.col("l_quantity") > 0),
    }
    return P.constraints(t.lineitem, ["l_orderkey"], tests)


@R.query("constraint_by_series", "WITH s AS (SELECT c_nationkey, c_mktsegment, count(DISTINCT c_acctbal > 0) = 1 one FROM customer GROUP BY ALL) SELECT c_nationkey, bool_and(one) compatible FROM s GROUP BY 1")
def _(t):
    s = t.customer.groupBy("c_nationkey", "c_mktsegment").agg((F.count_distinct(F.col("c_acctbal") > 0) == 1).alias("one"))
    return s.groupBy("c_nationkey").agg(F.bool_and("one").alias("compatible"))


@R.query("constraint_disjoint", "WITH s AS (SELECT n_regionkey k, list(DISTINCT c_mktsegment) FILTER (c_acctbal > 9500) a, list(DISTINCT c_mktsegment) FILTER (c_acctbal < -500) b FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) SELECT k, coalesce(len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b), false) AS disjoint FROM s")
def _(t):
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    some = lambda w: F.collect_set(F.when(F.expr(w), F.col("c_mktsegment")))
    s = j.groupBy(F.col("n_regionkey").alias("k")).agg(some("c_acctbal > 9500").alias("a"), some("c_acctbal < -500").alias("b"))
    return s.select("k", ((F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b")).alias("disjoint"))


@R.query("constraint_above_average", "WITH a AS (SELECT *, sum(CAST(c_acctbal AS DECIMAL(18,4))) OVER w / count(*) OVER w m FROM customer WINDOW w AS (PARTITION BY c_nationkey)) SELECT c_nationkey, count(*) FILTER (c_acctbal > m) above, count(*) FILTER (c_acctbal > m) > 0 passed FROM a GROUP BY 1")
def _(t):
    # the mean is joined back by nation: one small row a group instead of a window that holds a whole group
    m = t.customer.groupBy("c_nationkey").agg((F.sum(F.col("c_acctbal").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))).alias("m"))
    above = F.count_if(F.col("c_acctbal") > F.col("m"))
    return t.customer.join(m, "c_nationkey").groupBy("c_nationkey").agg(above.alias("above"), (above > 0).alias("passed"))


@R.query("constraint_complete_across", "WITH s AS (SELECT o_custkey, year(o_orderdate) y, list_sort(list(DISTINCT o_orderstatus)) s FROM orders GROUP BY ALL) SELECT o_custkey, count(DISTINCT s) = 1 complete FROM s GROUP BY 1")
def _(t):
    s = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    return s.groupBy("o_custkey").agg((F.count_distinct("s") == 1).alias("complete"))


@R.query("constraint_followup_pair", "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) l_returnflag FROM lineitem GROUP BY ALL) SELECT a.l_orderkey, count(*) n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag || b.l_returnflag IN ('NR', 'RA') GROUP BY 1")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    pair = F.concat("l_returnflag", F.lead("l_returnflag").over(w))
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    ordered = lines.select("l_orderkey", F.when(F.lead("l_linenumber").over(w) == F.col("l_linenumber") + 1, pair).alias("pair"))
    return ordered.where(F.col("pair").isin("NR", "RA")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def _bucket(c):
    return F.conv(F.substring(F.sha1(c.cast("string")), 1, 8), 16, 10).cast("long")


_HASH = "('0x' || substr(sha1({c}::VARCHAR), 1, 8))::BIGINT"
_SAMPLES = "s AS (SELECT o_orderkey k, o_custkey e, year(o_orderdate)::INT y FROM orders)"


@R.query("split_assignment", f"""WITH {_SAMPLES}, c AS (SELECT e, max(y) y, bool_or({_HASH.format(c='e')} % 20 = 0) held FROM s GROUP BY 1)
SELECT k, CASE WHEN held THEN 'test_entity_holdout' WHEN c.y >= 1998 THEN 'test_temporal_holdout' WHEN {_HASH.format(c='e')} % 100 < 80 THEN 'train' WHEN {_HASH.format(c='e')} % 100 < 90 THEN 'dev' ELSE 'test_standard' END split FROM s JOIN c USING (e)""")
def _(t):
    """Clusters are the components over shared entities; a cluster is held out as a whole if any of its members is."""
    s = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("e"), F.year("o_orderdate").alias("y"))
    c = s.groupBy("e").agg(F.max("y").alias("last"), F.bool_or(_bucket(F.col("e")) % 20 == 0).alias("held"))
    b = _bucket(F.col("e")) % 100
    split = F.when(F.col("held"), "test_entity_holdout").when(F.col("last") >= 1998, "test_temporal_holdout").when(b < 80, "train").when(b < 90, "dev").otherwise("test_standard")
    return s.join(c, "e").select("k", split.alias("split"))


@R.query("split_component_holdout", """WITH RECURSIVE n AS (SELECT s_suppkey k, s_nationkey, s_suppkey % 10 z FROM supplier), l AS (SELECT a.k a, b.k b FROM n a JOIN n b ON a.k <> b.k AND (a.s_nationkey = b.s_nationkey AND a.z = b.z)),
r AS (SELECT k x, k y FROM n UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y) SELECT x::BIGINT k, min(y)::BIGINT component, bool_or(y % 20 = 0) held FROM r GROUP BY 1""")
def _(t):
    n = t.supplier.select(F.col("s_suppkey").alias("k"), F.concat_ws(":", "s_nationkey", F.col("s_suppkey") % 10).alias("key"))
    return P.held_out(n, "k", "key", F.col("k") % 20 == 0)


@R.query("evidence_partition", "WITH e AS (SELECT DISTINCT l_orderkey src, l_returnflag rel, l_suppkey dst FROM lineitem), r AS (SELECT * FROM e WHERE rel = 'R' AND src % 20 = 0), d AS (SELECT DISTINCT dst FROM r) SELECT rel, CASE WHEN rel = 'R' AND src % 20 = 0 THEN 'required' WHEN rel = 'A' OR src % 20 = 0 OR dst IN (SELECT dst FROM d) THEN 'context' ELSE 'discarded' END part, count(*) n FROM e GROUP BY ALL")
def _(t):
    e = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.col("l_returnflag").alias("rel"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    seeds = t.orders.where("o_orderkey % 20 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return P.evidence(e, seeds, ["R"], ["A"]).groupBy("rel", "part").agg(F.count(F.lit(1)).alias("n"))
