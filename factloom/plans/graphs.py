"""The property graph over the tables: build, neighbours, expansion, integrity, motifs, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..registry import Registry

R = Registry()

GRAPH = """nodes AS (SELECT 'region:' || r_regionkey id, 'Region' kind FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'Nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'Order' FROM orders UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier' FROM supplier),
edges AS (SELECT DISTINCT src, rel, dst FROM (SELECT 'region:' || n_regionkey src, 'CONTAINS' rel, 'nation:' || n_nationkey dst FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'HAS_CUSTOMER', 'customer:' || c_custkey FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'HAS_SUPPLIER', 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'PLACED', 'order:' || o_orderkey FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'SUPPLIED_BY', 'supplier:' || l_suppkey FROM lineitem))"""


@R.query("graph_build_counts", f"WITH {GRAPH} SELECT kind, count(*) n FROM nodes GROUP BY 1 UNION ALL SELECT rel, count(*) FROM edges GROUP BY 1")
def _(t):
    nodes, edges = G.build(t)
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy(F.col("rel").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@R.query("serve_neighbors", f"WITH {GRAPH} SELECT rel, dst neighbour, 'out' direction FROM edges WHERE src = 'nation:3' UNION ALL SELECT rel, src, 'in' FROM edges WHERE dst = 'nation:3'")
def _(t):
    return G.neighbours(G.build(t)[1], "nation:3")


@R.query("graph_expand_collect", f"WITH {GRAPH} SELECT n.id, count(e.dst) n_related, sha256(coalesce(string_agg(e.dst, ',' ORDER BY e.dst), '')) related FROM nodes n LEFT JOIN edges e ON e.src = n.id AND e.rel = 'HAS_SUPPLIER' WHERE n.kind = 'Nation' GROUP BY 1")
def _(t):
    nodes, edges = G.build(t)
    out = G.expand(nodes.where("kind = 'Nation'"), edges, "HAS_SUPPLIER", required=False)
    return out.select("id", F.size("related").cast("long").alias("n_related"), F.sha2(F.array_join("related", ","), 256).alias("related"))


@R.query("graph_missing_edges", f"WITH {GRAPH} SELECT id FROM nodes WHERE kind = 'Order' EXCEPT SELECT src FROM edges WHERE rel = 'SUPPLIED_BY'")
def _(t):
    nodes, edges = G.build(t)
    return nodes.where("kind = 'Order'").join(edges.where("rel = 'SUPPLIED_BY'"), F.col("id") == F.col("src"), "left_anti").select("id")


@R.query("graph_dangling", f"WITH {GRAPH} SELECT rel, sum((s.id IS NULL OR d.id IS NULL)::INT)::BIGINT dangling FROM edges LEFT JOIN nodes s ON s.id = src AND s.kind <> 'Region' LEFT JOIN nodes d ON d.id = dst GROUP BY 1")
def _(t):
    nodes, edges = G.build(t)
    return G.dangling(nodes.where("kind <> 'Region'"), nodes, edges)


@R.query("graph_motifs", f"WITH {GRAPH} SELECT a.rel first, b.rel AS second, count(*) n, count(DISTINCT a.src) roots FROM edges a JOIN edges b ON a.dst = b.src GROUP BY ALL")
def _(t):
    return G.motifs(G.build(t)[1])


@R.query("graph_provenance_complete", f"WITH {GRAPH}, o AS (SELECT src id, rel FROM edges UNION ALL SELECT dst, 'IN_' || rel FROM edges) SELECT count(*) complete FROM (SELECT id FROM o WHERE rel IN ('SUPPLIED_BY', 'IN_PLACED') GROUP BY 1 HAVING count(DISTINCT rel) = 2)")
def _(t):
    edges = G.build(t)[1]
    o = edges.select(F.col("src").alias("id"), "rel").unionByName(edges.select(F.col("dst").alias("id"), F.concat(F.lit("IN_"), "rel").alias("rel")))
    return o.where(F.col("rel").isin("SUPPLIED_BY", "IN_PLACED")).groupBy("id").agg(F.count_distinct("rel").alias("k")).where("k = 2").agg(F.count(F.lit(1)).alias("complete"))


@R.query("graph_role_coverage", f"WITH {GRAPH}, s AS (SELECT src id, list_sort(list(DISTINCT dst)) m FROM edges WHERE rel = 'SUPPLIED_BY' GROUP BY 1) SELECT len(m)::BIGINT suppliers, count(*) n FROM s GROUP BY 1")
def _(t):
    s = G.build(t)[1].where("rel = 'SUPPLIED_BY'").groupBy("src").agg(F.size(F.collect_set("dst")).cast("long").alias("suppliers"))
    return s.groupBy("suppliers").agg(F.count(F.lit(1)).alias("n"))


@R.query("graph_components")
def _(t):
    """The whole bipartite graph; recursive SQL cannot follow it, tests hold it against union-find."""
    return G.components_of(t.lineitem.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b")))


@R.query("graph_shape")
def _(t):
    """The graph of each customer's orders and their suppliers."""
    o = t.orders.select(F.col("o_custkey").cast("long").alias("sample"), "o_orderkey")
    e = t.lineitem.select("l_orderkey", "l_suppkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return G.shapes(e.select("sample", F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")))
