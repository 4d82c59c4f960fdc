"""The fact views as SQL, for the statements that queries are held against."""

LINES = """lines AS (
  SELECT l.*, o_orderdate, o_custkey, n_name, r_name FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FACTS = LINES + """, wide AS (
  SELECT n_name entity_id, r_name industry, year(o_orderdate)::INT fiscal_year,
    sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))::DOUBLE revenue, sum(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE gross_value,
    sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4)))::DOUBLE discount_value, sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4)))::DOUBLE tax_value,
    sum(CAST(l_quantity AS DECIMAL(18,4)))::DOUBLE quantity FROM lines GROUP BY ALL),
facts AS (
  SELECT entity_id, industry, 'revenue' metric_id, fiscal_year, revenue AS value FROM wide UNION ALL SELECT entity_id, industry, 'gross_value', fiscal_year, gross_value FROM wide
  UNION ALL SELECT entity_id, industry, 'discount_value', fiscal_year, discount_value FROM wide UNION ALL SELECT entity_id, industry, 'tax_value', fiscal_year, tax_value FROM wide
  UNION ALL SELECT entity_id, industry, 'quantity', fiscal_year, quantity FROM wide)"""
CHANGE = FACTS + """, chg AS (
  SELECT *, value - prior AS difference, CASE WHEN prior <> 0 THEN (value - prior) / abs(prior) * 100 END growth
  FROM (SELECT *, lag(value) OVER w prior, lag(fiscal_year) OVER w py FROM facts WINDOW w AS (PARTITION BY entity_id, metric_id ORDER BY fiscal_year)) WHERE py = fiscal_year - 1)"""
QUARTERS = LINES + """, q AS (
  SELECT n_name entity_id, year(o_orderdate)::INT fiscal_year, quarter(o_orderdate)::INT AS quarter, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))::DOUBLE AS value
  FROM lines GROUP BY ALL), quarters AS (SELECT *, (fiscal_year * 4 + quarter)::INT period_index FROM q)"""
DAILY = """daily AS (SELECT event_type series, ts::DATE AS day, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS value FROM events GROUP BY ALL)"""
