"""Raw JSON records into facts, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S

_UNIT = "array<struct<start:string,end:string,val:decimal(38,10),fy:int,fp:string,form:string,filed:string,accn:string,frame:string>>"
COMPANY_FACTS = f"struct<cik:string,facts:map<string,map<string,struct<units:map<string,{_UNIT}>>>>>"


def company_facts(records: DataFrame, json: str, aliases: DataFrame) -> DataFrame:
    """Facts of company filings; (concept, metric_id) aliases are joined, other concepts go."""
    r = records.select(F.from_json(json, COMPANY_FACTS).alias("r")).select("r.cik", F.explode("r.facts"))
    r = r.select("cik", F.col("key").alias("namespace"), F.explode("value")).select("cik", "namespace", F.col("key").alias("concept"), F.explode("value.units"))
    r = r.select(F.lpad("cik", 10, "0").alias("cik"), "namespace", "concept", F.col("key").alias("unit"), F.explode("value").alias("f"))
    r = r.join(aliases, "concept").select("cik", "metric_id", "unit", "f.*")
    days = F.datediff(S.iso_day(F.col("end")), S.iso_day(F.col("start"))) + 1
    label = F.when(F.col("fp") == "FY", "FY").when(F.col("fp").isin("Q1", "Q2", "Q3", "Q4"), F.when(days > 120, F.concat("fp", F.lit("_YTD"))).when(F.col("start").isNull() | days.isNotNull(), F.col("fp")).otherwise(F.concat("fp", F.lit("_UNKNOWN_DURATION"))))
    return r.withColumn("period_label", label)


def canonical_filings(facts: DataFrame) -> DataFrame:
    """One fact of each period: original annual forms first, then framed, then latest filed."""
    from ..operators.facts import best_by

    form = F.when(F.col("form").startswith("10-K"), 50).when(F.col("form").startswith("20-F"), 45).when(F.col("form").startswith("10-Q"), 40).otherwise(10)
    score = form - F.when(F.col("form").endswith("/A"), 30).otherwise(0)
    keys = ["cik", "metric_id", "unit", "start", "end"]
    return best_by(facts, keys, [score.desc(), F.col("frame").isNotNull().desc(), F.desc_nulls_last("filed"), F.desc_nulls_last("accn")])


def observations(records: DataFrame, json: str) -> DataFrame:
    """A fact for each observation of a series; missing values, written as a dot, go."""
    r = records.select("series_id", F.explode(F.from_json(json, "struct<observations:array<struct<date:string,value:string>>>")["observations"]).alias("o"))
    return r.select("series_id", S.iso_day(F.col("o.date")).alias("period_end"), F.col("o.value").try_cast("decimal(38,10)").alias("value")).where("value is not null")


def indicators(records: DataFrame, json: str) -> DataFrame:
    """Annual facts of (country, indicator, year) records, over the calendar year."""
    r = records.select(F.explode(F.from_json(json, "array<struct<country:struct<id:string>,indicator:struct<id:string>,date:string,value:decimal(38,10)>>")).alias("o"))
    year = F.col("o.date").try_cast("int")
    return r.select(F.col("o.country.id").alias("country"), F.col("o.indicator.id").alias("indicator"), year.alias("year"), F.make_date(year, F.lit(1), F.lit(1)).alias("period_start"), F.make_date(year, F.lit(12), F.lit(31)).alias("period_end"), F.col("o.value").alias("value")).where("value is not null")


def datamapper(records: DataFrame, json: str, retrieval_year: Column) -> DataFrame:
    """Facts of nested maps indicator, country, year; years from the retrieval on are forecasts."""
    r = records.select(retrieval_year.alias("_ry"), F.explode(F.from_json(json, "struct<values:map<string,map<string,map<string,decimal(38,10)>>>>")["values"]).alias("indicator", "_c"))
    r = r.select("_ry", "indicator", F.explode("_c").alias("country", "_y")).select("_ry", "indicator", "country", F.explode("_y").alias("year", "value"))
    return r.select("indicator", "country", F.col("year").cast("int").alias("year"), "value", (F.col("year").cast("int") >= F.col("_ry")).alias("is_forecast"))


def html_chunks(pages: DataFrame, size: int = 3000, most: int = 20) -> DataFrame:
    """Fixed chunks of each page's text without tags, with their offsets."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), r"[ \t\n\r]+", " "))
    t = pages.select("page_id", text.alias("text")).where("text <> ''")
    starts = F.sequence(F.lit(0), F.least(F.floor((F.length("text") - 1) / size), F.lit(most - 1)).cast("int"))
    return t.select("page_id", "text", F.explode(starts).alias("chunk")).select("page_id", "chunk", (F.col("chunk") * size).alias("start"), F.substring("text", F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, row, table, table_row, cells) of every table row or list, 500 characters a cell.

    ``row`` runs over the page; ``table`` is null for what stands outside a table, and ``table_row`` runs within the table.
    """
    whole = r"(?is)<table\b[^>]*>.*?</table\s*>|<(?:tr|ul)\b[^>]*>.*?</(?:tr|ul)\s*>"
    blocks = F.regexp_extract_all("html", F.lit(whole), 0)
    is_table = lambda b: b.rlike(r"(?i)^<table\b")
    bodies = lambda b: F.regexp_extract_all(b, F.lit(r"(?is)<(?:tr|ul)\b[^>]*>(.*?)</(?:tr|ul)\s*>"), 1)
    p = pages.select("page_id", F.posexplode(blocks).alias("block", "html"))
    p = p.select("page_id", "block", is_table(F.col("html")).alias("is_table"), bodies(F.col("html")).alias("bodies"))
    w = Window.partitionBy("page_id").orderBy("block")
    before = F.coalesce(F.sum(F.size("bodies")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    number = F.when(F.col("is_table"), F.sum(F.col("is_table").cast("int")).over(w) - 1).cast("int")
    # the sums come first: beside a generator they would run over its rows
    p = p.select("page_id", before.alias("before"), number.alias("table"), "bodies").select("page_id", "before", "table", F.posexplode("bodies").alias("k", "body"))
    cells = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<(?:td|th|li)\b[^>]*>(.*?)</(?:td|th|li)\s*>"), 1), lambda c: F.substring(F.trim(F.regexp_replace(c, "<[^>]*>", "")), 1, 500))
    return p.select("page_id", (F.col("before") + F.col("k")).alias("row"), "table", F.when(F.col("table").isNotNull(), F.col("k")).alias("table_row"), cells.alias("cells"))
