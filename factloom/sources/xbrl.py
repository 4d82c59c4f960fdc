"""Numbers tagged inline in HTML filings, with the units and periods they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def _elements(html: Column, name: str) -> Column:
    """Every whole element of that name."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>"), F.lit(0))


def _inner(element: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(element, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)), F.lit(""))


def _head(element: Column) -> Column:
    return F.regexp_extract(element, r"(?s)^<[^\s>]*([^>]*)>", 1)


def _context(element: Column) -> Column:
    days = [x for n in ("enddate", "instant", "startdate") for x in (F.lit(n), _inner(element, f"xbrli:{n}"))]
    return F.named_struct(F.lit("id"), _attribute(_head(element), "id"), *days)


def _unit(element: Column) -> Column:
    measures = F.regexp_extract_all(element, F.lit(r"(?is)<xbrli:measure>(.*?)</xbrli:measure>"), F.lit(1))
    plain = F.transform(measures, lambda m: F.trim(F.element_at(F.split(m, ":"), -1)))
    return F.named_struct(F.lit("id"), _attribute(_head(element), "id"), F.lit("unit"), F.nullif(F.array_join(plain, "/"), F.lit("")))


def inline_facts(pages: DataFrame, key: str, html: str, aliases: DataFrame, fallback: Column | None = None) -> DataFrame:
    """(key, metric_id, concept, value, unit, period, evidence) of every different tagged number whose concept has an alias.

    The period is JSON of the context's dates, or ``fallback`` where the context is not there. Units and contexts are looked up inside
    their page, so only the rows found are shuffled; of two elements with one id the last counts. No limit of numbers a page.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    contexts = F.filter(F.transform(_elements(text, "xbrli:context"), _context), lambda c: F.coalesce(c["enddate"], c["instant"], c["startdate"]).isNotNull())
    units = F.filter(F.transform(_elements(text, "xbrli:unit"), _unit), lambda u: u["unit"].isNotNull())
    later = F.lit("") if fallback is None else F.coalesce(fallback, F.lit(""))
    # arrays first: beside a generator they would be cut again for each tag
    p = pages.select(F.col(key).alias("key"), contexts.alias("contexts"), units.alias("units"), later.alias("later"), _elements(text, "ix:nonfraction").alias("tags"))
    p = p.select("key", "contexts", "units", "later", F.posexplode("tags").alias("at", "tag"))
    head = _head(F.col("tag"))
    p = p.select("*", *[_attribute(head, a).alias(c) for a, c in (("name", "concept"), ("unitref", "unit_ref"), ("contextref", "context_ref"))], *[_attribute(head, a).alias(a) for a in ("scale", "decimals", "format")])
    p = p.withColumn("context", F.try_element_at(F.filter("contexts", lambda c: c["id"] == F.col("context_ref")), F.lit(-1)))
    context = F.col("context")
    unit = F.try_element_at(F.filter("units", lambda u: u["id"] == F.col("unit_ref")), F.lit(-1))["unit"]
    details = [F.when(F.col(a).isNotNull(), F.concat(F.lit(f"{a}="), a)) for a in ("scale", "decimals", "format")]
    dates = F.to_json(F.struct("context_ref", *[context[n].alias(n) for n in ("enddate", "instant", "startdate")]))
    period = F.when(context.isNotNull(), dates).when(F.col("later") != "", F.col("later")).otherwise(F.coalesce("context_ref", F.lit("")))
    body = F.regexp_replace(F.regexp_extract("tag", r"(?is)^<[^>]*>(.*)</ix:nonfraction\s*>$", 1), "<[^>]*>", " ")
    f = p.select(
        "key", "at", "concept", S.numeric_text(body).alias("value"), F.concat_ws("; ", F.coalesce(unit, "unit_ref", F.lit("inline_xbrl_unit")), *details).alias("unit"), period.alias("period"),
        F.substring(F.trim(body), 1, 1000).alias("evidence"),
    ).where("concept is not null and value is not null")
    f = f.join(aliases.select("concept", "metric_id"), "concept")
    f = f.groupBy("key", "metric_id", "concept", "value", "unit", "period").agg(F.min_by("evidence", "at").alias("evidence"))
    return f.withColumnRenamed("key", key)
