"""Scalar rules on facts as expressions inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Factors to millions by scale word, in the order they are tried.
SCALES = (("hundred_million", 100.0), ("ten_thousand", 0.01), ("thousand", 0.001), ("million", 1.0), ("billion", 1000.0))
_QUARTERS = ("Q1", "Q2", "Q3", "Q4")


def frequency(freq: Column, quarter: Column, year: Column) -> Column:
    """Declared frequency, or one inferred from the period of a filing."""
    f = F.lower(F.coalesce(freq, F.lit("")))
    quarterly = quarter.isin(*_QUARTERS)
    filing = F.when(quarterly, "quarterly").when((quarter == "FY") | year.isNotNull(), "annual").otherwise(f)
    plain = F.when(year.isNotNull() & quarterly, "quarterly").when(year.isNotNull(), "annual").otherwise("observation")
    return F.when(f.isin("filing_period", "fiscal_period"), filing).when(f == "", plain).otherwise(f)


def period_index(freq: Column, year: Column, quarter: Column, day: Column) -> Column:
    """A number that is one greater for the next period of the same frequency."""
    q = F.when(quarter.isin(*_QUARTERS), F.substring(quarter, 2, 1).cast("int"))
    return F.when(freq == "annual", year).when(freq == "quarterly", year * 4 + q).when(freq == "monthly", F.year(day) * 12 + F.month(day)).otherwise(
        F.datediff(day, F.lit("1970-01-01").cast("date"))
    )


def annual_duration_valid(freq: Column, kind: Column, start: Column, end: Column) -> Column:
    """Annual flows span 300 to 430 days; others pass."""
    return F.when(freq != "annual", True).when(kind == "point_in_time", True).otherwise(F.coalesce(F.datediff(end, start).between(300, 430), F.lit(False)))


def iso_day(text: Column) -> Column:
    """The date that a text begins with, or null."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def numeric_text(text: Column) -> Column:
    """Number in a table cell: parentheses are negative, thousands marks and symbols go."""
    t = F.trim(text)
    digits = F.regexp_replace(t, r"[^0-9.]", "")
    sign = F.when(t.rlike(r"^\(.*\)$") | t.rlike(r"^\s*-"), -1.0).otherwise(1.0)
    return F.when((digits != "") & (F.regexp_count(digits, F.lit(r"\.")) <= 1), sign * digits.try_cast("double"))


def to_millions(value: Column, unit: Column) -> Column:
    """Monetary value in millions by the scale word in its unit; without one it is in units."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    out = F.when(u.contains("percent"), value).when(u == "ratio", value * 100).when(u.contains("per_share"), value)
    for word, factor in SCALES:
        out = out.when(u.contains(word), value * factor)
    return out.otherwise(value / 1e6)


def canonical_url(url: Column) -> Column:
    """The url with its query parameters sorted and without a fragment."""
    base = F.regexp_replace(url, "#.*$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(base, r"\?(.*)$", 1), "&")), "&")
    return F.when(base.contains("?"), F.concat(F.regexp_extract(base, r"^([^?]*)", 1), F.lit("?"), query)).otherwise(base)


def fact_id(*parts: Column) -> Column:
    """A stable id of 24 hex digits."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 24)
