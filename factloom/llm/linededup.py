"""Line deduplication by site-relative frequency, as one DataFrame plan.

A host's boilerplate lines are those that more than ``ratio`` of its different pages contain; a line on
one page only does not repeat, so ``least`` is two. Copies of a text count as one page, else they would
vote for their own lines and all be emptied. The lines are dropped from every page of the host. A host
with n lines a page has at most n / ratio such lines, so they travel as one row a host: by broadcast
where their measured size is small, else repeated for the parts that each host's pages are dealt into.

Lines are compared with white space trimmed, by 128-bit digests, so what travels does not grow with their
length; blank lines are kept. Defined cases: a null text stays null; a null host is a host of its own;
null texts count as one page; columns besides ``text`` pass unchanged whatever their names; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import scratch

RATIO, LEAST = 0.05, 2
#: Blanks that are trimmed from a line.
_BLANK = " \t\r\x0b\x0c"


def _digest(line):
    """128 bits of a line without the white space around it; null for a blank one."""
    line = F.trim(line, F.lit(_BLANK))
    return F.when(line != "", F.unhex(F.md5(line.cast("binary"))))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, lines): the digests of the lines of each host that exceed the ratio."""
    page = F.coalesce(F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))), F.lit(b""))
    lines = F.transform(F.split(F.col(f"`{text}`"), "\n"), _digest)
    named = pages.select(F.col(f"`{host}`").alias("host"), page.alias("page"), lines.alias("lines"))
    # copies of a text or a line meet as partial counts, so a hot host, text or line is no hot task
    totals = named.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = named.select("host", "page", F.explode("lines").alias("line")).where("line is not null").distinct()
    seen = found.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    over = seen.join(totals, seen["host"].eqNullSafe(totals["host"])).where(F.col("n") > ratio * F.col("pages"))
    return over.groupBy(seen["host"].alias("host")).agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """The pages with boilerplate lines dropped from ``text``, other columns as they were, and the
    numbers of lines and of dropped lines as ``n_lines`` and ``n_dropped``."""
    host_key, drop, kept = (scratch.column_like(c, pages.columns) for c in ("_host", "_drop", "_kept"))
    bad = boilerplate(pages, host, text, ratio, least).select(F.col("host").alias(host_key), F.col("lines").alias(drop))
    size = 24 * F.size(drop) + 64
    joined = scratch.hot_join(pages, bad, F.col(f"`{host}`"), host_key, F.col(f"`{text}`"), "boilerplate", size)
    parts = F.split(F.col(f"`{text}`"), "\n")
    keep = F.when(F.col(drop).isNull(), parts).otherwise(
        F.filter(parts, lambda x: ~F.coalesce(F.array_contains(F.col(drop), _digest(x)), F.lit(False)))
    )
    joined = joined.withColumn(kept, keep)
    columns = [
        F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(f"`{c}`")
        for c in pages.columns
    ]
    n, left = F.coalesce(F.size(parts), F.lit(0)), F.coalesce(F.size(kept), F.lit(0))
    return joined.select(
        *columns,
        F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col(text).isNull(), 0).otherwise(n - left).cast("long").alias("n_dropped"),
    )
