"""Selection among filed values, names and definitions of one thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import column_like

# Rank of a form for yearly and point values, quarter values, and all others.
ANNUAL_FORMS = {"10-K": 100, "20-F": 95, "40-F": 95, "10-K/A": 75, "20-F/A": 70, "40-F/A": 70, "10-Q": 40, "10-Q/A": 30}
QUARTER_FORMS = {"10-Q": 100, "10-Q/A": 75, "10-K": 20, "10-K/A": 15}
OTHER_FORMS = {"10-Q": 70, "10-Q/A": 55, "10-K": 50, "10-K/A": 40, "20-F": 45, "40-F": 45}
UNKNOWN_FORM, AMENDED = 10, -30
QUARTERS = ("Q1", "Q2", "Q3", "Q4")


def days(start: Column, end: Column) -> Column:
    """Days of a period, both ends counted."""
    return F.datediff(end, start) + 1


def period_role(point: Column, label: Column, duration: Column) -> Column:
    quarter = label.isin(*QUARTERS)
    return (
        F.when(point, "instant").when(label == "FY", "annual_flow").when(quarter & duration.isNull(), "quarter_or_ytd_unknown")
        .when(quarter & (duration <= 120), "quarter_flow").when(quarter, "ytd_flow").otherwise("duration_flow")
    )


def period_label(role: Column, label: Column) -> Column:
    return F.when(role == "quarter_or_ytd_unknown", F.concat(label, F.lit("_UNKNOWN_DURATION"))).when(role == "ytd_flow", F.concat(label, F.lit("_YTD"))).otherwise(label)


def _form(table: dict[str, int], form: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.upper(form)], F.lit(UNKNOWN_FORM))


def scores(c: dict[str, Column], role: Column) -> list[Column]:
    """Form, amendment, frame and duration score of a filed value, for ``canonical``."""
    form = F.when(role.isin("annual_flow", "instant"), _form(ANNUAL_FORMS, c["form"])).when(role == "quarter_flow", _form(QUARTER_FORMS, c["form"])).otherwise(_form(OTHER_FORMS, c["form"]))
    amended = F.when(F.upper(c["form"]).endswith("/A"), AMENDED).otherwise(0)
    frame, year = F.upper(F.coalesce(c["frame"], F.lit(""))), F.concat(F.lit("CY"), c["fy"].cast("string"))
    framed = (
        F.when(frame == "", 5).when((role == "annual_flow") & (frame == year), 25).when((role == "quarter_flow") & (frame == F.concat(year, c["fp"])), 25)
        .when(frame.contains(year), 15).otherwise(0)
    )
    n = days(c["start"], c["end"])
    lasting = F.when(role == "instant", 20).when((role == "annual_flow") & n.between(330, 380), 25).when((role == "quarter_flow") & n.between(70, 110), 25).when((role == "ytd_flow") & n.isNotNull(), 5).otherwise(0)
    return [form.alias("form_score"), amended.alias("amended_score"), framed.alias("frame_score"), lasting.alias("duration_score")]


def canonical(df: DataFrame, keys: list[str], last: list[str]) -> DataFrame:
    """The best filed value of each key, with the number of candidates; ``last`` breaks ties, newest first."""
    order = [F.desc(x) for x in ("form_score", "amended_score", "frame_score", "duration_score", *last)]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_rn = 1").drop("_rn")


def resolve(df: DataFrame, keys: list[str], allow_single: bool = True) -> DataFrame:
    """Candidates (keys, document, page, published, value) with a ``cross_check`` status.

    Inside a document with several values its last page decides; across documents with several values the latest publication does.
    A last page or a latest date with several values, or a missing date, is a conflict. Three aggregates by key, no row is dropped.
    """
    doc = [*keys, "document"]
    pages = df.groupBy(*doc, "page").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    in_doc = pages.groupBy(*doc).agg(
        (F.min("lo") == F.max("hi")).alias("one"), F.max("page").alias("last_page"), F.max_by("lo", "page").alias("page_lo"), F.max_by("hi", "page").alias("page_hi")
    ).withColumn("clear", F.col("one") | (F.col("page_lo") == F.col("page_hi")))
    date = df.groupBy(*doc).agg(F.max("published").alias("doc_published"))
    found = in_doc.where("clear").join(date, doc)
    by_date = found.groupBy(*keys, "doc_published").agg(F.min("page_lo").alias("lo"), F.max("page_hi").alias("hi"), F.count(F.lit(1)).alias("n"))
    overall = by_date.groupBy(*keys).agg(
        (F.min("lo") == F.max("hi")).alias("agreed"), F.sum("n").alias("documents"), F.bool_or(F.col("doc_published").isNull()).alias("undated"),
        F.max_by("lo", "doc_published").alias("new_lo"), F.max_by("hi", "doc_published").alias("new_hi"),
    )
    j = df.join(in_doc, doc).join(overall, keys, "left")
    old_page = ~F.col("one") & (F.col("page") < F.col("last_page"))
    return j.withColumn(
        "cross_check",
        F.when(~F.col("clear"), "conflict").when(old_page, "superseded_same_document")
        .when(F.col("agreed") & (F.col("documents") > 1), "matched").when(F.col("agreed"), "single_document" if allow_single else "requires_cross_check")
        .when(F.col("undated") | (F.col("new_lo") != F.col("new_hi")), "conflict").when(F.col("value") == F.col("new_lo"), "latest_restated").otherwise("superseded"),
    ).select(*df.columns, "cross_check")


def lookup_in_order(df: DataFrame, definitions: DataFrame, keys: list[Column], by: str, value: str) -> DataFrame:
    """``value`` of the first key expression that has a definition; ``definitions`` (by, value) has one row for each key and is small."""
    out, hits = df, []
    for k, key in enumerate(keys):
        side = definitions.select(F.col(by).alias(f"_k{k}"), F.col(value).alias(f"_v{k}"))
        out = out.withColumn("_key", key).join(side, F.col("_key") == F.col(f"_k{k}"), "left").drop("_key", f"_k{k}")
        hits.append(f"_v{k}")
    return out.withColumn(value, F.coalesce(*hits)).drop(*hits)


def longest_label(texts: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """Rows with the longest alias that begins their text as whole words, then the smallest alias and metric; repeated rows stay.

    Each different text is looked up once: an equi-join on its leading words of every length up to the longest alias, not a join of
    all pairs, and an aggregate. The rows then join their text's alias.
    """
    most = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 0
    words = F.split(F.trim(F.lower("label")), " ")
    lengths = F.sequence(F.lit(1), F.greatest(F.least(F.size(words), F.lit(most)), F.lit(1)))
    heads = texts.select(F.col(text).alias("label")).distinct().withColumn("head", F.explode(F.transform(lengths, lambda n: F.array_join(F.slice(words, 1, n), " "))))
    met = heads.join(aliases.select("alias", "metric_id"), F.col("head") == F.lower("alias"))
    best = met.groupBy("label").agg(F.min(F.struct((-F.length("alias")).alias("n"), "alias", "metric_id")).alias("best"))
    label = column_like("_label", texts.columns)
    best = best.select(F.col("label").alias(label), "best.alias", "best.metric_id")
    return texts.join(best, F.col(text) == F.col(label)).drop(label)


def merge_entities(first: DataFrame, then: DataFrame, key: str) -> DataFrame:
    """All of ``first`` and those of ``then`` with a key that ``first`` lacks."""
    return first.unionByName(then.join(first.select(key), key, "left_anti").select(first.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new)


def profile(metrics: Column, statements: Column, profiles: dict[str, dict[str, list[str]]], default: str) -> Column:
    """The one profile whose ``any``, ``all``, ``absent`` and ``statements`` sets fit; several that fit are ambiguous."""
    fits = []
    for name, rule in profiles.items():
        if set(rule) - {"any", "all", "absent", "statements"}:
            raise ValueError(f"unknown rule in profile {name}")
        lits = {k: F.array(*[F.lit(x) for x in v]) for k, v in rule.items() if v}
        ok = F.lit(True)
        if "any" in lits:
            ok = ok & F.arrays_overlap(metrics, lits["any"])
        if "all" in lits:
            ok = ok & (F.size(F.array_except(lits["all"], metrics)) == 0)
        if "absent" in lits:
            ok = ok & ~F.arrays_overlap(metrics, lits["absent"])
        if "statements" in lits:
            ok = ok & (F.size(F.array_except(lits["statements"], statements)) == 0)
        fits.append(F.when(ok, name))
    found = F.filter(F.array(*fits), lambda x: x.isNotNull())
    return F.when(F.size(found) > 1, "ambiguous").when(F.size(found) == 1, F.get(found, 0)).otherwise(default)


def multiset_jaccard(a: DataFrame, b: DataFrame, keys: DataFrame) -> DataFrame:
    """(g, similarity) of the multisets (g, x, n) of each key; keys with neither are left out."""
    j = a.select("g", "x", F.col("n").alias("p")).join(b.select("g", "x", F.col("n").alias("q")), ["g", "x"], "full").fillna(0, ["p", "q"])
    s = j.groupBy("g").agg(F.round(F.sum(F.least("p", "q")) / F.sum(F.greatest("p", "q")), 6).alias("similarity"))
    return s.join(keys, "g", "left_semi")
