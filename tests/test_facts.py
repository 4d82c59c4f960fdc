"""Operators of the fact engine on small literal tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import derived as D, facts as X, graph as G, stats as T, vectors as V
from factloom.plans.dag import OPERATORS, Step, compile_dag, validate
from factloom.sources import scans, sinks


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("A", "Software", "revenue", 2023, 100.0), ("A", "Software", "revenue", 2024, 120.0), ("B", "Software", "revenue", 2023, 100.0), ("B", "Software", "revenue", 2024, 90.0)]
    rows += [("A", "Software", "tax_value", 2024, 10.0), ("B", "Software", "tax_value", 2024, 20.0), ("C", "Retail", "revenue", 2020, 0.0), ("C", "Retail", "revenue", 2021, 5.0), ("C", "Retail", "revenue", 2023, 7.0)]
    return spark.createDataFrame(rows, "entity_id string, industry string, metric_id string, fiscal_year int, value double")


def test_growth_needs_the_previous_year(facts):
    rows = {(r.entity_id, r.fiscal_year): (r.difference, r.growth) for r in D.change(facts.where("metric_id = 'revenue'"), ["entity_id"], "fiscal_year").collect()}
    assert rows == {("A", 2024): (20.0, 20.0), ("B", 2024): (-10.0, -10.0), ("C", 2021): (5.0, None)}


def test_screening_and_ranking(facts):
    assert [(r.entity_id, r.fiscal_year) for r in D.screening(facts).collect()] == [("A", 2024)]
    top = D.ranked(facts.where("metric_id = 'revenue'"), ["fiscal_year"], 1).collect()
    assert sorted((r.fiscal_year, r.entity_id) for r in top) == [(2023, "A"), (2024, "A")]


def test_complete_window_extrema(spark):
    f = spark.createDataFrame([("A", y, float(y)) for y in range(2015, 2025)] + [("B", y, 1.0) for y in (2020, 2022, 2023, 2024)], "k string, y int, value double")
    got = D.window_extrema(f, ["k"], "y", 5).collect()
    assert [tuple(r) for r in got] == [("A", 2024, 2024.0, 2020, 2020.0)]


def test_nearest_return_takes_the_earlier_of_equal_gaps(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    s = spark.createDataFrame([("x", day(9), 4.0), ("x", day(11), 8.0), ("x", day(30), 12.0)], "series string, day date, value double")
    assert [tuple(r) for r in D.nearest_return(s, 20, 3).collect()] == [("x", day(9), day(30), 200.0)]


def test_latest_window_is_cut_to_its_end(spark):
    f = spark.createDataFrame([("A", y) for y in (1, 2, 3, 5, 6, 7, 8)] + [("B", 1), ("B", 3)], "k string, i int")
    assert sorted(r.i for r in X.latest_window(f, ["k"], "i", 3, 2).collect()) == [7, 8]


def test_scalars(spark):
    df = spark.createDataFrame([("(1,234.5)", "http://x/?b=2&a=1#f"), ("1.2.3", "http://x/"), ("$7", None), (None, "y?"), ("-3", "z")], "t string, u string")
    assert [r.n for r in df.select(S.numeric_text(F.col("t")).alias("n")).collect()] == [-1234.5, None, 7.0, None, -3.0]
    assert [r.u for r in df.select(S.canonical_url(F.col("u")).alias("u")).collect()] == ["http://x/?a=1&b=2", "http://x/", None, "y?", "z"]
    one = spark.range(1).select(
        S.frequency(F.lit("fiscal_period"), F.lit("Q2"), F.lit(2020)).alias("a"), S.frequency(F.lit(None).cast("string"), F.lit("FY"), F.lit(2020)).alias("b"),
        S.period_index(F.lit("quarterly"), F.lit(2020), F.lit("Q2"), F.lit(None).cast("date")).alias("c"), S.iso_day(F.lit("bad")).alias("d"),
        S.annual_duration_valid(F.lit("annual"), F.lit("flow"), F.lit("2020-01-01").cast("date"), F.lit("2020-12-31").cast("date")).alias("e"),
    ).first()
    assert tuple(one) == ("quarterly", "annual", 8082, None, True)


def test_dag_validation():
    with pytest.raises(ValueError, match="unknown operator"):
        validate([Step("a", "nothing", ())], set())
    with pytest.raises(ValueError, match="no earlier step"):
        validate([Step("a", "mean", ("b",))], set())
    assert len(OPERATORS) == 17


def test_dag_leaves_incomplete_bindings_out(spark):
    a = spark.createDataFrame([("x", "A", 1, 3.0), ("x", "B", 1, 2.0), ("y", "C", 1, 1.0)], "binding string, entity_id string, fiscal_year int, value double")
    steps = [Step("r", "rank", ("a",)), Step("l", "lookup_ranked_entities", ("r", "b"))]
    out = compile_dag(steps, {"a": a, "b": a.where("entity_id <> 'B'")}).collect()
    assert [(r.binding, r.entity_id) for r in out] == [("y", "C")]


def test_components_and_motifs(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (3, 20), (20, 19)], "a long, b long")
    assert {r.id: r.component for r in G.components_of(links).collect()} == {1: 1, 2: 1, 3: 1, 20: 1, 19: 1, 10: 10, 11: 10}
    e = spark.createDataFrame([("a", "R", "b"), ("a", "R", "c"), ("b", "S", "d"), ("b", "S", "e")], "src string, rel string, dst string")
    assert [tuple(r) for r in G.motifs(e).collect()] == [("R", "S", 2, 1)]


def test_distances_of_disjoint_distributions(spark):
    a, b = (T.distribution(spark.createDataFrame([(x,) for x in s], "c string"), F.col("c")) for s in ("aab", "cd"))
    assert tuple(T.distances(a, b).first()) == (1.0, 1.0) and tuple(T.distances(a, a).first()) == (0.0, 0.0)


def test_cosine_of_equal_texts(spark):
    v = V.ngram_vectors(spark.createDataFrame([(1, "net income of the year"), (2, "something else"), (3, None)], "id long, text string"))
    assert [tuple(r) for r in V.nearest(v.where("id = 1"), v).collect()] == [(1, 1, 1.0)]


def test_scans(spark):
    doc = {"cik": "320193", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [
        {"start": "2022-10-01", "end": "2023-09-30", "val": 383285, "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2023-11-03", "accn": "a"},
        {"start": "2022-10-01", "end": "2023-09-30", "val": 1, "fy": 2023, "fp": "FY", "form": "10-K/A", "filed": "2023-12-03", "accn": "b"}]}}}}}
    raw = spark.createDataFrame([(json.dumps(doc),)], "j string")
    alias = spark.createDataFrame([("Revenues", "revenue")], "concept string, metric_id string")
    got = scans.canonical_filings(scans.company_facts(raw, "j", alias)).first()
    assert (got.cik, got.metric_id, int(got.val), got.period_label) == ("0000320193", "revenue", 383285, "FY")
    obs = spark.createDataFrame([("s", '{"observations":[{"date":"2024-01-01","value":"."},{"date":"2024-02-01","value":"2.5"}]}')], "series_id string, j string")
    assert [(r.period_end, float(r.value)) for r in scans.observations(obs, "j").collect()] == [(dt.date(2024, 2, 1), 2.5)]
    imf = spark.createDataFrame([('{"values":{"NGDP":{"USA":{"2024":1.5,"2026":2}}}}',)], "j string")
    assert {(r.year, r.is_forecast) for r in scans.datamapper(imf, "j", F.lit(2025)).collect()} == {(2024, False), (2026, True)}
    wb = spark.createDataFrame([('[{"country":{"id":"US"},"indicator":{"id":"X"},"date":"2020","value":3},{"country":{"id":"US"},"indicator":{"id":"X"},"date":"2021","value":null}]',)], "j string")
    assert [(r.year, r.period_end) for r in scans.indicators(wb, "j").collect()] == [(2020, dt.date(2020, 12, 31))]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (2, "test")], "id long, split string")
    assert sinks.archive(df, str(tmp_path / "zstd"))[0] == 3 and sinks.digest(df) != sinks.digest(df.distinct())
    assert {tuple(r) for r in sinks.write_splits(df, str(tmp_path / "json")).collect()} == {("train", 1), ("test", 2)}
    for build in ("b1", "b2"):
        sinks.write_build(df.where("id = 1") if build == "b2" else df, str(tmp_path / "builds"), build)
    assert sinks.read_active(spark, str(tmp_path / "builds")).count() == 1
