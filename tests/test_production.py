"""Selection within a budget, walks, tagged numbers, hotspots and splits on small fixtures."""

import random

import pytest

from factloom.operators import feedback as K, universe as U, walks as W
from factloom.sources import xbrl


def plain_cover(chains, budget, target, every):
    """The greedy choice chain by chain."""
    have, joined = set(), 0
    closed = lambda: sum(c[3] <= have for c in chains)
    for c in sorted(chains):
        if len(have | c[3]) <= budget:
            have |= c[3]
            joined += 1
            if (joined % every == 0 or joined == len(chains)) and closed() >= target:
                break
    return have, joined, closed()


@pytest.mark.parametrize("seed,budget,target,every,block", [(1, 12, 999, 5, 65536), (2, 25, 20, 4, 65536), (3, 25, 12, 3, 4), (4, 0, 5, 5, 3), (5, 60, 30, 7, 8), (6, 9, 0, 5, 65536)])
def test_chain_cover_is_the_greedy_choice(spark, monkeypatch, seed, budget, target, every, block):
    monkeypatch.setattr(U, "BLOCK", block)
    r = random.Random(seed)
    sets = [frozenset(r.sample(range(50), r.choice((1, 2, 2, 3, 5, 6)))) for _ in range(40)]
    chains = [(len(s), r.choice("ab"), k, s) for k, s in enumerate(sets)]
    rows = [(k, kind, f) for _, kind, k, s in chains for f in s]
    found, report = U.chain_cover(spark.createDataFrame(rows, "chain long, kind string, fact long"), budget, target=target, every=every)
    have, joined, closed = plain_cover(chains, budget, target, every)
    assert {x.fact for x in found.collect()} == have
    assert (report["joined"], report["closed"], report["facts"]) == (joined, closed, len(have))


def test_chain_cover_of_nothing(spark):
    found, report = U.chain_cover(spark.createDataFrame([], "chain long, kind string, fact long"), 5)
    assert found.count() == 0 and report["joined"] == 0


def test_places_are_one_order(spark):
    rows = [(k * 7919 % 1000, k) for k in range(1000)]
    got = U.placed(spark.createDataFrame(rows, "v long, id long").repartition(7), ["v", "id"]).collect()
    assert [x.v for x in sorted(got, key=lambda x: x.place)] == sorted(v for v, _ in rows) and {x.place for x in got} == set(range(1000))


def test_inline_numbers(spark):
    html = """<xbrli:context id="c"><xbrli:instant>2020-12-31</xbrli:instant></xbrli:context><xbrli:context id="none"></xbrli:context>
      <IX:nonFraction contextRef="c" name='a:X' unitRef="u" format="f"><span>1,0</span>50</ix:nonFraction> <ix:nonfraction name="a:X" contextref="c" unitref="u" format="f">1,0 50</ix:nonfraction>
      <ix:nonFraction name="a:X" contextRef="none">(2)</ix:nonFraction><ix:nonFraction name="a:Y" contextRef="c">3</ix:nonFraction><ix:nonFraction name="a:X">none</ix:nonFraction>"""
    pages = spark.createDataFrame([(1, html, "2019"), (2, None, None), (3, "<p>", None)], "id long, html string, day string")
    aliases = spark.createDataFrame([("a:X", "x")], "concept string, metric_id string")
    from pyspark.sql import functions as F

    got = {(r.id, r.metric_id, r.value, r.unit, r.period) for r in xbrl.inline_facts(pages, "id", "html", aliases, F.col("day")).collect()}
    assert got == {(1, "x", 1050.0, "u; format=f", '{"context_ref":"c","instant":"2020-12-31"}'), (1, "x", -2.0, "inline_xbrl_unit", "2019")}


def test_beam_keeps_the_cheapest(spark):
    schema = spark.createDataFrame([("A", "r", "out", "B", 1), ("A", "s", "out", "C", 1), ("B", "t", "out", "D", 1), ("C", "u", "out", "D", 1)], "kind string, rel string, direction string, other string, n long")
    costs = {"r": 1, "s": 2, "t": 5, "u": 1}
    wide = W.typed_paths(schema, costs, 3).where("start = 'A' and finish = 'D'").orderBy("place").collect()
    assert [(x.path, x.cost) for x in wide] == [("s out C > u out D", 3), ("r out B > t out D", 6)]
    narrow = W.typed_paths(schema, costs, 3, beam=1).where("start = 'A' and finish = 'D'").collect()
    assert [x.path for x in narrow] == ["r out B > t out D"]


def test_hotspots_and_large_components(spark):
    samples = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "sample long, pattern string")
    calls = spark.createDataFrame([(1, "a", ["x", "x"], False), (1, "b", ["x"], True), (2, "a", ["x", "y"], False), (9, "a", ["x"], True)], "sample long, role string, issues array<string>, confirms boolean")
    got = {(r.value, r.issue): (r.flagged, r.agreed, r.confirmed, r.total, r.rate) for r in K.hotspots(samples, calls, ["pattern"]).collect()}
    assert got == {("p", "x"): (2, 1, 1, 2, 1.0), ("p", "y"): (1, 0, 0, 2, 0.5)}
    rows = [(1, "peer")] * 9 + [(2, None), (2, "entity")] + [(3, "entity"), (3, "peer")] + [(k, None) for k in range(10, 40)]
    split = {r.component: r.split for r in K.component_splits(spark.createDataFrame(rows, "component long, holdout string"), ["peer", "entity"]).collect()}
    assert (split[1], split[2], split[3]) == ("train", "test_entity", "test_peer") and {split[k] for k in range(10, 40)} <= {"train", "dev", "test"}


def test_graph_and_reports_are_written_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from factloom.sources import sinks

    nodes = spark.createDataFrame([("a", "K"), ("b", "K")], "id string, kind string")
    edges = spark.createDataFrame([("a", "r", "b")], "src string, rel string, dst string")
    assert {(r.part, r.rows) for r in sinks.write_graph(nodes, edges, str(tmp_path / "kg")).collect()} == {("nodes", 2), ("edges", 1)}
    assert spark.read.json(str(tmp_path / "kg/edges")).count() == 1
    assert sinks.write_report(nodes.withColumn("x", F.lit(None).cast("string")), str(tmp_path / "report"), "Nodes") == 2
    text = [r.value for r in spark.read.text(str(tmp_path / "report/markdown")).collect()]
    assert text[0] == "# Nodes" and "| a | K |  |" in text and spark.read.json(str(tmp_path / "report/json")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_report(nodes, str(tmp_path / "other"), "Nodes", 1)


def test_exports_are_combined(spark, tmp_path):
    from factloom.sources import sinks

    one = spark.createDataFrame([("train", k, "q") for k in range(50)] + [("test", 100, "q")], "split string, id long, question string")
    two = spark.createDataFrame([("train", 49), ("train", 77)], "split string, id long")
    got = {r.split: (r.rows, r.ids, r.exports) for r in sinks.combine_exports([one, two], str(tmp_path / "a"), ["id"]).collect()}
    assert got == {"train": (52, 51, 2), "test": (1, 1, 1)}
    assert spark.read.json(str(tmp_path / "a")).count() == 53
    digest = lambda frames, at: {r.split: r.ids_sha256 for r in sinks.combine_exports(frames, str(tmp_path / at), ["id"]).collect()}
    a, b, c = digest([one, two], "b"), digest([two.repartition(3), one], "c"), digest([one], "d")
    assert a == b and a["train"] != c["train"] and a["test"] == c["test"]
