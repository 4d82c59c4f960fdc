"""Selections, filings and roles against plain versions and fixed cases."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation as E, filings as X, roles as P, selection as S


def plain_release(rows, targets, size):
    """The greedy choice over all rows at once."""
    left = {n: S.largest_remainder(t, size) for n, t in targets.items()}
    pool, taken = list(rows), []
    while pool and len(taken) < size:
        able = [r for r in pool if all(left[n].get(r[n], 0) > 0 for n in left)]
        if not able:
            break
        supply = {n: collections.Counter(r[n] for r in able) for n in left}
        best = min(able, key=lambda r: (-sum(left[n][r[n]] / supply[n][r[n]] for n in left), -r["score"], r["id"]))
        taken.append(best["id"])
        pool.remove(best)
        for n in left:
            left[n][best[n]] -= 1
    return set(taken)


@pytest.mark.parametrize("seed", range(3))
def test_release_equals_the_plain_greedy(spark, seed):
    r = random.Random(seed)
    rows = [{"id": k, "score": float(r.randint(0, 9)), "task": r.choice(["T2", "T3", "T3"]), "language": r.choice("ef")} for k in range(60)]
    targets = {"task": {"T2": 0.5, "T3": 0.5}, "language": {"e": 0.3, "f": 0.7}}
    df = spark.createDataFrame(rows, "id long, score double, task string, language string")
    assert {x.id for x in S.release(df, "id", "score", targets, 21).collect()} == plain_release(rows, targets, 21)
    assert S.release(df.limit(0), "id", "score", targets, 21).count() == 0


def test_release_meets_hard_margins(spark):
    rows = [(k, float(k % 7), f"T{2 + k % 2}", "en" if k // 2 % 2 else "zh", "walk" if k // 4 % 2 else "macro") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, score double, task string, language string, pipeline string")
    half = lambda a, b: {a: 0.5, b: 0.5}
    out = S.release(df, "id", "score", {"task": half("T2", "T3"), "language": half("en", "zh"), "pipeline": half("walk", "macro")}, 20)
    for c in ("task", "language", "pipeline"):
        assert {x["count"] for x in out.groupBy(c).count().collect()} == {10}


def test_stratum_quotas(spark):
    def got(counts, budget, least=1):
        df = spark.createDataFrame(list(counts.items()), "g string, n long")
        return {r.g: r.quota for r in S.stratum_quotas(df, "g", "n", budget, least).collect()}

    have = {"large": 80, "medium": 15, "small": 5}
    out = got(have, 37)
    assert sum(out.values()) == 37 and all(1 <= out[k] <= n for k, n in have.items())
    assert got({"a": 3, "b": 9, "c": 9}, 2) == {"a": 0, "b": 1, "c": 1}
    assert got({"a": 3, "b": 2}, 99) == {"a": 3, "b": 2}
    assert got({"a": 0}, 5) == {} and got({"a": 4}, 0) == {"a": 0}
    r = random.Random(1)
    for _ in range(5):
        counts = {f"s{k}": r.randint(1, 40) for k in range(12)}
        size = r.randint(1, 200)
        out = got(counts, size, r.randint(0, 3))
        assert sum(out.values()) == min(size, sum(counts.values())) and all(out[k] <= n for k, n in counts.items())


def test_longest_label_keeps_repeated_rows(spark):
    texts = spark.createDataFrame([("net income total",), ("net income total",), ("net",), ("other",), (None,)], "label string")
    aliases = spark.createDataFrame([("net", "a"), ("Net income", "b"), ("Net income", "c")], "alias string, metric_id string")
    assert sorted((r.label, r.alias, r.metric_id) for r in X.longest_label(texts, aliases, "label").collect()) == [("net", "net", "a"), ("net income total", "Net income", "b"), ("net income total", "Net income", "b")]


def test_shape_of_all_components(spark):
    from factloom.operators import graph as G

    rows = [(1, "a", "b"), (1, "x", "y"), (1, "y", "z"), (1, "z", "u"), (1, "z", "v"), (2, "p", "p"), (2, "", "q"), (3, None, "r")]
    out = G.shapes(spark.createDataFrame(rows, "sample long, a string, b string")).collect()
    assert {r["sample"]: (r.n_nodes, r.diameter, r.branches) for r in out} == {1: (7, 3, 1), 2: (1, 0, 0)}
    rnd = random.Random(4)
    links = [(k, f"n{rnd.randint(0, 14)}", f"n{rnd.randint(0, 14)}") for k in range(30) for _ in range(rnd.randint(1, 16))]

    def plain(pairs):
        near = collections.defaultdict(set)
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)

        def far(start):
            dist, queue = {start: 0}, [start]
            for x in queue:
                for y in near[x]:
                    if y not in dist:
                        dist[y] = dist[x] + 1
                        queue.append(y)
            end = max(dist, key=lambda x: (dist[x], x))
            return end, dist[end], set(dist)

        best, left = 0, set(near)
        while left:
            end, _, part = far(min(left))
            left -= part
            best = max(best, far(end)[1])
        return len(near), best, sum(len(v) > 2 for v in near.values())

    out = G.shapes(spark.createDataFrame(links, "sample long, a string, b string")).collect()
    assert {r["sample"]: (r.n_nodes, r.diameter, r.branches) for r in out} == {k: plain([(a, b) for j, a, b in links if j == k]) for k in range(30)}


def test_the_active_build_survives_a_broken_pointer(spark, tmp_path):
    from factloom.sources import sinks

    path = str(tmp_path)
    sinks.write_build(spark.range(3), path, "one")
    sinks.write_build(spark.range(5), path, "two")
    (tmp_path / "_active" / "turn-000000003").mkdir()  # begun, never finished
    assert sinks.read_active(spark, path).count() == 5
    sinks.write_build(spark.range(2), path, "one")
    assert sinks.read_active(spark, path).count() == 2


def test_candidate_resolution(spark):
    rows = [
        (1, "d1", 1, "2024-01-01", 5), (1, "d2", 1, "2024-02-01", 5),
        (2, "d1", 1, "2024-01-01", 5), (2, "d1", 2, "2024-01-01", 6), (2, "d1", 2, "2024-01-01", 6),
        (3, "d1", 1, "2024-01-01", 5), (3, "d2", 1, "2024-02-01", 7),
        (4, "d1", 1, None, 5), (4, "d2", 1, "2024-02-01", 7),
        (5, "d1", 1, "2024-01-01", 5), (5, "d1", 1, "2024-01-01", 6),
    ]
    df = spark.createDataFrame(rows, "k int, document string, page int, published string, value int")
    got = collections.Counter((r.k, r.value, r.cross_check) for r in X.resolve(df, ["k"]).collect())
    assert got == {
        (1, 5, "matched"): 2, (2, 5, "superseded_same_document"): 1, (2, 6, "single_document"): 2, (3, 5, "superseded"): 1, (3, 7, "latest_restated"): 1,
        (4, 5, "conflict"): 1, (4, 7, "conflict"): 1, (5, 5, "conflict"): 1, (5, 6, "conflict"): 1,
    }


def test_role_predicates_are_never_null(spark):
    df = spark.createDataFrame([(None,), (3,)], "v int")
    for op, value, want in (("gt", 2, [False, True]), ("ne", 3, [True, False]), ("exists", None, [False, True]), ("truthy", None, [False, True]), ("in", [3], [False, True]), ("not_in", [3], [True, False])):
        assert [r[0] for r in df.select(P.predicate(F.col("v"), op, value)).collect()] == want
    with pytest.raises(ValueError):
        P.predicate(F.col("v"), "like", "x")


def test_one_seed_holds_a_component_out(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "id long, key string")
    got = {r.id: (r.component, r.held) for r in P.held_out(df, "id", "key", F.col("id") == 3).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (1, True), 4: (4, False), 5: (5, False)}


def test_retention_and_latest(spark):
    rows = [("a", "success", "passed", 0, 5, 0, "2024-01-01"), ("b", "success", "passed", 0, 5, 0, "2024-01-02"), ("c", "failed", "passed", 0, 5, 0, "2024-01-03"), ("d", "archived", None, 0, 0, 0, "2023-01-01"), ("e", "failed", None, 1, 0, 0, None)]
    df = spark.createDataFrame(rows, "build_id string, status string, quality_status string, is_active int, n_nodes int, n_edges int, started_at string").withColumn("completed_at", F.lit(None).cast("string"))
    assert {r.build_id: r.action for r in E.retention(df, 1).collect()} == {"a": "archive", "b": "hot", "c": "archive", "d": "archived", "e": "hot"}
    with pytest.raises(ValueError):
        E.retention(df, 0)
