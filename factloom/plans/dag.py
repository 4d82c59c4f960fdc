"""Operation DAGs: declarative steps compiled into one lazy plan.

A step names an operator, the steps it reads and its parameters. Every relation is a DataFrame of
(binding, entity_id, fiscal_year, value); ``compile_dag`` folds the steps in order, so Catalyst sees
the whole DAG at once. What would stop a row-wise interpreter (a missing input, a zero denominator)
leaves the binding out of the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F


@dataclass(frozen=True)
class Step:
    step_id: str
    operator: str
    inputs: tuple[str, ...]
    params: dict = field(default_factory=dict)


_KEY = ["binding", "entity_id"]


def _lookup(a, **p):
    return a.where(F.col("fiscal_year") == p["year"]) if "year" in p else a


def _two(a: DataFrame, b: DataFrame, on=("binding",)) -> DataFrame:
    right = b.select(*on, F.col("value").alias("other"), *([F.col("entity_id").alias("other_id")] if "entity_id" not in on else []))
    return a.join(right, list(on))


def _difference(a, b, **p):
    return _two(a, b).withColumn("value", F.col("value") - F.col("other")).drop("other", "other_id")


def _compare(a, b, **p):
    d = _two(a, b)
    winner = F.when(F.col("value") > F.col("other"), F.col("entity_id")).when(F.col("value") < F.col("other"), F.col("other_id")).otherwise("equal")
    return d.select("binding", winner.alias("entity_id"), "fiscal_year", F.abs(F.col("value") - F.col("other")).alias("value"))


def _mean(a, **p):
    return a.groupBy("binding").agg(F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("int").alias("fiscal_year"), (F.sum(F.col("value").cast("decimal(28,4)")).cast("double") / F.count("value")).alias("value"))


def _extreme(sign: int):
    def run(a, **p):
        w = Window.partitionBy("binding").orderBy(sign * F.col("value"), "entity_id", "fiscal_year")
        return a.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

    return run


def _rank(a, **p):
    w = Window.partitionBy("binding").orderBy(F.desc("value"), "entity_id")
    out = a.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= p["top_k"]) if "top_k" in p else out


_TESTS: dict[str, Callable] = {
    "gt": lambda c, x: c > x, "gte": lambda c, x: c >= x, "lt": lambda c, x: c < x, "lte": lambda c, x: c <= x, "eq": lambda c, x: c == x,
}


def _filter(a, **p):
    return a.where(F.coalesce(_TESTS[p["op"]](F.col(p.get("field", "value")), p["value"]), F.lit(False)))


def _growth(a, b, **p):
    return _two(a, b, _KEY).where("other <> 0").withColumn("value", (F.col("value") - F.col("other")) / F.abs("other") * 100).drop("other")


def _ratio(a, b, **p):
    return _two(a, b, _KEY).where("other <> 0").withColumn("value", F.col("value") / F.col("other") * p.get("scale", 100)).drop("other")


def _select_by_period(a, b, **p):
    return b.join(a.select("binding", "fiscal_year"), ["binding", "fiscal_year"], "left_semi")


def _intersect(a, b, **p):
    return a.join(b.select(*_KEY), _KEY, "left_semi")


def _lookup_ranked(a, b, **p):
    """Secondary values of ranked entities; a binding with a missing one is left out whole."""
    s = a.select(*_KEY, "rank").join(b.select(*_KEY, "fiscal_year", "value"), _KEY, "left")
    whole = F.count_if(F.col("value").isNull()).over(Window.partitionBy("binding"))
    s = s.withColumn("_missing", whole).where("_missing = 0").drop("_missing")
    return s.where(F.col("rank").isin(p["target_ranks"])) if "target_ranks" in p else s


def _above_mean(a, **p):
    return a.withColumn("_mean", F.avg("value").over(Window.partitionBy("binding"))).where("value > _mean").drop("_mean")


def _multi_factor(growth, rate, margin, **p):
    passed = _filter(growth, op="gt", value=p["growth_above"]).join(_filter(rate, op="lt", value=p["rate_below"]).select(*_KEY), _KEY, "left_semi")
    return _rank(_intersect(_above_mean(margin), passed))


def _provenance(a, b, **p):
    """The selected facts with the sorted raw objects that (fact_id, raw_object_id) rows bind to them; a fact without any is left out."""
    own = F.coalesce("secondary_fact_id", "fact_id") if "secondary_fact_id" in a.columns else F.col("fact_id")
    bound = b.where(F.col("raw_object_id").isNotNull()).groupBy(F.col("fact_id").alias("_bound")).agg(F.array_sort(F.collect_set("raw_object_id")).alias("raw_object_ids"))
    return a.join(bound, own == F.col("_bound")).drop("_bound")


def _graph_answer(a, **p):
    """The projected structure unchanged; a binding whose projection is empty is left out."""
    there = [F.size(c) > 0 if t.startswith(("array", "map")) else F.col(c).isNotNull() for c, t in a.dtypes if c != "binding"]
    return a.where(F.coalesce(F.greatest(*there, F.lit(False)), F.lit(False)))


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "lookup": _lookup, "difference": _difference, "compare": _compare, "mean": _mean, "argmax": _extreme(-1), "argmin": _extreme(1), "rank": _rank, "filter": _filter,
    "growth_by_entity": _growth, "ratio_by_entity": _ratio, "select_by_period": _select_by_period, "intersect_on_entity": _intersect,
    "lookup_ranked_entities": _lookup_ranked, "attach_provenance": _provenance, "multi_factor_screen": _multi_factor, "above_mean": _above_mean,
    "graph_answer": _graph_answer,
}


def validate(steps: list[Step], relations: set[str]) -> None:
    """Known operators, and inputs that are relations or earlier steps."""
    seen = set(relations)
    for s in steps:
        if s.operator not in OPERATORS:
            raise ValueError(f"unknown operator {s.operator}")
        if missing := [i for i in s.inputs if i not in seen]:
            raise ValueError(f"{s.step_id} reads {missing}, which no earlier step gives")
        if s.step_id in seen:
            raise ValueError(f"{s.step_id} is defined twice")
        seen.add(s.step_id)


def compile_dag(steps: list[Step], relations: dict[str, DataFrame]) -> DataFrame:
    """The last step's relation."""
    validate(steps, set(relations))
    done = dict(relations)
    for s in steps:
        done[s.step_id] = OPERATORS[s.operator](*[done[i] for i in s.inputs], **s.params)
    return done[steps[-1].step_id]


def lineage(steps: list[Step], relations: dict[str, DataFrame], answer: DataFrame) -> DataFrame:
    """(binding, step_ids, fact_ids, entities, periods) of an answer: the steps it rests on, and all that the relations under them hold
    of its binding. Sets are unioned by one aggregate."""
    by_id, reached, todo = {s.step_id: s for s in steps}, [], [steps[-1].step_id]
    while todo:
        name = todo.pop()
        if name not in reached:
            reached.append(name)
            todo += by_id[name].inputs if name in by_id else ()
    under = [relations[n].select("binding", F.col("fact_id").cast("string").alias("fact_id"), "entity_id", F.col("fiscal_year").cast("int").alias("fiscal_year")) for n in reached if n in relations]
    rows = under[0]
    for more in under[1:]:
        rows = rows.unionByName(more)
    kept = rows.join(answer.select("binding").distinct(), "binding", "left_semi")
    sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("fact_id", "fact_ids"), ("entity_id", "entities"), ("fiscal_year", "periods"))]
    return kept.groupBy("binding").agg(*sets).withColumn("step_ids", F.array(*[F.lit(s) for s in sorted(n for n in reached if n in by_id)]))
