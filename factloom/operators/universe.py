"""Which facts a build takes in: peer scopes, shares of regions, and chains whose inputs fit a budget."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import scratch

#: Chains whose running sum the driver follows at a time; larger sums are taken block by block on the cluster.
BLOCK = 65_536


def peer_universe(facts: DataFrame, base: str, others: Sequence[str], least: int = 5, most: int = 30) -> DataFrame:
    """(scope, year, members, n, eligible) from facts (entity, scope, year, metric, definition, fact_id, value, score).

    An entity is a member if it has ``base`` this year and the year before under one definition, every other metric this year, and no
    zero among the two base values and the first other metric's, which are denominators. Of several facts for a slot the best score
    counts, then the largest id; of several definitions the one whose lesser score is best, then the greater score, then the name.
    """
    best = F.max(F.struct("score", "fact_id", "value"))
    now = facts.where(F.col("metric") == base).groupBy("entity", "scope", "year", "definition").agg(best.alias("now"))
    before = now.select("entity", (F.col("year") + 1).alias("year"), "definition", F.col("now").alias("before"))
    rank = lambda c: F.struct(c["score"], c["fact_id"])
    a, b = F.col("now"), F.col("before")
    order = F.struct(F.least(rank(a), rank(b)).alias("low"), F.greatest(rank(a), rank(b)).alias("high"), "definition", a["value"].alias("now"), b["value"].alias("before"))
    pairs = now.join(before, ["entity", "year", "definition"]).groupBy("entity", "scope", "year").agg(F.max(order).alias("b"))
    slots = facts.where(F.col("metric").isin(*others)).groupBy("entity", "year", "metric").agg(best.alias("best"))
    first = F.max(F.when(F.col("metric") == others[0], F.col("best.value")))
    rest = slots.groupBy("entity", "year").agg(F.count(F.lit(1)).alias("k"), first.alias("first")).where(F.col("k") == len(others))
    members = pairs.join(rest, ["entity", "year"]).where("b.now <> 0 and b.before <> 0 and first <> 0")
    scopes = members.groupBy("scope", "year").agg(F.array_sort(F.collect_set("entity")).alias("members"))
    n = F.size("members")
    return scopes.select("scope", "year", "members", n.alias("n"), n.between(least, most).alias("eligible"))


def share_budget(home: Column, share: float) -> Column:
    """How many other rows go with ``home`` rows so that these are at least ``share`` of all."""
    return F.floor(home * (1 - share) / share)


def _reach(amounts: DataFrame, bound: int) -> int | None:
    """The first place at which the running sum of (place, n) is above ``bound``; sums by block first, then inside one block."""
    block = F.floor(F.col("place") / BLOCK)
    total = 0
    for b, n in amounts.groupBy(block.alias("b")).agg(F.sum("n").alias("n")).orderBy("b").toLocalIterator():
        if total + n > bound:
            for place, m in amounts.where(block == b).groupBy("place").agg(F.sum("n")).orderBy("place").toLocalIterator():
                total += m
                if total > bound:
                    return place
        total += n
    return None


def placed(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 in an order over all rows, without sorting them in one task."""
    part = scratch.column_like("_part", df.columns)
    dealt = scratch.stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "places")
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(part, before.alias("n"))  # a row for each partition
    inner = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn(name, inner.cast("long")).join(starts, part).withColumn(name, (F.col(name) + F.col("n")).cast("long")).drop(part, "n")


def chain_cover(members: DataFrame, budget: int, fraction: float | None = None, target: int | None = None, every: int = 25) -> tuple[DataFrame, dict[str, int]]:
    """Facts of as many chains as a budget of facts allows, shortest chains first; gives (fact) and what was reached.

    ``members`` holds (chain, kind, fact), all distinct. Chains come by number of facts, kind and id; one joins if the facts it adds fit
    into what is left of ``budget``. After every ``every`` that joined, and after all, the chains whose facts are all there are counted,
    and the search ends when they are ``target`` (or ``fraction`` of all).

    The greedy order is followed in stretches. Until a chain does not fit, each fact is added by the first chain that has it, so a
    stretch's end is where a running sum passes the budget: aggregates on the cluster and one block of sums here. Where a stretch ends
    less is left than one chain has, and each later stretch adds a fact, so there are fewer stretches than a chain has facts.
    """
    chains = members.groupBy("chain", "kind").agg(F.count(F.lit(1)).alias("size"))
    order = placed(chains, ["size", "kind", "chain"])
    m = scratch.stored(members.join(order.select("chain", "kind", "place"), ["chain", "kind"]).select("place", "fact"), "members")
    count = order.count()
    target = math.floor(count * (1.0 if fraction is None else fraction)) if target is None else target
    chosen = m.select("fact").limit(0)
    start, spent, joined, stop = 0, 0, 0, False

    def closing(first: DataFrame) -> DataFrame:
        """(place, n): how many chains have all their facts once the chain at that place has joined; -1 for those that have them already."""
        known = chosen.select("fact", F.lit(-1).cast("long").alias("place_of")).unionByName(first.select("fact", F.col("place").alias("place_of")))
        whole = m.join(known, "fact", "left").groupBy("place").agg(F.max(F.coalesce("place_of", F.lit(2**62))).alias("at"))
        return scratch.stored(whole.where(F.col("at") < 2**62).groupBy(F.col("at").alias("place")).agg(F.count(F.lit(1)).alias("n")), "closing")

    skipping = False
    while start < count:
        open_ = m.join(chosen, "fact", "left_anti")
        if skipping:  # chains that do not fit are passed over; those that add nothing join
            added = scratch.stored(open_.where(F.col("place") >= start).groupBy("place").agg(F.count(F.lit(1)).alias("n")), "added")
            fits = added.where(F.col("n") <= budget - spent).agg(F.min("place")).first()[0]
            end = count if fits is None else fits
            free = end - start - added.where(F.col("place") < end).count()
            if (joined + free) // every > joined // every and count - open_.select("place").distinct().count() >= target:
                joined += every - joined % every
                break
            joined, start = joined + free, end
            if fits is None:
                break
        first = scratch.stored(open_.where(F.col("place") >= start).groupBy("fact").agg(F.min("place").alias("place")), "first")
        over = _reach(first.groupBy("place").agg(F.count(F.lit(1)).alias("n")), budget - spent)
        end = count if over is None else over
        ready = start if target <= 0 else _reach(closing(first), target - 1)
        check = start + every - 1 - joined % every  # the first place after whose chain the closed ones are counted
        if ready is not None:
            check += max(0, -(-(ready - check) // every)) * every
            if check < end:
                end, stop = check + 1, True
        chosen = scratch.stored(chosen.unionByName(first.where(F.col("place") < end).select("fact")), "chosen")
        spent, joined, start, skipping = chosen.count(), joined + end - start, end, True
        if stop:
            break
    shut = count - m.join(chosen, "fact", "left_anti").select("place").distinct().count()
    return chosen, {"chains": count, "target": target, "joined": joined, "facts": spent, "closed": shut}
