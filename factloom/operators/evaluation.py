"""Scores, classes and verdicts of question samples, as columns and group aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Cost of a pattern's base level; (feature, offset, cap, weight) terms; upper score of each level.
BASE_COST = {"easy": 0.0, "medium": 1.0, "hard": 2.0, "expert": 4.0, "research": 6.0}
TERMS = (
    ("fact_count", 0, 10, 0.25), ("derived_fact_count", 0, 5, 0.5), ("entity_count", 1, None, 0.6), ("metric_count", 1, None, 0.6),
    ("period_count", 1, 4, 0.2), ("reasoning_graph_hop_depth", 0, None, 0.15), ("reasoning_branch_count", 0, 5, 0.08),
    ("provenance_graph_depth", 0, None, 0.03), ("operation_cost", 0, None, 1.0), ("operation_depth", 1, None, 1.4),
    ("semantic_constraint_count", 0, 10, 0.2), ("time_span_years", 0, 10, 0.08), ("node_count", 0, 100, 0.003), ("edge_count", 0, 150, 0.003),
    ("answer_cardinality", 1, None, 0.1), ("source_count", 1, None, 0.5),
)
LEVELS = (("easy", 2.5), ("medium", 5.5), ("hard", 9.5), ("expert", 18.0))
SCOPE_WEIGHT = 0.2
ACCEPTED, COVERAGE, REVIEW = 80, 70, 60
STRUCTURED = ("list", "table", "ranking", "ranked_table", "screening_table")


def difficulty(columns: list[str], base: Column | None = None) -> Column:
    """Weighted sum of the features present in ``columns``; an absent or null feature counts as 0."""
    have = {c.lower() for c in columns}
    score = F.lit(0.0)
    if base is not None:
        score = score + F.coalesce(F.create_map(*[F.lit(x) for kv in BASE_COST.items() for x in kv])[base], F.lit(0.0))
    for name, offset, cap, weight in TERMS:
        if name in have:
            x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
            x = F.greatest(x - offset, F.lit(0.0)) if offset else x
            score = score + (F.least(x, F.lit(float(cap))) if cap else x) * weight
    if "scope_size" in have:
        score = score + F.log2(F.greatest(F.coalesce(F.col("scope_size").cast("double"), F.lit(1.0)), F.lit(1.0))) * SCOPE_WEIGHT
    return F.round(score, 3)


def level(score: Column) -> Column:
    out = F
    for name, limit in LEVELS:
        out = out.when(score < limit, name)
    return out.otherwise("research")


def task_reasons(periods: Column, entities: Column, depth: Column, sources: Column, complete: Column, answer: Column) -> Column:
    """Why a sample is of the complex task; no reason makes it the simple one."""
    rules = (
        ("period_count>=3", periods >= 3), ("reasoning_operation_depth>=2", depth >= 2), ("source_count>=2", sources >= 2),
        ("scope_completeness", complete), ("structured_multi_item_answer", answer.isin(*STRUCTURED)),
        ("multi_entity_multi_period", (entities >= 2) & (periods >= 2)),
    )
    return F.filter(F.array(*[F.when(rule, name) for name, rule in rules]), lambda x: x.isNotNull())


def subjective_score(scores: DataFrame, key: str, owners: dict[str, str], weights: dict[str, float]) -> DataFrame:
    """(key, score, missing) from rows (key, role, dimension, score, confidence).

    A dimension counts only from the role that owns it; scores run from 1 to 5; a missing dimension leaves the score null.
    """
    own = F.create_map(*[F.lit(x) for kv in owners.items() for x in kv])
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    kept = scores.where(own[F.col("dimension")] == F.col("role"))
    per = kept.groupBy(key, "dimension").agg(F.max("score").cast("double").alias("score"))
    out = per.groupBy(key).agg(F.count(F.lit(1)).alias("have"), (F.sum(weight[F.col("dimension")] * (F.col("score") - 1) / 4) * 100).alias("raw"))
    return out.select(key, F.when(F.col("have") == len(weights), F.round("raw", 6)).alias("score"), (len(weights) - F.col("have")).alias("missing"))


def decision(score: Column, fatal: Column, pending: Column, role_value: Column, trainable: Column) -> Column:
    """The verdict, first rule that holds."""
    return (
        F.when(fatal, "rejected_subjective_fatal").when(pending | score.isNull(), "manual_review").when(score >= ACCEPTED, "accepted")
        .when((score >= COVERAGE) & (role_value >= COVERAGE) & trainable, "accepted_for_coverage").when(score >= REVIEW, "manual_review")
        .otherwise("rejected_subjective_quality")
    )


def issue_report(calls: DataFrame, key: str) -> DataFrame:
    """(issue, any_judge, two_or_more, confirmed) from calls (key, role, issue_codes, resolved)."""
    one = calls.select(key, "role", F.explode(F.array_distinct("issue_codes")).alias("issue"), "resolved")
    sure = (F.col("role") == "adversarial_reviewer") & F.col("resolved")
    per = one.groupBy(key, "issue").agg(F.count_distinct("role").alias("roles"), F.bool_or(sure).alias("sure"))
    return per.groupBy("issue").agg(
        F.count(F.lit(1)).alias("any_judge"), F.count_if(F.col("roles") >= 2).alias("two_or_more"), F.count_if("sure").alias("confirmed")
    )


def gap_value(target: Column, current: Column) -> Column:
    """Per cent of the target that is missing."""
    return F.when((target <= 0) | (current >= target), 0.0).otherwise(F.round(100.0 * (target - current) / target, 6))


def capacity_value(count: Column, most: int) -> Column:
    return F.when(count <= most, 100.0).otherwise(F.round(100.0 * most / count, 6))


def retention(builds: DataFrame, hot: int, preserved: list[str] = ()) -> DataFrame:
    """Builds with their action: hot, archive, or empty.

    Hot are the ``hot`` newest valid builds, active ones and preserved ones; others are archived if they hold anything.
    """
    if hot < 1:
        raise ValueError("at least one build must stay hot")
    valid = F.coalesce((F.col("status") == "success") & (F.col("quality_status") == "passed") & (F.col("n_nodes") > 0), F.lit(False))
    newest = builds.where(valid).orderBy(F.desc(F.coalesce("completed_at", "started_at")), F.desc("started_at"), "build_id").limit(hot).select("build_id", F.lit(True).alias("_hot"))
    keep = F.coalesce(F.col("_hot"), F.lit(False)) | F.coalesce(F.col("is_active") == 1, F.lit(False)) | F.col("build_id").isin(list(preserved))
    holds = (F.coalesce("n_nodes", F.lit(0)) > 0) | (F.coalesce("n_edges", F.lit(0)) > 0)
    done = F.coalesce(F.col("status").isin("archived", "archived_partial"), F.lit(False))
    action = F.when(keep, "hot").when(holds, "archive").when(~done, "empty").otherwise("archived")
    return builds.join(newest, "build_id", "left").withColumn("action", action).drop("_hot")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of ``order``, which should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def reason_counts(df: DataFrame, key: str, rules: dict[str, Column], otherwise: str, examples: int = 20) -> DataFrame:
    """(reason, n, examples) where a row may have several reasons; ``multiple_reasons`` counts those that do, without examples."""
    found = F.filter(F.array(*[F.when(r, n) for n, r in rules.items()]), lambda x: x.isNotNull())
    rows = df.select(F.col(key).alias("_key"), F.when(F.size(found) == 0, F.array(F.lit(otherwise))).otherwise(found).alias("r"))
    many = F.when(F.size("r") > 1, F.concat("r", F.array(F.lit("multiple_reasons")))).otherwise(F.col("r"))
    each = rows.select("_key", F.explode(many).alias("reason"))
    first = each.withColumn("_rn", F.row_number().over(Window.partitionBy("reason").orderBy("_key"))).where((F.col("_rn") <= examples) & (F.col("reason") != "multiple_reasons"))
    shown = first.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("_key")), ",").alias("examples"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(shown, "reason", "left")
