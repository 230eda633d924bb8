"""Three-way routing by thresholds, and how decisions of people and models are brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, EXCLUDE, MANUAL = "keep", "exclude", "manual_review"


def route(p: Column, t_keep: float, t_exclude: float, enabled: Column | bool = True) -> Column:
    """Closed tails: ``p <= t_keep`` keeps, ``p >= t_exclude`` excludes, the rest is for people."""
    if not 0 <= t_keep < t_exclude <= 1:
        raise ValueError("thresholds must rise within 0 and 1")
    fine = F.when(p.isNull() | F.isnan(p) | (p < 0) | (p > 1), F.raise_error(F.lit("not a probability")))
    on = F.lit(enabled) if isinstance(enabled, bool) else enabled
    return fine.otherwise(F.when(~on, MANUAL).when(p <= t_keep, KEEP).when(p >= t_exclude, EXCLUDE).otherwise(MANUAL)).cast("string")


def manual_tasks(scored: DataFrame, humans: DataFrame, key: str, action: str = "action") -> DataFrame:
    """The middle band without what people have labelled."""
    return scored.filter(F.col(action) == MANUAL).join(humans, key, "left_anti")


def final_action(audit: Column, training: Column, model: Column, enabled: Column) -> Column:
    """(action, source): training label, audit label, released tail, downgraded tail, middle band."""
    said = lambda label, source: F.struct(F.when(label == "related", KEEP).when(label == "unrelated", EXCLUDE).otherwise(MANUAL).alias("action"), F.lit(source).alias("source"))
    plain = lambda action, source: F.struct(action.alias("action"), F.lit(source).alias("source"))
    return (
        F.when(training.isNotNull(), said(training, "human_training_label"))
        .when(audit.isNotNull(), said(audit, "human_audit_label"))
        .when(model == MANUAL, plain(F.lit(MANUAL), "model_middle_band"))
        .when(enabled, plain(model, "model_audit_released"))
        .otherwise(plain(F.lit(MANUAL), "model_tail_downgraded"))
    )


def merge_candidates(records: DataFrame, scores: DataFrame, key: str, t_keep: float, t_exclude: float, cluster: str) -> DataFrame:
    """Each record with its human decision or else the routed score; clusters of mixed decisions are flagged."""
    met = records.join(scores, key, "left")
    human = F.col("human_action").isNotNull()
    decided = met.withColumn("decision", F.when(human, F.col("human_action")).when(F.col("p").isNull(), F.raise_error(F.lit("a record has neither label nor score"))).otherwise(route(F.coalesce("p", F.lit(0.5)), t_keep, t_exclude)))
    decided = decided.withColumns({"origin": F.when(human, "human").otherwise("model"), "probability": F.when(~human, F.col("p")), "review_state": F.lit("pending")})
    mixed = decided.groupBy(cluster).agg((F.min("decision") != F.max("decision")).alias("conflict"))
    return decided.join(mixed, cluster)


def current_decisions(ledger: DataFrame) -> DataFrame:
    """Decisions of an append-only ledger that no later one supersedes."""
    return ledger.join(ledger.select(F.col("supersedes_id").alias("decision_id")).filter("decision_id is not null"), "decision_id", "left_anti")


def wave_a_stratum(sparse: Column, dense: Column) -> Column:
    """The first of six strata that holds for two models' probabilities."""
    high_s, high_d, yes_s, yes_d = sparse >= 0.9, dense >= 0.9, sparse >= 0.5, dense >= 0.5
    return (
        F.when(high_s & high_d, "both_high").when(high_d, "dense_high").when(high_s, "sparse_high")
        .when(yes_s != yes_d, "disagree").when(yes_s & yes_d, "both_unrelated").otherwise("both_related")
    )


def cross_action(selected: Column, comparator: Column) -> Column:
    return F.concat(F.lit("dense_"), selected, F.lit("__sparse_"), comparator)


def closest_points(points: DataFrame, targets: DataFrame, rate: str = "manual_rate") -> DataFrame:
    """For each target workload the grid point whose rate is nearest, then the one of least thresholds."""
    order = F.struct(F.round(F.abs(F.col(rate) - F.col("target")), 9).alias("gap"), F.col("t_keep"), F.col("t_exclude"))
    best = targets.crossJoin(F.broadcast(points)).groupBy("target").agg(F.min_by(F.struct("t_keep", "t_exclude", rate), order).alias("b"))
    return best.select("target", "b.*")
