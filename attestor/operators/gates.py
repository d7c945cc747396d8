"""Gates: named thresholds on summary metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gate, metric, scope ('overall', 'each' condition or one condition), comparison, required. A gate of two conditions has two rows.
SCREEN_GATES = [
    ("median_auroc_delta", "median_auroc_delta", "overall", ">=", 0.03),
    ("paired_auroc_delta_ci_lower", "bootstrap_lower", "overall", ">", 0.0),
    ("coverage_each_corruption", "median_coverage", "each", ">=", 0.97),
    ("support_area_ratio", "median_support_area_ratio", "overall", "<=", 0.65),
    ("fallback_each_corruption", "fallback_over_limit", "each", "<=", 0.0),
    ("invalid_border", "invalid_border_rate", "overall", "<=", 0.05),
    ("mass_concentration_delta", "median_mass_concentration_delta", "overall", ">=", 0.08),
    ("corruption_auroc_regression", "auroc_regression", "each", "<=", 0.05),
    ("old_proxy_redundancy", "redundant", "overall", "<=", 0.0),
]
RANKING_GATES = [
    ("coverage_each_corruption", "median_coverage", "each", ">=", 0.97),
    ("overall_auroc_delta", "median_auroc_delta", "overall", ">=", 0.04),
    ("auroc_delta_each_corruption", "median_auroc_delta", "each", ">=", 0.02),
    ("paired_auroc_delta_ci_lower", "bootstrap_lower", "overall", ">", 0.0),
    ("overall_auprc_delta", "median_auprc_delta", "overall", ">=", 0.03),
    ("gaussian_noise_auprc_delta", "median_auprc_delta", "gaussian_noise", ">=", 0.02),
    ("support_area_ratio_overall", "median_support_area_ratio", "overall", "<=", 0.60),
    ("support_area_ratio_each_corruption", "median_support_area_ratio", "each", "<=", 0.65),
    ("fallback_each_corruption", "fallback_rate", "each", "<=", 0.35),
    ("clean_to_noise_auroc_degradation", "auroc_regression", "gaussian_noise", "<=", 0.06),
    ("boundary_f1_delta", "median_boundary_f1_delta", "overall", ">=", 0.025),
    ("dice_delta", "median_dice_delta", "overall", ">=", 0.015),
    ("invalid_border", "invalid_border_rate", "overall", "<=", 0.05),
    ("runtime_median", "runtime_median_seconds", "overall", "<=", 1.5),
    ("runtime_p95", "runtime_p95_seconds", "overall", "<=", 3.0),
]
CONTOUR_GATES = [
    ("bf1_delta_overall", "median_boundary_f1_delta", "overall", ">=", 0.040),
    ("bf1_delta_each_corruption", "median_boundary_f1_delta", "each", ">=", 0.020),
    ("bootstrap_bf1_lower", "bootstrap_lower", "overall", ">", 0.0),
    ("dice_delta", "median_dice_delta", "overall", ">=", -0.010),
    ("precision_delta", "median_precision_delta", "overall", ">=", 0.020),
    ("recall_delta", "median_recall_delta", "overall", ">=", -0.015),
    ("probability_ranking", "max_auroc_regression", "overall", "<=", 0.010),
    ("probability_ranking", "max_auprc_regression", "overall", "<=", 0.010),
    ("fallback_each_corruption", "fallback_rate", "each", "<=", 0.25),
    ("invalid_border_each_corruption", "invalid_border_rate", "each", "<=", 0.05),
    ("assd_relative_improvement", "median_assd_relative_improvement", "overall", ">=", 0.10),
    ("hd95_relative_regression", "median_hd95_relative_regression", "overall", "<=", 0.02),
    ("runtime_median", "runtime_median_seconds", "overall", "<=", 1.0),
    ("runtime_p95", "runtime_p95_seconds", "overall", "<=", 2.0),
]
#: Fixed values of the rules that metrics follow: a fallback rate's limit, by itself and below the baseline; the redundant correlation.
FALLBACK_MOST, FALLBACK_BELOW, CORRELATION_MOST = 0.45, 0.15, 0.95
PROTOCOLS = {"screen": SCREEN_GATES, "ranking": RANKING_GATES, "contour": CONTOUR_GATES}


def protocol(name: str) -> list[tuple[str, str, str, str, float]]:
    """The gates of a protocol, under names that no other protocol has."""
    return [(f"{name}.{gate}", *rest) for gate, *rest in PROTOCOLS[name]]


def derived(summary: DataFrame) -> DataFrame:
    """summary (scope, metric, value) with the metrics that follow from others:

    'auroc_regression' of each condition but 'clean': the clean median AUROC less its own. 'fallback_over_limit' of each
    condition: its fallback rate less the limit, which is the smaller of 0.45 and the baseline's less 0.15, and infinite if that
    is below 0. 'redundant' (1 or 0): a correlation with the old proxy of over 0.95 without a gain in AUROC or mass. What lacks a
    metric that it needs is left out.
    """
    value = lambda scope, metric: F.max(F.when((F.col("scope") == scope) & (F.col("metric") == metric), F.col("value")))
    known = summary.agg(
        value("clean", "median_auroc").alias("clean"),
        value("overall", "fallback_baseline").alias("baseline"),
        value("overall", "median_spearman_vs_old_proxy").alias("correlation"),
        value("overall", "median_auroc_delta").alias("auroc"),
        value("overall", "median_mass_concentration_delta").alias("mass"),
    )  # one row
    rows = summary.where("scope <> 'overall'").join(F.broadcast(known), F.lit(True))
    limit = F.least(F.lit(FALLBACK_MOST), F.col("baseline") - FALLBACK_BELOW)
    over = F.when(F.col("baseline").isNotNull(), F.when(limit >= 0, F.col("value") - limit).otherwise(float("inf")))
    made = rows.where("metric = 'median_auroc' and scope <> 'clean'").select("scope", F.lit("auroc_regression").alias("metric"), (F.col("clean") - F.col("value")).alias("value"))
    made = made.union(rows.where("metric = 'fallback_rate'").select("scope", F.lit("fallback_over_limit"), over))
    redundant = ((F.col("correlation") > CORRELATION_MOST) & (F.col("auroc") <= 0) & (F.col("mass") <= 0)).cast("double")
    made = made.union(known.select(F.lit("overall"), F.lit("redundant"), redundant))
    return summary.select("scope", "metric", "value").union(made.where("value is not null"))


def verdicts(results: DataFrame) -> DataFrame:
    """(protocol, gates, failed, blocked, passed) of evaluate(): a gate passes if all its rows do, a protocol if all its gates do."""
    worst = F.max(F.when(F.col("status") == "blocked", 2).when(F.col("status") == "failed", 1).otherwise(0)).alias("worst")
    by_gate = results.groupBy(F.split("gate", r"\.")[0].alias("protocol"), "gate").agg(worst)
    found = by_gate.groupBy("protocol").agg(F.count("*").alias("gates"), F.count_if(F.col("worst") == 1).alias("failed"), F.count_if(F.col("worst") == 2).alias("blocked"))
    return found.withColumn("passed", F.col("failed") + F.col("blocked") == 0)


def evaluate(summary: DataFrame, gates: DataFrame) -> DataFrame:
    """(gate, observed, required, comparison, status) of summary (scope, metric, value) and gates (gate, metric, scope, comparison, required).

    A gate over 'each' scope looks at its worst condition. A metric that isn't there leaves the gate 'blocked'.
    """
    worst = F.when(F.col("comparison").startswith(">"), F.min("value")).otherwise(F.max("value"))
    g, s = gates.alias("g"), summary.withColumnRenamed("scope", "of").alias("s")
    fits = (F.col("g.metric") == F.col("s.metric")) & ((F.col("g.scope") == F.col("of")) | ((F.col("g.scope") == "each") & (F.col("of") != "overall")))
    met = g.join(s, fits, "left").groupBy("gate", F.col("g.metric").alias("_metric"), "comparison", "required").agg(worst.alias("observed")).drop("_metric")
    o, r = F.col("observed"), F.col("required")
    ok = F.when(F.col("comparison") == ">=", o >= r).when(F.col("comparison") == ">", o > r).otherwise(o <= r)
    return met.withColumn("status", F.when(o.isNull() | F.isnan(o), "blocked").when(ok, "passed").otherwise("failed"))
