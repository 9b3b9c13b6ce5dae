"""From an assessment that holds to the one experiment to register next."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ALWAYS = ["holdout-membership", "payload-policy", "policy-gates", "production-state"]
SOMETIMES = ["evaluator-calibration", "execution-profiles", "routing-policy", "sampling-membership"]

# Diagnosis, changed variable, target, evidence required, the control that is not frozen.
PROPOSALS = [
    ("insufficient-evidence", "evidence-collection", "assessment-evidence", ["paired-evaluator-evidence", "independent-group-coverage", "observer-failure-evidence"], ""),
    ("evaluator-drift", "evaluator-calibration", "external-evaluator", ["evaluator-calibration-evidence"], "evaluator-calibration"),
    ("quality-regression", "routing-policy", "selected-policy", ["paired-evaluator-evidence", "independent-group-coverage"], "routing-policy"),
    ("critical-slice-regression", "routing-policy", "selected-policy", ["paired-evaluator-evidence", "critical-slice-coverage"], "routing-policy"),
    ("ttft-regression", "execution-profile", "selected-profile", ["observer-timing-evidence", "paired-evaluator-evidence", "observer-failure-evidence"], "execution-profiles"),
    ("tail-latency-regression", "execution-profile", "selected-profile", ["observer-timing-evidence", "paired-evaluator-evidence", "observer-failure-evidence"], "execution-profiles"),
    ("error-regression", "execution-profile", "selected-profile", ["observer-failure-evidence", "paired-evaluator-evidence"], "execution-profiles"),
    ("cost-regression", "execution-profile", "selected-profile", ["attempt-cost-evidence", "paired-evaluator-evidence"], "execution-profiles"),
    ("unavailable-capacity", "capacity-observation", "nominated-window", ["exact-policy-capacity-evidence"], ""),
    ("capability-mismatch", "required-capability", "finding", ["runtime-capability-evidence"], "execution-profiles"),
    ("sealed-shadow-replication", "evidence-window", "sealed-shadow-window", ["sealed-shadow-window-evidence", "paired-evaluator-evidence", "independent-group-coverage"], "sampling-membership"),
]
# What makes an assessment stale by its evaluator alone.
EVALUATOR_STALE = [
    "evaluator-verification-context-drift",
    "evaluator-evidence-revoked",
    "evaluator-evidence-stale",
    "evaluator-evidence-future-dated",
    "evaluator-evidence-key-not-yet-valid",
    "evaluator-evidence-key-expired",
    "evaluator-evidence-produced-after-assessment-cutoff",
]
CAPACITY = "required-service-capacity-unavailable"


def diagnose(assessments: DataFrame) -> DataFrame:
    """Adds ``diagnosis``; the first rule that fits holds, null if none does.

    Columns: phase, status, failed (ids of failed gates), insufficient and stale (reasons), capacity_unknown (the
    capacity gate failed for want of a figure), mismatch (a required capability is known to be lacking).
    """
    failed = lambda *gates: F.exists("failed", lambda g: g.isin(*gates))
    evaluator_only = (F.col("status") == "STALE") & (F.size("stale") > 0) & F.forall("stale", lambda r: r.isin(*EVALUATOR_STALE))
    capacity = (F.col("phase") == "window") & (F.array_contains("insufficient", CAPACITY) | F.col("capacity_unknown"))
    rule = (
        F.when(F.exists("insufficient", lambda r: r != CAPACITY), "insufficient-evidence")
        .when(evaluator_only, "evaluator-drift")
        .when(failed("paired-quality", "minimum-mean-score"), "quality-regression")
        .when(F.exists("failed", lambda g: g.startswith("paired-critical-slice-quality:")), "critical-slice-regression")
        .when(failed("maximum-p95-ttft"), "ttft-regression")
        .when(failed("maximum-p95-end-to-end"), "tail-latency-regression")
        .when(failed("maximum-failure-rate"), "error-regression")
        .when(failed("maximum-cost-per-thousand"), "cost-regression")
        .when(capacity, "unavailable-capacity")
        .when(F.col("mismatch"), "capability-mismatch")
        .when((F.col("phase") == "development") & (F.col("status") == "NOMINATED"), "sealed-shadow-replication")
    )
    return assessments.withColumn("diagnosis", rule)


def propose(diagnosed: DataFrame) -> DataFrame:
    """Adds variable, target, evidence and frozen controls by the diagnosis; no diagnosis, no proposal."""
    table = diagnosed.sparkSession.createDataFrame(PROPOSALS, "diagnosis string, variable string, target string, evidence array<string>, free string")
    controls = F.array_sort(F.array_remove(F.array(*map(F.lit, ALWAYS + SOMETIMES)), F.col("free")))
    return diagnosed.join(F.broadcast(table), "diagnosis").withColumn("frozen", controls).drop("free")
