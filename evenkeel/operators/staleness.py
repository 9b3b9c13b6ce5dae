"""Why an assessment is stale: facts of the protocol, the context, the policy and the window, and facts of its executions.

The facts of the executions are one aggregate of flags per key, combined before the shuffle; nothing is exploded.  Times are
timestamps or numbers.  An execution has ``completed_at, profile_ok`` (its profile is the protocol's), and of its evidence
``authentic`` (null: no verification), ``status, evidence_context, assessed_at, trust_digest, revocation_digest, produced_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Verification results that make evidence stale.
STALE_STATUS = ["revoked", "stale", "future-dated", "key-not-yet-valid", "key-expired"]
DRIFT = "evaluator-verification-context-drift"


def fixed_reasons(protocol: dict, dataset: dict, context: dict, policy: dict | None = None, window: dict | None = None) -> list[str]:
    """Reasons that need no row.  ``protocol``: study, digest, created_at, expires_at; ``dataset``: study, protocol_digest,
    context_digest (or None), contexts (their number); ``context``: digest, as_of; ``policy``: issued_at; ``window``: start, end, watermark."""
    now = context["as_of"]
    rules = [
        ("protocol-or-study-drift", (dataset["study"], dataset["protocol_digest"]) != (protocol["study"], protocol["digest"])),
        ("assessment-context-drift", dataset["context_digest"] not in (None, context["digest"])),
        (DRIFT, dataset["contexts"] > 1),
        ("protocol-not-yet-valid", now < protocol["created_at"]),
        ("protocol-expired", now >= protocol["expires_at"]),
        ("policy-not-yet-valid", policy is not None and policy["issued_at"] > now),
        ("window-not-yet-sealed-at-assessment-time", window is not None and max(window["end"], window["watermark"]) > now),
        ("policy-issued-after-window-start", policy is not None and window is not None and policy["issued_at"] > window["start"]),
    ]
    return [code for code, holds in rules if holds]


def row_rules(context: dict) -> list[tuple[str, Column]]:
    c, real = F.col, F.coalesce(F.col("authentic"), F.lit(False))
    same = c("evidence_context").eqNullSafe(F.lit(context["digest"])) & c("assessed_at").eqNullSafe(F.lit(context["as_of"])) & c("trust_digest").eqNullSafe(F.lit(context["trust_digest"])) & c("revocation_digest").eqNullSafe(F.lit(context["revocation_digest"]))
    return [
        ("trace-completed-after-assessment-cutoff", c("completed_at") > F.lit(context["as_of"])),
        ("execution-profile-drift", ~F.coalesce(c("profile_ok"), F.lit(False))),
        (DRIFT, real & ((c("status") == "context-mismatch") | ~same)),
        *[(f"evaluator-evidence-{s}", real & (c("status") == s)) for s in STALE_STATUS],
        ("evaluator-evidence-produced-after-assessment-cutoff", c("produced_at") > F.lit(context["as_of"])),
    ]


def stale_reasons(executions: DataFrame, context: dict, fixed: list[str] = (), by: list[str] = ()) -> DataFrame:
    """(by, reasons): all reasons, sorted, each once.  No executions and no key: one row with the fixed reasons."""
    rules = row_rules(context)
    flags = [F.coalesce(F.max(F.coalesce(rule, F.lit(False))), F.lit(False)).alias(f"_r{i}") for i, (_, rule) in enumerate(rules)]
    rows = executions.groupBy(*by).agg(*flags)
    found = F.array_compact(F.array(*[F.when(F.col(f"_r{i}"), F.lit(code)) for i, (code, _) in enumerate(rules)], *map(F.lit, fixed)))
    return rows.select(*by, F.array_sort(F.array_distinct(found)).alias("reasons"))
