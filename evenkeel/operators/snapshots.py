"""What is wrong with a controller's snapshot, as a list of codes in the rules' order.

A snapshot is one row: state, sequence, last_event_id, last_event_at, created_at, expires_at, protocol, collection, evidence
(struct dataset, traces, evaluators), policy (struct digest, issued_at, expires_at), assessments (structs phase, status, decision,
protocol, dataset, traces, evaluators, policy, manifest), windows (structs window, revisions; a revision has window, revision,
predecessor, manifest, protocol, policy, starts, ends, watermark, traces, evaluators, capacity), deployment (struct policy,
observed_at) and stale (texts).  Times are comparable.  All rules are expressions over the row, so the check is a map.
A null list is empty; a null condition is no fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .semantics import last, listed, repeats

REVISIONS = 1_024  # of all windows of one snapshot, by contract
# Events that a state has exactly, and states with rules of their own.
EVENTS = {"REGISTERED": 1, "COLLECTING": 2, "DEV_READY": 3, "NOMINATED": 4}
AFTER_DEPLOYMENT = ["MONITORING", "HOLD", "ROLLBACK_RECOMMENDED", "STALE", "RETIRED"]
NEEDS_COLLECTION = ["COLLECTING", "DEV_READY", "NOMINATED", "SHADOW_ASSESSING", "HOLDOUT_CONFIRMED", "PROMOTION_RECOMMENDED", "MONITORING", "HOLD", "ROLLBACK_RECOMMENDED"]
NEEDS_NOMINATION = NEEDS_COLLECTION[2:7] + NEEDS_COLLECTION[8:]
NEEDS_HOLDOUT = ["HOLDOUT_CONFIRMED", "PROMOTION_RECOMMENDED", "MONITORING", "ROLLBACK_RECOMMENDED"]


def _listed_in_order(values: Column) -> Column:
    return values == F.array_sort(values)


def _steps(revisions: Column, broken) -> Column:
    """Whether some revision and the one after it are ``broken``."""
    n = F.greatest(F.size(revisions) - 1, F.lit(0))
    return F.exists(F.zip_with(F.slice(revisions, 1, n), F.slice(revisions, 2, n), broken), lambda x: F.coalesce(x, F.lit(False)))


def faults() -> Column:
    state, sequence, at = F.col("state"), F.col("sequence"), F.col("last_event_at")
    created, expires, policy, evidence, deployment = F.col("created_at"), F.col("expires_at"), F.col("policy"), F.col("evidence"), F.col("deployment")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    assessments = F.coalesce(F.col("assessments"), F.slice("assessments", 1, 0))
    windows, stale = F.col("windows"), none(F.col("stale"), "array<string>")
    n_assessments, n_windows = F.coalesce(F.size("assessments"), F.lit(0)), F.coalesce(F.size("windows"), F.lit(0))
    n_assessments, n_windows = F.greatest(n_assessments, F.lit(0)), F.greatest(n_windows, F.lit(0))
    revisions = F.flatten(F.transform(windows, lambda w: w["revisions"]))
    n_revisions = F.greatest(F.coalesce(F.size(revisions), F.lit(0)), F.lit(0))
    of = lambda phase: F.filter(assessments, lambda a: a["phase"] == phase)
    count = lambda a: F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0))
    development, holdout = F.try_element_at(of("development"), F.lit(1)), F.try_element_at(of("holdout"), F.lit(1))
    is_ = lambda c, value: F.coalesce(c == value, F.lit(False))
    nominated, passed = is_(development["status"], "NOMINATED"), is_(holdout["status"], "PASS")
    n_window = count(of("window"))
    rank = F.transform(assessments, lambda a: F.when(a["phase"] == "development", 0).when(a["phase"] == "holdout", 1).otherwise(2))
    any_of = lambda items, rule: F.coalesce(F.exists(items, lambda x: F.coalesce(rule(x), F.lit(False))), F.lit(False))
    final = last(assessments)
    ends = F.transform(windows, lambda w: last(w["revisions"])["manifest"])
    latest = lambda status: is_(final["phase"], "window") & is_(final["status"], status) & F.coalesce(F.array_contains(ends, final["manifest"]), F.lit(False))
    later = policy.isNotNull() | (n_assessments > 0) | (n_windows > 0) | deployment.isNotNull()
    after_holdout = 6 + n_revisions + n_window
    wanted = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])[state]
    wanted = (
        F.when(state == "SHADOW_ASSESSING", 5 + n_revisions)
        .when(state.isin("HOLDOUT_CONFIRMED", "PROMOTION_RECOMMENDED"), after_holdout)
        .when(state.isin("MONITORING", "ROLLBACK_RECOMMENDED"), after_holdout + 1)
        .when(state == "HOLD", F.when(policy.isNull(), 3 + n_assessments).otherwise(4 + n_assessments + n_revisions + deployment.isNotNull().cast("int")))
        .otherwise(wanted)
    )
    active = ~state.isin("STALE", "RETIRED")
    sources = lambda a, b: (a["traces"] != b["traces"]) | (a["evaluators"] != b["evaluators"])
    lineage = lambda w: any_of(F.transform(w["revisions"], lambda r, i: (r["window"] != w["window"]) | (r["revision"] != i + 1) | ~r["predecessor"].eqNullSafe(F.when(i > 0, F.get(w["revisions"], i - 1)["manifest"]))), lambda x: x)
    excluded = (
        ((state == "REGISTERED") & (F.col("collection").isNotNull() | evidence.isNotNull() | later))
        | ((state == "COLLECTING") & (evidence.isNotNull() | later))
        | ((state == "DEV_READY") & later)
        | ((state == "NOMINATED") & (holdout.isNotNull() | (n_windows > 0) | deployment.isNotNull()))
        | ((state == "SHADOW_ASSESSING") & (holdout.isNotNull() | deployment.isNotNull()))
        | (state.isin("HOLDOUT_CONFIRMED", "PROMOTION_RECOMMENDED") & deployment.isNotNull())
    )
    lacking = (
        (state.isin(*NEEDS_COLLECTION) & F.col("collection").isNull())
        | (state.isin(*NEEDS_COLLECTION[1:]) & evidence.isNull())
        | (state.isin(*NEEDS_NOMINATION) & (policy.isNull() | ~nominated))
        | (state.isin(*NEEDS_HOLDOUT) & ~passed)
        | (state.isin("MONITORING", "ROLLBACK_RECOMMENDED") & deployment.isNull())
    )
    observed = deployment["observed_at"]
    rules = [
        ("validity-order", created >= expires),
        ("last-event-halves", F.col("last_event_id").isNull() != at.isNull()),
        ("genesis-identity", (sequence == 0) != F.col("last_event_id").isNull()),
        ("genesis-not-empty", (sequence == 0) & ((state != "DRAFT") | F.col("collection").isNotNull() | evidence.isNotNull() | later | (F.size(stale) > 0))),
        ("draft-after-genesis", (sequence != 0) & (state == "DRAFT")),
        ("event-before-creation", at < created),
        ("expired-but-active", active & (at >= expires)),
        ("window-repeated", repeats(F.transform(windows, lambda w: w["window"]))),
        ("windows-unsorted", ~_listed_in_order(F.transform(windows, lambda w: w["window"]))),
        ("too-many-revisions", n_revisions > REVISIONS),
        ("revision-lineage", any_of(windows, lineage)),
        ("revision-policy", any_of(revisions, lambda r: (r["protocol"] != F.col("protocol")) | policy.isNull() | (r["policy"] != policy["digest"]))),
        ("revision-outside-validity", any_of(revisions, lambda r: (r["starts"] < created) | (r["watermark"] >= expires))),
        ("revision-after-event", any_of(revisions, lambda r: r["watermark"] > at)),
        ("manifest-repeated", repeats(F.transform(revisions, lambda r: r["manifest"]))),
        ("revision-bounds", any_of(windows, lambda w: _steps(w["revisions"], lambda a, b: (a["starts"] != b["starts"]) | (a["ends"] != b["ends"])))),
        ("revision-watermark", any_of(windows, lambda w: _steps(w["revisions"], lambda a, b: b["watermark"] < a["watermark"]))),
        ("revision-unchanged", any_of(windows, lambda w: _steps(w["revisions"], lambda a, b: ~sources(a, b) & (a["capacity"] == b["capacity"])))),
        ("assessment-repeated", repeats(F.transform(assessments, lambda a: a["decision"]))),
        ("assessment-protocol", any_of(assessments, lambda a: a["protocol"] != F.col("protocol"))),
        ("assessment-phase-order", ~_listed_in_order(rank)),
        ("development-repeated", count(of("development")) > 1),
        ("holdout-without-nomination", (count(of("holdout")) > 0) & (~nominated | (count(of("holdout")) > 1))),
        ("window-without-holdout", (n_window > 0) & ~passed),
        ("window-source", any_of(of("window"), lambda a: ~F.coalesce(F.exists(revisions, lambda r: (r["manifest"] == a["manifest"]) & ~sources(a, r)), F.lit(False)))),
        ("policy-validity", (policy["issued_at"] < created) | (policy["expires_at"] != expires) | (policy["issued_at"] > at)),
        ("policy-nomination", F.when(policy.isNull(), nominated).otherwise(~nominated | ~policy.eqNullSafe(development["policy"]))),
        ("assessment-policy", any_of(assessments, lambda a: (a["phase"] != "development") & (policy.isNull() | ~a["policy"].eqNullSafe(policy)))),
        ("evidence-without-collection", evidence.isNotNull() & F.col("collection").isNull()),
        ("assessment-without-evidence", (n_assessments > 0) & evidence.isNull()),
        ("development-evidence", (development["dataset"] != evidence["dataset"]) | sources(development, evidence)),
        ("window-without-policy", (n_windows > 0) & policy.isNull()),
        ("deployment-incoherent", deployment.isNotNull() & (policy.isNull() | ~passed | ~any_of(of("window"), lambda a: a["status"] == "PASS") | (deployment["policy"] != policy["digest"]) | (observed < created) | (observed >= expires) | at.isNull() | (observed > at) | ~state.isin(*AFTER_DEPLOYMENT))),
        ("stale-reasons-state", (F.size(stale) > 0) & active),
        ("stale-without-reason", (F.size(stale) == 0) & (state == "STALE")),
        ("state-sequence", sequence != wanted),
        ("state-excludes", excluded),
        ("state-requires", lacking),
        ("state-last-assessment", ((state == "PROMOTION_RECOMMENDED") & ~latest("PASS")) | ((state == "ROLLBACK_RECOMMENDED") & ~latest("HOLD")) | ((state == "HOLD") & (final.isNull() | final["status"].isin("NOMINATED", "PASS", "STALE")))),
    ]
    return listed(rules)


def snapshot_faults(snapshots: DataFrame) -> DataFrame:
    """The snapshots with ``faults``, the codes of the rules that they break."""
    return snapshots.withColumn("faults", faults())
