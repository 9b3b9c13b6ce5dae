"""Nomination of a policy on development evidence and its confirmation on holdout evidence, as artifacts with digests.

Policies and gates are few (``CANDIDATES`` is checked) and come to the driver; rows and groups don't.  The groups of the development
evidence are a table beside the artifact, which holds its digest, and leakage is a join of two such tables.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, functions as F

from ..functions import canonical

CANDIDATES = 10_000  # policies of one nomination; more are refused
GATES = 64  # gates of one policy
DOMAIN = "evenkeel/nomination/1"
NAMED = 20  # leaked groups that an error names

#: Which experiment answers which failed gate; another gate, or none, asks for a replication.
TECHNIQUES = {
    "mean_score": "calibrate-routing",
    "paired_quality": "calibrate-routing",
    "p10_tps": "speculative-decoding",
    "p50_total_tps": "continuous-batching",
    "cost_per_request": "quantization",
    "cost_improvement": "quantization",
    "p95_e2e": "queues-and-autoscaling",
    "error_rate": "queues-and-autoscaling",
}


class Refused(ValueError):
    """A nomination that can't be made or confirmed; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def rows_digest(rows: DataFrame, levels: int = 3) -> str:
    """One digest of a table's rows in any order: digests of rows are hashed by prefix, and those digests again.

    The prefixes have two hex digits a level, so a task holds a share of 1 in 256 to the power of ``levels``; repeated rows count.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    level = rows.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n")).select(F.substring("h", 1, 2 * levels).alias("p"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("h"))
    for depth in range(levels, 0, -1):
        done = level.groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("d"))
        level = done.select(F.substring("p", 1, 2 * depth - 2).alias("p"), F.concat_ws(":", "p", "d").alias("h"))
    parts = sorted(r["h"] for r in level.collect())  # 256 at most
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def _plain(row) -> dict:
    return {k: (float(v) if hasattr(v, "is_integer") or hasattr(v, "as_tuple") else v) for k, v in row.asDict().items()}


def _evaluated(metrics: DataFrame, gated: DataFrame) -> tuple[dict, dict]:
    rows = metrics.limit(CANDIDATES + 1).collect()
    if len(rows) > CANDIDATES:
        raise Refused("too-many-candidates")
    gates: dict[str, list] = {}
    for r in gated.limit(CANDIDATES * GATES).collect():
        gates.setdefault(r["policy"], []).append(_plain(r))
    return {r["policy"]: _plain(r) for r in rows}, {p: sorted(g, key=lambda x: x["place"]) for p, g in gates.items()}


def _frontier(metrics: dict, higher: list[str], lower: list[str]) -> list[str]:
    def beaten(m, o):
        least = all(o[g] >= m[g] for g in higher) and all(o[g] <= m[g] for g in lower)
        return least and (any(o[g] > m[g] for g in higher) or any(o[g] < m[g] for g in lower))

    return sorted(p for p, m in metrics.items() if not any(beaten(m, o) for o in metrics.values()))


def sealed(body: dict, key: bytes | None) -> dict:
    """``body`` with its own digest and, where there is a key, an HMAC over both."""
    whole = {**body, "self_digest": canonical.domain_digest(DOMAIN, body)}
    if key is None:
        return whole
    return {**whole, "attestation": hmac.new(key, canonical.encode(whole).encode(), hashlib.sha256).hexdigest()}


def unsealed(artifact: dict, key: bytes | None) -> dict:
    """The artifact's body; a changed body, or a missing or wrong attestation where there is a key, is refused."""
    whole = {k: v for k, v in artifact.items() if k != "attestation"}
    body = {k: v for k, v in whole.items() if k != "self_digest"}
    if key is not None:
        want = hmac.new(key, canonical.encode(whole).encode(), hashlib.sha256).hexdigest()
        if not hmac.compare_digest(want, str(artifact.get("attestation", ""))):
            raise Refused("attestation")
    if canonical.domain_digest(DOMAIN, body) != whole.get("self_digest"):
        raise Refused("self-digest")
    return body


def nominate(policies: dict[str, dict], metrics: DataFrame, gated: DataFrame, goals: tuple[list[str], list[str]], expert: str, spec: dict, rows: DataFrame, group: str, evaluator: dict, synthetic: bool, key: bytes | None = None) -> dict:
    """{status, frontier, evaluations, nomination}: the passing policy on the frontier of least cost, then p95 latency, then name.

    ``policies`` are the bodies by name, ``metrics`` and ``gated`` what ``replay`` makes of the development ``rows``.
    """
    measured, gates = _evaluated(metrics, gated)
    candidates = {p: m for p, m in measured.items() if p != expert and p in policies}
    passing = {p: m for p, m in candidates.items() if gates.get(p) and all(g["pass"] for g in gates[p])}
    frontier = _frontier(passing, *goals)
    evaluations = {p: {"metrics": candidates[p], "gates": gates.get(p, [])} for p in sorted(candidates)}
    if not frontier:
        return {"status": "NO_CANDIDATE", "frontier": [], "evaluations": evaluations, "nomination": None}
    chosen = min(frontier, key=lambda p: (passing[p]["cost_per_request"], passing[p]["p95_e2e"], p.encode("utf-16-be")))
    body = {
        "spec_digest": canonical.domain_digest("evenkeel/spec/1", spec),
        "development_digest": rows_digest(rows),
        "groups_digest": rows_digest(rows.select(group).distinct()),
        "evaluator": evaluator,
        "development_synthetic": synthetic,
        "policy": policies[chosen],
        "policy_id": chosen,
        "policy_digest": canonical.domain_digest("evenkeel/policy/1", policies[chosen]),
        "metrics": passing[chosen],
        "expert_metrics": measured.get(expert),
        "gates": gates[chosen],
        "decision_digest": canonical.domain_digest("evenkeel/decision/1", {"evaluations": evaluations, "frontier": frontier, "chosen": chosen}),
    }
    return {"status": "NOMINATED", "frontier": frontier, "evaluations": evaluations, "nomination": sealed(body, key)}


def confirm(artifact: dict, policies: dict[str, dict], gated: DataFrame, spec: dict, development_groups: DataFrame, holdout: DataFrame, group: str, evaluator: dict, synthetic: bool, key: bytes | None = None) -> dict:
    """The confirmation of a nomination on holdout rows: HOLD or DEMO_ONLY, never more, and why.

    Refused: another spec, an edited or unregistered policy, another evaluator, other development groups than the artifact's, and
    groups that stand in both.  ``gated`` holds the gates of the holdout rows.
    """
    body = unsealed(artifact, key)
    if body["spec_digest"] != canonical.domain_digest("evenkeel/spec/1", spec):
        raise Refused("spec-digest")
    if body["policy_digest"] != canonical.domain_digest("evenkeel/policy/1", body["policy"]):
        raise Refused("policy-digest")
    if policies.get(body["policy_id"]) != body["policy"]:
        raise Refused("policy-drift")
    if body["evaluator"] != evaluator:
        raise Refused("evaluator-drift")
    known = development_groups.select(group).distinct()
    if rows_digest(known) != body["groups_digest"]:
        raise Refused("development-groups")
    leaked = holdout.select(group).distinct().join(known, group, "left_semi").orderBy(group).limit(NAMED).collect()
    if leaked:
        raise Refused("group-leakage", ", ".join(str(r[0]) for r in leaked))
    gates = sorted((_plain(r) for r in gated.where(F.col("policy") == body["policy_id"]).limit(GATES + 1).collect()), key=lambda g: g["place"])
    failed = [g["gate"] for g in gates if not g["pass"]]
    shown = synthetic or body["development_synthetic"]
    if not gates or failed:
        status, reason = "HOLD", "failed: " + ", ".join(failed) if failed else "no-evaluation"
    else:
        status, reason = ("DEMO_ONLY", "synthetic-evidence") if shown else ("HOLD", "registered-protocol-required")
    result = {"status": status, "reason": reason, "policy_id": body["policy_id"], "nomination_digest": artifact["self_digest"], "holdout_digest": rows_digest(holdout), "gates": gates, "attestation_verified": key is not None}
    return {**result, "decision_digest": canonical.domain_digest("evenkeel/confirmation/1", result)}


def next_experiment(rejected: DataFrame, repeated_prefixes: bool, long_inputs: bool) -> DataFrame:
    """``rejected`` (policy, dominant_gate) with ``technique``: what to try next.  What a slow first token asks for hangs on the
    workload: whether prompts share prefixes and whether inputs reach a registered length."""
    gate = F.col("dominant_gate")
    first = {(True, True): "prefix-caching-and-chunked-prefill", (True, False): "prefix-caching", (False, True): "chunked-prefill", (False, False): "profile-prefill-and-queue"}[(repeated_prefixes, long_inputs)]
    known = F.create_map(*[F.lit(x) for pair in TECHNIQUES.items() for x in pair])
    technique = F.when(gate.startswith("slice_") & ~gate.startswith("slice_groups"), "calibrate-routing").when(gate == "p95_ttft", first).otherwise(F.coalesce(F.try_element_at(known, gate), F.lit("replicate")))
    return rejected.withColumn("technique", technique)
