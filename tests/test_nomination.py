"""Nomination, confirmation and what they refuse."""

import pytest

from evenkeel.operators import nomination

METRICS = "policy string, cost_per_request double, p95_e2e double, mean_score double"
GATED = "policy string, place int, gate string, actual double, op string, threshold double, pass boolean"
BODIES = {"a": {"kind": "cascade", "c": 0.5}, "b": {"kind": "cascade", "c": 0.25}, "c": {"kind": "fast-only"}}
GOALS = (["mean_score"], ["cost_per_request", "p95_e2e"])
SPEC, EVALUATOR, KEY = {"gates": ["g"]}, {"id": "e", "validated": True}, b"k" * 32


def gates(spark, **passed):
    return spark.createDataFrame([(p, 0, "g", 1.0, ">=", 0.5, ok) for p, ok in passed.items()], GATED)


def rows(spark, *groups):
    return spark.createDataFrame([(g, float(i), None) for i, g in enumerate(groups)], "group_id string, score double, note string")


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame([("a", 2.0, 5.0, 0.5), ("b", 2.0, 4.0, 0.5), ("c", 1.0, 1.0, 0.1), ("x", 9.0, 9.0, 0.9)], METRICS)


@pytest.fixture(scope="module")
def found(spark, metrics):
    return nomination.nominate(BODIES, metrics, gates(spark, a=True, b=True, c=False, x=True), GOALS, "x", SPEC, rows(spark, "g1", "g2", "g2"), "group_id", EVALUATOR, False, KEY)


def confirm(spark, artifact, **changes):
    given = dict(policies=BODIES, gated=gates(spark, b=True), spec=SPEC, development_groups=rows(spark, "g2", "g1"), holdout=rows(spark, "g3"), group="group_id", evaluator=EVALUATOR, synthetic=False, key=KEY)
    return nomination.confirm(artifact, **{**given, **changes})


def test_choice(spark, metrics, found):
    assert (found["status"], found["frontier"], found["nomination"]["policy_id"]) == ("NOMINATED", ["b"], "b")  # the expert is no candidate
    none = nomination.nominate(BODIES, metrics, gates(spark, a=False, b=False, c=False), GOALS, "x", SPEC, rows(spark), "group_id", EVALUATOR, False)
    assert (none["status"], none["frontier"], none["nomination"]) == ("NO_CANDIDATE", [], None)
    assert nomination.nominate(BODIES, metrics.limit(0), gates(spark, a=True), GOALS, "x", SPEC, rows(spark), "group_id", EVALUATOR, False)["status"] == "NO_CANDIDATE"


def test_outcomes(spark, found):
    artifact = found["nomination"]
    assert [confirm(spark, artifact)[k] for k in ("status", "reason")] == ["HOLD", "registered-protocol-required"]
    assert confirm(spark, artifact, synthetic=True)["status"] == "DEMO_ONLY"
    failed = confirm(spark, artifact, gated=gates(spark, a=True, b=False), synthetic=True)
    assert (failed["status"], failed["reason"]) == ("HOLD", "failed: g")
    assert confirm(spark, artifact, gated=gates(spark, a=True))["reason"] == "no-evaluation"


def test_refusals(spark, found):
    artifact = found["nomination"]
    edited = {**artifact, "policy": {"kind": "cascade", "c": 0.1}}
    resealed = nomination.sealed({k: v for k, v in edited.items() if k not in ("self_digest", "attestation")}, KEY)
    cases = [
        ("attestation", edited, {}),
        ("attestation", {k: v for k, v in artifact.items() if k != "attestation"}, {}),
        ("attestation", artifact, {"key": b"other"}),
        ("self-digest", edited, {"key": None}),
        ("policy-digest", resealed, {}),
        ("spec-digest", artifact, {"spec": {}}),
        ("policy-drift", artifact, {"policies": {**BODIES, "b": {"kind": "fast-only"}}}),
        ("evaluator-drift", artifact, {"evaluator": {**EVALUATOR, "validated": False}}),
        ("development-groups", artifact, {"development_groups": rows(spark, "g1")}),
        ("group-leakage", artifact, {"holdout": rows(spark, "g3", "g2")}),
    ]
    for code, given, changes in cases:
        with pytest.raises(nomination.Refused) as refused:
            confirm(spark, given, **changes)
        assert refused.value.code == code


def test_rows_digest_knows_rows_not_their_order(spark):
    one = rows(spark, "a", "b", "c")
    first = nomination.rows_digest(one)
    assert first == nomination.rows_digest(one.repartition(7).select("note", "score", "group_id"))
    assert len({first, nomination.rows_digest(one.union(one)), nomination.rows_digest(one.limit(0)), nomination.rows_digest(rows(spark, "a", "b", None))}) == 4


def test_next_experiment(spark):
    rejected = spark.createDataFrame([("a", "p95_ttft"), ("b", "slice_0"), ("c", "slice_groups_0"), ("d", None), ("e", "error_rate")], "policy string, dominant_gate string")
    tried = lambda *x: [r["technique"] for r in nomination.next_experiment(rejected, *x).orderBy("policy").collect()]
    assert tried(True, True) == ["prefix-caching-and-chunked-prefill", "calibrate-routing", "replicate", "replicate", "queues-and-autoscaling"]
    assert [tried(a, b)[0] for a, b in ((True, False), (False, True), (False, False))] == ["prefix-caching", "chunked-prefill", "profile-prefill-and-queue"]
