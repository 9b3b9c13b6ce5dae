"""Quantiles by value ranges, bundles and the evidence join, on small made tables."""

import hashlib
import json
import random
import statistics

import pytest

from evenkeel.functions import stats
from evenkeel.operators import assessment, join


def test_quantiles_by_ranges(spark):
    """Against plain sorting: negative values, zeros, ties, weights of zero, and values of all magnitudes."""
    rng = random.Random(4)
    rows = [("a", rng.choice([-1, 1]) * 10.0 ** rng.randint(-12, 12) * rng.random(), rng.randint(0, 5)) for _ in range(400)]
    rows += [("a", 0.0, 3), ("a", 0.0, 2), ("b", 7.0, 1), (None, -2.5, 2), (None, 4.0, 2)]
    ps = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "most": 1.0}
    df = spark.createDataFrame(rows, "k string, v double, w bigint")
    got = {r.k: r for r in stats.weighted_quantiles(df, ["k"], "v", "w", ps).collect()}
    for k in ("a", "b", None):
        own = sorted((v, w) for key, v, w in rows if key == k)
        whole = sum(w for _, w in own)
        for name, p in ps.items():
            upto, want = 0, None
            for v, w in own:
                upto += w
                last = max(i for i, x in enumerate(own) if x[0] == v)
                if sum(w for _, w in own[: last + 1]) >= p * whole:
                    want = v
                    break
            assert got[k][name] == want, (k, name)
    plain = [v for k, v, _ in rows if k == "a"]
    r7 = stats.r7_quantiles(df.where("k = 'a'"), ["k"], "v", {"q1": 0.25, "q2": 0.5}).first()
    q = statistics.quantiles(plain, n=4, method="inclusive")
    assert r7.q1 == pytest.approx(q[0]) and r7.q2 == pytest.approx(q[1])


PROTOCOL = assessment.Protocol("expert", ["small", "tiny"], [("less-than", 0.3), ("greater-than-or-equal", 0.9)], -0.1, 0.5, 0.5, 1e6, 1e6, 1e6, 0.5, 1, 0)


def test_bundles():
    found = assessment.enumerate_bundles(PROTOCOL)
    assert len(found) == 6 and [b["policy"] for b in found] == sorted(b["policy"] for b in found)
    for b in found:
        own = {k: v for k, v in b.items() if k != "policy"}
        text = json.dumps({"domain": PROTOCOL.domain, "value": own}, sort_keys=True, separators=(",", ":"))
        assert b["policy"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        assessment.require_member(PROTOCOL, b)
    with pytest.raises(ValueError):
        assessment.require_member(PROTOCOL, found[0] | {"threshold": 0.4})


def test_replay_of_two_primaries(spark):
    """A true predicate runs the expert alone, a failing primary adds it; missing sides and signals are problems; a second execution is an error."""
    row = lambda case, profile, status, signal, score, cost: (case, 1, profile, 1, 2.0, ["s"], status, "scored" if status == "success" else "failure", score, signal, 10.0, 20.0, cost, 0, 0)
    rows = [row(c, "expert", "success", None, 1.0, 5.0) for c in (1, 2, 3, 4)]
    rows += [row(1, "small", "success", 0.2, 0.5, 1.0), row(2, "small", "failure", 0.5, None, 1.0), row(3, "small", "success", None, 0.5, None), row(5, "small", "success", 0.5, 0.4, 1.0), row(4, "tiny", "success", 0.95, 0.1, 1.0)]
    kind = "case_id int, replicate int, profile string, group_id int, weight double, slices array<string>, status string, outcome string, score double, signal double, ttft double, e2e double, cost double, ttft_class int, cost_class int"
    executions = spark.createDataFrame(rows, kind)
    bundles = [b for b in assessment.enumerate_bundles(PROTOCOL) if b["primary"] == "small"]
    table = spark.createDataFrame([tuple(b[k] for k in ("policy", "kind", "operator", "threshold", "primary")) for b in bundles], "policy string, kind string, operator string, threshold double, primary string")
    got = assessment.replay(assessment.side_by_side(executions, ["small"], "expert"), table).collect()
    name = {b["policy"]: (b["kind"], b["operator"]) for b in bundles}
    by = {(*name[r.policy], r.case_id): r for r in got}
    low, high, fast = ("cascade", "less-than"), ("cascade", "greater-than-or-equal"), ("fast-only", None)
    assert (by[(*low, 1)].by_expert, by[(*low, 1)].serial, by[(*low, 1)].cost) == (True, False, 5.0)
    assert (by[(*high, 1)].by_expert, by[(*high, 1)].score) == (False, 0.5)
    assert (by[(*low, 2)].serial, by[(*low, 2)].cost, by[(*low, 2)].e2e, by[(*low, 2)].ttft) == (True, 6.0, 40.0, 30.0)
    assert (by[(*fast, 2)].failed, by[(*fast, 2)].score) == (True, 0.0)
    assert by[(*low, 3)].problem == "missing-route-signal" and by[(*fast, 3)].problem is None and by[(*fast, 3)].cost_class == assessment.UNAVAILABLE
    assert {by[(*b, c)].problem for b in (low, high, fast) for c in (4, 5)} == {"missing-required-profile"}
    twice = executions.unionByName(executions.where("case_id = 1 and profile = 'small'"))
    with pytest.raises(Exception, match="two executions"):
        assessment.side_by_side(twice, ["small"], "expert").collect()
    empty = assessment.assess(executions.limit(0), PROTOCOL, assessment.enumerate_bundles(PROTOCOL), "development", 100).collect()
    assert len(empty) == 7 and {(r.status, r.decision) for r in empty} == {("INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE")}


def test_evidence_of_two_contexts_is_rejected(spark):
    ex = spark.createDataFrame([(i, 1, "p", 9, i, f"d{i}", "s", "success", "completed", 5) for i in (1, 2, 3)], "case_id int, replicate int, profile string, output int, trace_id int, digest string, study string, status string, dispatch string, completed_at int")
    kind = "case_id int, replicate int, profile string, output int, digest string, study string, verification string, pinned boolean, drifted boolean, context string, kind string, score double, produced_at int"
    one = [(1, 1, "p", 9, "a", "s", "trusted", True, False, "c1", "scored", 0.5, 6), (2, 1, "p", 9, "b", "other", "trusted", True, False, "c1", "scored", 0.5, 6), (3, 1, "p", 9, "c", "s", "revoked", True, False, "c2", "scored", 0.5, 6)]
    said = lambda rows: {r.case_id: (r.outcome, r.detail, r.score) for r in join.join(ex, spark.createDataFrame(rows, kind), ["study"]).collect()}
    assert said(one) == {1: ("scored", "", 0.5), 2: ("conflicting", "lineage", None), 3: ("invalid", "verification-revoked", None)}
    two = [one[0], (*one[1][:5], "s", *one[1][6:9], "c2", *one[1][10:])]
    assert {v[:2] for c, v in said(two).items() if c < 3} == {("invalid", "verification-context-drift")} and said(two)[3][0] == "missing"


def test_evidence_join_is_one_shuffle(spark):
    """Executions and evidence meet in one shuffle, not in joins of their own groupings; hand-made cases of everything that meets there."""
    ex_kind = "case_id int, replicate int, profile string, output int, trace_id int, digest string, study string, status string, dispatch string, completed_at int"
    ev_kind = "case_id int, replicate int, profile string, output int, digest string, study string, verification string, pinned boolean, drifted boolean, context string, kind string, score double, produced_at int"
    run = lambda case, output=9, trace=1, digest="d", status="success", profile="p": (case, 1, profile, output, trace, digest, "s", status, "completed", 5)
    told = lambda case, output=9, digest="e", verification="trusted", at=6: (case, 1, "p", output, digest, "s", verification, True, False, "c", "scored", 0.5, at)
    runs = [run(1), run(1), run(2), run(2, digest="other"), run(3), run(3, output=8, trace=2), run(4, output=None, status="failed"), run(5, output=None), run(6), run(7), run(None), run(8), run(8, profile=None)]
    said = [told(1), told(1), told(2), told(3), told(4, output=7), told(5, output=None), told(6), told(6, digest="f"), told(7, digest="z", verification="stale"), told(7, digest="a", verification="revoked"), told(7, output=3, verification="stale"), told(None), told(8, output=1), told(8, at=4), told(9)]
    executions, evidence = spark.createDataFrame(runs, ex_kind), spark.createDataFrame(said, ev_kind)
    out = join.join(executions, evidence, ["study"])
    got = {(r.case_id, r.output): (r.outcome, r.detail, r.score, r.duplicate_traces, r.duplicate_evidence) for r in out.collect()}
    assert got == {
        (1, 9): ("scored", "", 0.5, True, True), (2, 9): ("orphan", "no-matching-trace", None, False, False), (3, 9): ("orphan", "no-matching-trace", None, False, False), (4, None): ("failure", "", 0.0, False, False),
        (4, 7): ("orphan", "evidence-for-failed-execution", None, False, False), (5, None): ("scored", "", 0.5, False, False), (6, 9): ("conflicting", "different-evidence", None, False, False), (7, 9): ("invalid", "verification-revoked", None, False, False),
        (None, 9): ("orphan", "no-matching-trace", None, False, False), (8, 1): ("orphan", "terminal-output-mismatch", None, False, False), (8, 9): ("invalid", "evidence-predates-completion", None, False, False), (9, 9): ("orphan", "no-matching-trace", None, False, False),
    }
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" not in plan
    counted = {r.what: r.n for r in join.counts(executions, evidence, ["study"]).collect()}
    assert counted == {"trace-rows": 13, "accepted": 6, "conflicting-traces": 3, "joined": 6, "scored": 2, "matched": 3, "orphan-evaluator-evidence": 6, "duplicate-traces": 1, "duplicate-evaluator-evidence": 1, "conflicting-evaluator-evidence": 1, "cases": 6, "case-replicates": 6}


def test_assessment_keeps_no_replayed_rows(spark, monkeypatch):
    """What is cut off and kept grows with bundles and groups, not with pairs, and metrics spread no row out for each distinct count."""
    kept, cut = [], assessment.cut
    monkeypatch.setattr(assessment, "cut", lambda rows: kept.append(rows.count()) or cut(rows))
    row = lambda case, profile, score: (case, 1, profile, case % 3, 2.0, ["s"], "success", "scored", score, 0.5, 10.0, 20.0, 1.0, 0, 0)
    kind = "case_id int, replicate int, profile string, group_id int, weight double, slices array<string>, status string, outcome string, score double, signal double, ttft double, e2e double, cost double, ttft_class int, cost_class int"
    executions = spark.createDataFrame([row(c, p, s) for c in range(60) for p, s in (("expert", 1.0), ("small", 0.9), ("tiny", 0.5))], kind)
    bundles = assessment.enumerate_bundles(PROTOCOL)
    out = assessment.assess(executions, PROTOCOL, bundles, "development", 100)
    assert sum(kept) <= 3 * (len(bundles) + 1)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.policy: (r.cases, r.groups, r.replicates, r.status, round(r.mean_score, 9), round(r.estimate, 9)) for r in out.collect()}
    primary = {b["policy"]: b for b in bundles}
    for policy, found in got.items():
        score = {"small": 0.9, "tiny": 0.5}[primary[policy]["primary"]] if policy in primary else 1.0
        assert found == (60, 3, 60, "HOLD" if policy in primary and primary[policy]["primary"] == "tiny" else "PASS", score, round(score - 1.0, 9))
