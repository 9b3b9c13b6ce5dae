"""Queries do the whole job: no subset of the ids, no subset of the gates."""

import json
import random

from pyspark.sql import functions as F

from evenkeel.functions import sampling
from evenkeel.operators import replay
from evenkeel.plans import catalog, control
from evenkeel.sources import providers

SF = "/root/testdata/sf0.01"  # the smallest tables with ids of 40 and more


def test_streams_of_all_events_are_decoded(spark):
    ids = sorted(r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect())
    parsed = catalog.sse_parse(spark, SF).collect()
    assert sorted(r.stream for r in parsed if r.place == 0) == ids == sorted(r.stream for r in parsed if r.place == 1)
    assert len(parsed) == 2 * len(ids)
    ends = {r.event_id: (r.terminal, r.final_usage) for r in control.stream_ends(spark, SF).collect()}
    assert sorted(ends) == ids
    for i, (terminal, usage) in ends.items():
        assert terminal == ("provider-error" if i % 10 == 0 else "truncated" if i % 7 == 0 else "done-sentinel")
        assert usage == ("present" if i % 10 and i % 7 and i % 3 else "missing")


def test_all_gates_of_all_policies_decide(spark):
    small = "/root/testdata/sf0.001"
    rows = catalog.gates_v1(spark, small).collect()
    gates = {name for name, _, _ in [*catalog.PAIRED, *catalog.LIMITS, *catalog.DEVELOPMENT]}
    by = {}
    for r in rows:
        by.setdefault(r.policy, {})[r.gate] = r
    assert len(by) == 6 and len(gates) == 12 and all(set(g) == gates for g in by.values())
    boot = {r.policy: r for r in catalog.grouped_bootstrap(spark, small).collect()}
    better = {r.policy: r.improvement for r in catalog.cost_improvement(spark, small).collect()}
    assert set(boot) == set(by) - {"expert-only"} == {r.policy for r in catalog.case_effects(spark, small).select("policy").distinct().collect()}
    for policy, g in by.items():
        assert g["cost_improvement"].actual == better[policy]
        assert policy not in boot and not g["paired_quality"]["pass"] or abs(g["paired_quality"].actual - boot[policy].lo) < 1e-6 and g["independent_groups"].actual == boot[policy].groups
    passing = {p for p, g in by.items() if all(r["pass"] for r in g.values())}
    chosen = {r.policy for r in catalog.select_policy(spark, small).collect()}
    assert chosen <= passing and bool(chosen) == bool(passing)


def test_select_policy_finds_what_passes_all(spark, monkeypatch):
    wide = lambda gates: [(m, op, t if m == "p50_total_tps" else -1e9 if op == ">=" else 1e9) for m, op, t in gates]
    for name in ("PAIRED", "LIMITS", "DEVELOPMENT"):
        monkeypatch.setattr(catalog, name, wide(getattr(catalog, name)))
    got = catalog.select_policy(spark, "/root/testdata/sf0.001").collect()
    costs = {r.policy: r.cost_per_request for r in catalog.policy_metrics_v1(spark, "/root/testdata/sf0.001").collect() if r.policy != "expert-only"}
    assert len(got) == 1 and got[0].cost_per_request == min(costs.values())


def test_effects_of_cases_are_those_of_replayed_rows(spark):
    """Policies applied to gathered cases, without a join, give what joining replayed rows with the control gives."""
    rng, rows = random.Random(3), []
    for i in range(120):
        for r in range(rng.randint(1, 4)):
            rows.append((i, r, i % 7, 1.0 + i % 3, rng.choice(["1-URGENT", "5-LOW", None]), rng.choice([10, 600, 2000, None]), rng.choice(["success", "failure"]), rng.choice([0.5, 0.9, None]), rng.choice([None, 0.1, 0.5, 0.7]), rng.choice(["success", "success", "failure"]), rng.choice([0.4, 1.0])))
    names = "case_id bigint, replicate bigint, group_id bigint, weight double, slice string, input_tokens bigint, p_status string, p_score double, p_confidence double, e_status string, e_score double"
    pairs = spark.createDataFrame(rows, names).withColumns({f"{k}_{m}": F.lit(1.0) for k in "pe" for m in ("ttft", "e2e", "tps", "cost")})
    policies = replay.enumerate_policies(spark, [0.3, 0.6], [500, 1500])
    scale = lambda x: F.round(x * 10000)
    want = replay.case_effects(replay.replay(pairs, policies, ["1-URGENT"]), "expert-only", scale)
    got = replay.paired_effects(pairs, policies, ["1-URGENT"], scale)
    key = lambda rows: sorted(tuple(map(repr, (r.policy, r.case_id, r.group_id, r.weight, r.effect))) for r in rows.collect())
    assert key(got) == key(want)
    assert "Join" not in got.select("effect")._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "").replace("Join Inner", "") and got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_buckets_work_a_digest_out_once(spark):
    odd = spark.createDataFrame([("plain",), ('quote " and \\ and \n \x01 é/',), ("",)], "g string")
    said = {r.g: r.j for r in odd.select("g", sampling.canonical_strings({"groupId": F.col("g")}).alias("j")).collect()}
    assert {g: json.loads(j)["groupId"] for g, j in said.items()} == {g: g for g in said}
    kept = odd.where(sampling.group_bucket("d", "a", "s", F.col("g"), 10) < 5)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1


def test_each_path_of_a_response_is_parsed_once(spark):
    body = '{"choices":[{"finish_reason":"length"}],"usage":{"prompt_tokens":2,"completion_tokens":3,"total_tokens":5}}'
    got = providers.usage(spark.createDataFrame([(1, body), (2, "{}")], "k bigint, body string"), "body", "openai-chat")
    assert got.columns == ["k", "body", "finish", "usage_state", "input_tokens", "output_tokens", "total_tokens"]
    assert {r.k: (r.usage_state, r.total_tokens, r.finish) for r in got.collect()} == {1: ("valid", 5, "length"), 2: ("missing", None, None)}
    plan = got.groupBy("finish", "usage_state").agg(F.sum("input_tokens"), F.sum("total_tokens"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(") == 7
