"""Shadow plans and benchmark logs on rows that the queries' tables do not hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import manifests, shadow
from evenkeel.sources import benchlogs

POLICY = "struct<digest:string,issued_at:bigint,expires_at:bigint>"
RULE = manifests.RULE.simpleString()
KIND = (
    f"i int, snapshot struct<state:string,study:string,protocol:string,created_at:bigint,expires_at:bigint,policy:{POLICY},last_event_at:bigint,digest:string>, "
    f"protocol struct<study:string,digest:string,created_at:bigint,expires_at:bigint,rule:{RULE},profiles:array<struct<id:string,runtime:string,digest:string>>,"
    "endpoints:array<struct<alias:string,runtime:string,transport:string>>,max_executions:bigint,max_concurrency:bigint>, "
    f"policy {POLICY}, window struct<window_id:string,starts:bigint,ends:bigint,rule:{RULE},membership:string>, "
    f"targets {shadow.BODY_TYPE['targets'].dataType.simpleString()}, budget struct<profiles:bigint,executions:bigint,concurrency:bigint,wall:bigint>, "
    "snapshot_digest string, protocol_digest string, policy_digest string, issued_at bigint, expires_at bigint"
)
P = ("sp", 90, 900)
A, B = ("a", "e0", ["r0", "r1"], "da", "ra", "http"), ("b", "e1", [], "db", "rb", "stdio")


def plan(i, targets=(A, B), state="SHADOW_ASSESSING", selected=P, last=None, budget=(2, 10, 2, 100), window=(200, 300), issued=150, expires=400):
    protocol = ("s", "pd", 50, 1000, ("x", 10, "seed"), [("a", "ra", "da"), ("b", "rb", "db")], [("e0", "ra", "http"), ("e1", "rb", "stdio")], 10, 2)
    snapshot = (state, "s", "pd", 50, 1000, selected, last, "sd")
    return (i, snapshot, protocol, P, ("w", *window, ("x", 10, "seed"), None), None if targets is None else list(targets), budget, "sd", "pd", "sp", issued, expires)


CASES = [
    ({}, []),
    ({"targets": [B, A]}, ["targets-not-derived"]),
    ({"targets": [A]}, ["target-missing"]),
    ({"targets": []}, ["target-missing"]),
    ({"targets": None}, ["target-missing"]),
    ({"targets": [A, A, B], "budget": (3, 10, 2, 100)}, ["target-repeated"]),
    ({"targets": [("a", "e0", ["r1", "r0"], "da", "ra", "http"), B]}, ["targets-not-derived"]),
    ({"targets": [("a", "e0", ["r0", "r0"], "da", "ra", "http"), B]}, ["receipt-repeated"]),
    ({"targets": [("a", "e1", [], "da", "ra", None), B]}, ["target-endpoint"]),
    ({"targets": [A, B, (None, "e1", [], None, None, None)]}, ["target-of-unknown-profile", "targets-not-derived", "budget-profiles"]),
    ({"state": None}, ["not-shadow-assessing"]),
    ({"selected": None}, ["not-shadow-assessing", "snapshot-policy"]),
    ({"selected": ("sp", None, 900)}, ["snapshot-policy"]),
    ({"last": 151}, ["issued-before-snapshot"]),
    ({"last": 150}, []),
    ({"issued": 89, "budget": (2, 10, 2, 10)}, ["issued-before-policy"]),
    ({"window": (150, 400), "budget": (2, 10, 2, 250)}, []),
    ({"window": (149, 401), "budget": (2, 11, 3, 252)}, ["window-before-issue", "window-beyond-plan", "budget-executions", "budget-concurrency", "budget-beyond-plan"]),
    ({"window": (300, 300), "budget": (2, 10, 2, 0)}, ["window-empty"]),
    ({"budget": (2, 10, 2, 101)}, ["budget-beyond-window"]),
    ({"budget": None}, []),
]


def bound(rows):
    whole = rows.withColumn("window", F.col("window").withField("membership", manifests.membership_digest(F.col("window.window_id"), F.col("protocol.digest"), F.col("protocol.rule"))))
    return whole.withColumn("plan_digest", shadow.plan_digest())


def test_plans(spark):
    rows = bound(spark.createDataFrame([plan(i, **c) for i, (c, _) in enumerate(CASES)], KIND))
    got = {r.i: r.faults for r in shadow.shadow_plan_faults(rows).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]
    assert shadow.shadow_plan_faults(rows.limit(0)).collect() == []


def test_any_change_breaks_the_digest(spark):
    rows = bound(spark.createDataFrame([plan(0)], KIND))
    changes = {"targets": F.reverse("targets"), "budget": F.col("budget").withField("wall", F.lit(1).cast("bigint")), "issued_at": F.col("issued_at") + 1, "window": F.col("window").withField("ends", F.col("window.ends") - 1)}
    for c, value in changes.items():
        assert "plan-digest" in shadow.shadow_plan_faults(rows.withColumn(c, value)).first().faults
    assert set(shadow.shadow_plan_faults(rows.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])).first().faults) >= {"not-shadow-assessing", "plan-digest"}


def line(i, prompt="10.5", generation="2", memory="3.25", gap=" ", end=""):
    return f"Trial {i}:{gap}prompt_tps={prompt},{gap}generation_tps={generation},{gap}peak_memory={memory}{end}\n"


LOGS = [
    (line(1) + "noise\n" + line(2, "20"), 2, None),
    (line(1, gap="\n\t") + line(2)[:-1], None, None),
    (line(1) + line(2), 3, "trial-count"),
    (line(2) + line(1), 2, "trial-gap"),
    (line(1) + line(3), 2, "trial-gap"),
    (line(1, "1.2.3"), 2, "invalid-number"),
    (line(1, "."), 1, "invalid-number"),
    (line(1, "5.", ".5"), 1, None),
    (line(1, end=" GB"), None, "no-trials"),
    (line(1, end="\r"), 1, "no-trials"),
    (" " + line(1), None, "no-trials"),
    (line("99999999999999999999"), 1, "trial-gap"),
    ("", None, "no-trials"),
    (None, 0, "no-trials"),
    ("x " + line(1), None, "no-trials"),
]


def test_logs(spark):
    rows = spark.createDataFrame([(i, b, n) for i, (b, n, _) in enumerate(LOGS)], "i int, body string, expected int")
    got = {r.i: r for r in benchlogs.scan(rows, "body", F.col("expected")).collect()}
    assert [got[i].failure for i in range(len(LOGS))] == [want for _, _, want in LOGS]
    assert (got[0].prompt_median, got[0].prompt_p10, got[0].memory_max) == (15.25, pytest.approx(11.45), 3.25)
    assert got[2].prompt_median is None and len(got[2].trials) == 2
    assert benchlogs.scan(rows.limit(0), "body").collect() == []


def test_a_long_log_equals_a_plain_scan(spark):
    random.seed(3)
    values = [[round(random.uniform(0, 500), random.randrange(4)) for _ in range(3)] for _ in range(5000)]
    body = "".join(line(i, *map(str, v), gap=random.choice([" ", "\n", "  "])) + random.choice(["", "note\n"]) for i, v in enumerate(values, 1))
    row = benchlogs.scan(spark.createDataFrame([(body,)], "body string"), "body", F.lit(5000)).first()
    assert row.failure is None and [t.trial for t in row.trials] == list(range(1, 5001))
    assert [[t.prompt, t.generation, t.memory] for t in row.trials] == values
    for j, m in enumerate(benchlogs.MEASURES):
        ordered = sorted(v[j] for v in values)
        for name, p in benchlogs.QUANTILES.items():
            at = (len(ordered) - 1) * p
            low, high = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
            assert row[f"{m}_{name}"] == pytest.approx(low + (high - low) * (at - int(at)))
    assert len(re.findall("^Trial", body, re.M)) == len(row.trials)


def test_targets_are_matched_once_and_digests_written_at_once(spark):
    """Profiles and endpoints are looked through once a target, not for every rule; plan texts come of Spark's JSON writer."""
    rows = bound(spark.createDataFrame([plan(0)], KIND))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        said = shadow.shadow_plan_faults(rows)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert said.count("filter(") == 3  # profiles, endpoints, the codes
    assert "StructsToJson" in said or "to_json" in said
