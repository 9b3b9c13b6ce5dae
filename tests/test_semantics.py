"""Rules of records on rows that the queries' tables do not hold: nulls, empty lists, single attempts."""

import pytest
from pyspark.sql import Row, functions as F

from evenkeel.operators import semantics

TRIES = "array<struct<attempt_id:string,number:bigint,started_at:bigint,headers_at:bigint,first_byte_at:bigint,first_token_at:bigint,completed_at:bigint,status:string,dispatch:string,failure:string,abort:string,partial:boolean,finish:string,model:string>>"
TRACE = f"split string, source_mode string, window_id string, membership_digest string, profile string, selected_profile string, receipts array<string>, slices array<string>, signal_at bigint, intent_at bigint, terminal_output string, attempts {TRIES}"
WON = ("a", 1, 10, None, 12, 15, 20, "success", "completed", None, "not-aborted", False, "stop", "m")


def trace(**changes):
    whole = dict(split="holdout", source_mode="recorded", window_id=None, membership_digest=None, profile="p", selected_profile="p", receipts=None, slices=["x"], signal_at=None, intent_at=5, terminal_output="o", attempts=[WON])
    return tuple({**whole, **changes}.values())


def tried(**changes):
    names = ["attempt_id", "number", *semantics.TIMES, "status", "dispatch", "failure", "abort", "partial", "finish", "model"]
    return tuple({**dict(zip(names, WON)), **changes}.values())


CASES = [
    ({}, []),
    ({"attempts": None, "terminal_output": None}, ["no-attempts"]),
    ({"attempts": [], "terminal_output": None}, ["no-attempts"]),
    ({"slices": None, "receipts": None}, []),
    ({"selected_profile": None}, ["profile-not-selected"]),
    ({"receipts": ["b", "a", "b"], "source_mode": "shadow"}, ["receipt-repeated", "receipts-unsorted"]),
    ({"attempts": [tried(number=None)]}, ["number-gap"]),
    ({"attempts": [tried(first_byte_at=16)]}, ["time-order"]),
    ({"attempts": [tried(), tried(attempt_id="b", number=2, started_at=19)]}, ["time-order", "retry-overlaps", "success-not-last"]),
    ({"attempts": [tried(status="aborted")], "terminal_output": None}, ["failure-without-category", "abort-unexplained"]),
    ({"intent_at": 11}, ["intent-after-start"]),
    ({"signal_at": 6}, ["signal-after-intent"]),
    ({"split": "online"}, ["online-without-window"]),
]


def test_traces(spark):
    rows = spark.createDataFrame([(i, *trace(**c)) for i, (c, _) in enumerate(CASES)], f"i int, {TRACE}")
    got = {r.i: r.faults for r in rows.select("i", semantics.trace_faults().alias("faults")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]
    assert rows.limit(0).select(semantics.trace_faults()).collect() == []


def test_outcomes(spark):
    rows = [("abstained", None, None, None, None), ("scored", 0.5, 0.0, 1.0, []), ("scored", 1.5, 0.0, 1.0, None), ("scored", 0.5, 0.0, 2.0, [("a", 3.0, 1.0, 1.0), ("a", 1.0, 0.0, 1.0)])]
    df = spark.createDataFrame(rows, "kind string, score double, lo double, hi double, subscores array<struct<id:string,score:double,lo:double,hi:double>>")
    assert [r[0] for r in df.select(semantics.outcome_faults()).collect()] == [[], [], ["score-out-of-range"], ["range-not-unit", "subscore-repeated", "subscore-out-of-range"]]


def test_rollup(spark):
    kind = "attempts array<struct<started_at:bigint,first_token_at:bigint,completed_at:bigint,status:string,cost_kind:string,cost:double>>"
    rows = [([(0, None, 10, "failure", "measured", 1.0), (20, 25, 40, "success", "modeled", 2.0)],), ([(0, 5, 10, "failure", "measured", 1.0)],), ([(0, 5, 10, "success", "unavailable", None)],)]
    got = [tuple(r) for r in spark.createDataFrame(rows, kind).select(*semantics.execution_rollup()).collect()]
    assert got == [(25, "measured", 40, 3.0, "modeled"), (10, "modeled", 10, 1.0, "measured"), (5, "measured", 10, None, "unavailable")]
    with pytest.raises(Exception, match="ends before it starts"):
        spark.createDataFrame([([(9, None, 3, "failure", "measured", 1.0)],)], kind).select(*semantics.execution_rollup()).collect()


def test_admission_without_cost_model(spark):
    kind = "study string, protocol_digest string, profile string, execution_digest string, split string, group_split string, signal struct<id:string,version:string,calibration:string,value:double,observed_at:bigint>, attempts array<struct<started_at:bigint,completed_at:bigint,cost_kind:string,cost_model:string,requested:string,requested_revision:string,resolved:string,resolved_source:string,resolved_revision:string>>"
    attempt = (10, 20, "modeled", "c", "m", "r", None, None, None)
    rows = spark.createDataFrame([("s", "d", "p", "e", "online", None, None, [attempt]), (None, "d", "q", "e", "holdout", "holdout", None, [attempt])], kind)
    profiles = spark.createDataFrame([Row(profile="p", profile_digest="e", model="m", revision="r")])
    protocol = {"study": "s", "digest": "d", "created_at": 0, "expires_at": 20, "cost_model": None, "signal": {"id": "x", "version": "1", "calibration": "c", "lo": 0.0, "hi": 1.0}}
    got = {r.profile: r.faults for r in semantics.admission(rows, protocol, profiles).collect()}
    assert got == {"p": ["outside-validity", "modeled-cost-not-allowed"], "q": ["study", "outside-validity", "profile-missing", "modeled-cost-not-allowed"]}
    assert semantics.admission(rows.limit(0), protocol, profiles.limit(0)).count() == 0


def test_measurements(spark):
    kind = "case_id string, slices array<string>, profiles array<string>, judge boolean, validated boolean"
    rows = [("a", ["x", "x"], ["p"], False, False), ("a", ["x"], ["p", "p"], None, False), ("b", [], None, True, False), ("c", None, [], True, True)]
    got = {r.case_id: (r.rows, r.faults) for r in semantics.measurement_faults(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": (2, ["case-repeated", "profile-repeated", "slice-repeated"]), "b": (1, ["judge-not-validated"])}


def test_window_null_time(spark):
    window = {"protocol_digest": "p", "policy_digest": "q", "window_id": "w", "membership_digest": "m", "start": 1, "end": 5, "watermark": 6, "sample": 10}
    row = spark.createDataFrame([("online", "p", "q", "w", "m", None, 3, 0), ("online", "p", "q", "w", "m", 2, 3, 10), ("online", "p", "q", "w", "m", 2, 3, 9)], "split string, protocol_digest string, policy_digest string, window_id string, membership_digest string, event_at int, completed_at int, bucket int")
    assert [r[0] for r in row.select(semantics.window_fault(window, F.col("bucket"))).collect()] == ["outside-interval", "not-sampled", None]
