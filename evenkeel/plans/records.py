"""Queries of what is wrong with traces, outcomes, protocols and measurements, with SQL that gives the same rows.

Orders stand for traces and their lineitems for attempts.  What the made-up fields hold is one SQL text for both engines;
the rules are expressions over arrays in Spark and plain joins, windows and comparisons in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import sampling
from ..operators import semantics, staleness
from ..sources import decoders
from . import catalog

_AT = "l_orderkey * 100000 + place * 1000"
ATTEMPT = {
    "attempt_id": "CAST(l_partkey % 40 AS STRING)",
    "number": "CASE WHEN l_suppkey % 41 = 0 THEN place + 1 ELSE place END",
    "started_at": _AT,
    "headers_at": f"CASE WHEN l_discount > 5e-3 THEN {_AT} + CAST(l_quantity AS BIGINT) END",
    "first_byte_at": f"CASE WHEN l_suppkey % 3 <> 0 THEN {_AT} + 45 END",
    "first_token_at": f"CASE WHEN l_tax > 15e-3 THEN {_AT} + 47 END",
    "completed_at": f"{_AT} + 100 + CASE WHEN l_partkey % 29 = 0 THEN 1500 ELSE 0 END",
    "status": "CASE WHEN l_returnflag = 'N' AND place = n THEN 'success' WHEN l_partkey % 31 = 0 THEN 'success' WHEN l_returnflag = 'A' THEN 'aborted' ELSE 'failure' END",
    "dispatch": "CASE WHEN l_suppkey % 19 = 0 THEN 'rejected' ELSE 'completed' END",
    "failure": "CASE WHEN l_returnflag <> 'N' AND l_suppkey % 23 <> 0 THEN 'timeout' WHEN place < n THEN 'provider' END",
    "abort": "CASE WHEN l_returnflag = 'A' AND l_suppkey % 7 <> 0 THEN 'confirmed' ELSE 'not-aborted' END",
    "partial": "l_suppkey % 37 = 0",
    "finish": "CASE WHEN l_linenumber <> 4 THEN 'stop' END",
    "model": "CASE WHEN l_suppkey % 43 <> 0 THEN 'm' END",
    "cost_kind": "CASE WHEN l_suppkey % 17 = 0 THEN 'unavailable' WHEN l_suppkey % 3 = 1 THEN 'modeled' WHEN l_suppkey % 3 = 2 THEN 'provider-reported' ELSE 'measured' END",
    "cost": "CASE WHEN l_suppkey % 17 <> 0 THEN CAST(round(l_extendedprice) AS DOUBLE) END",
    "cost_model": "CASE WHEN l_partkey % 83 = 0 THEN 'cost-0' ELSE 'cost-1' END",
    "requested": "CASE WHEN l_partkey % 89 = 0 THEN 'other' ELSE concat('m', CAST(o_custkey % 3 AS STRING)) END",
    "requested_revision": "'r1'",
    "resolved": "CASE WHEN l_partkey % 97 <> 0 THEN concat('m', CAST(o_custkey % 3 AS STRING)) END",
    "resolved_source": "CASE WHEN l_linenumber < 3 THEN 'provider-reported' ELSE 'declared' END",
    "resolved_revision": "CASE WHEN l_suppkey % 71 = 0 THEN 'r0' ELSE 'r1' END",
}
TRACE = {
    "split": "CASE o_custkey % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'holdout' ELSE 'online' END",
    "source_mode": "CASE WHEN o_orderkey % 4 = 0 THEN 'shadow' ELSE 'recorded' END",
    "window_id": "CASE WHEN o_custkey % 3 = 2 AND o_orderkey % 7 <> 0 THEN 'w' END",
    "membership_digest": "CASE WHEN o_custkey % 3 = 2 OR o_orderkey % 13 = 0 THEN 'd' END",
    "profile": "concat('p', CAST(o_custkey % 27 AS STRING))",
    "selected_profile": "CASE WHEN o_custkey % 29 <> 0 THEN concat('p', CAST(o_custkey % 27 AS STRING)) END",
    "bound": "o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 OR o_orderkey % 11 = 0",
    "r1": "concat('a', CAST(o_custkey % 10 AS STRING))",
    "r2": "concat('a', CAST(o_orderkey % 9 AS STRING))",
    "s1": "o_orderstatus",
    "s2": "CASE WHEN o_custkey % 31 = 0 THEN 'F' ELSE o_orderpriority END",
    "signal_at": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 100000 + 900 + CASE WHEN o_custkey % 37 = 0 THEN 90 ELSE 0 END END",
    "intent_at": "o_orderkey * 100000 + 950 + CASE WHEN o_custkey % 41 = 0 THEN 90 ELSE 0 END",
    "terminal_output": "CASE WHEN o_orderkey % 6 <> 0 THEN 'out' END",
    "study": "CASE WHEN o_custkey % 43 = 0 THEN 'other' ELSE 'study' END",
    "protocol_digest": "CASE WHEN o_custkey % 47 = 0 THEN 'other' ELSE 'digest' END",
    "execution_digest": "CASE WHEN o_custkey % 53 = 0 THEN 'other' ELSE concat('d', CAST(o_custkey % 27 AS STRING)) END",
    "group_split": "CASE WHEN o_custkey % 59 = 0 THEN 'holdout' WHEN o_custkey % 3 = 0 THEN 'development' ELSE 'holdout' END",
    "signal_id": "CASE WHEN o_custkey % 61 = 0 THEN 'other' ELSE 'signal' END",
    "signal_value": "CAST(o_custkey % 103 AS DOUBLE) / 100",
    "observed_at": "o_orderkey * 100000 + 990 + CASE WHEN o_custkey % 67 = 0 THEN 90 ELSE 0 END",
}
PROTOCOL = {"study": "study", "digest": "digest", "created_at": 500_000, "expires_at": 100_000_000, "cost_model": "cost-1", "signal": {"id": "signal", "version": "1", "calibration": "c", "lo": 0.0, "hi": 1.0}}
REQUIRED = ["chat-completions", "streaming", "final-usage"]
_NEEDED = {
    "mode": "CASE WHEN event_id % 9 = 0 THEN 'completion' ELSE 'chat' END",
    "binding_route": "CASE event_id % 4 WHEN 0 THEN 'responses' WHEN 1 THEN 'chatCompletions' END",
    "status": "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END",
    "event_stream": "CASE WHEN user_id % 5 <> 0 THEN 's' END",
    "tokens_in": "CASE WHEN value > 5 THEN 7 END",
    "tokens_out": "CASE WHEN value < 90 THEN 8 END",
    "tokens_total": "CASE WHEN user_id % 11 <> 0 THEN 15 END",
}
_OUTCOME = {
    "kind": "CASE WHEN l_linenumber = 1 THEN 'abstained' ELSE 'scored' END",
    "score": "l_discount * 10 + CASE WHEN l_partkey % 53 = 0 THEN 1e0 ELSE 0e0 END",
    "lo": "CASE WHEN l_suppkey % 59 = 0 THEN 5e-1 ELSE 0e0 END",
    "hi": "CASE WHEN l_suppkey % 61 = 0 THEN 5e-1 ELSE 1e0 END",
    "id2": "CASE WHEN l_partkey % 67 = 0 THEN 'a' ELSE 'b' END",
    "lo2": "CASE WHEN l_partkey % 71 = 0 THEN 9e-2 ELSE 0e0 END",
    "hi2": "CASE WHEN l_partkey % 73 = 0 THEN 0e0 ELSE 9e-2 END",
}
_WINDOW = {"protocol_digest": "p", "policy_digest": "q", "window_id": "w", "membership_digest": "m", "start": 100, "end": 8000, "watermark": 8100, "sample": 2500}
_ONLINE = {
    "split": "CASE WHEN event_id % 17 = 0 THEN 'holdout' ELSE 'online' END",
    "protocol_digest": "CASE WHEN event_id % 19 = 0 THEN 'x' ELSE 'p' END",
    "policy_digest": "CASE WHEN event_id % 23 <> 0 THEN 'q' END",
    "window_id": "CASE WHEN event_id % 29 = 0 THEN 'v' ELSE 'w' END",
    "membership_digest": "CASE WHEN event_id % 31 <> 0 THEN 'm' END",
    "event_at": "event_id",
    "completed_at": "event_id + user_id % 700",
}


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(fields: dict, *names: str):
    return [F.expr(fields[n]).alias(n) for n in names or fields]


def traces(spark, sf_dir):
    """One row per order with its attempts in order; orders without lineitems have none."""
    by = Window.partitionBy("l_orderkey")
    rows = _t(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(by.orderBy(*catalog.EVERY)).cast("bigint")).withColumn("n", F.count("*").over(by))
    orders = _t(spark, sf_dir, "orders")
    rows = rows.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    tries = rows.select("l_orderkey", F.struct("place", F.struct(*_made(ATTEMPT)).alias("a")).alias("a")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("a")).alias("a"))
    tries = tries.select("l_orderkey", F.col("a.a").alias("attempts"))
    out = orders.select("o_orderkey", *_made(TRACE)).join(tries, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return out.withColumn("receipts", F.when(F.col("bound"), F.array("r1", "r2"))).withColumn("slices", F.array("s1", "s2"))


def _shown(faults):
    return F.array_join(faults, ",").alias("faults")


def trace_faults(spark, sf_dir):
    return traces(spark, sf_dir).select("o_orderkey", _shown(semantics.trace_faults()))


def trace_admission(spark, sf_dir):
    profiles = _t(spark, sf_dir, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("profile"), F.concat(F.lit("d"), "n_nationkey").alias("profile_digest"), F.concat(F.lit("m"), F.col("n_nationkey") % 3).alias("model"), F.lit("r1").alias("revision"))
    signal = F.struct(F.col("signal_id").alias("id"), F.lit("1").alias("version"), F.lit("c").alias("calibration"), F.col("signal_value").alias("value"), F.col("observed_at").alias("observed_at"))
    rows = traces(spark, sf_dir).where("attempts is not null").withColumn("signal", F.when(F.col("signal_at").isNotNull(), signal))
    return semantics.admission(rows, PROTOCOL, profiles).select("o_orderkey", _shown(F.col("faults")))


def execution_rollup(spark, sf_dir):
    return traces(spark, sf_dir).where("attempts is not null").select("o_orderkey", *semantics.execution_rollup())


def outcome_faults(spark, sf_dir):
    sub = lambda i, *x: F.struct(i.alias("id"), *[v.alias(n) for v, n in zip(x, ("score", "lo", "hi"))])
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_tax", "l_discount", *_made(_OUTCOME))
    subs = F.array(sub(F.lit("a"), F.col("l_tax") * 10, F.lit(0.0), F.lit(1.0)), sub(F.col("id2"), F.col("l_discount"), F.col("lo2"), F.col("hi2")))
    return rows.withColumn("subscores", subs).select("l_orderkey", "l_partkey", "l_suppkey", _shown(semantics.outcome_faults()))


def capability_faults(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", *_made(_NEEDED))
    return rows.select("event_id", _shown(semantics.capability_faults(REQUIRED)))


def window_membership(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", *_made(_ONLINE))
    bucket = sampling.window_bucket(*catalog.SAMPLE[:3], F.concat(F.lit("case-"), "event_id"), F.concat(F.lit("replicate-"), "user_id"))
    return e.select("event_id", F.coalesce(semantics.window_fault(_WINDOW, bucket), F.lit("inside")).alias("reason"))


def measurement_faults(spark, sf_dir):
    """Cases by order and line number: repeated numbers are repeated cases."""
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), F.array("l_returnflag", F.when(F.col("l_partkey") % 79 == 0, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))).alias("slices"), F.array(F.col("l_suppkey") % 50, F.col("l_partkey") % 50).alias("profiles"), (F.col("l_suppkey") % 10 == 0).alias("judge"), (F.col("l_partkey") % 2 == 0).alias("validated"))
    return semantics.measurement_faults(rows).select("case_id", "rows", _shown(F.col("faults")))


def spec_faults(spark, sf_dir):
    """Each customer's number as a spec of three profiles."""
    key = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("p"), key % n)
    slices = F.when(key % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("c_mktsegment"), F.when(key % 11 == 0, F.col("c_mktsegment")).otherwise("x")))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.array(name(5), name(6), F.lit("p9")).alias("profiles"), name(7).alias("champion"), name(8).alias("primary"), slices.alias("critical_slices"), F.when(key % 3 == 0, 1).alias("minimum_slice_groups"))
    return rows.select("c_custkey", _shown(semantics.spec_faults()))


def protocol_faults(spark, sf_dir):
    """Each part's number as a protocol of four profiles, ten buckets and two predicates."""
    k = F.col("p_partkey")
    name = lambda p, x: F.concat(F.lit(p), x)
    rule = lambda s, t, to: F.struct(s.alias("signal"), t.alias("threshold"), to.alias("to"))
    reach = (k % 13) / 12 * F.lit(1.1)
    other = lambda n, x, y: F.when(k % n == 0, F.lit(x)).otherwise(F.lit(y))
    rows = _t(spark, sf_dir, "part").select(
        "p_partkey", F.lit(10).alias("created_at"), (k % 50 + 9).alias("expires_at"), F.struct(F.lit("s").alias("id"), F.lit(0.0).alias("lo"), other(13, 0.0, 1.0).alias("hi")).alias("signal"),
        F.array(F.lit("p0"), F.lit("p1"), name("p", k % 4 + 1)).alias("profiles"), F.array(F.lit("p1"), name("p", k % 5)).alias("candidates"),
        F.array(name("k", k % 3), name("k", k % 17)).alias("trusted_keys"), F.array(F.lit("streaming"), other(19, "streaming", "final-usage")).alias("capabilities"),
        F.when(k % 23 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), other(29, "x", "y"))).alias("critical_slices"), F.lit(1).alias("minimum_slice_groups"),
        other(31, "p7", "p0").alias("champion"), F.lit(10).alias("buckets"), F.array(*map(F.lit, range(7)), k % 12).cast("array<bigint>").alias("development"), F.array(F.lit(8), k % 11).cast("array<bigint>").alias("holdout"),
        F.array(rule(other(37, "t", "s"), F.when(k % 59 == 0, reach).otherwise(0.5), F.lit("p0")), rule(F.lit("s"), reach, other(41, "p7", "p0"))).alias("predicates"),
        (k % 10 + 3).alias("max_candidates"), F.array(F.lit("a"), F.lit("b")).alias("runtimes"),
        F.array(F.struct(F.lit("e1").alias("alias"), F.lit("a").alias("runtime")), F.struct(other(43, "e1", "e2").alias("alias"), other(47, "c", "b").alias("runtime"))).alias("endpoints"),
        F.lit("K1").alias("dispatch_key"), other(53, "K1", "K2").alias("collector_key"),
    )
    return rows.select("p_partkey", _shown(semantics.protocol_faults()))


_CONTEXT = {"digest": "c", "as_of": 9000, "trust_digest": "t", "revocation_digest": "r"}
_CHECKED = {
    "completed_at": "event_id + CASE WHEN user_id % 13 = 0 THEN 500 ELSE 0 END",
    "profile_ok": "user_id % 7 <> 0 OR event_id % 5 <> 0",
    "authentic": "CASE WHEN event_id % 3 <> 0 THEN event_type <> 'error' END",
    "status": "CASE WHEN event_id % 41 = 0 THEN 'revoked' WHEN event_id % 43 = 0 THEN 'stale' WHEN event_id % 47 = 0 THEN 'future-dated' WHEN event_id % 53 = 0 THEN 'key-not-yet-valid' WHEN event_id % 59 = 0 THEN 'key-expired' WHEN event_id % 61 = 0 THEN 'context-mismatch' ELSE 'trusted' END",
    "evidence_context": "CASE WHEN user_id % 17 = 0 THEN 'x' ELSE 'c' END",
    "assessed_at": "9000 + CASE WHEN user_id % 19 = 0 THEN 1 ELSE 0 END",
    "trust_digest": "CASE WHEN user_id % 23 <> 0 THEN 't' END",
    "revocation_digest": "'r'",
    "produced_at": "event_id + user_id % 90",
}


def staleness_reasons(spark, sf_dir):
    """Each user's events as the executions of an assessment whose policy came after its window's start."""
    fixed = staleness.fixed_reasons({"study": "s", "digest": "d", "created_at": 0, "expires_at": 9500}, {"study": "s", "protocol_digest": "d", "context_digest": None, "contexts": 1}, _CONTEXT, {"issued_at": 20}, {"start": 10, "end": 8000, "watermark": 8100})
    rows = _t(spark, sf_dir, "events").select("user_id", *_made(_CHECKED))
    return staleness.stale_reasons(rows, _CONTEXT, fixed, ["user_id"]).select("user_id", F.array_join("reasons", ",").alias("reasons"))


_HEADS = [0x2001, 0x2600, 0x2002, 0x3FF8, 0xFC12, 0xFE9F, 0xFF02, 0x0064]


def address_class_v6(spark, sf_dir):
    """Addresses whole, shortened, in capitals, with a dotted end, and broken ones."""
    a, b, z = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("event_id") % 8 + 1).cast("int")), F.pmod(F.col("event_id") * 7, F.lit(5000)), F.col("user_id") % 65536
    h = lambda x: F.lower(F.hex(x))
    form = F.col("event_id") % 5
    text = (
        F.when(form == 0, F.concat_ws(":", h(a), h(b), *[F.lit("0")] * 5, h(z)))
        .when(form == 1, F.concat(h(a), F.lit(":"), h(b), F.lit("::"), h(z)))
        .when(form == 2, F.upper(F.concat(h(a), F.lit(":"), h(b), F.lit("::"), h(z))))
        .when(form == 3, F.concat(h(a), F.lit(":"), h(b), F.lit("::10.0."), F.floor(z / 256), F.lit("."), z % 256))
        .otherwise(F.concat_ws(":", h(a), h(b), h(z), F.lit("::1::")))
    )
    return _t(spark, sf_dir, "events").select("event_id", text.alias("address")).select("event_id", "address", decoders.address_class(F.col("address")).alias("kind"))


def queries():
    own = [staleness_reasons, address_class_v6, trace_faults, trace_admission, execution_rollup, outcome_faults, capability_faults, window_membership, measurement_faults, spec_faults, protocol_faults]
    return {q.__name__: q for q in own}


def _cols(fields: dict) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in fields.items())


_TRIES = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(catalog.EVERY)}) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
tries AS (SELECT l_orderkey, place, n, {_cols(ATTEMPT)} FROM placed JOIN orders ON o_orderkey = l_orderkey),
traces AS (SELECT o_orderkey, o_custkey, {_cols(TRACE)} FROM orders)"""


def _codes(rules: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in rules) + ")"


def oracle_sql() -> dict[str, str]:
    s = PROTOCOL
    outside = "({hi} <= {lo} OR {v} < {lo} OR {v} > {hi})"
    trace = _codes(
        [
            ("profile-not-selected", "selected_profile IS NULL OR selected_profile <> profile"),
            ("online-without-window", "split = 'online' AND (window_id IS NULL OR membership_digest IS NULL)"),
            ("window-not-online", "split <> 'online' AND (window_id IS NOT NULL OR membership_digest IS NOT NULL)"),
            ("shadow-without-binding", "source_mode = 'shadow' AND NOT bound"),
            ("binding-not-shadow", "source_mode <> 'shadow' AND bound"),
            ("receipt-repeated", "bound AND r1 = r2"),
            ("receipts-unsorted", "bound AND r1 > r2"),
            ("slice-repeated", "s1 = s2"),
            ("signal-after-intent", "signal_at > intent_at"),
            ("no-attempts", "n IS NULL"),
            ("attempt-id-repeated", "ids < n"),
            ("intent-after-start", "intent_at > begun"),
            ("number-gap", "gap"),
            ("time-order", "backwards"),
            ("success-inconsistent", "inconsistent"),
            ("success-incomplete", "incomplete"),
            ("failure-without-category", "uncategorised"),
            ("abort-unexplained", "unexplained"),
            ("retry-overlaps", "crossing"),
            ("success-not-last", "early"),
            ("success-without-output", "won AND terminal_output IS NULL"),
            ("output-without-success", "NOT won AND terminal_output IS NOT NULL"),
        ]
    )
    admitted = _codes(
        [
            ("study", "study <> 'study'"),
            ("protocol-digest", "protocol_digest <> 'digest'"),
            ("outside-validity", f"begun < {s['created_at']} OR done >= {s['expires_at']}"),
            ("profile-missing", "n_nationkey IS NULL"),
            ("profile-digest", "n_nationkey IS NOT NULL AND execution_digest <> 'd' || n_nationkey"),
            ("cost-model-digest", "drift"),
            ("requested-model", "n_nationkey IS NOT NULL AND requested_other"),
            ("resolved-model", "n_nationkey IS NOT NULL AND resolved_other"),
            ("signal-drift", "signal_at IS NOT NULL AND (signal_id <> 'signal' OR signal_value > 1)"),
            ("signal-after-start", "signal_at IS NOT NULL AND observed_at > begun"),
            ("split", "split <> 'online' AND split <> group_split"),
        ]
    )
    outcome = _codes(
        [
            ("range-not-unit", "lo <> 0 OR hi <> 1"),
            ("score-out-of-range", outside.format(v="score", lo="lo", hi="hi")),
            ("subscore-repeated", "id2 = 'a'"),
            ("subscore-out-of-range", f"l_tax * 10 > 1 OR {outside.format(v='l_discount', lo='lo2', hi='hi2')}"),
        ]
    )
    needed = _codes(
        [
            ("chat-completions", "mode <> 'chat' OR binding_route = 'responses'"),
            ("streaming", "status = 'success' AND event_stream IS NULL"),
            ("final-usage", "status = 'success' AND (tokens_in IS NULL OR tokens_out IS NULL OR tokens_total IS NULL)"),
        ]
    )
    measured = _codes([("case-repeated", "rows > 1"), ("judge-not-validated", "judged"), ("profile-repeated", "same_profile"), ("slice-repeated", "same_slice")])
    spec = _codes(
        [
            ("profile-repeated", "c_custkey % 5 = c_custkey % 6"),
            ("champion-missing", "c_custkey % 7 NOT IN (c_custkey % 5, c_custkey % 6, 9)"),
            ("primary-missing", "c_custkey % 8 NOT IN (c_custkey % 5, c_custkey % 6, 9)"),
            ("champion-is-primary", "c_custkey % 7 = c_custkey % 8"),
            ("critical-slice-repeated", "c_custkey % 7 <> 0 AND c_custkey % 11 = 0"),
            ("slice-groups-without-slices", "c_custkey % 7 = 0 AND c_custkey % 3 = 0"),
        ]
    )
    protocol = _codes(
        [
            ("authorities-equal", "k % 53 = 0"),
            ("expires-before-creation", "k % 50 + 9 <= 10"),
            ("signal-range-empty", "k % 13 = 0"),
            ("profile-repeated", "k % 4 + 1 = 1"),
            ("candidate-repeated", "k % 5 = 1"),
            ("trusted-key-repeated", "k % 3 = k % 17"),
            ("capability-repeated", "k % 19 = 0"),
            ("critical-slice-repeated", "k % 23 <> 0 AND k % 29 = 0"),
            ("predicate-repeated", "k % 37 <> 0 AND k % 41 <> 0 AND k % 59 = 0"),
            ("slice-groups-without-slices", "k % 23 = 0"),
            ("endpoint-repeated", "k % 43 = 0"),
            ("champion-missing", "k % 31 = 0"),
            ("candidate-missing", "k % 5 NOT IN (0, 1, k % 4 + 1)"),
            ("champion-is-candidate", "k % 31 <> 0 AND k % 5 = 0"),
            ("profile-without-role", "(k % 31 = 0 AND k % 5 <> 0) OR k % 4 + 1 NOT IN (1, k % 5)"),
            ("bucket-out-of-range", "k % 12 >= 10 OR k % 11 >= 10"),
            ("bucket-repeated", "k % 12 < 7 OR k % 11 = 8"),
            ("bucket-overlap", "k % 12 = 8 OR k % 11 < 7 OR k % 12 = k % 11"),
            ("bucket-missing", "8 + (k % 12 >= 7 AND k % 12 <> 8)::INT + (k % 11 >= 7 AND k % 11 <> 8 AND k % 11 <> k % 12)::INT < 10"),
            ("predicate-of-unknown-signal", "k % 37 = 0"),
            ("predicate-to-missing-profile", "k % 41 = 0"),
            ("predicate-not-to-champion", "k % 31 = 0 OR k % 41 = 0"),
            ("threshold-out-of-range", "(k % 13 = 0 AND k % 59 <> 0) OR (k % 13) / 12 * 1.1::DOUBLE > 1"),
            ("too-many-candidates", "6 > k % 10 + 3"),
            ("endpoint-of-unknown-runtime", "k % 47 = 0"),
        ]
    )
    bucket = catalog.oracle_sql()["window_sample_bucket"]
    w = _WINDOW
    real = "authentic IS TRUE"
    heads = ", ".join(map(str, _HEADS))
    stale = [("trace-completed-after-assessment-cutoff", "completed_at > 9000"), ("execution-profile-drift", "NOT profile_ok"), ("evaluator-verification-context-drift", f"{real} AND (status = 'context-mismatch' OR evidence_context <> 'c' OR assessed_at <> 9000 OR trust_digest IS NULL)"), ("evaluator-evidence-produced-after-assessment-cutoff", "produced_at > 9000")]
    stale += [(f"evaluator-evidence-{x}", f"{real} AND status = '{x}'") for x in ("revoked", "stale", "future-dated", "key-not-yet-valid", "key-expired")]
    each = " UNION ALL ".join(f"SELECT user_id, '{code}' AS reason FROM e WHERE {rule}" for code, rule in stale)
    return {
        "staleness_reasons": f"""WITH e AS (SELECT user_id, {_cols(_CHECKED)} FROM events)
SELECT user_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM ({each} UNION ALL SELECT user_id, 'policy-issued-after-window-start' FROM e) GROUP BY user_id""",
        "address_class_v6": f"""WITH n AS (SELECT event_id, [{heads}][event_id % 8 + 1] AS a, event_id * 7 % 5000 AS b, user_id % 65536 AS z FROM events),
t AS (SELECT *, lower(printf('%x', a)) AS ha, lower(printf('%x', b)) AS hb, lower(printf('%x', z)) AS hz FROM n)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN ha || ':' || hb || ':0:0:0:0:0:' || hz WHEN 1 THEN ha || ':' || hb || '::' || hz WHEN 2 THEN upper(ha || ':' || hb || '::' || hz)
  WHEN 3 THEN ha || ':' || hb || '::10.0.' || (z // 256) || '.' || (z % 256) ELSE ha || ':' || hb || ':' || hz || ':::1::' END AS address,
  CASE WHEN event_id % 5 = 4 THEN NULL WHEN a >= 65280 THEN 'multicast' WHEN a BETWEEN 65152 AND 65215 THEN 'link-local' WHEN a BETWEEN 64512 AND 65023 THEN 'private'
    WHEN (a = 8193 AND (b < 512 OR b = 3512)) OR a = 8194 OR a BETWEEN 16368 AND 16383 THEN 'special' WHEN a BETWEEN 8192 AND 16383 THEN 'public' ELSE 'reserved' END AS kind
FROM t""",
        "trace_faults": f"""WITH {_TRIES},
each_ AS (SELECT *, lag(completed_at) OVER (PARTITION BY l_orderkey ORDER BY place) > started_at AS crossed FROM tries),
per AS (
  SELECT l_orderkey, any_value(n) AS n, count(DISTINCT attempt_id) AS ids, min(started_at) AS begun, bool_or(number <> place) AS gap,
    bool_or(coalesce(headers_at < started_at, false) OR coalesce(first_byte_at < greatest(started_at, headers_at), false)
      OR coalesce(first_token_at < greatest(started_at, headers_at, first_byte_at), false) OR completed_at < greatest(started_at, headers_at, first_byte_at, first_token_at)) AS backwards,
    bool_or(status = 'success' AND (dispatch <> 'completed' OR failure IS NOT NULL OR abort <> 'not-aborted' OR partial)) AS inconsistent,
    bool_or(status = 'success' AND (finish IS NULL OR model IS NULL)) AS incomplete, bool_or(status <> 'success' AND failure IS NULL) AS uncategorised,
    bool_or(status = 'aborted' AND abort = 'not-aborted') AS unexplained, bool_or(coalesce(crossed, false)) AS crossing,
    bool_or(status = 'success' AND place < n) AS early, bool_or(status = 'success' AND place = n) AS won
  FROM each_ GROUP BY l_orderkey)
SELECT o_orderkey, {trace} AS faults FROM traces LEFT JOIN per ON l_orderkey = o_orderkey""",
        "trace_admission": f"""WITH {_TRIES},
per AS (
  SELECT l_orderkey, min(started_at) AS begun, max(completed_at) FILTER (place = n) AS done, bool_or(cost_kind = 'modeled' AND cost_model <> 'cost-1') AS drift
  FROM tries GROUP BY l_orderkey),
models AS (
  SELECT l_orderkey, bool_or(requested <> 'm' || n_nationkey % 3) AS requested_other,
    bool_or(coalesce(resolved <> 'm' || n_nationkey % 3, false) OR (resolved_source = 'provider-reported' AND resolved_revision <> 'r1')) AS resolved_other
  FROM tries JOIN traces ON o_orderkey = l_orderkey JOIN nation ON profile = 'p' || n_nationkey GROUP BY l_orderkey)
SELECT o_orderkey, {admitted} AS faults FROM traces JOIN per USING (l_orderkey) LEFT JOIN models USING (l_orderkey) LEFT JOIN nation ON profile = 'p' || n_nationkey""".replace("traces JOIN per USING (l_orderkey)", "traces JOIN per ON l_orderkey = o_orderkey"),
        "execution_rollup": f"""WITH {_TRIES},
per AS (
  SELECT l_orderkey, min(started_at) AS begun, max(completed_at) FILTER (place = n) AS done, max(first_token_at) FILTER (place = n AND status = 'success') AS token,
    count(*) FILTER (cost_kind = 'unavailable') AS without, sum(cost) AS cost,
    max(CASE cost_kind WHEN 'measured' THEN 0 WHEN 'provider-reported' THEN 1 WHEN 'modeled' THEN 2 ELSE 3 END) AS worst
  FROM tries GROUP BY l_orderkey)
SELECT l_orderkey AS o_orderkey, coalesce(token, done) - begun AS ttft_ms, CASE WHEN token IS NULL THEN 'modeled' ELSE 'measured' END AS ttft_class, done - begun AS e2e_ms,
  CASE WHEN without = 0 THEN cost END AS cost, CASE worst WHEN 0 THEN 'measured' WHEN 1 THEN 'reported' WHEN 2 THEN 'modeled' ELSE 'unavailable' END AS cost_class FROM per""",
        "outcome_faults": f"SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN kind = 'scored' THEN {outcome} ELSE '' END AS faults FROM (SELECT *, {_cols(_OUTCOME)} FROM lineitem)",
        "capability_faults": f"SELECT event_id, {needed} AS faults FROM (SELECT event_id, {_cols(_NEEDED)} FROM events)",
        "window_membership": f"""SELECT event_id, CASE WHEN split <> 'online' THEN 'not-online' WHEN protocol_digest <> 'p' THEN 'protocol-digest' WHEN policy_digest IS NULL THEN 'policy-digest'
  WHEN window_id <> 'w' THEN 'window-id' WHEN membership_digest IS NULL THEN 'membership-digest' WHEN event_at NOT BETWEEN {w["start"]} AND {w["end"] - 1} THEN 'outside-interval'
  WHEN completed_at > {w["watermark"]} THEN 'late' WHEN NOT selected THEN 'not-sampled' ELSE 'inside' END AS reason
FROM (SELECT event_id, {_cols(_ONLINE)} FROM events) JOIN ({bucket}) USING (event_id)""",
        "measurement_faults": f"""SELECT * FROM (SELECT case_id, rows, {measured} AS faults FROM (
  SELECT l_orderkey * 10 + l_linenumber AS case_id, count(*) AS rows, bool_or(l_suppkey % 10 = 0 AND l_partkey % 2 <> 0) AS judged, bool_or(l_suppkey % 50 = l_partkey % 50) AS same_profile,
    bool_or(l_partkey % 79 = 0 OR l_returnflag = l_linestatus) AS same_slice FROM lineitem GROUP BY 1)) WHERE faults <> ''""",
        "spec_faults": f"SELECT c_custkey, {spec} AS faults FROM customer",
        "protocol_faults": f"SELECT k AS p_partkey, {protocol} AS faults FROM (SELECT p_partkey AS k FROM part)",
    }
