"""What is wrong with recorded traces, outcomes, protocols and measurements, as data: a list of codes per row, in the rules' order.

All rules are expressions over one row (arrays of structs inside), so a check is a map over the input; only
``repeated_cases`` shuffles, and ``admission`` joins the protocol's profiles.  Times are timestamps or numbers of
milliseconds.  A null condition is no fault; a null list counts as empty.

A trace has ``split, source_mode, window_id, membership_digest, profile, selected_profile, receipts`` (null without a
collection binding), ``binding_route, slices, signal_at, intent_at, terminal_output`` and ``attempts``, structs of
``attempt_id, number, started_at, headers_at, first_byte_at, first_token_at, completed_at, status, dispatch, failure,
abort, partial, finish, model``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TIMES = ["started_at", "headers_at", "first_byte_at", "first_token_at", "completed_at"]
PROFILES = 100_000  # profiles of one protocol; more are refused


def listed(rules: list[tuple[str, Column]]) -> Column:
    """The codes of the rules that hold."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))


def repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) < F.size(values)


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


#: The codes of attempts, in the order in which a trace lists them.
ATTEMPT_CODES = ["number-gap", "time-order", "success-inconsistent", "success-incomplete", "failure-without-category", "abort-unexplained"]


def attempt_faults(a: Column, place: Column) -> Column:
    """Codes of one attempt, ``place`` being its position from 0: its number, its times, and what its status requires."""
    times = F.array_compact(F.array(*[a[t] for t in TIMES]))
    won = a["status"] == "success"
    return listed(
        [
            ("number-gap", ~a["number"].eqNullSafe(place + 1)),
            ("time-order", times != F.array_sort(times)),
            ("success-inconsistent", won & (~a["dispatch"].eqNullSafe(F.lit("completed")) | a["failure"].isNotNull() | ~a["abort"].eqNullSafe(F.lit("not-aborted")) | F.coalesce(a["partial"], F.lit(False)))),
            ("success-incomplete", won & (a["finish"].isNull() | a["model"].isNull())),
            ("failure-without-category", ~won & a["failure"].isNull()),
            ("abort-unexplained", (a["status"] == "aborted") & (a["abort"] == "not-aborted")),
        ]
    )


def trace_faults(attempts: str = "attempts") -> Column:
    """Codes of a trace and of its attempts, each once."""
    tries = F.col(attempts)
    n = F.size(tries)
    online, shadow = F.col("split") == "online", F.col("source_mode") == "shadow"
    end, start = last(tries), first(tries)
    steps = F.zip_with(F.slice(tries, 1, F.greatest(n - 1, F.lit(0))), F.slice(tries, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b["started_at"] < a["completed_at"])
    own = listed(
        [
            ("profile-not-selected", ~F.col("profile").eqNullSafe(F.col("selected_profile"))),
            ("online-without-window", online & (F.col("window_id").isNull() | F.col("membership_digest").isNull())),
            ("window-not-online", ~online & (F.col("window_id").isNotNull() | F.col("membership_digest").isNotNull())),
            ("shadow-without-binding", shadow & F.col("receipts").isNull()),
            ("binding-not-shadow", ~shadow & F.col("receipts").isNotNull()),
            ("receipt-repeated", repeats(F.col("receipts"))),
            ("receipts-unsorted", F.col("receipts") != F.array_sort("receipts")),
            ("slice-repeated", repeats(F.col("slices"))),
            ("signal-after-intent", F.col("signal_at") > F.col("intent_at")),
            ("no-attempts", tries.isNull() | (n == 0)),
            ("attempt-id-repeated", repeats(tries["attempt_id"])),
            ("intent-after-start", F.col("intent_at") > start["started_at"]),
        ]
    )
    tail = listed(
        [
            ("retry-overlaps", F.exists(steps, lambda x: x)),
            ("success-not-last", F.exists(F.slice(tries, 1, F.greatest(n - 1, F.lit(0))), lambda a: a["status"] == "success")),
            ("success-without-output", (end["status"] == "success") & F.col("terminal_output").isNull()),
            ("output-without-success", (end["status"] != "success") & F.col("terminal_output").isNotNull()),
        ]
    )
    each = F.array_intersect(F.array(*map(F.lit, ATTEMPT_CODES)), F.flatten(F.transform(tries, attempt_faults)))
    return F.concat(own, F.coalesce(each, F.array().cast("array<string>")), tail)


def outcome_faults() -> Column:
    """Codes of ``kind, score, lo, hi, subscores`` (structs of id, score, lo, hi): only scored outcomes have rules."""
    outside = lambda score, lo, hi: (hi <= lo) | (score < lo) | (score > hi)
    subs = F.col("subscores")
    found = listed(
        [
            ("range-not-unit", (F.col("lo") != 0) | (F.col("hi") != 1)),
            ("score-out-of-range", outside(F.col("score"), F.col("lo"), F.col("hi"))),
            ("subscore-repeated", repeats(subs["id"])),
            ("subscore-out-of-range", F.exists(subs, lambda s: outside(s["score"], s["lo"], s["hi"]))),
        ]
    )
    return F.when(F.col("kind") == "scored", found).otherwise(F.array().cast("array<string>"))


def capability_faults(required: list[str]) -> Column:
    """Required capabilities that a trace does not show, by ``mode, binding_route, status, event_stream, tokens_in, tokens_out, tokens_total``."""
    won = F.col("status") == "success"
    missing = {
        "chat-completions": ~F.col("mode").eqNullSafe(F.lit("chat")) | (F.col("binding_route") != "chatCompletions"),
        "streaming": won & F.col("event_stream").isNull(),
        "final-usage": won & (F.col("tokens_in").isNull() | F.col("tokens_out").isNull() | F.col("tokens_total").isNull()),
    }
    return listed([(name, missing[name]) for name in required if name in missing])


def protocol_faults() -> Column:
    """Codes of a protocol's row.

    It has ``created_at, expires_at, signal (id, lo, hi), profiles, candidates, trusted_keys, capabilities,
    critical_slices, minimum_slice_groups, champion, buckets, development, holdout, predicates`` (structs of signal,
    threshold, to), ``max_candidates, runtimes, endpoints`` (structs of alias, runtime), ``dispatch_key, collector_key``.
    """
    c, signal, rules, ends = F.col, F.col("signal"), F.col("predicates"), F.col("endpoints")
    some = lambda x: F.size(x) > 0
    both = F.concat("development", "holdout")
    return listed(
        [
            ("authorities-equal", c("dispatch_key") == c("collector_key")),
            ("expires-before-creation", c("expires_at") <= c("created_at")),
            ("signal-range-empty", signal["hi"] <= signal["lo"]),
            ("profile-repeated", repeats(c("profiles"))),
            ("candidate-repeated", repeats(c("candidates"))),
            ("trusted-key-repeated", repeats(c("trusted_keys"))),
            ("capability-repeated", repeats(c("capabilities"))),
            ("critical-slice-repeated", repeats(c("critical_slices"))),
            ("predicate-repeated", repeats(rules)),
            ("slice-groups-without-slices", (F.size("critical_slices") == 0) & (c("minimum_slice_groups") > 0)),
            ("endpoint-repeated", repeats(ends["alias"])),
            ("champion-missing", ~F.array_contains("profiles", c("champion"))),
            ("candidate-missing", some(F.array_except("candidates", "profiles"))),
            ("champion-is-candidate", F.array_contains("candidates", c("champion"))),
            ("profile-without-role", some(F.array_except("profiles", F.concat("candidates", F.array("champion"))))),
            ("bucket-out-of-range", F.exists(both, lambda b: (b < 0) | (b >= c("buckets")))),
            ("bucket-repeated", repeats(c("development")) | repeats(c("holdout"))),
            ("bucket-overlap", F.arrays_overlap("development", "holdout")),
            ("bucket-missing", F.size(F.array_distinct(both)) < c("buckets")),
            ("predicate-of-unknown-signal", F.exists(rules, lambda p: p["signal"] != signal["id"])),
            ("predicate-to-missing-profile", F.exists(rules, lambda p: ~F.array_contains("profiles", p["to"]))),
            ("predicate-not-to-champion", F.exists(rules, lambda p: p["to"] != c("champion"))),
            ("threshold-out-of-range", F.exists(rules, lambda p: (p["threshold"] < signal["lo"]) | (p["threshold"] > signal["hi"]))),
            ("too-many-candidates", F.size("candidates") * (F.size(rules) + 1) > c("max_candidates")),
            ("endpoint-of-unknown-runtime", F.exists(ends, lambda e: ~F.array_contains("runtimes", e["runtime"]))),
        ]
    )


def spec_faults() -> Column:
    """Codes of a v1 spec's row: ``profiles, champion, primary, critical_slices, minimum_slice_groups`` (null: one where there are slices)."""
    least = F.coalesce("minimum_slice_groups", F.when(F.size("critical_slices") == 0, 0).otherwise(1))
    return listed(
        [
            ("profile-repeated", repeats(F.col("profiles"))),
            ("champion-missing", ~F.array_contains("profiles", F.col("champion"))),
            ("primary-missing", ~F.array_contains("profiles", F.col("primary"))),
            ("champion-is-primary", F.col("champion") == F.col("primary")),
            ("critical-slice-repeated", repeats(F.col("critical_slices"))),
            ("slice-groups-without-slices", (F.size("critical_slices") == 0) & (least > 0)),
        ]
    )


def measurement_faults(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, rows, faults) of each case id with a fault; ``cases`` has ``slices, profiles, judge, validated`` beside the id."""
    own = listed([("judge-not-validated", F.col("judge") & ~F.col("validated")), ("slice-repeated", repeats(F.col("slices"))), ("profile-repeated", repeats(F.col("profiles")))])
    seen = cases.select(F.col(case), own.alias("own")).groupBy(case).agg(F.count("*").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("own"))
    faults = F.concat(F.array_compact(F.array(F.when(F.col("rows") > 1, F.lit("case-repeated")))), "own")
    return seen.select(case, "rows", faults.alias("faults")).where(F.size("faults") > 0)


def admission(traces: DataFrame, protocol: dict, profiles: DataFrame) -> DataFrame:
    """``traces`` with ``faults``: why a protocol does not admit them.

    ``protocol``: study, digest, created_at, expires_at, cost_model (None: no modeled cost), signal (dict of id, version,
    calibration, lo, hi).  ``profiles`` (profile, profile_digest, model, revision), one row each, go to every task: their number is checked.
    ``traces`` has ``study, protocol_digest, profile, execution_digest, split, group_split`` (the split that its group
    falls in), ``signal`` (null or a struct of id, version, calibration, value, observed_at) and ``attempts`` of ``started_at,
    completed_at, cost_kind, cost_model, requested, requested_revision, resolved, resolved_source, resolved_revision``.
    """
    if profiles.limit(PROFILES + 1).count() > PROFILES:
        raise ValueError("too many profiles in the protocol")
    known = profiles.select(F.struct("profile_digest", "model", "revision").alias("_profile"), F.col("profile").alias("_of"))
    rows = traces.join(F.broadcast(known), F.col("profile") == F.col("_of"), "left")
    p, tries, s, rule = F.col("_profile"), F.col("attempts"), F.col("signal"), protocol["signal"]
    modeled = lambda a: a["cost_kind"] == "modeled"
    no_model = F.exists(tries, modeled) if protocol["cost_model"] is None else F.lit(False)
    drift = F.lit(False) if protocol["cost_model"] is None else F.exists(tries, lambda a: modeled(a) & ~a["cost_model"].eqNullSafe(F.lit(protocol["cost_model"])))
    moved = ~s["id"].eqNullSafe(F.lit(rule["id"])) | ~s["version"].eqNullSafe(F.lit(rule["version"])) | ~s["calibration"].eqNullSafe(F.lit(rule["calibration"])) | (s["value"] < rule["lo"]) | (s["value"] > rule["hi"])
    faults = listed(
        [
            ("study", ~F.col("study").eqNullSafe(F.lit(protocol["study"]))),
            ("protocol-digest", ~F.col("protocol_digest").eqNullSafe(F.lit(protocol["digest"]))),
            ("outside-validity", (first(tries)["started_at"] < F.lit(protocol["created_at"])) | (last(tries)["completed_at"] >= F.lit(protocol["expires_at"]))),
            ("profile-missing", p.isNull()),
            ("profile-digest", F.col("execution_digest") != p["profile_digest"]),
            ("modeled-cost-not-allowed", no_model),
            ("cost-model-digest", drift),
            ("requested-model", F.exists(tries, lambda a: (a["requested"] != p["model"]) | (a["requested_revision"] != p["revision"]))),
            ("resolved-model", F.exists(tries, lambda a: (a["resolved"] != p["model"]) | ((a["resolved_source"] == "provider-reported") & (a["resolved_revision"] != p["revision"])))),
            ("signal-drift", s.isNotNull() & moved),
            ("signal-after-start", s["observed_at"] > first(tries)["started_at"]),
            ("split", (F.col("split") != "online") & (F.col("split") != F.col("group_split"))),
        ]
    )
    return rows.withColumn("faults", faults).drop("_profile", "_of")


def window_fault(window: dict, bucket: Column) -> Column:
    """The first rule of a sealed window that a trace breaks, null inside; ``bucket`` is its sampling bucket.

    ``window``: protocol_digest, policy_digest, window_id, membership_digest, start, end, watermark, sample.  The trace
    has columns of these digests and ids, ``split, event_at, completed_at``.
    """
    rules = [("not-online", ~F.col("split").eqNullSafe(F.lit("online")))]
    rules += [(name.replace("_", "-"), ~F.col(name).eqNullSafe(F.lit(window[name]))) for name in ("protocol_digest", "policy_digest", "window_id", "membership_digest")]
    rules += [
        ("outside-interval", ~F.coalesce((F.col("event_at") >= F.lit(window["start"])) & (F.col("event_at") < F.lit(window["end"])), F.lit(False))),
        ("late", F.col("completed_at") > F.lit(window["watermark"])),
        ("not-sampled", bucket >= window["sample"]),
    ]
    return F.coalesce(*[F.when(rule, F.lit(code)) for code, rule in rules])


#: Evidence classes, the strongest first.
CLASSES = ["measured", "reported", "modeled", "unavailable"]


def elapsed(start: Column, end: Column) -> Column:
    """Milliseconds between two instants given in milliseconds; an end before its start is an error."""
    return F.when(end < start, F.raise_error(F.lit("an attempt ends before it starts"))).otherwise(end - start).cast("bigint")


def execution_rollup(attempts: str = "attempts") -> list[Column]:
    """Latency and cost of an execution over all its attempts (``started_at, first_token_at, completed_at`` in
    milliseconds, ``status, cost_kind, cost``): ttft_ms, ttft_class, e2e_ms, cost, cost_class.

    Without a first token of a successful end the time to it is modeled by the whole; one cost that is unavailable leaves none.
    """
    tries = F.col(attempts)
    begin, end = first(tries)["started_at"], last(tries)
    whole, met = elapsed(begin, end["completed_at"]), (end["status"] == "success") & end["first_token_at"].isNotNull()
    named = F.create_map(*[F.lit(x) for pair in (("measured", 0), ("provider-reported", 1), ("modeled", 2), ("unavailable", 3)) for x in pair])
    weakest = F.array_max(F.transform(tries, lambda a: named[a["cost_kind"]]))
    total = F.aggregate(tries, F.lit(0.0), lambda s, a: s + a["cost"])
    return [
        F.when(met, elapsed(begin, end["first_token_at"])).otherwise(whole).alias("ttft_ms"),
        F.when(met, "measured").otherwise("modeled").alias("ttft_class"),
        whole.alias("e2e_ms"),
        F.when(weakest < 3, total).alias("cost"),
        F.element_at(F.array(*map(F.lit, CLASSES)), weakest + 1).alias("cost_class"),
    ]
