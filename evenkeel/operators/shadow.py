"""Shadow run plans: what is wrong with them as a list of codes, and their digests.

A plan is one row that holds all it relies on:

* ``snapshot``: struct state, study, protocol, created_at, expires_at, policy (struct digest, issued_at, expires_at), last_event_at, digest
* ``protocol``: struct study, digest, created_at, expires_at, rule, profiles (structs id, runtime, digest), endpoints (structs alias, runtime,
  transport), max_executions, max_concurrency
* ``policy``: struct digest, issued_at, expires_at
* ``window``: struct window_id, starts, ends, rule, membership
* ``targets``: structs profile, endpoint, receipts (texts), profile_digest, runtime, transport, one for each profile, by profile
* ``budget``: struct profiles, executions, concurrency, wall
* ``snapshot_digest, protocol_digest, policy_digest, issued_at, expires_at, plan_digest``

Times and durations are whole numbers of one unit.  All rules are expressions over the row, so the check is a map.  A condition that is null
is no fault, but what must be there (a state, a selected policy, a digest that is compared) is missing if it is null; null lists are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import canonical_rows
from .manifests import RULE, membership_digest
from .semantics import listed, repeats

DOMAIN = "evenkeel/shadow-plan/1"
READY = "SHADOW_ASSESSING"
BODY = ["snapshot_digest", "protocol_digest", "policy_digest", "window", "targets", "budget", "issued_at", "expires_at"]
_TARGET = T.StructType().add("profile", "string").add("endpoint", "string").add("receipts", T.ArrayType(T.StringType())).add("profile_digest", "string").add("runtime", "string").add("transport", "string")
_WINDOW = T.StructType().add("window_id", "string").add("starts", "long").add("ends", "long").add("rule", RULE).add("membership", "string")
_BUDGET = T.StructType().add("profiles", "long").add("executions", "long").add("concurrency", "long").add("wall", "long")
_KINDS = ["string", "string", "string", _WINDOW, T.ArrayType(_TARGET), _BUDGET, "long", "long"]
BODY_TYPE = T.StructType()
for _name, _kind in zip(BODY, _KINDS):
    BODY_TYPE.add(_name, _kind)


def plan_digest(plan: Column | None = None) -> Column:
    """The digest of a plan (by default the row's); protocol, policy and snapshot stand in it by their digests."""
    return canonical_rows.once(F.struct(*BODY) if plan is None else plan, lambda b: canonical_rows.digest(DOMAIN, F.struct(*[b[n].alias(n) for n in BODY]), BODY_TYPE))


def _differ(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether any pair differs; a null differs from all but a null."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ~a.eqNullSafe(b)
    return out


def _some(items: Column, rule) -> Column:
    return F.exists(items, lambda x: F.coalesce(rule(x), F.lit(False)))


def matched(targets: Column, protocol: Column) -> Column:
    """Each target ``t`` with how many profiles are its own, the first of them, whether an endpoint serves any of them, and the first endpoint of its alias."""
    first = lambda items: F.try_element_at(items, F.lit(1))

    def one(t):
        found = F.struct(F.filter(protocol["profiles"], lambda p: p["id"] == t["profile"]).alias("profiles"), F.filter(protocol["endpoints"], lambda e: e["alias"] == t["endpoint"]).alias("ends"))
        served = lambda x: F.exists(x["profiles"], lambda p: F.exists(x["ends"], lambda e: e["runtime"] == p["runtime"]))
        return canonical_rows.once(found, lambda x: F.struct(t.alias("t"), F.size(x["profiles"]).alias("n"), first(x["profiles"]).alias("profile"), served(x).alias("served"), first(x["ends"]).alias("endpoint")))

    return F.transform(targets, one)


def derived(found: Column) -> Column:
    """The targets of ``matched`` in the order and with the derived fields that they should have, from profile, endpoint and receipts.

    A target of an unknown profile or of no endpoint keeps nulls there.
    """

    def one(x):
        t, profile, endpoint = x["t"], x["profile"], x["endpoint"]
        fit = F.when(endpoint["runtime"] == profile["runtime"], endpoint["transport"])
        fields = {"profile": t["profile"], "endpoint": t["endpoint"], "receipts": F.array_sort(t["receipts"]), "profile_digest": profile["digest"], "runtime": profile["runtime"], "transport": fit}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    name = lambda t: F.coalesce(t["profile"], F.lit(""))
    order = lambda a, b: F.when(name(a) < name(b), -1).when(name(a) > name(b), 1).otherwise(0)
    return F.array_sort(F.transform(found, one), order)


def faults() -> Column:
    """The codes; the row and its matched targets are bound once for all rules."""
    none = F.array().cast(T.ArrayType(_TARGET))
    fields = ["snapshot", "protocol", "policy", *BODY, "plan_digest"]
    found = lambda r: F.struct(r.alias("r"), matched(F.coalesce(r["targets"], none), r["protocol"]).alias("found"))
    return canonical_rows.once(F.struct(*fields), lambda r: canonical_rows.once(found(r), lambda x: _faults(x["r"], x["found"])))


def _faults(r: Column, found: Column) -> Column:
    c = lambda name: r[name]
    snapshot, protocol, policy, window, budget = c("snapshot"), c("protocol"), c("policy"), c("window"), c("budget")
    issued, expires = c("issued_at"), c("expires_at")
    targets = F.coalesce(c("targets"), F.array().cast(T.ArrayType(_TARGET)))
    names = F.transform(targets, lambda t: t["profile"])
    profiles = F.transform(protocol["profiles"], lambda p: p["id"])
    same_times = lambda a, b, fields: [(a[f], b[f]) for f in fields]
    membership = membership_digest(window["window_id"], protocol["digest"], protocol["rule"])
    rules = [
        ("not-shadow-assessing", _differ([(snapshot["state"], F.lit(READY))]) | snapshot["policy"].isNull()),
        ("snapshot-protocol", _differ([(snapshot["protocol"], protocol["digest"]), *same_times(snapshot, protocol, ["study", "created_at", "expires_at"])])),
        ("snapshot-policy", _differ(same_times(snapshot["policy"], policy, ["digest", "issued_at", "expires_at"]))),
        ("derived-digest", _differ([(c("snapshot_digest"), snapshot["digest"]), (c("protocol_digest"), protocol["digest"]), (c("policy_digest"), policy["digest"])])),
        ("membership", _differ([(window["membership"], membership), (window["rule"], protocol["rule"])])),
        ("expiry-before-issue", expires <= issued),
        ("issued-before-snapshot", issued < F.coalesce(snapshot["last_event_at"], snapshot["created_at"])),
        ("issued-before-policy", issued < policy["issued_at"]),
        ("beyond-protocol", expires > protocol["expires_at"]),
        ("beyond-policy", expires > policy["expires_at"]),
        ("window-empty", window["starts"] >= window["ends"]),
        ("window-before-issue", window["starts"] < issued),
        ("window-beyond-plan", window["ends"] > expires),
        ("target-repeated", repeats(names)),
        ("target-of-unknown-profile", _some(found, lambda x: x["n"] == 0)),
        ("target-endpoint", _some(found, lambda x: (x["n"] > 0) & ~F.coalesce(x["served"], F.lit(False)))),
        ("receipt-repeated", _some(targets, lambda t: repeats(t["receipts"]))),
        ("target-missing", F.size(F.array_except(profiles, names)) > 0),
        ("targets-not-derived", ~targets.eqNullSafe(derived(found))),
        ("budget-profiles", budget["profiles"] < F.size(targets)),
        ("budget-executions", budget["executions"] > protocol["max_executions"]),
        ("budget-concurrency", budget["concurrency"] > protocol["max_concurrency"]),
        ("budget-beyond-plan", budget["wall"] > expires - issued),
        ("budget-beyond-window", budget["wall"] > window["ends"] - window["starts"]),
        ("plan-digest", ~c("plan_digest").eqNullSafe(plan_digest(r))),
    ]
    return listed(rules)


def shadow_plan_faults(plans: DataFrame) -> DataFrame:
    """The plans with ``faults``, the codes of the rules that they break."""
    return plans.withColumn("faults", faults())
