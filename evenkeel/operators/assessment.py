"""Assessment of routing bundles on paired, scored executions: replay, metrics with evidence classes, gates and the decision.

An execution is one profile's run of a replicate of a case: case_id, replicate, profile, group_id, weight (of the case),
slices, status, outcome, score, signal, ttft, e2e, cost (null: unavailable), ttft_class and cost_class.  A bundle sends a case
to the expert before dispatch where its predicate holds; where it doesn't and the primary fails, the expert runs after it.

Every bundle is replayed over every pair in one pass.  A bundle whose evidence leaves a reason is INSUFFICIENT_EVIDENCE and has
no interval; else it passes all gates (PASS) or not (HOLD).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import canonical
from ..functions.lineage import cut, stored
from ..functions.stats import weighted_quantiles
from .replay import bootstrap_of_groups

#: Evidence classes from the strongest to the weakest, and why an outcome has no score.
CLASSES = ["measured", "reported", "modeled", "unavailable"]
MEASURED, REPORTED, MODELED, UNAVAILABLE = range(4)
NO_SCORE = {
    "ambiguous": "ambiguous-execution",
    "abstained": "evaluator-abstention",
    "missing": "missing-evaluator-evidence",
    "invalid": "invalid-evaluator-evidence",
    "conflicting": "conflicting-evidence",
}
WITH_SCORE = ["scored", "failure"]
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "less-than": lambda a, b: a < b,
    "less-than-or-equal": lambda a, b: a <= b,
    "greater-than": lambda a, b: a > b,
    "greater-than-or-equal": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Protocol:
    """What is registered before the evidence is seen."""

    champion: str
    candidates: list[str]
    predicates: list[tuple[str, float]]  # operator, threshold on the route signal
    margin: float
    mean_score: float
    failure_rate: float
    p95_ttft: float
    p95_e2e: float
    cost_per_thousand: float
    coverage: float
    groups: int
    slice_groups: int
    critical_slices: list[str] = field(default_factory=list)
    capacity: float | None = None  # least requests per second; None: no such gate
    iterations: int = 128
    alpha: float = 0.05
    seed: int = 42
    domain: str = "evenkeel/bundle/1"


def bundle_id(protocol: Protocol, bundle: dict) -> str:
    """Digest of a bundle's canonical JSON under the protocol's domain."""
    return canonical.domain_digest(protocol.domain, bundle)


def enumerate_bundles(protocol: Protocol) -> list[dict]:
    """For each candidate profile fast-only and a cascade per predicate, in the order of their digests."""
    out = []
    for primary in protocol.candidates:
        shared = {"primary": primary, "expert": protocol.champion}
        out.append(shared | {"kind": "fast-only", "operator": None, "threshold": None})
        out += [shared | {"kind": "cascade", "operator": op, "threshold": float(t)} for op, t in protocol.predicates]
    out = [b | {"policy": bundle_id(protocol, b)} for b in out]
    if len({b["policy"] for b in out}) < len(out):
        raise ValueError("two bundles are the same")
    return sorted(out, key=lambda b: b["policy"])


def control_bundle(protocol: Protocol) -> dict:
    """The expert alone; its pairs are those of the first candidate profile."""
    own = {"primary": protocol.candidates[0], "expert": protocol.champion, "kind": "expert-only", "operator": None, "threshold": None}
    return own | {"policy": bundle_id(protocol, own)}


def require_member(protocol: Protocol, bundle: dict) -> None:
    """An error where a bundle is not one that the protocol enumerates, digest included."""
    if bundle not in [control_bundle(protocol), *enumerate_bundles(protocol)]:
        raise ValueError("the bundle is not one of the protocol's")


_SIDE = ["status", "outcome", "score", "signal", "ttft", "e2e", "cost", "ttft_class", "cost_class"]


def side_by_side(executions: DataFrame, primaries: list[str], expert: str) -> DataFrame:
    """One row per replicate and primary profile: both executions as structs ``p`` and ``e``, null where one is absent.

    A second execution of one profile and replicate is an error: joins come without it.
    """
    side = F.struct(*_SIDE)
    twice = F.count_if(F.col("profile") == expert) > 1
    for p in primaries:
        twice = twice | (F.count_if(F.col("profile") == p) > 1)
    wide = executions.groupBy("case_id", "replicate").agg(
        F.max("group_id").alias("group_id"), F.max("weight").alias("weight"), F.max("slices").alias("slices"),
        F.max(F.when(F.col("profile") == expert, side)).alias("e"), *[F.max(F.when(F.col("profile") == p, side)).alias(f"p{i}") for i, p in enumerate(primaries)],
        F.when(twice, F.raise_error(F.lit("two executions of one profile and replicate"))).alias("twice"),
    )
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("primary"), F.col(f"p{i}").alias("p")) for i, p in enumerate(primaries)]))
    return wide.where("twice is null").select("case_id", "replicate", "group_id", "weight", "slices", "e", each.alias("x")).select("case_id", "replicate", "group_id", "weight", "slices", "e", "x.*")


def counted(pairs: DataFrame) -> DataFrame:
    """The pairs with the rows of their case that are replayed, with and without a signal: the same for all bundles of a kind."""
    c, case = F.col, Window.partitionBy("primary", "case_id")
    whole = c("p").isNotNull() & c("e").isNotNull()
    return pairs.withColumn("n_whole", F.count_if(whole).over(case)).withColumn("n_signal", F.count_if(whole & c("p.signal").isNotNull()).over(case))


def _routing(signal: Column, status: Column) -> tuple[Column, Column]:
    """Whether a pair's primary runs before the expert, and whether the expert runs, by the row's bundle."""
    c = F.col
    test = F.lit(False)
    for name, holds in OPERATORS.items():
        test = F.when(c("operator") == name, holds(signal, c("threshold"))).otherwise(test)
    cascade = c("kind") == "cascade"
    serial = cascade & ~test & (status != "success")
    return serial, (c("kind") == "expert-only") | (cascade & test) | serial


def _score(side: str) -> Column:
    return F.when(F.col(f"{side}.outcome") == "scored", F.col(f"{side}.score")).when(F.col(f"{side}.outcome") == "failure", F.lit(0.0))


def replay(pairs: DataFrame, bundles: DataFrame) -> DataFrame:
    """Every bundle over every pair of its primary profile.  ``problem`` says why a pair can't be replayed."""
    c = F.col
    whole = c("p").isNotNull() & c("e").isNotNull()
    rows = (pairs if "n_whole" in pairs.columns else counted(pairs)).join(F.broadcast(bundles), "primary")
    cascade = c("kind") == "cascade"
    problem = F.when(~whole, "missing-required-profile").when(cascade & c("p.signal").isNull(), "missing-route-signal")
    serial, expert = _routing(c("p.signal"), c("p.status"))
    take = lambda f: F.when(expert, c(f"e.{f}")).otherwise(c(f"p.{f}"))
    after = lambda f: F.when(serial, c(f"p.{f}")).otherwise(F.lit(0.0))
    scored = F.when(take("outcome") == "scored", take("score")).when(take("outcome") == "failure", F.lit(0.0))
    cost = take("cost") + F.when(serial, c("p.cost")).otherwise(F.lit(0.0))
    rows = rows.select(
        "policy", "kind", "case_id", "replicate", "group_id", "weight", "slices", problem.alias("problem"), serial.alias("serial"), expert.alias("by_expert"),
        F.try_divide("weight", F.when(cascade, c("n_signal")).otherwise(c("n_whole"))).alias("row_weight"), (take("status") != "success").alias("failed"),
        scored.alias("score"), _score("e").alias("control_score"), take("outcome").alias("outcome"), c("e.outcome").alias("control_outcome"),
        (after("e2e") + take("ttft")).alias("ttft"), (after("e2e") + take("e2e")).alias("e2e"), cost.alias("cost"),
        F.when(cascade, MODELED).otherwise(F.when(take("outcome") == "scored", REPORTED).otherwise(MODELED)).alias("score_class"),
        F.when(cascade, MODELED).otherwise(take("ttft_class")).alias("ttft_class"), F.when(cascade, MODELED).otherwise(MEASURED).alias("e2e_class"),
        F.when(cost.isNull(), UNAVAILABLE).when(cascade, MODELED).otherwise(take("cost_class")).alias("cost_class"),
    )
    return rows


def no_score_bit(outcome: Column) -> Column:
    """The place of an outcome's reason in NO_SCORE as a bit, 0 where it has a score.  A name that is not known is an error."""
    rule = F.when(outcome.isNull() | outcome.isin(*WITH_SCORE), F.lit(0))
    for i, name in enumerate(NO_SCORE):
        rule = rule.when(outcome == name, F.lit(1 << i))
    return rule.otherwise(F.raise_error(F.concat(F.lit("unknown outcome: "), outcome)).cast("int"))


def metrics(rows: DataFrame, slices: list[str], cases: DataFrame) -> DataFrame:
    """One row per bundle: metrics with their weakest evidence class, coverage, counts, and the reasons that evidence leaves.

    Sums, flags and classes of each group are numbers, so that rows are neither spread out for each thing that is counted
    once nor gathered; ``cases`` has each bundle's number of cases.
    """
    c, ok = F.col, F.col("problem").isNull()
    known = rows.where(ok)
    w = c("row_weight")
    beside = ok | (c("problem") == "missing-route-signal")  # pairs that the control replays
    paired = ok & c("score").isNotNull() & c("control_score").isNotNull()
    problems = ["missing-required-profile", "missing-route-signal"]
    problem_bit = F.when(ok, 0).when(c("problem") == problems[0], 1).otherwise(2)
    bits = problem_bit.bitwiseOR(F.shiftleft(F.when(ok, no_score_bit(c("outcome"))).otherwise(0).bitwiseOR(F.when(F.coalesce(beside, F.lit(False)), no_score_bit(c("control_outcome"))).otherwise(0)), 2))
    counted_ = {"replayed": ok, "failures": ok & c("failed"), "serial": ok & c("serial"), "unscored": ok & c("score").isNull(), "unpaid": ok & c("cost").isNull(), "scored": ok & c("score").isNotNull(), "based": beside & c("control_score").isNotNull(), "beside": beside, "replicates": paired}
    summed = {"mass": w, "score_mass": c("score") * w, "failed_mass": c("failed").cast("double") * w, "cost_mass": c("cost") * 1000 * w}
    classes = ["score_class", "cost_class", "ttft_class", "e2e_class"]
    seen = {"groups": paired} | {f"slice_groups_{i}": paired & F.array_contains("slices", s) for i, s in enumerate(slices)}
    per = rows.groupBy("policy", "kind", "group_id").agg(
        *[F.count_if(test).alias(n) for n, test in counted_.items()], *[F.sum(F.when(ok, x)).alias(n) for n, x in summed.items()], *[F.max(F.when(ok, c(n))).alias(n) for n in classes],
        *[F.count_if(test).alias(n) for n, test in seen.items()], F.bit_or(bits).alias("bits"),
    )
    out = per.groupBy("policy", "kind").agg(
        *[F.sum(n).alias(n) for n in (*counted_, *summed)], *[F.max(n).alias(n) for n in classes],
        *[F.count_if(c("group_id").isNotNull() & (c(n) > 0)).alias(n) for n in seen], F.bit_or("bits").alias("bits"),
    )
    mean = lambda n: F.coalesce(F.try_divide(n, "mass"), F.lit(0.0))
    reasons = F.array_distinct(F.array_compact(F.array(*[F.when(c("bits").bitwiseAND(1 << i) != 0, name) for i, name in enumerate([*problems, *NO_SCORE.values()])])))
    out = out.select(
        "policy", "kind", "replayed", "failures", "serial", F.when(c("unscored") == 0, mean("score_mass")).alias("mean_score"), mean("failed_mass").alias("failure_rate"), F.when(c("unpaid") == 0, mean("cost_mass")).alias("cost_per_thousand"), *classes,
        (c("scored") + F.when(c("kind") != "expert-only", c("based")).otherwise(0)).alias("covered"), "beside", "replicates", *seen, reasons.alias("reasons"),
    )
    out = out.join(F.broadcast(cases), "policy", "left").withColumn("cases", F.coalesce("cases", F.lit(0).cast("bigint")))  # a row a bundle
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c(m).cast("double").alias("value")) for m in ("ttft", "e2e")]))
    long = known.select("policy", "row_weight", each.alias("m")).select("policy", "row_weight", "m.*")
    tails = weighted_quantiles(long, ["policy", "metric"], "value", "row_weight", {"p95": 0.95})
    tails = tails.groupBy("policy").agg(*[F.max(F.when(c("metric") == m, c("p95"))).alias(f"p95_{m}") for m in ("ttft", "e2e")])
    evidence = c("replayed") + F.when(c("kind") == "expert-only", 0).otherwise(c("beside"))
    return out.join(F.broadcast(tails), "policy", "left").withColumn("coverage", F.try_divide(c("covered"), evidence))


def group_effects(pairs: DataFrame, bundles: DataFrame, scale: int, unit: float = 1.0) -> DataFrame:
    """(policy, group_id, num, mass, cases): each case's median difference from the control, times its weight, summed by group.

    Scores are whole multiples of 1 / ``scale`` and weights of ``unit``, so no order of addition shows.  A bundle only picks one
    of a pair's two differences, the primary's and the expert's own, so the pairs are gathered by case once (a case's replicates
    in a row), and bundles are applied to cases.
    """
    c, base = F.col, _score("e")
    delta = lambda side: F.round((_score(side) - base) * scale)
    each = F.struct(delta("p").alias("own"), delta("e").alias("none"), c("p.signal").alias("signal"), c("p.status").alias("status"))
    cases = pairs.where(c("p").isNotNull() & c("e").isNotNull() & base.isNotNull()).groupBy("primary", "case_id").agg(F.max("group_id").alias("group_id"), F.max("weight").alias("weight"), F.collect_list(each).alias("each"))

    def effect(x: Column) -> Column:
        _, expert = _routing(x["signal"], x["status"])
        return F.when((c("kind") != "cascade") | x["signal"].isNotNull(), F.when(expert, x["none"]).otherwise(x["own"]))

    rows = cases.join(F.broadcast(bundles), "primary").select("policy", "case_id", "group_id", F.round(c("weight") / unit).cast("bigint").alias("w"), F.sort_array(F.filter(F.transform("each", effect), lambda v: v.isNotNull())).alias("s")).where(F.size("s") > 0)
    low, high = F.get("s", F.floor((F.size("s") - 1) / 2).cast("int")), F.get("s", F.floor(F.size("s") / 2).cast("int"))
    twice = (F.when(low == high, low).otherwise(low * 0.5 + high * 0.5) * 2).cast("bigint")
    return rows.groupBy("policy", "group_id").agg(F.sum(twice * c("w")).alias("num"), F.sum("w").alias("mass"), F.count("case_id").alias("cases"))


def assess(executions: DataFrame, protocol: Protocol, bundles: list[dict], phase: str, scale: int, unit: float = 1.0, capacity_attested: bool = False) -> DataFrame:
    """One row per bundle, the control among them: metrics, interval, reasons, failed gates and status, for a phase.

    ``phase`` is development, holdout or window.  A required capacity counts in a window only, and only if a receipt
    attests it, which no reported declaration is.
    """
    spark, c = executions.sparkSession, F.col
    for b in bundles:
        require_member(protocol, b)
    control = control_bundle(protocol)
    listed = [b for b in bundles if b["policy"] != control["policy"]] + [control]
    table = spark.createDataFrame([tuple(b[k] for k in ("policy", "kind", "operator", "threshold", "primary")) for b in listed], "policy string, kind string, operator string, threshold double, primary string")
    pairs = stored(counted(side_by_side(executions, sorted({b["primary"] for b in listed}), protocol.champion)))  # read for metrics, tails and effects
    effects = cut(group_effects(pairs, table, scale, unit))  # a row a bundle and group
    out = metrics(replay(pairs, table), protocol.critical_slices, effects.groupBy("policy").agg(F.sum("cases").alias("cases")))
    out = spark.createDataFrame([(b["policy"], b["kind"]) for b in listed], "policy string, kind string").join(out.drop("kind"), "policy", "left")
    spread = bootstrap_of_groups(effects, "policy", "group_id", protocol.iterations, protocol.alpha, protocol.seed).select("policy", *[(c(n) / (2 * scale)).alias(n) for n in ("estimate", "lo", "hi")])
    out = out.join(F.broadcast(spread), "policy", "left")
    # what evidence leaves open
    extra = [
        F.when(F.coalesce(c("coverage") < protocol.coverage, F.lit(True)), "insufficient-evaluator-coverage"),
        F.when(c("cost_per_thousand").isNull(), "required-cost-evidence-unavailable"),
        F.when(F.coalesce(c("groups"), F.lit(0)) < protocol.groups, "insufficient-independent-groups"),
        *[F.when(F.coalesce(c(f"slice_groups_{i}"), F.lit(0)) < protocol.slice_groups, f"insufficient-critical-slice-groups:{s}") for i, s in enumerate(protocol.critical_slices)],
    ]
    # reasons of the control's pairs hold for all: the same pairs are replayed, so the control's rows are in every bundle's
    if phase == "window" and protocol.capacity is not None and not capacity_attested:
        extra.append(F.lit("required-service-capacity-unavailable"))
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.array(*extra)))))
    out = out.withColumn("reasons", reasons)
    enough = F.size("reasons") == 0
    gates = [
        ("paired-quality", F.when(enough, c("lo")), ">=", protocol.margin),
        ("minimum-mean-score", c("mean_score"), ">=", protocol.mean_score),
        ("maximum-failure-rate", c("failure_rate"), "<=", protocol.failure_rate),
        ("maximum-p95-ttft", c("p95_ttft"), "<=", protocol.p95_ttft),
        ("maximum-p95-end-to-end", c("p95_e2e"), "<=", protocol.p95_e2e),
        ("maximum-cost-per-thousand", c("cost_per_thousand"), "<=", protocol.cost_per_thousand),
        ("minimum-evidence-coverage", c("coverage"), ">=", protocol.coverage),
        ("minimum-independent-groups", c("groups"), ">=", protocol.groups),
        *[(f"minimum-critical-slice-groups:{s}", c(f"slice_groups_{i}"), ">=", protocol.slice_groups) for i, s in enumerate(protocol.critical_slices)],
    ]
    if phase == "window" and protocol.capacity is not None:
        gates.append(("minimum-service-capacity", F.lit(None).cast("double"), ">=", protocol.capacity))
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(x >= t if op == ">=" else x <= t, F.lit(False)), name) for name, x, op, t in gates]))
    out = out.withColumn("failed", failed)
    out = out.withColumn("status", F.when(~enough, "INSUFFICIENT_EVIDENCE").when(F.size("failed") == 0, "PASS").otherwise("HOLD"))
    for name in ("estimate", "lo", "hi"):
        out = out.withColumn(name, F.when(enough, c(name)))
    return _decided(out, phase, [b["policy"] for b in bundles])


def _decided(out: DataFrame, phase: str, policies: list[str]) -> DataFrame:
    """``selected`` and ``decision``: the cheapest passing bundle is nominated in development; else the one bundle's status."""
    own = F.col("policy").isin(policies)
    order = Window.orderBy(F.when(own & (F.col("status") == "PASS"), 0).otherwise(1), F.col("cost_per_thousand").asc_nulls_last(), F.col("p95_e2e").asc_nulls_last(), "policy")
    everything = Window.partitionBy()  # a row a bundle
    out = out.withColumn("place", F.row_number().over(order))
    if phase != "development":
        return out.withColumn("selected", F.col("policy") == policies[0]).withColumn("decision", F.max(F.when(F.col("policy") == policies[0], F.col("status"))).over(everything)).drop("place")
    out = out.withColumn("selected", own & (F.col("status") == "PASS") & (F.col("place") == 1))
    none = F.min(F.when(own, F.col("status") == "INSUFFICIENT_EVIDENCE")).over(everything)
    decision = F.when(F.max("selected").over(everything), "NOMINATED").when(none, "INSUFFICIENT_EVIDENCE").otherwise("NO_CANDIDATE")
    return out.withColumn("decision", decision).drop("place")
