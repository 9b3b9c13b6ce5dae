"""Policies, their replay over paired executions, metrics, gates, frontier and choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.numbering import number_within
from ..functions.stats import r7, weighted_mean, weighted_quantiles
from ..functions.prng import draw


def enumerate_policies(spark, confidences: list[float], tokens: list[int], fast_only: bool = True) -> DataFrame:
    """Expert-only, fast-only and one cascade per pair of distinct thresholds; a short list whatever the data."""
    rows = [("expert-only", "expert-only", None, None)] + ([("fast-only", "fast-only", None, None)] if fast_only else [])
    rows += [(f"cascade-{c:g}-{t}", "cascade", float(c), t) for c in sorted(set(confidences)) for t in sorted(set(tokens))]
    return spark.createDataFrame(rows, "policy string, kind string, min_confidence double, max_tokens bigint")


def row_weights(rows: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """A row's share of its case's weight: the weight over the case's rows."""
    return rows.withColumn("row_weight", F.col(weight) / F.count("*").over(Window.partitionBy(*keys)))


def replay(pairs: DataFrame, policies: DataFrame, critical: list[str]) -> DataFrame:
    """Every policy over every pair, in one job.  ``pairs`` has the primary's p_* and the expert's e_* columns side by side.

    A cascade runs the expert after the primary where that failed, is unsure, has a long input or a critical slice; then
    costs and times add.  A failure scores 0 and takes its elapsed time.
    """
    c = F.col
    unsure = c("p_confidence").isNull() | (c("p_confidence") < c("min_confidence"))
    leaves = (c("p_status") == "failure") | unsure | (c("input_tokens") >= c("max_tokens")) | c("slice").isin(*critical)
    rows = pairs.crossJoin(F.broadcast(policies)).withColumn("escalated", (c("kind") == "cascade") & leaves)
    by_expert = (c("kind") == "expert-only") | c("escalated")
    pick = lambda name: F.when(by_expert, c(f"e_{name}")).otherwise(c(f"p_{name}"))
    before = F.when(c("escalated"), c("p_e2e")).otherwise(F.lit(0.0))
    failed = pick("status") == "failure"
    return rows.select(
        "policy", "kind", "case_id", "replicate", "group_id", "slice", "weight", "escalated",
        pick("status").alias("status"),
        F.when(failed, F.lit(0.0)).otherwise(pick("score")).alias("score"),
        (before + F.when(failed, pick("e2e")).otherwise(pick("ttft"))).alias("ttft"),
        (before + pick("e2e")).alias("e2e"),
        F.when(failed, F.lit(0.0)).otherwise(pick("tps")).alias("tps"),
        F.when(~failed & (c("kind") != "cascade"), pick("tps")).alias("total_tps"),
        (pick("cost") + F.when(c("escalated"), c("p_cost")).otherwise(F.lit(0.0))).alias("cost"),
        *([c("row_weight")] if "row_weight" in rows.columns else []),
    )


QUANTILES = {"ttft": {"p50_ttft": 0.5, "p95_ttft": 0.95}, "e2e": {"p50_e2e": 0.5, "p95_e2e": 0.95, "p99_e2e": 0.99}, "tps": {"p10_tps": 0.1}, "total_tps": {"p50_total_tps": 0.5}}


def policy_metrics(rows: DataFrame, critical: list[str]) -> DataFrame:
    """One row per policy: weighted means and inverse-CDF quantiles; a policy with an unmeasured throughput has none.

    ``rows`` bring their row_weight, which depends on the case and not on the policy.  All quantiles come of one pass.
    """
    w, fail = F.col("row_weight"), F.col("status") == "failure"
    out = rows.groupBy("policy").agg(
        weighted_mean(F.col("score"), w).alias("mean_score"),
        weighted_mean(fail.cast("double"), w).alias("error_rate"),
        weighted_mean(F.col("cost"), w).alias("cost_per_request"),
        weighted_mean(F.col("escalated").cast("double"), w).alias("escalation_rate"),
        F.max(F.col("total_tps").isNull()).alias("_no_tps"),
        *[F.try_divide(F.sum(F.when(F.col("slice") == s, F.col("score") * w)), F.sum(F.when(F.col("slice") == s, w))).alias(f"slice_{i}") for i, s in enumerate(critical)],
    )
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("value")) for v in QUANTILES]))
    long = rows.select("policy", "row_weight", each.alias("m")).select("policy", "m.metric", "m.value", "row_weight").where("value is not null")
    ps = {name: (v, p) for v, named in QUANTILES.items() for name, p in named.items()}
    found = weighted_quantiles(long, ["policy", "metric"], "value", "row_weight", {name: p for name, (_, p) in ps.items()})
    found = found.groupBy("policy").agg(*[F.max(F.when(F.col("metric") == v, F.col(name))).alias(name) for name, (v, _) in ps.items()])
    out = out.join(F.broadcast(found), "policy", "left")  # a row a policy
    return out.withColumn("p50_total_tps", F.when(~F.col("_no_tps"), F.col("p50_total_tps"))).drop("_no_tps")


def gates(metrics: DataFrame, limits: list[tuple[str, str, float]]) -> DataFrame:
    """(policy, gate, actual, threshold, pass) in the limits' order; a null value fails, save a zero capacity threshold."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("gate"), F.col(m).cast("double").alias("actual"), F.lit(op).alias("op"), F.lit(float(t)).alias("threshold")) for i, (m, op, t) in enumerate(limits)])
    rows = metrics.select("policy", F.explode(each).alias("g")).select("policy", "g.*")
    met = F.when(F.col("op") == ">=", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold"))
    off = (F.col("gate") == "p50_total_tps") & F.col("actual").isNull() & (F.col("threshold") == 0)
    return rows.withColumn("pass", F.coalesce(met, F.lit(False)) | off)


def pareto(metrics: DataFrame, higher: list[str], lower: list[str]) -> DataFrame:
    """Rows that no other row beats: at least as good in all objectives and better in one.  Equal rows stand together."""
    goals = [*higher, *lower]
    points = F.broadcast(metrics.select(*[F.col(g).alias(f"o_{g}") for g in goals]).distinct())  # one row per policy at most
    worse = [(F.col(f"o_{g}") >= F.col(g)) for g in higher] + [(F.col(f"o_{g}") <= F.col(g)) for g in lower]
    better = [(F.col(f"o_{g}") > F.col(g)) for g in higher] + [(F.col(f"o_{g}") < F.col(g)) for g in lower]
    every, some = worse[0], better[0]
    for x in worse[1:]:
        every = every & x
    for x in better[1:]:
        some = some | x
    return metrics.join(points, every & some, "left_anti")


def select_policy(metrics: DataFrame, passing: DataFrame) -> DataFrame:
    """The passing policy of least cost, then p95 latency, then name."""
    return metrics.join(F.broadcast(passing), "policy", "left_semi").orderBy("cost_per_request", "p95_e2e", "policy").limit(1)


def rejected_rank(gated: DataFrame) -> DataFrame:
    """Failing policies, the most promising first: fewest failures, least summed breach, name; with the gate of the largest breach.

    Breaches are decimals of nine places, so no order of addition shows; a gate without a value breaches without bound.
    """
    gap = F.when(F.col("op") == ">=", F.col("threshold") - F.col("actual")).otherwise(F.col("actual") - F.col("threshold"))
    size = F.round(gap / F.greatest(F.abs("threshold"), F.abs("actual"), F.lit(1e-12)), 9).cast("decimal(30,9)")
    failed = gated.where(~F.col("pass")).withColumn("breach", size)
    largest = F.max_by("gate", F.struct(F.col("breach").isNull().alias("none"), "breach", (-F.col("place")).alias("first")))
    total = F.when(F.max(F.col("breach").isNull()), F.lit(float("inf"))).otherwise(F.sum("breach").cast("double"))
    out = failed.groupBy("policy").agg(F.count("*").alias("failures"), total.alias("total"), largest.alias("dominant_gate"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("failures", "total", "policy")))  # policies are few


def case_effects(rows: DataFrame, control: str, scale=lambda x: x) -> DataFrame:
    """(policy, case, group, effect): the median over replicates of candidate minus control, each put through ``scale``."""
    base = rows.where(F.col("policy") == control).select("case_id", "replicate", F.col("score").alias("base"))
    both = rows.where(F.col("policy") != control).join(base, ["case_id", "replicate"])
    return both.groupBy("policy", "case_id").agg(F.first("group_id").alias("group_id"), F.first("weight").alias("weight"), F.median(scale(F.col("score") - F.col("base"))).alias("effect"))


def paired_effects(pairs: DataFrame, policies: DataFrame, critical: list[str], scale=lambda x: x) -> DataFrame:
    """``case_effects`` of all policies against the expert, which stands beside the primary in every pair.

    A pair's two effects, the primary's and the expert's own, hold for every policy, which only picks; so the pairs are gathered by
    case once (a case's replicates in a row), and the policies are applied to cases, not joined to replayed rows.
    """
    c = F.col
    scored = lambda side: F.when(c(f"{side}_status") == "failure", F.lit(0.0)).otherwise(c(f"{side}_score"))
    always = (c("p_status") == "failure") | c("p_confidence").isNull() | F.coalesce(c("slice").isin(*critical), F.lit(False))
    each = F.struct(scale(scored("p") - scored("e")).alias("own"), scale(scored("e") - scored("e")).alias("none"), always.alias("always"), c("p_confidence").alias("sure"), c("input_tokens").alias("long"))
    cases = pairs.where(c("case_id").isNotNull() & c("replicate").isNotNull()).groupBy("case_id").agg(F.first("group_id").alias("group_id"), F.first("weight").alias("weight"), F.collect_list(each).alias("each"))
    rows = cases.crossJoin(F.broadcast(policies.where(c("kind") != "expert-only")))

    def effect(x: Column) -> Column:
        leaves = (c("kind") == "cascade") & (x["always"] | (x["sure"] < c("min_confidence")) | (x["long"] >= c("max_tokens")))
        return F.when(leaves, x["none"]).otherwise(x["own"])

    rows = rows.select("policy", "case_id", "group_id", "weight", F.sort_array(F.filter(F.transform("each", effect), lambda v: v.isNotNull())).alias("s"))
    low, high = F.get("s", F.floor((F.size("s") - 1) / 2).cast("int")), F.get("s", F.floor(F.size("s") / 2).cast("int"))
    return rows.select("policy", "case_id", "group_id", "weight", F.when(low == high, low).otherwise(low * 0.5 + high * 0.5).alias("effect"))


def grouped_bootstrap(effects: DataFrame, key: str, group: str, effect: str, weight: str, iterations: int, alpha: float, seed: int) -> DataFrame:
    """Per key: estimate and R-7 interval of weighted means over groups drawn with replacement.

    Draw k of iteration b is number b * groups + k of the generator, so all draws are made side by side.  Sums are over
    whole numbers (effects and weights are scaled to such by the caller), so no order of addition shows.  Groups are numbered by
    ranges, so no task holds all groups of a key.
    """
    return bootstrap_of_groups(effects.groupBy(key, group).agg(F.sum(F.col(effect) * F.col(weight)).alias("num"), F.sum(weight).alias("mass")), key, group, iterations, alpha, seed)


def bootstrap_of_groups(per: DataFrame, key: str, group: str, iterations: int, alpha: float, seed: int) -> DataFrame:
    """``grouped_bootstrap`` of each group's ``num``, the sum of effects times weights, and ``mass``, the sum of weights."""
    per = cut(number_within(per, [key], [group], "at", "groups"))
    sizes = per.select(key, "groups").distinct()
    draws = sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("_k", F.explode(F.expr("sequence(0, CAST(groups AS INT) - 1)")))
    draws = draws.withColumn("at", F.floor(draw(F.col("_b").cast("bigint") * F.col("groups") + F.col("_k"), seed) * F.col("groups")))
    each = draws.join(per.select(key, "at", "num", "mass"), [key, "at"]).groupBy(key, "_b").agg((F.sum("num") / F.sum("mass")).alias("estimate"))
    spread = each.groupBy(key).agg(F.sort_array(F.collect_list("estimate")).alias("s"))  # as many as iterations
    point = per.groupBy(key).agg((F.sum("num") / F.sum("mass")).alias("estimate"), F.count("*").alias("groups"))
    return point.join(spread, key).select(key, "estimate", "groups", r7(F.col("s"), alpha / 2).alias("lo"), r7(F.col("s"), 1 - alpha / 2).alias("hi"))
