"""Queries by name over the driver's tables, with SQL that gives the same rows.

Lineitems stand for replicates of orders (cases): the order's customer is the group, its rounded price the traffic weight
(times 27,720, which the usual numbers of replicates divide, so that weights stay whole), its priority the slice.  The
expert always succeeds; the primary fails on returned lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import prng, sampling, stats
from ..functions.lineage import cut, stored
from ..operators import evidence, replay, window
from ..sources import decoders

CRITICAL = ["1-URGENT"]
CONFIDENCES, TOKENS = [0.3, 0.6], [500, 1500]
LIMITS = [("mean_score", ">=", 0.95), ("slice_0", ">=", 0.95), ("p95_ttft", "<=", 250.0), ("p95_e2e", "<=", 1100.0), ("p10_tps", ">=", 10.0), ("p50_total_tps", ">=", 0.0), ("error_rate", "<=", 0.05), ("cost_per_request", "<=", 8.0)]
#: The gates that need the pairs with the expert (A18), thresholds of the reference's synthetic spec and its defaults.
PAIRED = [("paired_quality", ">=", -0.08), ("independent_groups", ">=", 3), ("slice_groups_0", ">=", 1)]
DEVELOPMENT = [("cost_improvement", ">=", 0.15)]
EVERY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SPLIT = ("evenkeel/group-bucket/1", "sha256-group-bucket-1", "seed-1", 10)
SAMPLE = ("evenkeel/window-bucket/1", "sha256-window-bucket-1", "seed-2", 2500)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_split(split: str):
    """Whether a customer's group falls into a split."""
    domain, algorithm, seed, n = SPLIT
    bucket = sampling.group_bucket(domain, algorithm, seed, F.concat(F.lit("group-"), F.col("o_custkey").cast("string")), n)
    return F.when(bucket < 8, "dev").otherwise("holdout") == split


def pairs(spark, sf_dir, split: str | None = None, orders: DataFrame | None = None, more: list[str] | tuple = ()) -> DataFrame:
    """Primary and expert executions side by side, one row per replicate; those of one split of the groups, or all.

    ``orders`` may stand for the table of that name, with columns of its own, ``more``.
    """
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*EVERY)).cast("bigint")
    rows = _t(spark, sf_dir, "lineitem").withColumn("replicate", place).join(_t(spark, sf_dir, "orders") if orders is None else orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.where(_in_split(split)) if split else rows
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return rows.select(
        F.col("l_orderkey").alias("case_id"), "replicate", F.col("o_custkey").alias("group_id"), (F.round("o_totalprice") * 27720.0).alias("weight"),
        F.col("o_orderpriority").alias("slice"), F.col("l_partkey").alias("input_tokens"),
        F.when(F.col("l_returnflag") == "R", "failure").otherwise("success").alias("p_status"), F.round(1 - F.col("l_discount"), 2).alias("p_score"),
        F.when(F.col("l_linenumber") != 7, F.round(F.col("l_discount") * 10, 1)).alias("p_confidence"),
        (q * 2).alias("p_ttft"), (q * 8).alias("p_e2e"), (100 - q).alias("p_tps"), (price * 5e-5).alias("p_cost"),
        F.lit("success").alias("e_status"), F.round(1 - F.col("l_tax"), 2).alias("e_score"), (q * 4).alias("e_ttft"), (q * 20).alias("e_e2e"), (60 - q).alias("e_tps"), (price * 2e-4).alias("e_cost"), *more,
    )


_PAIRS = f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(EVERY)}) AS replicate FROM lineitem),
pairs AS (
  SELECT l_orderkey AS case_id, replicate, o_custkey AS group_id, round(o_totalprice) * 27720.0::DOUBLE AS weight, o_orderpriority AS slice,
    l_partkey AS input_tokens, CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END AS p_status, round(1 - l_discount, 2) AS p_score,
    CASE WHEN l_linenumber != 7 THEN round(l_discount * 10, 1) END AS p_confidence, l_quantity * 2 AS p_ttft, l_quantity * 8 AS p_e2e,
    100 - l_quantity AS p_tps, l_extendedprice * 5e-5::DOUBLE AS p_cost, 'success' AS e_status, round(1 - l_tax, 2) AS e_score,
    l_quantity * 4 AS e_ttft, l_quantity * 20 AS e_e2e, 60 - l_quantity AS e_tps, l_extendedprice * 2e-4::DOUBLE AS e_cost
  FROM placed JOIN orders ON l_orderkey = o_orderkey)"""

_POLICIES = "policies(policy, kind, min_confidence, max_tokens) AS (VALUES ('expert-only', 'expert-only', NULL, NULL), ('fast-only', 'fast-only', NULL, NULL), " + ", ".join(f"('cascade-{c:g}-{t}', 'cascade', {c}::DOUBLE, {t})" for c in CONFIDENCES for t in TOKENS) + ")"

_REPLAY = f"""{_PAIRS}, {_POLICIES},
led AS (
  SELECT *, kind = 'cascade' AND (p_status = 'failure' OR p_confidence IS NULL OR p_confidence < min_confidence OR input_tokens >= max_tokens
    OR slice IN ('1-URGENT')) AS escalated
  FROM pairs, policies),
picked AS (SELECT *, kind = 'expert-only' OR escalated AS x FROM led),
rows_ AS (
  SELECT policy, kind, case_id, replicate, group_id, slice, weight, escalated, CASE WHEN x THEN e_status ELSE p_status END AS status,
    CASE WHEN x THEN e_score WHEN p_status = 'failure' THEN 0 ELSE p_score END AS score,
    CASE WHEN escalated THEN p_e2e ELSE 0 END + CASE WHEN x THEN e_ttft WHEN p_status = 'failure' THEN p_e2e ELSE p_ttft END AS ttft,
    CASE WHEN escalated THEN p_e2e ELSE 0 END + CASE WHEN x THEN e_e2e ELSE p_e2e END AS e2e,
    CASE WHEN x THEN e_tps WHEN p_status = 'failure' THEN 0 ELSE p_tps END AS tps,
    CASE WHEN kind = 'cascade' THEN NULL WHEN x THEN e_tps WHEN p_status = 'failure' THEN NULL ELSE p_tps END AS total_tps,
    CASE WHEN x THEN e_cost ELSE p_cost END + CASE WHEN escalated THEN p_cost ELSE 0 END AS cost
  FROM picked)"""

_QUANTILE_SQL = ",\n".join(
    f"q_{v} AS (SELECT policy, {', '.join(f'min(v) FILTER (u >= {p}::DOUBLE * t) AS {n}' for n, p in ps.items())} FROM (SELECT policy, v, sum(w) OVER (PARTITION BY policy ORDER BY v) AS u, sum(w) OVER (PARTITION BY policy) AS t FROM (SELECT policy, {v} AS v, sum(row_weight) AS w FROM weighed WHERE {v} IS NOT NULL GROUP BY ALL)) GROUP BY policy)"
    for v, ps in replay.QUANTILES.items()
)
_METRICS = f"""{_REPLAY},
weighed AS (SELECT *, weight / count(*) OVER (PARTITION BY policy, case_id) AS row_weight FROM rows_),
means AS (
  SELECT policy, sum(score * row_weight) / sum(row_weight) AS mean_score, sum(CASE WHEN status = 'failure' THEN row_weight ELSE 0 END) / sum(row_weight) AS error_rate,
    sum(cost * row_weight) / sum(row_weight) AS cost_per_request, sum(CASE WHEN escalated THEN row_weight ELSE 0 END) / sum(row_weight) AS escalation_rate,
    sum(score * row_weight) FILTER (slice = '1-URGENT') / sum(row_weight) FILTER (slice = '1-URGENT') AS slice_0, bool_or(total_tps IS NULL) AS no_tps
  FROM weighed GROUP BY policy),
{_QUANTILE_SQL},
metrics AS (
  SELECT means.* EXCLUDE (no_tps), p50_ttft, p95_ttft, p50_e2e, p95_e2e, p99_e2e, p10_tps, CASE WHEN NOT no_tps THEN p50_total_tps END AS p50_total_tps
  FROM means LEFT JOIN q_ttft USING (policy) LEFT JOIN q_e2e USING (policy) LEFT JOIN q_tps USING (policy) LEFT JOIN q_total_tps USING (policy))"""
_ROUNDED = ["mean_score", "error_rate", "cost_per_request", "escalation_rate", "slice_0"]
_SHOWN = [*_ROUNDED, "p50_ttft", "p95_ttft", "p50_e2e", "p95_e2e", "p99_e2e", "p10_tps", "p50_total_tps"]
_SHOW = "policy, " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in _SHOWN)
def _policies(spark):
    return replay.enumerate_policies(spark, CONFIDENCES, TOKENS)


def _replayed(spark, sf_dir, split=None):
    return replay.replay(replay.row_weights(pairs(spark, sf_dir, split), ["case_id"]), _policies(spark), CRITICAL)


def _metrics(spark, sf_dir, split=None):
    return replay.policy_metrics(_replayed(spark, sf_dir, split), CRITICAL)


def _gated(spark, sf_dir):
    return replay.gates(_metrics(spark, sf_dir), LIMITS)


def _assessed(spark, sf_dir, split=None, every=None, metrics=None):
    """All gates of every policy in the inventory's order; the expert, which has no pairs, fails them and is no candidate."""
    return _measured_and_gated(spark, sf_dir, split, every, metrics)[1]


def _measured_and_gated(spark, sf_dir, split=None, every=None, metrics=None):
    """(metrics, gates): the pairs are joined and stored once, and metrics, effects and coverage are read off their columns."""
    paired = stored(replay.row_weights(pairs(spark, sf_dir, split), ["case_id"]))
    metrics = cut(replay.policy_metrics(replay.replay(paired, _policies(spark), CRITICAL), CRITICAL) if metrics is None else metrics)  # a row a policy
    quality = _bootstrap(spark, sf_dir, split, paired).select("policy", (F.col("lo") / 20000).alias("paired_quality"), F.col("groups").alias("independent_groups"))
    groups = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_nationkey").alias("nation"))
    critical = paired.where(F.col("slice").isin(*CRITICAL)).select("group_id", "slice").distinct()
    covered = critical.join(groups, "group_id").agg(*[F.countDistinct(F.when(F.col("slice") == s, F.col("nation"))).alias(f"slice_groups_{i}") for i, s in enumerate(CRITICAL)])
    base = metrics.where("policy = 'expert-only'").select(F.col("cost_per_request").alias("base"))
    wide = metrics.join(quality, "policy", "left").crossJoin(F.broadcast(covered)).crossJoin(F.broadcast(base))
    return metrics, cut(replay.gates(wide.withColumn("cost_improvement", F.try_divide(F.col("base") - F.col("cost_per_request"), F.col("base"))), every or [*PAIRED, *LIMITS, *DEVELOPMENT]))


def replay_v1(spark, sf_dir):
    rows = _replayed(spark, sf_dir)
    return rows.groupBy("policy", "status", "escalated").agg(F.count("*").alias("n"), F.sum("ttft").cast("bigint").alias("ttft"), F.sum("e2e").cast("bigint").alias("e2e"), F.round(F.sum("cost"), 3).alias("cost"), F.sum(F.round(F.col("score") * 100).cast("bigint")).alias("score"))


def row_weight(spark, sf_dir):
    rows = replay.row_weights(pairs(spark, sf_dir), ["case_id"])
    return rows.select("case_id", "replicate", F.round("row_weight", 4).alias("row_weight"))


def policy_metrics_v1(spark, sf_dir):
    return _metrics(spark, sf_dir).select("policy", *[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in _SHOWN])


def gates_v1(spark, sf_dir):
    return _assessed(spark, sf_dir).select("policy", "gate", F.round("actual", 6).alias("actual"), "threshold", "pass")


def cost_improvement(spark, sf_dir):
    cost = _metrics(spark, sf_dir).select("policy", "cost_per_request")
    base = cost.where("policy = 'expert-only'").select(F.col("cost_per_request").alias("base"))
    return cost.crossJoin(F.broadcast(base)).select("policy", F.round(F.try_divide(F.col("base") - F.col("cost_per_request"), F.col("base")), 6).alias("improvement"))


_GOALS = (["mean_score", "p10_tps"], ["error_rate", "p95_ttft", "p95_e2e", "cost_per_request"])


def _rounded(metrics):
    return metrics.select("policy", *[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in _SHOWN])


def pareto_frontier(spark, sf_dir):
    return replay.pareto(cut(_rounded(_metrics(spark, sf_dir))), *_GOALS).select("policy")


def select_policy(spark, sf_dir):
    """The choice among the frontier of the policies that pass all gates; no row where none does."""
    metrics, gated = _measured_and_gated(spark, sf_dir)
    passing = gated.groupBy("policy").agg(F.min("pass").alias("ok")).where("ok").select("policy")
    metrics = _rounded(metrics).join(F.broadcast(passing), "policy", "left_semi")
    return replay.select_policy(metrics, replay.pareto(metrics, *_GOALS).select("policy")).select("policy", "cost_per_request", "p95_e2e")


def rejected_candidate_rank(spark, sf_dir):
    return replay.rejected_rank(_assessed(spark, sf_dir)).select("policy", "failures", F.round("total", 6).alias("total"), "dominant_gate", "place")


def _effects(spark, sf_dir, split=None, paired=None):
    paired = pairs(spark, sf_dir, split) if paired is None else paired
    return replay.paired_effects(paired, _policies(spark), CRITICAL, lambda x: F.round(x * 10000))


def case_effects(spark, sf_dir):
    return _effects(spark, sf_dir).select("policy", "case_id", "group_id", "effect")


def _by_nation(spark, sf_dir, split=None, paired=None):
    effects = _effects(spark, sf_dir, split, paired)
    groups = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_nationkey").alias("nation"))
    whole = effects.join(groups, "group_id").withColumn("twice", (F.col("effect") * 2).cast("bigint")).withColumn("w", (F.col("weight") / 27720).cast("bigint"))
    return whole.select("policy", "nation", "twice", "w")


def _bootstrap(spark, sf_dir, split=None, paired=None):
    return replay.grouped_bootstrap(_by_nation(spark, sf_dir, split, paired), "policy", "nation", "twice", "w", 200, 0.05, 42)


def grouped_bootstrap(spark, sf_dir):
    return _bootstrap(spark, sf_dir).select("policy", *[F.round(F.col(c) / 20000, 9).alias(c) for c in ("estimate", "lo", "hi")], "groups")


def mean_bootstrap(spark, sf_dir):
    """Plain mean of the nations' customers' balances, drawn by the same generator."""
    vals = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("v")).select(F.lit("all").alias("k"), F.col("c_nationkey").alias("g"), "v", F.lit(1).alias("one"))
    out = replay.grouped_bootstrap(vals, "k", "g", "v", "one", 100, 0.1, 7)
    return out.select(*[F.round(c, 4).alias(c) for c in ("estimate", "lo", "hi")], "groups")


def weighted_quantiles(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("w"))
    return stats.weighted_quantiles(rows, ["l_returnflag"], "l_extendedprice", "w", {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99})


def r7_quantiles(spark, sf_dir):
    """Linear quantiles, median, mean and maximum, as the benchmark summaries have them."""
    e = _t(spark, sf_dir, "events")
    ps = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    found = stats.r7_quantiles(e, ["event_type"], "value", ps).select("event_type", *[F.round(n, 8).alias(n) for n in ps])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.round(F.avg("value"), 8).alias("mean")).join(F.broadcast(found), "event_type")


def slice_group_coverage(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.groupBy("slice").agg(F.count("*").alias("replicates"), F.countDistinct("case_id").alias("cases"), F.countDistinct("group_id").alias("groups"), F.count_if(F.col("p_status") == "failure").alias("failures"))


def evidence_coverage(spark, sf_dir):
    """Traffic mass by case, once a case, and counts by split."""
    domain, algorithm, seed, n = SPLIT
    cases = pairs(spark, sf_dir).groupBy("case_id").agg(F.max("group_id").alias("group_id"), F.max("weight").alias("weight"), F.count("*").alias("replicates"))
    bucket = sampling.group_bucket(domain, algorithm, seed, F.concat(F.lit("group-"), F.col("group_id").cast("string")), n)
    return cases.withColumn("split", F.when(bucket < 8, "dev").otherwise("holdout")).groupBy("split").agg(F.count("*").alias("cases"), F.sum("replicates").alias("replicates"), F.countDistinct("group_id").alias("groups"), F.sum(F.col("weight") / 27720).cast("bigint").alias("mass"))


def group_split_bucket(spark, sf_dir):
    domain, algorithm, seed, n = SPLIT
    bucket = sampling.group_bucket(domain, algorithm, seed, F.concat(F.lit("group-"), F.col("c_custkey").cast("string")), n)
    return _t(spark, sf_dir, "customer").select("c_custkey", bucket.alias("bucket"), F.when(bucket < 8, "dev").otherwise("holdout").alias("split"))


def window_sample_bucket(spark, sf_dir):
    domain, algorithm, seed, points = SAMPLE
    bucket = sampling.window_bucket(domain, algorithm, seed, F.concat(F.lit("case-"), F.col("event_id").cast("string")), F.concat(F.lit("replicate-"), F.col("user_id").cast("string")))
    return _t(spark, sf_dir, "events").select("event_id", bucket.alias("bucket"), (bucket < points).alias("selected"))


def split_leakage(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "group_id")
    return evidence.leakage(o.where("o_orderdate < TIMESTAMP_NTZ '1996-01-01'"), o.where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'"), "group_id")


def trace_dedup_conflict(spark, sf_dir):
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_returnflag")]), 256)
    rows = _t(spark, sf_dir, "lineitem").withColumn("digest", digest)
    return evidence.dedup_conflicts(rows, ["l_orderkey", "l_linenumber"], "digest")


_KEY = ["case_id", "replicate", "output"]


def _executions(spark, sf_dir):
    p = pairs(spark, sf_dir)
    output = F.when(F.col("p_status") == "success", F.col("case_id") * 100 + F.col("replicate"))
    at = F.timestamp_add("SECOND", (F.col("input_tokens") % 1000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return p.select("case_id", "replicate", output.alias("output"), F.col("p_status").alias("status"), F.when(F.col("input_tokens") % 97 == 0, "sent_unknown").otherwise("sent").alias("dispatch"), at.alias("completed_at"), "input_tokens", "p_score")


def _evidence(spark, sf_dir):
    """A perturbed copy: some missing, some for another output, some too old, some abstained, some for no trace."""
    e = _executions(spark, sf_dir).where("input_tokens % 11 != 0")
    output = F.when(F.col("input_tokens") % 13 == 0, F.col("case_id") * 100 + 99).otherwise(F.coalesce("output", F.col("case_id") * 100))
    old = F.when(F.col("input_tokens") % 17 == 0, -5).otherwise(5)
    case = F.when(F.col("input_tokens") % 29 == 0, -F.col("case_id") - 1).otherwise(F.col("case_id"))
    kind = F.when(F.col("input_tokens") % 7 == 0, "abstained").otherwise("scored")
    return e.select(case.alias("case_id"), "replicate", output.alias("output"), F.timestamp_add("SECOND", old, F.col("completed_at")).alias("produced_at"), kind.alias("kind"), F.col("p_score").alias("score"))


_EVIDENCE = f"""{_PAIRS},
ex AS (
  SELECT case_id, replicate, CASE WHEN p_status = 'success' THEN case_id * 100 + replicate END AS output, p_status AS status,
    CASE WHEN input_tokens % 97 = 0 THEN 'sent_unknown' ELSE 'sent' END AS dispatch, input_tokens % 1000 AS completed, input_tokens, p_score FROM pairs),
ev AS (
  SELECT CASE WHEN input_tokens % 29 = 0 THEN -case_id - 1 ELSE case_id END AS case_id, replicate,
    CASE WHEN input_tokens % 13 = 0 THEN case_id * 100 + 99 ELSE coalesce(output, case_id * 100) END AS output,
    completed + CASE WHEN input_tokens % 17 = 0 THEN -5 ELSE 5 END AS produced, CASE WHEN input_tokens % 7 = 0 THEN 'abstained' ELSE 'scored' END AS kind, p_score AS score
  FROM ex WHERE input_tokens % 11 != 0)"""


def evidence_join_outcomes(spark, sf_dir):
    return evidence.outcomes(_executions(spark, sf_dir), _evidence(spark, sf_dir), _KEY)


def orphan_reasons(spark, sf_dir):
    out = evidence.orphan_reasons(_executions(spark, sf_dir), _evidence(spark, sf_dir), _KEY, ["case_id", "replicate"])
    return out.select("case_id", "replicate", "output", "reason")


def pair_completeness(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return evidence.pair_completeness(li, ["l_orderkey"], ["A", "N", "R"], "l_returnflag")


def metadata_consistency(spark, sf_dir):
    return evidence.inconsistent(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_linestatus", "l_returnflag"])


def matrix_completeness(spark, sf_dir):
    return evidence.matrix_gaps(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", ["F", "O"])


def timing_plausibility(spark, sf_dir):
    """Total time of at least the first token's, and room for the rest at the rate seen."""
    p = pairs(spark, sf_dir).withColumn("decode", (F.col("input_tokens") - 1) / F.col("p_tps") * 1000)
    late = F.col("p_e2e") + F.greatest(F.lit(100.0), 0.2 * F.col("decode")) < F.col("p_ttft") + F.col("decode")
    return p.select("case_id", "replicate", F.when(F.col("p_e2e") < F.col("p_ttft"), "e2e-before-ttft").when((F.col("input_tokens") > 1) & late, "decode-too-slow").alias("problem"))


def _windowed(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("completed_at", F.timestamp_add("SECOND", (F.col("event_id") % 7200).cast("int"), F.col("ts")))
    return window.classify(e, "2024-01-05 00:00:00", "2024-01-15 00:00:00", "2024-01-15 00:30:00")


def sealed_window(spark, sf_dir):
    return _windowed(spark, sf_dir).select("event_id", F.coalesce("reason", F.lit("inside")).alias("reason"))


def late_rows(spark, sf_dir):
    return _windowed(spark, sf_dir).where("reason = 'late'").select("event_id", "user_id", "event_type")


def event_chain_check(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("parent", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    broken = F.when(F.col("event_id") % 50 == 0, F.col("event_id") + 1).otherwise(F.col("parent"))
    return evidence.chain_breaks(e.withColumn("parent", broken), "user_id", ["ts", "event_id"], "event_id", "parent").select("event_id", "user_id", "parent", "expected")


def counterbalance_order(spark, sf_dir):
    cases = pairs(spark, sf_dir).select("case_id", "replicate")
    return evidence.counterbalanced(cases, ["a", "b", "c"], "seed-3").select("case_id", "replicate", F.array_join("profiles", ",").alias("profiles"))


def replicate_fanout(spark, sf_dir):
    """Cases by replicates by profiles that the window's sample selects, counted by profile."""
    domain, algorithm, seed, points = SAMPLE
    cases = _t(spark, sf_dir, "orders").select(F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")).alias("case_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r"))
    bucket = sampling.window_bucket(domain, algorithm, seed, F.col("case_id"), F.concat(F.lit("replicate-"), F.col("r").cast("string")))
    kept = cases.where(bucket < points).withColumn("profile", F.explode(F.array(F.lit("expert"), F.lit("primary"))))
    return kept.groupBy("profile", "r").agg(F.count("*").alias("executions"))


_KEYS = "(1, '2024-01-01', '2024-01-20', NULL, 'click'), (2, '2024-01-10', '2024-02-01', NULL, 'view'), (3, '2024-01-01', '2024-02-01', '2024-01-12', 'error'), (4, '2024-01-01', '2024-02-01', NULL, 'purchase')"


def trust_status(spark, sf_dir):
    keys = spark.sql(f"SELECT key_id, CAST(a AS TIMESTAMP_NTZ) AS valid_from, CAST(b AS TIMESTAMP_NTZ) AS valid_to, CAST(c AS TIMESTAMP_NTZ) AS revoked_at, purpose FROM VALUES {_KEYS} AS t(key_id, a, b, c, purpose)")
    rows = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).cast("int").alias("key_id"), F.col("ts").alias("produced_at"), F.col("event_type").alias("kind"), (F.col("event_id") % 23 != 0).alias("signature_ok"))
    return evidence.trust_status(rows, keys, "2024-01-25 00:00:00", 20 * 86400, 30).select("event_id", F.col("trust").alias("status"))


def set_digest(spark, sf_dir):
    return evidence.set_digest(_t(spark, sf_dir, "events").withColumn("member", F.sha2(F.col("event_id").cast("string"), 256)), ["event_type"], "member")


_CLASS = "CASE WHEN l_tax > 0.06 THEN 3 WHEN l_discount > 0.08 THEN 2 WHEN l_discount > 0.04 THEN 1 ELSE 0 END"


def evidence_class_rollup(spark, sf_dir):
    """The weakest class of each supplier's rows; costs are null where one of them has none."""
    rank = F.max(F.expr(_CLASS))
    names = F.element_at(F.array(*map(F.lit, ("measured", "reported", "modeled", "unavailable"))), rank + 1)
    cost = F.when(F.count_if(F.col("l_tax") > 0.079) == 0, F.round(F.sum("l_extendedprice"), 2))
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(names.alias("weakest"), cost.alias("cost"))


def work_estimate(spark, sf_dir):
    """Rows, candidates, draws and their product, before any replay."""
    li = _t(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("cases"))
    return li.select("rows", "cases", (F.col("rows") * 6).alias("replays"), (F.lit(200).cast("bigint") * 25).alias("draws"), (F.col("rows") * 6 + 200 * 25 * 6).alias("work"))


def policy_metrics_v2(spark, sf_dir):
    """Pre-dispatch routing: a true predicate runs the expert alone; the primary's failure alone adds a serial expert."""
    p = pairs(spark, sf_dir)
    routed = F.col("p_confidence").isNull() | (F.col("p_confidence") < 0.6)
    both = ~routed & (F.col("p_status") == "failure")
    x = routed | both
    rows = p.select(
        F.lit("route").alias("policy"), "case_id", "replicate", "weight", "slice",
        F.when(x, F.col("e_score")).otherwise(F.col("p_score")).alias("score"), x.alias("expert"), both.alias("serial"),
        (F.when(both, F.col("p_e2e")).otherwise(0) + F.when(x, F.col("e_ttft")).otherwise(F.col("p_ttft"))).alias("ttft"),
        (F.when(both, F.col("p_e2e")).otherwise(0) + F.when(x, F.col("e_e2e")).otherwise(F.col("p_e2e"))).alias("e2e"),
        (F.when(x, F.col("e_cost")).otherwise(F.lit(0.0)) + F.when(routed, F.lit(0.0)).otherwise(F.col("p_cost"))).alias("cost"),
    )
    rows = replay.row_weights(rows, ["policy", "case_id"])
    w = F.col("row_weight")
    out = rows.groupBy("policy").agg(F.round(stats.weighted_mean(F.col("score"), w), 6).alias("mean_score"), F.round(stats.weighted_mean(F.col("cost") * 1000, w), 4).alias("cost_per_thousand"), F.round(stats.weighted_mean(F.col("expert").cast("double"), w), 6).alias("expert_share"), F.round(stats.weighted_mean(F.col("serial").cast("double"), w), 6).alias("serial_share"))
    for v in ("ttft", "e2e"):
        out = out.join(stats.weighted_quantiles(rows, ["policy"], v, "row_weight", {f"p95_{v}": 0.95}), "policy")
    return out


def json_metrics_unpivot(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count("*").alias("n")).select("event_type", F.explode(F.create_map(F.lit("k"), F.col("k"), F.lit("n"), F.col("n"))).alias("metric", "value"))


def prometheus_parse(spark, sf_dir):
    """Samples written from the events in text format, then scanned back."""
    e = _t(spark, sf_dir, "events")
    line = F.concat(F.lit('events_value{type="'), F.col("event_type"), F.lit('",user="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("event_id").cast("string"), F.lit(" "), (F.col("event_id") * 1000).cast("string"))
    got = decoders.prometheus(e.select(line.alias("line")), "line")
    return got.groupBy("metric", F.col("labels")["type"].alias("type")).agg(F.count("*").alias("samples"), F.sum("value").cast("bigint").alias("total"), F.max("timestamp_ms").alias("last"), F.count_if("bad").alias("bad"))


def sse_parse(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    body = F.concat(F.lit("event: "), F.col("event_type"), F.lit("\r\nid: "), F.col("event_id").cast("string"), F.lit("\r\ndata: "), F.col("props"), F.lit("\ndata: x\n\n: note\ndata: [DONE]\n\n"))
    got = decoders.sse(e.select(F.col("event_id").alias("stream"), body.alias("body")), "stream", "body")
    return got.select("stream", "place", "event", "id", "data")


def address_class(spark, sf_dir):
    octet = lambda i: F.pmod(F.shiftright(F.col("event_id") * 2654435761, 8 * i), F.lit(256)).cast("string")
    rows = _t(spark, sf_dir, "events").select("event_id", F.concat_ws(".", octet(3), octet(2), octet(1), octet(0)).alias("address"))
    return rows.select("event_id", "address", decoders.address_class(F.col("address")).alias("kind"))


def route_match(spark, sf_dir):
    """The longest prefix that matches each path."""
    routes = spark.sql("SELECT * FROM VALUES ('/', 'root'), ('/cl', 'c'), ('/click', 'click'), ('/v', 'v'), ('/click/1', 'one') AS t(prefix, route)")
    rows = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string")).alias("path"))
    both = rows.join(F.broadcast(routes), F.startswith(F.col("path"), F.col("prefix")))
    return both.groupBy("event_id").agg(F.max_by("route", F.length("prefix")).alias("route"))


def error_redaction(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("event_type = 'error'")
    category = F.when(F.col("value") > 100, "transport").when(F.col("user_id") % 3 == 0, "timeout").otherwise("provider")
    return decoders.redact(e.select("event_id", category.alias("category"), (F.col("user_id") + 90).cast("int").alias("http_status"), F.concat(F.lit("Bearer "), F.col("props")).alias("message")))


def attempt_order(spark, sf_dir):
    """Retries of a user that begin before the one before has ended."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").withColumn("done", F.timestamp_add("SECOND", (F.col("event_id") % 4000).cast("int"), F.col("ts")))
    return e.withColumn("before", F.lag("done").over(by)).where("before > ts").select("event_id", "user_id")


def window_revision_chain(spark, sf_dir):
    """Daily watermarks as revisions: each must not fall below the one before."""
    day = F.date_trunc("DAY", F.col("ts")).cast("date")
    r = _t(spark, sf_dir, "events").groupBy(day.alias("day")).agg(F.max("value").alias("mark"), F.count("*").alias("n"))
    by = Window.orderBy("day")  # one row a day
    return r.select(F.col("day").cast("string").alias("day"), F.row_number().over(by).cast("bigint").alias("revision"), F.coalesce(F.col("mark") >= F.lag("mark").over(by), F.lit(True)).alias("ok"), "n")


def queries() -> dict:
    own = [row_weight, replay_v1, policy_metrics_v1, policy_metrics_v2, gates_v1, cost_improvement, pareto_frontier, select_policy, rejected_candidate_rank, case_effects, grouped_bootstrap, mean_bootstrap, weighted_quantiles, r7_quantiles, slice_group_coverage, evidence_coverage, group_split_bucket, window_sample_bucket, split_leakage, trace_dedup_conflict, evidence_join_outcomes, orphan_reasons, pair_completeness, metadata_consistency, matrix_completeness, timing_plausibility, sealed_window, late_rows, event_chain_check, window_revision_chain, attempt_order, counterbalance_order, replicate_fanout, trust_status, set_digest, evidence_class_rollup, work_estimate, json_metrics_unpivot, prometheus_parse, sse_parse, address_class, route_match, error_redaction]
    return {f.__name__: f for f in own}


def _mod_sql(digest: str, n: int) -> str:
    return f"CAST(list_reduce(list_prepend(0::BIGINT, [CAST(('0x' || substr({digest}, 8 * i + 1, 8)) AS BIGINT) for i in range(8)]), lambda a, x: (a * {(1 << 32) % n} + x % {n}) % {n}) AS BIGINT)"


def _bucket_sql(domain: str, fields: dict[str, str], n: int) -> str:
    body = " || ',' || ".join(f"'\"{k}\":\"' || {v} || '\"'" for k, v in sorted(fields.items()))
    return _mod_sql(f"sha256('{{\"domain\":\"{domain}\",\"value\":{{' || {body} || '}}}}')", n)


_M32 = "4294967295"


def _mul_sql(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) % 4294967296 AS BIGINT)"


def _draw_ctes(source: str, seed: int) -> str:
    """CTEs d0..d3 that add column u, the draw of number n, to ``source``."""
    return f"""d0 AS (SELECT *, CAST(({seed} + CAST(n + 1 AS HUGEINT) * 1831565813) % 4294967296 AS BIGINT) AS s FROM {source}),
d1 AS (SELECT *, {_mul_sql("xor(s, s >> 15)", "(s | 1)")} AS t FROM d0),
d2 AS (SELECT *, xor(t, (t + {_mul_sql("xor(t, t >> 7)", "(t | 61)")}) & {_M32}) AS v FROM d1),
draws AS (SELECT *, xor(v, v >> 14) / 4294967296.0::DOUBLE AS u FROM d2)"""


def _r7_sql(values: str, p: float) -> str:
    at = f"((len({values}) - 1) * {p}::DOUBLE)"
    low, high = f"{values}[CAST(floor({at}) AS BIGINT) + 1]", f"{values}[CAST(ceil({at}) AS BIGINT) + 1]"
    return f"({low} + ({high} - {low}) * ({at} - floor({at})))"


def _bootstrap_sql(key: str, iterations: int, alpha: float, seed: int) -> str:
    return f"""per0 AS (SELECT {key}, g, sum(e * w) AS num, sum(w) AS mass FROM effects GROUP BY ALL),
per AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY g) - 1 AS at, count(*) OVER (PARTITION BY {key}) AS groups FROM per0),
sizes AS (SELECT DISTINCT {key}, groups FROM per),
numbered AS (SELECT {key}, groups, b, b * groups + k AS n FROM sizes, range({iterations}) AS t1(b), unnest(range(groups)) AS t2(k)),
{_draw_ctes("numbered", seed)},
each AS (SELECT draws.{key}, b, CAST(sum(num) AS DOUBLE) / CAST(sum(mass) AS DOUBLE) AS estimate FROM draws JOIN per ON draws.{key} = per.{key} AND CAST(floor(u * draws.groups) AS BIGINT) = per.at GROUP BY ALL),
spread AS (SELECT {key}, list(estimate ORDER BY estimate) AS s FROM each GROUP BY ALL),
point AS (SELECT {key}, CAST(sum(num) AS DOUBLE) / CAST(sum(mass) AS DOUBLE) AS estimate, count(*) AS groups FROM per GROUP BY ALL),
boot AS (SELECT point.{key}, estimate, groups, {_r7_sql("s", alpha / 2)} AS lo, {_r7_sql("s", 1 - alpha / 2)} AS hi FROM point JOIN spread USING ({key}))"""


_EFFECT_CTES = """base AS (SELECT case_id, replicate, score AS base FROM rows_ WHERE policy = 'expert-only'),
case_effects AS (
  SELECT policy, case_id, any_value(group_id) AS group_id, any_value(weight) AS weight, median(round((score - base) * 10000)) AS effect
  FROM rows_ JOIN base USING (case_id, replicate) WHERE policy != 'expert-only' GROUP BY policy, case_id)"""
_EFFECTS = f"{_REPLAY},\n{_EFFECT_CTES}"
_BY_NATION = "effects AS (SELECT policy, c_nationkey AS g, CAST(effect * 2 AS BIGINT) AS e, CAST(weight / 27720 AS BIGINT) AS w FROM case_effects JOIN customer ON group_id = c_custkey)"


def _gated_sql(every=(*PAIRED, *LIMITS, *DEVELOPMENT)) -> str:
    """Gates of all policies, in order; those that need pairs have no value for the expert, which has none."""
    limits = ", ".join(f"({i}, '{m}', '{op}', {float(t)}::DOUBLE)" for i, (m, op, t) in enumerate(every))
    names, values = ", ".join(f"'{m}'" for m, _, _ in every), ", ".join(f"CAST({m} AS DOUBLE)" for m, _, _ in every)
    return f"""{_METRICS},
{_EFFECT_CTES},
{_BY_NATION},
{_bootstrap_sql("policy", 200, 0.05, 42)},
critical_nations AS (SELECT count(DISTINCT c_nationkey) AS slice_groups_0 FROM pairs JOIN customer ON group_id = c_custkey WHERE slice = '1-URGENT'),
expert AS (SELECT cost_per_request AS expert_cost FROM metrics WHERE policy = 'expert-only'),
wide AS (
  SELECT metrics.*, lo / 20000 AS paired_quality, groups AS independent_groups, slice_groups_0, (expert_cost - cost_per_request) / expert_cost AS cost_improvement
  FROM metrics LEFT JOIN boot USING (policy), critical_nations, expert),
limits(place, gate, op, threshold) AS (VALUES {limits}),
long AS (SELECT policy, unnest([{names}]) AS gate, unnest([{values}]) AS actual FROM wide),
gated AS (
  SELECT policy, place, gate, op, actual, threshold, coalesce(CASE WHEN op = '>=' THEN actual >= threshold ELSE actual <= threshold END, FALSE)
    OR (gate = 'p50_total_tps' AND actual IS NULL AND threshold = 0) AS pass
  FROM long JOIN limits USING (gate))"""


def oracle_sql() -> dict[str, str]:
    goals = " AND ".join([f"o.{g} >= m.{g}" for g in _GOALS[0]] + [f"o.{g} <= m.{g}" for g in _GOALS[1]])
    better = " OR ".join([f"o.{g} > m.{g}" for g in _GOALS[0]] + [f"o.{g} < m.{g}" for g in _GOALS[1]])
    rounded = f"{_METRICS}, rounded AS (SELECT {_SHOW} FROM metrics)"
    group = _bucket_sql(SPLIT[0], {"algorithm": f"'{SPLIT[1]}'", "groupId": "'group-' || {id}", "seed": f"'{SPLIT[2]}'"}, SPLIT[3])
    sample = _bucket_sql(SAMPLE[0], {"algorithm": f"'{SAMPLE[1]}'", "caseId": "{case}", "replicateId": "{rep}", "seed": f"'{SAMPLE[2]}'"}, 10_000)
    events_window = "(SELECT *, ts + to_seconds(event_id % 7200) AS completed_at FROM events)"
    reason = "CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'before-window' WHEN ts >= TIMESTAMP '2024-01-15' THEN 'after-window' WHEN completed_at > TIMESTAMP '2024-01-15 00:30:00' THEN 'late' END"
    return {
        "row_weight": f"WITH {_PAIRS} SELECT case_id, replicate, round(weight / count(*) OVER (PARTITION BY case_id), 4) AS row_weight FROM pairs",
        "replay_v1": f"WITH {_REPLAY} SELECT policy, status, escalated, count(*) AS n, CAST(sum(ttft) AS BIGINT) AS ttft, CAST(sum(e2e) AS BIGINT) AS e2e, round(sum(cost), 3) AS cost, CAST(sum(CAST(round(score * 100) AS BIGINT)) AS BIGINT) AS score FROM rows_ GROUP BY ALL",
        "policy_metrics_v1": f"WITH {_METRICS} SELECT {_SHOW} FROM metrics",
        "policy_metrics_v2": f"""WITH {_PAIRS},
r AS (SELECT *, p_confidence IS NULL OR p_confidence < 0.6 AS routed FROM pairs),
b AS (SELECT *, NOT routed AND p_status = 'failure' AS serial FROM r),
x AS (
  SELECT *, routed OR serial AS expert, CASE WHEN serial THEN p_e2e ELSE 0 END + CASE WHEN routed OR serial THEN e_ttft ELSE p_ttft END AS ttft,
    CASE WHEN serial THEN p_e2e ELSE 0 END + CASE WHEN routed OR serial THEN e_e2e ELSE p_e2e END AS e2e, CASE WHEN routed OR serial THEN e_score ELSE p_score END AS score,
    CASE WHEN routed OR serial THEN e_cost ELSE 0 END + CASE WHEN routed THEN 0 ELSE p_cost END AS cost, weight / count(*) OVER (PARTITION BY case_id) AS w
  FROM b),
q AS (SELECT min(v) FILTER (k = 'ttft' AND u >= 0.95::DOUBLE * t) AS p95_ttft, min(v) FILTER (k = 'e2e' AND u >= 0.95::DOUBLE * t) AS p95_e2e FROM (
  SELECT k, v, sum(w) OVER (PARTITION BY k ORDER BY v) AS u, sum(w) OVER (PARTITION BY k) AS t
  FROM (SELECT k, v, sum(w) AS w FROM (SELECT 'ttft' AS k, ttft AS v, w FROM x UNION ALL SELECT 'e2e', e2e, w FROM x) GROUP BY k, v)))
SELECT 'route' AS policy, round(sum(score * w) / sum(w), 6) AS mean_score, round(sum(cost * 1000 * w) / sum(w), 4) AS cost_per_thousand,
  round(sum(CASE WHEN expert THEN w ELSE 0 END) / sum(w), 6) AS expert_share, round(sum(CASE WHEN serial THEN w ELSE 0 END) / sum(w), 6) AS serial_share,
  any_value(p95_ttft) AS p95_ttft, any_value(p95_e2e) AS p95_e2e
FROM x, q""",
        "gates_v1": f"WITH {_gated_sql()} SELECT policy, gate, round(actual, 6) AS actual, threshold, pass FROM gated",
        "cost_improvement": f"WITH {_METRICS} SELECT m.policy, round((b.cost_per_request - m.cost_per_request) / b.cost_per_request, 6) AS improvement FROM metrics m, metrics b WHERE b.policy = 'expert-only'",
        "pareto_frontier": f"WITH {rounded} SELECT policy FROM rounded m WHERE NOT EXISTS (SELECT 1 FROM rounded o WHERE {goals} AND ({better}))",
        "select_policy": f"""WITH {_gated_sql()},
good AS (SELECT {_SHOW} FROM metrics WHERE policy IN (SELECT policy FROM gated GROUP BY policy HAVING bool_and(pass)))
SELECT policy, cost_per_request, p95_e2e FROM good m WHERE NOT EXISTS (SELECT 1 FROM good o WHERE {goals} AND ({better})) ORDER BY cost_per_request, p95_e2e, policy LIMIT 1""",
        "rejected_candidate_rank": f"""WITH {_gated_sql()},
b AS (SELECT *, CAST(round(CASE WHEN op = '>=' THEN threshold - actual ELSE actual - threshold END / greatest(abs(threshold), abs(actual), 1e-12::DOUBLE), 9) AS DECIMAL(30, 9)) AS breach FROM gated WHERE NOT pass),
r AS (
  SELECT policy, count(*) AS failures, CASE WHEN bool_or(breach IS NULL) THEN 'inf'::DOUBLE ELSE CAST(sum(breach) AS DOUBLE) END AS total,
    arg_max(gate, (breach IS NULL, coalesce(breach, 0), -place)) AS dominant_gate
  FROM b GROUP BY policy)
SELECT policy, failures, round(total, 6) AS total, dominant_gate, CAST(row_number() OVER (ORDER BY failures, total, policy) AS INTEGER) AS place FROM r""",
        "case_effects": f"WITH {_EFFECTS} SELECT policy, case_id, group_id, effect FROM case_effects",
        "grouped_bootstrap": f"""WITH {_EFFECTS},
{_BY_NATION},
{_bootstrap_sql("policy", 200, 0.05, 42)}
SELECT policy, round(estimate / 20000, 9) AS estimate, round(lo / 20000, 9) AS lo, round(hi / 20000, 9) AS hi, groups FROM boot""",
        "mean_bootstrap": f"""WITH effects AS (SELECT 'all' AS one, c_nationkey AS g, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS e, 1 AS w FROM customer GROUP BY ALL),
{_bootstrap_sql("one", 100, 0.1, 7)}
SELECT round(estimate, 4) AS estimate, round(lo, 4) AS lo, round(hi, 4) AS hi, groups FROM boot""",
        "weighted_quantiles": """WITH m AS (SELECT l_returnflag, l_extendedprice AS v, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL),
r AS (SELECT *, CAST(sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS DOUBLE) AS u, CAST(sum(w) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS t FROM m)
SELECT l_returnflag, min(v) FILTER (u >= 0.1::DOUBLE * t) AS p10, min(v) FILTER (u >= 0.5::DOUBLE * t) AS p50, min(v) FILTER (u >= 0.95::DOUBLE * t) AS p95, min(v) FILTER (u >= 0.99::DOUBLE * t) AS p99 FROM r GROUP BY ALL""",
        "r7_quantiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.1), 8) AS p10, round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.95), 8) AS p95, max(value) AS most, round(avg(value), 8) AS mean FROM events GROUP BY ALL",
        "slice_group_coverage": f"WITH {_PAIRS} SELECT slice, count(*) AS replicates, count(DISTINCT case_id) AS cases, count(DISTINCT group_id) AS groups, count(*) FILTER (p_status = 'failure') AS failures FROM pairs GROUP BY ALL",
        "evidence_coverage": f"""WITH {_PAIRS},
c AS (SELECT case_id, max(group_id) AS group_id, max(weight) AS weight, count(*) AS r FROM pairs GROUP BY case_id),
s AS (SELECT *, CASE WHEN {group.replace("{id}", "group_id")} < 8 THEN 'dev' ELSE 'holdout' END AS split FROM c)
SELECT split, count(*) AS cases, CAST(sum(r) AS BIGINT) AS replicates, count(DISTINCT group_id) AS groups, CAST(sum(weight / 27720) AS BIGINT) AS mass FROM s GROUP BY split""",
        "group_split_bucket": f"SELECT c_custkey, bucket, CASE WHEN bucket < 8 THEN 'dev' ELSE 'holdout' END AS split FROM (SELECT c_custkey, {group.replace('{id}', 'c_custkey')} AS bucket FROM customer)",
        "window_sample_bucket": f"SELECT event_id, bucket, bucket < {SAMPLE[3]} AS selected FROM (SELECT event_id, {sample.replace('{case}', chr(39) + 'case-' + chr(39) + ' || event_id').replace('{rep}', chr(39) + 'replicate-' + chr(39) + ' || user_id')} AS bucket FROM events)",
        "split_leakage": "SELECT DISTINCT o_custkey AS group_id FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')",
        "trace_dedup_conflict": "SELECT *, CASE WHEN n_digests > 1 THEN 'conflict' WHEN n_rows > 1 THEN 'duplicate' ELSE 'unique' END AS status FROM (SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT sha256(l_partkey || '|' || l_suppkey || '|' || l_returnflag)) AS n_digests FROM lineitem GROUP BY ALL)",
        "evidence_join_outcomes": f"""WITH {_EVIDENCE}
SELECT coalesce(ex.case_id, ev.case_id) AS case_id, coalesce(ex.replicate, ev.replicate) AS replicate, coalesce(ex.output, ev.output) AS output, outcome,
  CASE WHEN outcome = 'failure' THEN 0 WHEN outcome = 'scored' THEN ev.score END AS score
FROM (SELECT ex, ev, CASE WHEN ex.status IS NULL THEN 'orphan' WHEN ex.dispatch = 'sent_unknown' THEN 'ambiguous' WHEN ex.status != 'success' THEN 'failure'
    WHEN ev.kind IS NULL THEN 'missing' WHEN ev.produced < ex.completed THEN 'invalid' WHEN ev.kind = 'scored' THEN 'scored' ELSE 'abstained' END AS outcome
  FROM ex FULL JOIN ev ON ex.case_id = ev.case_id AND ex.replicate = ev.replicate AND ex.output IS NOT DISTINCT FROM ev.output)""",
        "orphan_reasons": f"""WITH {_EVIDENCE},
near AS (SELECT case_id, replicate, bool_or(status != 'success') AS failed FROM ex GROUP BY ALL)
SELECT ev.case_id, ev.replicate, ev.output, CASE WHEN failed THEN 'evidence-for-failed-execution' WHEN failed IS NOT NULL THEN 'terminal-output-mismatch' ELSE 'no-matching-trace' END AS reason
FROM ev ANTI JOIN ex ON ex.case_id = ev.case_id AND ex.replicate = ev.replicate AND ex.output = ev.output LEFT JOIN near ON near.case_id = ev.case_id AND near.replicate = ev.replicate""",
        "pair_completeness": "SELECT l_orderkey, list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(have, x)) AS missing FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY ALL)",
        "metadata_consistency": "SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN a > 1 THEN 'l_linestatus' END, CASE WHEN b > 1 THEN 'l_returnflag' END], lambda x: x IS NOT NULL) AS differ FROM (SELECT l_orderkey, l_linenumber, count(DISTINCT l_linestatus) AS a, count(DISTINCT l_returnflag) AS b FROM lineitem GROUP BY ALL) WHERE a > 1 OR b > 1",
        "matrix_completeness": """WITH c AS (SELECT l_orderkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey, count(*) FILTER (l_linestatus IN ('F', 'O')) AS have, bool_or(l_linestatus NOT IN ('F', 'O')) AS unknown, count(DISTINCT n) AS sizes FROM c GROUP BY ALL)
SELECT l_orderkey, problem FROM (SELECT l_orderkey, CASE WHEN unknown THEN 'unknown-profile' WHEN have < 2 THEN 'missing-profile' WHEN sizes > 1 THEN 'unequal-replicates' END AS problem FROM p) WHERE problem IS NOT NULL""",
        "timing_plausibility": f"""WITH {_PAIRS}, d AS (SELECT *, (input_tokens - 1) / p_tps * 1000 AS decode FROM pairs)
SELECT case_id, replicate, CASE WHEN p_e2e < p_ttft THEN 'e2e-before-ttft' WHEN input_tokens > 1 AND p_e2e + greatest(100.0::DOUBLE, 0.2::DOUBLE * decode) < p_ttft + decode THEN 'decode-too-slow' END AS problem FROM d""",
        "sealed_window": f"SELECT event_id, coalesce({reason}, 'inside') AS reason FROM {events_window}",
        "late_rows": f"SELECT event_id, user_id, event_type FROM {events_window} WHERE {reason} = 'late'",
        "event_chain_check": "SELECT event_id, user_id, parent, expected FROM (SELECT event_id, user_id, CASE WHEN event_id % 50 = 0 THEN event_id + 1 ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS parent, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS expected FROM events) WHERE parent IS DISTINCT FROM expected",
        "window_revision_chain": "SELECT CAST(day AS VARCHAR) AS day, row_number() OVER (ORDER BY day) AS revision, coalesce(mark >= lag(mark) OVER (ORDER BY day), TRUE) AS ok, n FROM (SELECT CAST(ts AS DATE) AS day, max(value) AS mark, count(*) AS n FROM events GROUP BY ALL)",
        "attempt_order": "SELECT event_id, user_id FROM (SELECT *, lag(ts + to_seconds(event_id % 4000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before > ts",
        "counterbalance_order": f"""WITH {_PAIRS},
t AS (SELECT case_id, replicate, row_number() OVER (PARTITION BY case_id, (replicate - 1) // 3 ORDER BY sha256('seed-3/' || case_id || '/' || replicate), replicate) - 1 AS turn FROM pairs)
SELECT case_id, replicate, CASE turn WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'b,c,a' ELSE 'c,a,b' END AS profiles FROM t""",
        "replicate_fanout": f"""WITH c AS (SELECT 'case-' || o_orderkey AS case_id, r FROM orders, range(3) AS t(r)),
k AS (SELECT r, {sample.replace("{case}", "case_id").replace("{rep}", "'replicate-' || r")} AS bucket FROM c)
SELECT profile, CAST(r AS INTEGER) AS r, count(*) AS executions FROM k, (VALUES ('expert'), ('primary')) AS p(profile) WHERE bucket < {SAMPLE[3]} GROUP BY ALL""",
        "trust_status": f"""WITH k(key_id, a, b, c, purpose) AS (VALUES {_KEYS}),
e AS (SELECT events.*, user_id % 5 AS key_id, date_diff('second', ts, TIMESTAMP '2024-01-25') AS age FROM events),
j AS (SELECT e.*, CAST(a AS TIMESTAMP) AS a, CAST(b AS TIMESTAMP) AS b, CAST(c AS TIMESTAMP) AS c, purpose, epoch(TIMESTAMP '2024-01-25') - epoch(ts) AS secs FROM e LEFT JOIN k ON k.key_id = e.key_id)
SELECT event_id, CASE WHEN a IS NULL THEN 'unknown-key' WHEN event_id % 23 = 0 THEN 'invalid-signature' WHEN c <= TIMESTAMP '2024-01-25' THEN 'revoked'
  WHEN trunc(secs) < -30 THEN 'future-dated' WHEN trunc(secs) > 1728000 THEN 'stale' WHEN ts < a THEN 'key-not-yet-valid' WHEN ts >= b THEN 'key-expired'
  WHEN purpose != event_type THEN 'unauthorized-evidence' ELSE 'trusted' END AS status FROM j""",
        "set_digest": "SELECT event_type, sha256(string_agg(m, ',' ORDER BY m)) AS digest, count(*) AS members FROM (SELECT event_type, sha256(CAST(event_id AS VARCHAR)) AS m FROM events) GROUP BY event_type",
        "evidence_class_rollup": f"SELECT l_suppkey, l_linenumber, ['measured', 'reported', 'modeled', 'unavailable'][max({_CLASS}) + 1] AS weakest, CASE WHEN count(*) FILTER (l_tax > 0.079) = 0 THEN round(sum(l_extendedprice), 2) END AS cost FROM lineitem GROUP BY ALL",
        "work_estimate": "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS cases, count(*) * 6 AS replays, CAST(5000 AS BIGINT) AS draws, count(*) * 6 + 30000 AS work FROM lineitem",
        "json_metrics_unpivot": "SELECT event_type, metric, value FROM (SELECT event_type, unnest(['k', 'n']) AS metric, unnest([CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT), count(*)]) AS value FROM events GROUP BY event_type)",
        "prometheus_parse": "SELECT 'events_value' AS metric, event_type AS type, count(*) AS samples, CAST(sum(event_id) AS BIGINT) AS total, max(event_id) * 1000 AS last, CAST(0 AS BIGINT) AS bad FROM events GROUP BY event_type",
        "sse_parse": "SELECT event_id AS stream, place, CASE WHEN place = 0 THEN event_type ELSE 'message' END AS event, CAST(event_id AS VARCHAR) AS id, CASE WHEN place = 0 THEN props || chr(10) || 'x' ELSE '[DONE]' END AS data FROM events, (VALUES (0), (1)) AS t(place)",
        "address_class": """WITH a AS (SELECT event_id, CAST((event_id * 2654435761) % 4294967296 AS BIGINT) AS v FROM events),
o AS (SELECT event_id, v, (v >> 24) AS a, (v >> 16) & 255 AS b, (v >> 8) & 255 AS c, v & 255 AS d FROM a)
SELECT event_id, a || '.' || b || '.' || c || '.' || d AS address, CASE WHEN a = 127 THEN 'loopback' WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private'
  WHEN a = 169 AND b = 254 THEN 'link-local' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'shared' WHEN a >= 224 AND a < 240 THEN 'multicast' WHEN a = 0 OR a >= 240 THEN 'reserved'
  WHEN (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR (a = 198 AND b IN (18, 19)) THEN 'special' ELSE 'public' END AS kind FROM o""",
        "route_match": "SELECT event_id, CASE WHEN p LIKE '/click/1%' THEN 'one' WHEN p LIKE '/click%' THEN 'click' WHEN p LIKE '/cl%' THEN 'c' WHEN p LIKE '/v%' THEN 'v' ELSE 'root' END AS route FROM (SELECT event_id, '/' || event_type || '/' || user_id AS p FROM events)",
        "error_redaction": """SELECT event_id, category, CASE WHEN http_status BETWEEN 100 AND 599 THEN http_status END AS http_status,
  CASE category WHEN 'transport' THEN 'the connection failed' WHEN 'timeout' THEN 'the time limit was reached' ELSE 'the provider reported an error' END AS message
FROM (SELECT event_id, CASE WHEN value > 100 THEN 'transport' WHEN user_id % 3 = 0 THEN 'timeout' ELSE 'provider' END AS category, CAST(user_id + 90 AS INTEGER) AS http_status FROM events WHERE event_type = 'error')""",
    }
