"""The assessment's queries: the evidence join; development, holdout and window; over the driver's tables, with their SQL.

Nations are the independent groups and split by their bucket; the window takes the orders of 1996.  A primary without
confidence in its answer (signal 0) has no score and no known cost; in the holdout some signals, some expert executions and
some of the expert's scores are missing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sampling
from ..functions.lineage import stored
from ..operators import assessment, join
from . import catalog

PROTOCOL = assessment.Protocol("expert", ["primary"], [("less-than", 0.3), ("less-than", 0.6), ("greater-than", 0.7)], margin=-0.05, mean_score=0.9, failure_rate=0.4, p95_ttft=700.0, p95_e2e=1500.0, cost_per_thousand=7300.0, coverage=0.9, groups=3, slice_groups=1, critical_slices=["1-URGENT"])
UNIT, WINDOW = 27720.0, ("1996-01-01", "1997-01-01")
NATION = ("evenkeel/group-bucket/1", "sha256-group-bucket-1", "seed-1", 10)


def executions(spark, sf_dir, phase: str):
    """The phase's executions, long: one row per replicate and profile."""
    domain, algorithm, seed, n = NATION
    # the phase's orders are found before their lineitems come, which then are shuffled once, by order
    groups = catalog._t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders = catalog._t(spark, sf_dir, "orders")
    if phase == "window":
        dated = orders.where(f"o_orderdate >= timestamp_ntz '{WINDOW[0]}' and o_orderdate < timestamp_ntz '{WINDOW[1]}'")
        orders = orders.join(dated.select("o_orderkey"), "o_orderkey", "left_semi")
    else:
        bucket = sampling.group_bucket(domain, algorithm, seed, F.concat(F.lit("nation-"), F.col("nation").cast("string")), n)
        groups = groups.where(bucket < 8 if phase == "development" else bucket >= 8)
    p = catalog.pairs(spark, sf_dir, orders=orders.join(groups, F.col("o_custkey") == F.col("c_custkey")), more=["nation"])
    holdout = F.lit(phase == "holdout")
    signal = F.when(holdout, F.col("p_confidence")).otherwise(F.coalesce("p_confidence", F.lit(0.5)))
    p = p.withColumn("signal", signal)
    failed = F.col("p_status") == "failure"
    common = [F.col("case_id"), F.col("replicate"), F.col("nation").alias("group_id"), F.col("weight"), F.array("slice").alias("slices")]

    def side(profile, status, outcome, signal, cost, ttft_class, cost_class):
        k = profile[0]
        own = {"profile": F.lit(profile), "status": status, "outcome": outcome, "score": F.col(f"{k}_score"), "signal": signal, "ttft": F.col(f"{k}_ttft").cast("double"), "e2e": F.col(f"{k}_e2e").cast("double"), "cost": cost, "ttft_class": ttft_class, "cost_class": cost_class}
        return F.struct(*[v.alias(n) for n, v in own.items()])

    primary = side("primary", F.col("p_status"), F.when(failed, "failure").when(F.col("signal") == 0, "missing").otherwise("scored"), F.col("signal"), F.when(F.coalesce(F.col("signal") != 0, F.lit(True)), F.col("p_cost")), F.when(failed, assessment.MODELED).otherwise(assessment.MEASURED), F.lit(assessment.MEASURED))
    expert = side("expert", F.col("e_status"), F.when(holdout & (F.col("case_id") % 400 == 5), "abstained").otherwise("scored"), F.lit(None).cast("double"), F.col("e_cost"), F.lit(assessment.MEASURED), F.lit(assessment.REPORTED))
    there = ~(holdout & (F.col("case_id") % 500 == 3))
    both = F.array(primary, F.when(there, expert))
    return p.select(*common, F.explode(F.array_compact(both)).alias("x")).select("case_id", "replicate", "group_id", "weight", "slices", "x.*")


def _frozen() -> dict:
    """The bundle that the holdout and the window are about."""
    return next(b for b in assessment.enumerate_bundles(PROTOCOL) if b["operator"] == "less-than" and b["threshold"] == 0.3)


def _bundles(phase: str) -> list[dict]:
    return assessment.enumerate_bundles(PROTOCOL) if phase == "development" else [_frozen()]


def _shown(out):
    joined = lambda n: F.array_join(n, ",").alias(n)
    classes = F.concat_ws("-", *[F.col(f"{m}_class").cast("string") for m in ("score", "ttft", "e2e", "cost")]).alias("classes")
    return out.select(
        "policy", "kind", "status", "selected", "decision", joined("reasons"), joined("failed"), classes, F.round("mean_score", 6).alias("mean_score"), F.round("failure_rate", 6).alias("failure_rate"),
        "p95_ttft", "p95_e2e", F.round("cost_per_thousand", 4).alias("cost_per_thousand"), F.round("coverage", 6).alias("coverage"), "cases", "replicates", "groups", "slice_groups_0", F.round("lo", 9).alias("lo"),
    )


def _assess(spark, sf_dir, phase):
    return _shown(assessment.assess(executions(spark, sf_dir, phase), PROTOCOL, _bundles(phase), phase, 100, UNIT))


def assess_development(spark, sf_dir):
    """Every bundle on the development groups; the cheapest that passes is nominated."""
    return _assess(spark, sf_dir, "development")


def assess_holdout(spark, sf_dir):
    """The frozen bundle on the held-out groups, where some evidence is missing."""
    return _assess(spark, sf_dir, "holdout")


def assess_window(spark, sf_dir):
    """The frozen bundle on a sealed window."""
    return _assess(spark, sf_dir, "window")


LINEAGE = ["study", "split"]


def _paired(spark, sf_dir):
    """What executions and evidence are made of, placed, joined and stored once."""
    return stored(catalog.pairs(spark, sf_dir).select("case_id", "replicate", "input_tokens", "p_status", "p_score", "e_status", "e_score"))


def _traces(p):
    """Executions of both profiles; some rows stand twice, some with another digest, some replicates under two trace ids."""
    t = F.col("input_tokens")
    each = F.explode(F.array(F.struct(F.lit("primary").alias("profile"), F.col("p_status").alias("status"), F.col("p_score").alias("made"), F.lit(0).alias("side")), F.struct(F.lit("expert").alias("profile"), F.col("e_status").alias("status"), F.col("e_score").alias("made"), F.lit(1).alias("side"))))
    p = p.select("case_id", "replicate", t.alias("t"), each.alias("x")).select("case_id", "replicate", "t", "x.*")
    again = F.explode(F.when(F.col("t") % 31 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    p = p.withColumn("k", again)
    output = F.when(F.col("status") == "success", F.col("case_id") * 100 + F.col("replicate"))
    trace = F.col("case_id") * 1000 + F.col("replicate") * 10 + F.col("side") + F.when((F.col("k") == 1) & (F.col("t") % 93 == 0), 5).otherwise(0)
    digest = F.concat_ws("/", trace.cast("string"), F.when((F.col("k") == 1) & (F.col("t") % 62 == 0), "other").otherwise("same"))
    dispatch = F.when(F.col("t") % 97 == 0, "sent_unknown").otherwise("completed")
    return p.select("case_id", "replicate", "profile", output.alias("output"), trace.alias("trace_id"), digest.alias("digest"), F.lit("study-1").alias("study"), F.when(F.col("case_id") % 5 == 0, "holdout").otherwise("dev").alias("split"), "status", dispatch.alias("dispatch"), (F.col("t") % 1000).alias("completed_at"), "made", "t", "side", "k")


def _receipts(traces):
    """Evidence for the first rows of most executions, some astray, repeated, unverified, of other lineage or too old."""
    e = traces.where("k = 0 and t % 11 != 0")
    t = F.col("t")
    e = e.withColumn("again", F.explode(F.when(t % 37 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    case = F.when(t % 29 == 0, -F.col("case_id") - 1).otherwise(F.col("case_id"))
    output = F.when(t % 13 == 0, F.col("case_id") * 100 + 99).otherwise(F.coalesce("output", F.col("case_id") * 100))
    score = F.when((F.col("again") == 1) & (t % 74 == 0), F.lit(0.0)).otherwise(F.col("made"))
    kind = F.when(t % 7 == 0, "abstained").otherwise("scored")
    verification = F.when(t % 19 == 0, "revoked").when(t % 23 == 0, "stale").otherwise("trusted")
    digest = F.concat_ws("/", "trace_id", case.cast("string"), F.round(score * 100).cast("int").cast("string"))
    return e.select(case.alias("case_id"), "replicate", "profile", output.alias("output"), digest.alias("digest"), F.when(t % 41 == 0, "study-2").otherwise("study-1").alias("study"), "split", verification.alias("verification"), (t % 43 != 0).alias("pinned"), (t % 47 == 0).alias("drifted"), F.lit("context-1").alias("context"), kind.alias("kind"), score.alias("score"), (F.col("completed_at") + F.when(t % 17 == 0, -5).otherwise(5)).alias("produced_at"))


def evidence_join(spark, sf_dir):
    """Every execution's outcome and every orphan, by the whole join."""
    traces = _traces(_paired(spark, sf_dir))
    return join.join(traces, _receipts(traces), LINEAGE)


def evidence_join_counts(spark, sf_dir):
    traces = _traces(_paired(spark, sf_dir))
    return join.counts(traces, _receipts(traces), LINEAGE)


def queries() -> dict:
    return {f.__name__: f for f in (assess_development, assess_holdout, assess_window, evidence_join, evidence_join_counts)}


_JOIN = f"""{catalog._PAIRS},
sides AS (
  SELECT case_id, replicate, input_tokens AS t, 'primary' AS profile, p_status AS status, p_score AS made, 0 AS side FROM pairs
  UNION ALL SELECT case_id, replicate, input_tokens, 'expert', e_status, e_score, 1 FROM pairs),
numbered AS (SELECT *, case_id * 1000 + replicate * 10 + side + CASE WHEN k = 1 AND t % 93 = 0 THEN 5 ELSE 0 END AS trace_id FROM sides, (VALUES (0), (1)) AS v(k) WHERE k = 0 OR t % 31 = 0),
traces AS (
  SELECT *, CASE WHEN status = 'success' THEN case_id * 100 + replicate END AS output, trace_id || CASE WHEN k = 1 AND t % 62 = 0 THEN '/other' ELSE '/same' END AS digest, 'study-1' AS study,
    CASE WHEN case_id % 5 = 0 THEN 'holdout' ELSE 'dev' END AS split, CASE WHEN t % 97 = 0 THEN 'sent_unknown' ELSE 'completed' END AS dispatch, t % 1000 AS completed_at FROM numbered),
receipts0 AS (
  SELECT trace_id, CASE WHEN t % 29 = 0 THEN -case_id - 1 ELSE case_id END AS case_id, replicate, profile, CASE WHEN t % 13 = 0 THEN case_id * 100 + 99 ELSE coalesce(output, case_id * 100) END AS output,
    CASE WHEN a = 1 AND t % 74 = 0 THEN 0 ELSE made END AS score, CASE WHEN t % 7 = 0 THEN 'abstained' ELSE 'scored' END AS kind, CASE WHEN t % 41 = 0 THEN 'study-2' ELSE 'study-1' END AS study, split,
    CASE WHEN t % 19 = 0 THEN 'verification-revoked' WHEN t % 23 = 0 THEN 'verification-stale' WHEN t % 43 = 0 THEN 'evaluator-key-not-pinned' WHEN t % 47 = 0 THEN 'evaluator-identity-drift' END AS rejected,
    completed_at + CASE WHEN t % 17 = 0 THEN -5 ELSE 5 END AS produced_at
  FROM traces, (VALUES (0), (1)) AS v(a) WHERE k = 0 AND t % 11 != 0 AND (a = 0 OR t % 37 = 0)),
receipts AS (SELECT *, concat_ws('/', trace_id, case_id, CAST(round(score * 100) AS INTEGER)) AS digest FROM receipts0),
ids AS (SELECT case_id, replicate, profile, count(DISTINCT trace_id) > 1 AS split_ids FROM traces GROUP BY ALL),
identities AS (
  SELECT case_id, replicate, profile, output, any_value(study) AS study, any_value(split) AS split, any_value(status) AS status, any_value(dispatch) AS dispatch, any_value(completed_at) AS completed_at,
    count(*) > 1 AS repeated, count(DISTINCT digest) > 1 AS differ FROM traces GROUP BY case_id, replicate, profile, output),
ex AS (SELECT identities.*, differ OR split_ids AS conflicting FROM identities JOIN ids USING (case_id, replicate, profile)),
good AS (SELECT * FROM ex WHERE NOT conflicting),
accepted AS (
  SELECT case_id, replicate, profile, output, count(DISTINCT digest) AS n, count(*) AS v_rows, arg_min(kind, (kind, score)) AS kind, arg_min(score, (kind, score)) AS score, min(produced_at) AS produced_at,
    any_value(study) AS v_study, any_value(split) AS v_split FROM receipts WHERE rejected IS NULL GROUP BY ALL),
refused AS (SELECT case_id, replicate, profile, output, arg_min(rejected, digest) AS why FROM receipts WHERE rejected IS NOT NULL GROUP BY ALL),
near AS (SELECT case_id, replicate, profile, bool_or(status != 'success') AS failed FROM good GROUP BY ALL),
met AS (
  SELECT coalesce(g.case_id, a.case_id) AS case_id, coalesce(g.replicate, a.replicate) AS replicate, coalesce(g.profile, a.profile) AS profile, coalesce(g.output, a.output) AS output,
    g.case_id IS NULL AS orphan, status, dispatch, completed_at, repeated, n, v_rows, kind, score, produced_at, n > 1 AS several, a.case_id IS NOT NULL AND (v_study IS DISTINCT FROM study OR v_split IS DISTINCT FROM split) AS strays
  FROM good g FULL JOIN accepted a ON g.case_id = a.case_id AND g.replicate = a.replicate AND g.profile = a.profile AND g.output IS NOT DISTINCT FROM a.output),
said AS (
  SELECT met.*, why, failed, CASE WHEN orphan THEN 'orphan' WHEN dispatch = 'sent_unknown' THEN 'ambiguous' WHEN status != 'success' THEN 'failure' WHEN n = 1 AND NOT strays THEN CASE WHEN produced_at < completed_at THEN 'invalid' ELSE kind END
      WHEN why IS NOT NULL THEN 'invalid' WHEN n IS NOT NULL THEN 'conflicting' ELSE 'missing' END AS outcome,
    CASE WHEN orphan THEN CASE WHEN several THEN 'conflicting-evaluator-evidence' WHEN failed THEN 'evidence-for-failed-execution' WHEN failed IS NOT NULL THEN 'terminal-output-mismatch' ELSE 'no-matching-trace' END
      WHEN dispatch = 'sent_unknown' OR status != 'success' THEN '' WHEN n = 1 AND NOT strays THEN CASE WHEN produced_at < completed_at THEN 'evidence-predates-completion' ELSE '' END
      WHEN why IS NOT NULL THEN why WHEN several THEN 'different-evidence' WHEN strays THEN 'lineage' ELSE '' END AS detail
  FROM met LEFT JOIN refused r ON r.case_id = met.case_id AND r.replicate = met.replicate AND r.profile = met.profile AND r.output IS NOT DISTINCT FROM met.output
    LEFT JOIN near ON near.case_id = met.case_id AND near.replicate = met.replicate AND near.profile = met.profile),
joined AS (
  SELECT case_id, replicate, profile, output, outcome, detail, CASE outcome WHEN 'failure' THEN 0 WHEN 'scored' THEN score END AS score, coalesce(repeated, FALSE) AS duplicate_traces, coalesce(v_rows, 0) > coalesce(n, 0) AS duplicate_evidence FROM said)"""


def _sql(phase: str) -> str:
    bucket = catalog._bucket_sql(NATION[0], {"algorithm": f"'{NATION[1]}'", "groupId": "'nation-' || c_nationkey", "seed": f"'{NATION[2]}'"}, NATION[3])
    held = "TRUE" if phase == "holdout" else "FALSE"
    where = {"development": f"{bucket} < 8", "holdout": f"{bucket} >= 8", "window": f"case_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{WINDOW[0]}' AND o_orderdate < TIMESTAMP '{WINDOW[1]}')"}[phase]
    text = lambda x: "NULL" if x is None else f"'{x}'"
    number = lambda x: "NULL" if x is None else f"{x}::DOUBLE"
    own = _bundles(phase)
    listed = ", ".join(f"('{b['policy']}', '{b['kind']}', {text(b['operator'])}, {number(b['threshold'])})" for b in [*own, assessment.control_bundle(PROTOCOL)])
    candidates = ", ".join(f"'{b['policy']}'" for b in own)
    P = PROTOCOL
    decision = f"""CASE WHEN bool_or(selected) OVER () THEN 'NOMINATED' WHEN bool_and(status = 'INSUFFICIENT_EVIDENCE') FILTER (policy IN ({candidates})) OVER () THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NO_CANDIDATE' END"""
    chosen = f"""policy IN ({candidates}) AND status = 'PASS' AND row_number() OVER (ORDER BY CASE WHEN policy IN ({candidates}) AND status = 'PASS' THEN 0 ELSE 1 END, cost_per_thousand NULLS LAST, p95_e2e NULLS LAST, policy) = 1"""
    if phase != "development":
        chosen, decision = f"policy IN ({candidates})", f"max(status) FILTER (policy IN ({candidates})) OVER ()"
    return f"""WITH {catalog._PAIRS}, policies(policy, kind, op, threshold) AS (VALUES {listed}),
y AS (
  SELECT *, p_status = 'failure' AS p_fail, CASE WHEN p_status = 'failure' THEN 'failure' WHEN sig = 0 THEN 'missing' ELSE 'scored' END AS p_out,
    CASE WHEN sig = 0 THEN NULL ELSE p_cost END AS p_paid, CASE WHEN {held} AND case_id % 400 = 5 THEN 'abstained' ELSE 'scored' END AS e_out, NOT ({held} AND case_id % 500 = 3) AS there
  FROM (SELECT pairs.*, c_nationkey AS nation, CASE WHEN {held} THEN p_confidence ELSE coalesce(p_confidence, 0.5::DOUBLE) END AS sig FROM pairs JOIN customer ON group_id = c_custkey WHERE {where})),
z AS (SELECT *, count(*) FILTER (there) OVER (PARTITION BY case_id) AS n_whole, count(*) FILTER (there AND sig IS NOT NULL) OVER (PARTITION BY case_id) AS n_signal FROM y),
routed AS (
  SELECT z.*, policy, kind, CASE WHEN NOT there THEN 'missing-required-profile' WHEN kind = 'cascade' AND sig IS NULL THEN 'missing-route-signal' END AS problem,
    kind = 'cascade' AND CASE op WHEN 'less-than' THEN sig < threshold WHEN 'greater-than' THEN sig > threshold END AS routed, weight / CASE WHEN kind = 'cascade' THEN n_signal ELSE n_whole END AS w
  FROM z, policies),
led AS (SELECT *, kind = 'cascade' AND NOT routed AND p_fail AS serial FROM routed),
took AS (SELECT *, kind = 'expert-only' OR routed OR serial AS x FROM led),
rows_ AS (
  SELECT policy, kind, case_id, replicate, nation, weight, w, slice, problem, CASE WHEN x THEN e_out ELSE p_out END AS outcome, e_out, NOT x AND p_fail AS failed,
    CASE WHEN x THEN CASE WHEN e_out = 'scored' THEN e_score END ELSE CASE p_out WHEN 'scored' THEN p_score WHEN 'failure' THEN 0 END END AS score, CASE WHEN e_out = 'scored' THEN e_score END AS base,
    CASE WHEN serial THEN p_e2e ELSE 0 END + CASE WHEN x THEN e_ttft ELSE p_ttft END AS ttft, CASE WHEN serial THEN p_e2e ELSE 0 END + CASE WHEN x THEN e_e2e ELSE p_e2e END AS e2e,
    CASE WHEN x THEN e_cost ELSE p_paid END + CASE WHEN serial THEN p_paid ELSE 0 END AS cost,
    CASE WHEN kind = 'cascade' THEN 2 WHEN CASE WHEN x THEN e_out ELSE p_out END = 'scored' THEN 1 ELSE 2 END AS score_class,
    CASE WHEN kind = 'cascade' THEN 2 WHEN NOT x AND p_fail THEN 2 ELSE 0 END AS ttft_class, CASE WHEN kind = 'cascade' THEN 2 ELSE 0 END AS e2e_class, x
  FROM took),
fine AS (SELECT *, CASE WHEN cost IS NULL THEN 3 WHEN kind = 'cascade' THEN 2 WHEN x THEN 1 ELSE 0 END AS cost_class, score IS NOT NULL AND base IS NOT NULL AS paired FROM rows_ WHERE problem IS NULL),
sums AS (
  SELECT policy, count(*) AS replayed, count(score) AS covered, CASE WHEN count(score) = count(*) THEN sum(score * w) / sum(w) END AS mean_score, max(score_class) AS score_class,
    sum(CASE WHEN failed THEN w ELSE 0 END) / sum(w) AS failure_rate, CASE WHEN count(cost) = count(*) THEN sum(cost * 1000 * w) / sum(w) END AS cost_per_thousand, max(cost_class) AS cost_class,
    max(ttft_class) AS ttft_class, max(e2e_class) AS e2e_class, count(DISTINCT nation) FILTER (paired) AS groups, count(DISTINCT case_id) FILTER (paired) AS cases, count(*) FILTER (paired) AS replicates,
    count(DISTINCT nation) FILTER (paired AND slice = '1-URGENT') AS slice_groups_0
  FROM fine GROUP BY policy),
controls AS (SELECT policy, count(*) AS beside, count(base) AS based FROM rows_ WHERE problem IS DISTINCT FROM 'missing-required-profile' GROUP BY policy),
tails AS (
  SELECT policy, min(v) FILTER (k = 'ttft' AND u >= 0.95::DOUBLE * t) AS p95_ttft, min(v) FILTER (k = 'e2e' AND u >= 0.95::DOUBLE * t) AS p95_e2e
  FROM (SELECT policy, k, v, sum(m) OVER (PARTITION BY policy, k ORDER BY v) AS u, sum(m) OVER (PARTITION BY policy, k) AS t
    FROM (SELECT policy, k, v, sum(w) AS m FROM (SELECT policy, 'ttft' AS k, CAST(ttft AS DOUBLE) AS v, w FROM fine UNION ALL SELECT policy, 'e2e', CAST(e2e AS DOUBLE), w FROM fine) GROUP BY ALL)) GROUP BY policy),
effects AS (
  SELECT policy, any_value(nation) AS g, CAST(median(round((score - base) * 100)) * 2 AS BIGINT) AS e, CAST(any_value(weight) / 27720 AS BIGINT) AS w
  FROM fine WHERE paired GROUP BY policy, case_id),
{catalog._bootstrap_sql("policy", P.iterations, P.alpha, P.seed)},
joined AS (
  SELECT policy, kind, sums.* EXCLUDE (policy), tails.* EXCLUDE (policy), boot.lo / 200 AS lo,
    CASE WHEN replayed + beside > 0 THEN (covered + CASE WHEN kind = 'expert-only' THEN 0 ELSE based END)::DOUBLE / (replayed + CASE WHEN kind = 'expert-only' THEN 0 ELSE beside END) END AS coverage
  FROM policies LEFT JOIN sums USING (policy) LEFT JOIN tails USING (policy) LEFT JOIN boot USING (policy) LEFT JOIN controls USING (policy)),
open AS (
  SELECT policy, problem AS r FROM rows_ WHERE problem IS NOT NULL
  UNION SELECT policy, 'missing-evaluator-evidence' FROM fine WHERE outcome = 'missing' UNION SELECT policy, 'evaluator-abstention' FROM fine WHERE outcome = 'abstained'
  UNION SELECT policy, 'evaluator-abstention' FROM rows_ WHERE problem IS DISTINCT FROM 'missing-required-profile' AND e_out = 'abstained'
  UNION SELECT policy, 'insufficient-evaluator-coverage' FROM joined WHERE coalesce(coverage < {P.coverage}, TRUE) UNION SELECT policy, 'required-cost-evidence-unavailable' FROM joined WHERE cost_per_thousand IS NULL
  UNION SELECT policy, 'insufficient-independent-groups' FROM joined WHERE coalesce(groups, 0) < {P.groups}
  UNION SELECT policy, 'insufficient-critical-slice-groups:1-URGENT' FROM joined WHERE coalesce(slice_groups_0, 0) < {P.slice_groups}),
reasoned AS (SELECT joined.* EXCLUDE (lo), CASE WHEN r IS NULL THEN lo END AS lo, coalesce(r, '') AS reasons FROM joined LEFT JOIN (SELECT policy, string_agg(r, ',' ORDER BY r) AS r FROM open GROUP BY policy) USING (policy)),
judged AS (
  SELECT *, concat_ws(',', CASE WHEN NOT coalesce(lo >= {P.margin}, FALSE) THEN 'paired-quality' END, CASE WHEN NOT coalesce(mean_score >= {P.mean_score}, FALSE) THEN 'minimum-mean-score' END,
    CASE WHEN NOT coalesce(failure_rate <= {P.failure_rate}, FALSE) THEN 'maximum-failure-rate' END, CASE WHEN NOT coalesce(p95_ttft <= {P.p95_ttft}, FALSE) THEN 'maximum-p95-ttft' END,
    CASE WHEN NOT coalesce(p95_e2e <= {P.p95_e2e}, FALSE) THEN 'maximum-p95-end-to-end' END, CASE WHEN NOT coalesce(cost_per_thousand <= {P.cost_per_thousand}, FALSE) THEN 'maximum-cost-per-thousand' END,
    CASE WHEN NOT coalesce(coverage >= {P.coverage}, FALSE) THEN 'minimum-evidence-coverage' END, CASE WHEN NOT coalesce(groups >= {P.groups}, FALSE) THEN 'minimum-independent-groups' END,
    CASE WHEN NOT coalesce(slice_groups_0 >= {P.slice_groups}, FALSE) THEN 'minimum-critical-slice-groups:1-URGENT' END) AS failed
  FROM reasoned),
states AS (SELECT *, CASE WHEN reasons != '' THEN 'INSUFFICIENT_EVIDENCE' WHEN failed = '' THEN 'PASS' ELSE 'HOLD' END AS status FROM judged),
picked AS (SELECT *, {chosen} AS selected FROM states)
SELECT policy, kind, status, selected, {decision} AS decision, reasons, failed, concat_ws('-', score_class, ttft_class, e2e_class, cost_class) AS classes, round(mean_score, 6) AS mean_score,
  round(failure_rate, 6) AS failure_rate, p95_ttft, p95_e2e, round(cost_per_thousand, 4) AS cost_per_thousand, round(coverage, 6) AS coverage, cases, replicates, groups, slice_groups_0, round(lo, 9) AS lo
FROM picked"""


def oracle_sql() -> dict[str, str]:
    own = {f"assess_{phase}": _sql(phase) for phase in ("development", "holdout", "window")}
    own["evidence_join"] = f"WITH {_JOIN} SELECT * FROM joined"
    figures = {
        "trace-rows": "(SELECT count(*) FROM traces)", "accepted": "(SELECT count(*) FROM good)", "conflicting-traces": "(SELECT count(*) FROM ex WHERE conflicting)", "joined": "count(*) FILTER (outcome != 'orphan')",
        "scored": "count(*) FILTER (outcome = 'scored')", "matched": "count(*) FILTER (outcome IN ('scored', 'abstained') OR detail = 'evidence-predates-completion')", "orphan-evaluator-evidence": "count(*) FILTER (outcome = 'orphan')",
        "duplicate-traces": "count(*) FILTER (duplicate_traces)", "duplicate-evaluator-evidence": "count(*) FILTER (duplicate_evidence)",
        "conflicting-evaluator-evidence": "count(*) FILTER (detail IN ('different-evidence', 'conflicting-evaluator-evidence', 'lineage'))", "cases": "count(DISTINCT case_id) FILTER (outcome != 'orphan')", "case-replicates": "count(DISTINCT (case_id, replicate)) FILTER (outcome != 'orphan')",
    }
    own["evidence_join_counts"] = f"WITH {_JOIN}, f AS (SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in figures.items()) + " FROM joined) SELECT what, n FROM f UNPIVOT (n FOR what IN (" + ", ".join(f'"{n}"' for n in figures) + "))"
    return own
