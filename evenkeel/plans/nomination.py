"""Queries of nomination, confirmation and the next experiment over the catalog's pairs, with SQL that gives the same rows.

The groups' buckets part the pairs in development (eight of ten) and holdout.  The tables are made up, so the evidence is synthetic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nomination, replay
from . import catalog

EVALUATOR = {"id": "exact", "kind": "deterministic", "validated": True, "version": "1"}
KEY = bytes(range(32))  # of a made-up study
#: Gates that some of the made-up policies pass and others fail.
PAIRED = [("paired_quality", ">=", -0.5), ("independent_groups", ">=", 3), ("slice_groups_0", ">=", 1)]
LIMITS = [("mean_score", ">=", 0.6), ("slice_0", ">=", 0.6), ("p95_ttft", "<=", 1000.0), ("p95_e2e", "<=", 1400.0), ("p10_tps", ">=", 1.0), ("p50_total_tps", ">=", 0.0), ("error_rate", "<=", 0.35), ("cost_per_request", "<=", 12.0)]
DEVELOPMENT = [("cost_improvement", ">=", -0.15)]


def bodies() -> dict[str, dict]:
    """The registered candidates."""
    out = {"fast-only": {"kind": "fast-only"}}
    return out | {f"cascade-{c:g}-{t}": {"kind": "cascade", "min_confidence": c, "max_tokens": t} for c in catalog.CONFIDENCES for t in catalog.TOKENS}


def spec(development: bool) -> list:
    return [*PAIRED, *LIMITS, *(DEVELOPMENT if development else [])]


SPEC = {"gates": [list(g) for g in spec(True)], "critical": catalog.CRITICAL, "expert": "expert-only"}


def _measured(spark, sf_dir, split):
    """The metrics, a row per policy, worked out once."""
    rows = catalog._metrics(spark, sf_dir, split)
    return spark.createDataFrame(rows.limit(nomination.CANDIDATES + 1).collect(), rows.schema)


def nominated(spark, sf_dir) -> dict:
    rows, metrics = catalog.pairs(spark, sf_dir, "dev"), _measured(spark, sf_dir, "dev")
    gated = catalog._assessed(spark, sf_dir, "dev", spec(True), metrics)
    rounded = metrics.select("policy", *[F.round(c, 6).alias(c) if c in catalog._ROUNDED else F.col(c) for c in catalog._SHOWN])
    return nomination.nominate(bodies(), rounded, gated, catalog._GOALS, "expert-only", SPEC, rows, "group_id", EVALUATOR, True, KEY)


def confirmed(spark, sf_dir, artifact: dict) -> dict:
    gated = catalog._assessed(spark, sf_dir, "holdout", spec(False), _measured(spark, sf_dir, "holdout"))
    return nomination.confirm(artifact, bodies(), gated, SPEC, catalog.pairs(spark, sf_dir, "dev"), catalog.pairs(spark, sf_dir, "holdout"), "group_id", EVALUATOR, True, KEY)


def nominate_v1(spark, sf_dir):
    """One row: the choice on the development split."""
    found = nominated(spark, sf_dir)
    chosen = found["nomination"] and found["nomination"]["policy_id"]
    return spark.createDataFrame([(found["status"], chosen, ",".join(found["frontier"]))], "status string, policy string, frontier string")


def confirm_v1(spark, sf_dir):
    """One row: the nomination's gates on the holdout split; none where nothing was nominated."""
    kind, artifact = "status string, reason string, policy string", nominated(spark, sf_dir)["nomination"]
    if artifact is None:
        return spark.createDataFrame([], kind)
    done = confirmed(spark, sf_dir, artifact)
    return spark.createDataFrame([(done["status"], done["reason"], done["policy_id"])], kind)


def next_experiment(spark, sf_dir):
    """What every rejected candidate asks for next; inputs reach the registered lengths, prompts share no prefix."""
    ranked = replay.rejected_rank(catalog._assessed(spark, sf_dir)).where("policy != 'expert-only'")
    longest = catalog.pairs(spark, sf_dir).agg(F.max("input_tokens")).first()[0]
    return nomination.next_experiment(ranked.select("policy", "dominant_gate"), False, longest is not None and longest >= min(catalog.TOKENS))


def queries():
    return {q.__name__: q for q in (nominate_v1, confirm_v1, next_experiment)}


def _of_split(sql: str, split: str) -> str:
    """The catalog's SQL over the pairs of a split."""
    whole = "JOIN orders ON l_orderkey = o_orderkey)"
    assert sql.count(whole) == 1
    groups = catalog.oracle_sql()["group_split_bucket"]
    return sql.replace(whole, f"{whole[:-1]} WHERE o_custkey IN (SELECT c_custkey FROM ({groups}) WHERE split = '{split}'))")


def oracle_sql() -> dict[str, str]:
    goals, lower = catalog._GOALS
    least = " AND ".join([f"o.{g} >= m.{g}" for g in goals] + [f"o.{g} <= m.{g}" for g in lower])
    better = " OR ".join([f"o.{g} > m.{g}" for g in goals] + [f"o.{g} < m.{g}" for g in lower])
    chosen = f"""{_of_split(catalog._gated_sql(spec(True)), "dev")},
good AS (SELECT {catalog._SHOW} FROM metrics WHERE policy != 'expert-only' AND policy IN (SELECT policy FROM gated GROUP BY policy HAVING bool_and(pass))),
front AS (SELECT * FROM good m WHERE NOT EXISTS (SELECT 1 FROM good o WHERE {least} AND ({better}))),
nominee AS (SELECT count(*) AS n, string_agg(policy, ',' ORDER BY policy) AS frontier, (SELECT policy FROM front ORDER BY cost_per_request, p95_e2e, policy LIMIT 1) AS policy FROM front)"""
    holdout = _of_split(catalog._gated_sql(spec(False)), "holdout")
    techniques = " ".join(f"WHEN '{g}' THEN '{t}'" for g, t in nomination.TECHNIQUES.items())
    ranked = catalog.oracle_sql()["rejected_candidate_rank"]
    return {
        "nominate_v1": f"SELECT status, policy, frontier FROM (WITH {chosen} SELECT CASE WHEN n > 0 THEN 'NOMINATED' ELSE 'NO_CANDIDATE' END AS status, policy, coalesce(frontier, '') AS frontier FROM nominee)",
        "confirm_v1": f"""SELECT CASE WHEN failed IS NULL THEN 'DEMO_ONLY' ELSE 'HOLD' END AS status, coalesce('failed: ' || failed, 'synthetic-evidence') AS reason, policy
FROM (SELECT policy FROM (WITH {chosen} SELECT policy FROM nominee WHERE n > 0)) JOIN (WITH {holdout} SELECT policy, string_agg(gate, ', ' ORDER BY place) FILTER (NOT pass) AS failed FROM gated GROUP BY policy) USING (policy)""",
        "next_experiment": f"""SELECT policy, dominant_gate, CASE WHEN dominant_gate LIKE 'slice_groups%' THEN 'replicate' WHEN dominant_gate LIKE 'slice_%' THEN 'calibrate-routing'
  WHEN dominant_gate = 'p95_ttft' THEN (SELECT CASE WHEN max(l_partkey) >= {min(catalog.TOKENS)} THEN 'chunked-prefill' ELSE 'profile-prefill-and-queue' END FROM lineitem)
  ELSE coalesce(CASE dominant_gate {techniques} END, 'replicate') END AS technique FROM ({ranked}) WHERE policy != 'expert-only'""",
    }
