"""The query of sealed decisions: the development decision persisted, copies of it changed, and all revalidated; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions
from . import assess

PROTOCOL = "sha256:protocol"
CHANGES = [  # (what changes, whether the copy is digested anew)
    ({}, True),
    ({"selected": "other"}, False),
    ({"selected": "other"}, True),
    ({"evidence": "sha256:0"}, True),
    ({"phase": "holdout"}, True),
    ({"protocol": "sha256:1"}, True),
]


def revalidated_nominations(spark, sf_dir):
    """The nomination on the development groups as it was sealed, and copies of it, changed with or without a new digest."""
    evidence = decisions.evidence_digest(assess.executions(spark, sf_dir, "development"), ["case_id", "replicate", "profile"])
    fresh = decisions.seal(assess.assess_development(spark, sf_dir), "development", PROTOCOL, evidence)
    one = fresh.collect()[0]
    copies = None
    for i, (change, anew) in enumerate(CHANGES):
        row = spark.createDataFrame([one], fresh.schema).withColumns({k: F.lit(v) for k, v in change.items()})
        row = (row.withColumn("decision_digest", decisions.own_digest(row)) if anew else row).withColumn("copy", F.lit(i))
        copies = row if copies is None else copies.unionByName(row)
    now = spark.createDataFrame([one], fresh.schema)
    out = decisions.revalidate(copies, now)
    return out.select("copy", "phase", "evidence", "status", "selected", F.size("candidates").alias("n_candidates"), "decision_digest", "verdict")


def queries() -> dict:
    return {"revalidated_nominations": revalidated_nominations}


def _tree(source: str, levels: int = 4) -> str:
    """SQL of the digest of the members ``m`` of a table."""
    out = [f"h{levels} AS (SELECT substring(h, 1, {2 * levels}) AS p, h || ':' || count(*) AS x FROM (SELECT sha256(m) AS h FROM {source}) GROUP BY h)"]
    for depth in range(levels, 0, -1):
        out.append(f"h{depth - 1} AS (SELECT substring(p, 1, {2 * depth - 2}) AS p, p || ':' || sha256(string_agg(x, ',' ORDER BY x)) AS x FROM h{depth} GROUP BY p)")
    return ",\n".join([*out, "tree AS (SELECT 'sha256:' || sha256(string_agg(x, ',' ORDER BY x)) AS d FROM h0)"])


def oracle_sql() -> dict[str, str]:
    text = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
    number = lambda c: f"coalesce(regexp_replace(CAST({c} AS VARCHAR), '\\.0$', ''), 'null')"
    kinds = {c: text for c in ("policy", "kind", "status", "decision", "reasons", "failed", "classes")} | {"selected": lambda c: f"coalesce(CAST({c} AS VARCHAR), 'null')"}
    columns = "policy kind status selected decision reasons failed classes mean_score failure_rate p95_ttft p95_e2e cost_per_thousand coverage cases replicates groups slice_groups_0 lo".split()
    body = " || ',' || ".join(f"'\"{c}\":' || {kinds.get(c, number)(c)}" for c in sorted(columns))
    sealed = lambda domain, value: f"'sha256:' || sha256('{{\"domain\":\"{domain}\",\"value\":{{' || {value} || '}}}}')"
    decision = """'"candidates":[' || cands || '],"evidence":"' || evidence || '","phase":"' || phase || '","protocol":"' || protocol || '","selected":' || coalesce('"' || selected || '"', 'null') || ',"stale":[],"status":"' || status || '"'"""
    inner = assess._sql("development")
    head, _, last = inner.rpartition("\nSELECT policy, kind, status, selected,")
    shown = "SELECT policy, kind, status, selected," + last
    copies = []
    for i, (change, anew) in enumerate(CHANGES):
        pick = ", ".join(f"'{change[c]}' AS {c}" if c in change else c for c in ("phase", "protocol", "evidence", "status", "selected", "cands", "n"))
        copies.append(f"SELECT {i} AS copy, {str(anew).upper()} AS anew, {pick} FROM one")
    return {
        "revalidated_nominations": f"""{head},
shown AS ({shown}),
digested AS (SELECT *, {sealed(decisions.DOMAIN + "/candidate", body)} AS digest FROM shown),
members AS (SELECT '{{"case_id":' || case_id || ',"profile":"' || profile || '","replicate":' || replicate || '}}' AS m FROM y, (VALUES ('primary'), ('expert')) AS t(profile)),
{_tree("members")},
one AS (SELECT 'development' AS phase, '{PROTOCOL}' AS protocol, (SELECT d FROM tree) AS evidence, max(decision) AS status, max(policy) FILTER (selected) AS selected, string_agg('"' || digest || '"', ',' ORDER BY digest) AS cands, count(*) AS n FROM digested),
copies AS ({" UNION ALL ".join(copies)}),
said AS (SELECT *, {sealed(decisions.DOMAIN, decision)} AS own, (SELECT {sealed(decisions.DOMAIN, decision)} FROM one) AS first FROM copies),
kept AS (SELECT *, CASE WHEN anew THEN own ELSE first END AS decision_digest FROM said)
SELECT copy, phase, evidence, status, selected, CAST(n AS INTEGER) AS n_candidates, decision_digest,
  CASE WHEN phase <> 'development' OR status <> 'NOMINATED' OR selected IS NULL THEN 'not-a-nomination' WHEN decision_digest <> own THEN 'self-digest'
    WHEN protocol <> (SELECT protocol FROM one) THEN 'protocol' WHEN evidence <> (SELECT evidence FROM one) THEN 'evidence' WHEN cands <> (SELECT cands FROM one) THEN 'candidates'
    WHEN decision_digest <> first THEN 'recomputed' ELSE 'verified' END AS verdict FROM kept"""
    }
