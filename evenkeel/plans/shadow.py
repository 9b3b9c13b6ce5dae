"""The query of shadow run plans, with SQL that gives the same rows.

An order is a plan and its lineitems the targets; the protocol has a profile for each of them, served by three endpoints.  What the made-up
fields hold is one SQL text for both engines; the rules are expressions over nested rows in Spark and joins and comparisons in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import manifests, shadow
from . import catalog

PRIME = {  # (fault's number: a plan has it where the number divides k)
    "state": 31, "unselected": 37, "study": 41, "snapshot_policy": 43, "digest": 47, "membership": 53, "rule": 59, "expires": 61, "early": 67,
    "policy_late": 71, "protocol_short": 73, "policy_short": 79, "window_empty": 83, "window_early": 89, "window_late": 97, "few": 101,
    "executions": 103, "concurrency": 107, "wall": 109, "reversed": 113, "extra": 127, "tampered": 131,
}
_ON = {name: f"k % {n} = 0" for name, n in PRIME.items()}
_BIG = lambda n: f"CAST({n} AS BIGINT)"
FIELDS = {
    "state": f"CASE WHEN {_ON['state']} THEN 'NOMINATED' ELSE '{shadow.READY}' END",
    "study": f"CASE WHEN {_ON['study']} THEN 'other' ELSE 'study' END",
    "selected": f"CASE WHEN {_ON['unselected']} THEN CAST(NULL AS STRING) WHEN {_ON['snapshot_policy']} THEN 'sha256:other' ELSE 'sha256:policy' END",
    "last_event_at": f"CASE WHEN k % 2 = 0 THEN {_BIG(900)} END",
    "protocol_expires": f"CASE WHEN {_ON['protocol_short']} THEN {_BIG(1500)} ELSE {_BIG(9000)} END",
    "policy_issued": f"CASE WHEN {_ON['policy_late']} THEN {_BIG(1200)} ELSE {_BIG(800)} END",
    "policy_expires": f"CASE WHEN {_ON['policy_short']} THEN {_BIG(1600)} ELSE {_BIG(9000)} END",
    "protocol_digest": f"CASE WHEN {_ON['digest']} THEN 'sha256:other' ELSE 'sha256:protocol' END",
    "issued_at": f"CASE WHEN {_ON['early']} THEN {_BIG(850)} ELSE {_BIG(1000)} END",
    "expires_at": f"CASE WHEN {_ON['expires']} THEN {_BIG(700)} ELSE {_BIG(2000)} END",
    "starts": f"CASE WHEN {_ON['window_early']} THEN {_BIG(840)} ELSE {_BIG(1100)} END",
    "ends": f"CASE WHEN {_ON['window_empty']} THEN {_BIG(1100)} WHEN {_ON['window_late']} THEN {_BIG(2001)} ELSE {_BIG(1900)} END",
    "sample": f"CASE WHEN {_ON['rule']} THEN {_BIG(1)} ELSE {_BIG(2500)} END",
    "window_id": "concat('w', CAST(k % 3 AS STRING))",
    "bound_window": f"CASE WHEN {_ON['membership']} THEN 'other' ELSE concat('w', CAST(k % 3 AS STRING)) END",
    "b_profiles": f"CASE WHEN {_ON['few']} THEN {_BIG(1)} ELSE {_BIG(7)} END",
    "b_executions": f"CASE WHEN {_ON['executions']} THEN {_BIG(1001)} ELSE {_BIG(1000)} END",
    "b_concurrency": f"CASE WHEN {_ON['concurrency']} THEN {_BIG(5)} ELSE {_BIG(4)} END",
    "b_wall": f"CASE WHEN {_ON['wall']} THEN CASE WHEN k % 2 = 0 THEN {_BIG(1001)} ELSE {_BIG(801)} END ELSE {_BIG(700)} END",
}
_PLACE = "CAST(place AS STRING)"
TARGET = {
    "profile": f"CASE WHEN l_partkey % 61 = 0 THEN 'px' WHEN l_partkey % 37 = 0 AND place > 1 THEN concat('p', CAST(place - 1 AS STRING)) ELSE concat('p', {_PLACE}) END",
    "endpoint": f"CASE WHEN l_suppkey % 43 = 0 THEN 'e9' WHEN l_suppkey % 47 = 0 THEN concat('e', CAST((place + 1) % 3 AS STRING)) ELSE concat('e', CAST(place % 3 AS STRING)) END",
    "r1": "concat('r', CAST(l_suppkey % 19 AS STRING))",
    "r2": "CASE WHEN l_suppkey % 23 = 0 THEN 'r0' ELSE concat('s', CAST(l_partkey % 9 AS STRING)) END",
    "profile_digest": f"CASE WHEN l_partkey % 53 = 0 THEN 'd0' ELSE concat('d', {_PLACE}) END",
    "runtime": "concat('r', CAST(place % 3 AS STRING))",
    "transport": "CASE WHEN l_partkey % 59 = 0 THEN 'http' ELSE concat('t', CAST(place % 3 AS STRING)) END",
}
_ENDPOINTS = [(f"e{i}", f"r{i}", f"t{i}") for i in range(3)]


def plans(spark, sf_dir):
    """One row a plan, its digest that of the plan or, where tampered with, of another."""
    by = Window.partitionBy("l_orderkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("place", F.row_number().over(by.orderBy(*catalog.EVERY)).cast("bigint"))
    made = {name: F.expr(text) for name, text in TARGET.items()}
    target = F.struct(made["profile"].alias("profile"), made["endpoint"].alias("endpoint"), F.array(made["r1"], made["r2"]).alias("receipts"), *[made[c].alias(c) for c in ("profile_digest", "runtime", "transport")])
    lines = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("place", target.alias("t")))).alias("t"))  # an order has seven at most
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 7 + F.col("o_custkey") + 1).alias("k")).join(lines, "o_orderkey")
    rows = rows.select("o_orderkey", "k", F.col("t.t").alias("t"), *[F.expr(text).alias(name) for name, text in FIELDS.items()])
    number = F.sequence(F.lit(1), F.size("t") + F.expr(f"CASE WHEN {_ON['extra']} THEN 1 ELSE 0 END"))
    profile = lambda i: F.struct(F.concat(F.lit("p"), i).alias("id"), F.concat(F.lit("r"), i % 3).alias("runtime"), F.concat(F.lit("d"), i).alias("digest"))
    rule = lambda sample: F.struct(F.lit("basis").alias("algorithm"), sample.alias("sample"), F.lit("seed").alias("seed"))
    ends = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("alias", "runtime", "transport"), e)]) for e in _ENDPOINTS])
    c, text = F.col, F.lit
    policy = F.struct(text("sha256:policy").alias("digest"), c("policy_issued").alias("issued_at"), c("policy_expires").alias("expires_at"))
    selected = F.when(c("selected").isNotNull(), F.struct(c("selected").alias("digest"), policy["issued_at"].alias("issued_at"), policy["expires_at"].alias("expires_at")))
    own = rule(F.lit(2500).cast("bigint"))
    membership = manifests.membership_digest(c("bound_window"), text("sha256:protocol"), own)
    out = rows.select(
        "o_orderkey",
        "k",
        F.struct("state", text("study").alias("study"), text("sha256:protocol").alias("protocol"), F.lit(500).cast("bigint").alias("created_at"), c("protocol_expires").alias("expires_at"), selected.alias("policy"), "last_event_at", text("sha256:snapshot").alias("digest")).alias("snapshot"),
        F.struct("study", text("sha256:protocol").alias("digest"), F.lit(500).cast("bigint").alias("created_at"), c("protocol_expires").alias("expires_at"), own.alias("rule"), F.transform(number, profile).alias("profiles"), ends.alias("endpoints"), F.lit(1000).cast("bigint").alias("max_executions"), F.lit(4).cast("bigint").alias("max_concurrency")).alias("protocol"),
        policy.alias("policy"),
        F.struct("window_id", "starts", "ends", rule(c("sample")).alias("rule"), membership.alias("membership")).alias("window"),
        F.when(F.expr(_ON["reversed"]), F.reverse("t")).otherwise(c("t")).alias("targets"),
        F.struct(*[c(f"b_{n}").alias(n) for n in ("profiles", "executions", "concurrency", "wall")]).alias("budget"),
        text("sha256:snapshot").alias("snapshot_digest"),
        "protocol_digest",
        text("sha256:policy").alias("policy_digest"),
        "issued_at",
        "expires_at",
    )
    return out.withColumn("plan_digest", F.when(F.expr(_ON["tampered"]), "sha256:0").otherwise(shadow.plan_digest()))


def shadow_plan_faults(spark, sf_dir):
    """What is wrong with each plan."""
    return shadow.shadow_plan_faults(plans(spark, sf_dir)).select("o_orderkey", "plan_digest", F.array_join("faults", ",").alias("faults"))


def queries() -> dict:
    return {"shadow_plan_faults": shadow_plan_faults}


def oracle_sql() -> dict[str, str]:
    duck = lambda text: text.replace("AS STRING", "AS VARCHAR")
    fields = ", ".join(f"{duck(text)} AS {name}" for name, text in FIELDS.items())
    target = ", ".join(f"{duck(text)} AS {name}" for name, text in TARGET.items())
    rule = lambda sample: f"'{{\"algorithm\":\"basis\",\"sample\":' || {sample} || ',\"seed\":\"seed\"}}'"
    member = lambda window: f"'sha256:' || sha256('{{\"domain\":\"{manifests.MEMBERSHIP_DOMAIN}\",\"value\":{{\"protocol\":\"sha256:protocol\",\"rule\":' || {rule('2500')} || ',\"window_id\":\"' || {window} || '\"}}}}')"
    one = """'{"endpoint":"' || endpoint || '","profile":"' || profile || '","profile_digest":"' || profile_digest || '","receipts":["' || r1 || '","' || r2 || '"],"runtime":"' || runtime || '","transport":"' || transport || '"}'"""
    body = f"""'{{"budget":{{"concurrency":' || b_concurrency || ',"executions":' || b_executions || ',"profiles":' || b_profiles || ',"wall":' || b_wall || '}},"expires_at":' || expires_at || ',"issued_at":' || issued_at || ',"policy_digest":"sha256:policy","protocol_digest":"' || protocol_digest || '","snapshot_digest":"sha256:snapshot","targets":[' || said || '],"window":{{"ends":' || ends || ',"membership":"' || {member("bound_window")} || '","rule":' || {rule("sample")} || ',"starts":' || starts || ',"window_id":"' || window_id || '"}}}}'"""
    rules = [
        ("not-shadow-assessing", f"state <> '{shadow.READY}' OR selected IS NULL"),
        ("snapshot-protocol", "study <> 'study'"),
        ("snapshot-policy", "selected IS DISTINCT FROM 'sha256:policy'"),
        ("derived-digest", "protocol_digest <> 'sha256:protocol'"),
        ("membership", "bound_window <> window_id OR sample <> 2500"),
        ("expiry-before-issue", "expires_at <= issued_at"),
        ("issued-before-snapshot", "issued_at < coalesce(last_event_at, 500)"),
        ("issued-before-policy", "issued_at < policy_issued"),
        ("beyond-protocol", "expires_at > protocol_expires"),
        ("beyond-policy", "expires_at > policy_expires"),
        ("window-empty", "starts >= ends"),
        ("window-before-issue", "starts < issued_at"),
        ("window-beyond-plan", "ends > expires_at"),
        ("target-repeated", "profiles < n"),
        ("target-of-unknown-profile", "unknown"),
        ("target-endpoint", "unserved"),
        ("receipt-repeated", "twice"),
        ("target-missing", "known < n_profiles"),
        ("targets-not-derived", "unsorted OR wrong"),
        ("budget-profiles", "b_profiles < n"),
        ("budget-executions", "b_executions > 1000"),
        ("budget-concurrency", "b_concurrency > 4"),
        ("budget-beyond-plan", "b_wall > expires_at - issued_at"),
        ("budget-beyond-window", "b_wall > ends - starts"),
        ("plan-digest", _ON["tampered"]),
    ]
    listed = ", ".join(f"CASE WHEN {r} THEN '{code}' END" for code, r in rules)
    every = ", ".join(catalog.EVERY)
    return {
        "shadow_plan_faults": f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {every}) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
lines AS (SELECT l_orderkey AS o_orderkey, place, n, {target} FROM placed),
plans AS (SELECT o_orderkey, k, {fields} FROM (SELECT o_orderkey, o_orderkey * 7 + o_custkey + 1 AS k FROM orders)),
profiles AS (SELECT o_orderkey, 'p' || i AS id, 'r' || (i % 3) AS p_runtime, 'd' || i AS p_digest FROM (SELECT o_orderkey, max(n) + CASE WHEN any_value({_ON['extra']}) THEN 1 ELSE 0 END AS m FROM lines JOIN plans USING (o_orderkey) GROUP BY ALL), unnest(range(1, m + 1)) AS t(i)),
ends(alias, e_runtime, e_transport) AS (VALUES {", ".join(map(str, _ENDPOINTS))}),
judged AS (SELECT lines.*, id, p_digest, p_runtime, e_transport, lag(profile) OVER (PARTITION BY lines.o_orderkey ORDER BY CASE WHEN {_ON['reversed']} THEN -place ELSE place END) AS before
  FROM lines JOIN plans ON plans.o_orderkey = lines.o_orderkey LEFT JOIN profiles ON profiles.o_orderkey = lines.o_orderkey AND profiles.id = lines.profile LEFT JOIN ends ON alias = endpoint AND e_runtime = p_runtime),
targets AS (SELECT o_orderkey, max(n) AS n, count(DISTINCT profile) AS profiles, count(DISTINCT id) AS known, bool_or(id IS NULL) AS unknown, bool_or(id IS NOT NULL AND e_transport IS NULL) AS unserved, bool_or(r1 = r2) AS twice, bool_or(coalesce(before > profile, FALSE)) AS unsorted,
    bool_or(r1 > r2 OR profile_digest IS DISTINCT FROM p_digest OR runtime IS DISTINCT FROM p_runtime OR transport IS DISTINCT FROM e_transport) AS wrong, string_agg({one}, ',' ORDER BY place) AS forth, string_agg({one}, ',' ORDER BY place DESC) AS back FROM judged GROUP BY o_orderkey),
known_ AS (SELECT o_orderkey, count(*) AS n_profiles FROM profiles GROUP BY o_orderkey),
whole AS (SELECT *, CASE WHEN {_ON['reversed']} THEN back ELSE forth END AS said FROM plans JOIN targets USING (o_orderkey) JOIN known_ USING (o_orderkey))
SELECT o_orderkey, CASE WHEN {_ON['tampered']} THEN 'sha256:0' ELSE 'sha256:' || sha256('{{"domain":"{shadow.DOMAIN}","value":' || {body} || '}}') END AS plan_digest, array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') AS faults FROM whole"""
    }
