"""Queries of window manifests, with SQL that gives the same rows.

Every user is a window; its events are traces and, where they are errors, evaluators' evidence.  Each day of a window proposes a change.  What
comes on some days is withheld to the next, some watermarks fall and some capacities belong to another policy, so changes are refused;
copies of the sealed manifests are tampered with for the second query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests

PROTOCOL, POLICY, START, END = "sha256:protocol", "sha256:policy", 0, 5
SEED, SAMPLE, ALGORITHM = "seed-1", 2_500, "sha256-basis-points"
# One SQL text for both engines, of a window's number w and its day d.
_DAY = "CAST(datediff(to_date(ts), DATE '2024-01-01') AS BIGINT)"
_DAY_SQL = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT)"
_PLACE = "d + CASE WHEN (d + w) % 7 = 2 THEN 1 ELSE 0 END"
_WATERMARK = "d + 10 - CASE WHEN (d + w) % 5 = 3 THEN 3 ELSE 0 END"
_CLOSURE = "CASE WHEN d % 2 = 0 THEN 'watermark' ELSE 'quota' END"
_CAPACITY = {
    "kind": "CASE WHEN w % 3 = 0 THEN 'reported' ELSE 'unavailable' END",
    "requests": "CASE WHEN w % 3 = 0 THEN CAST(floor(d / 6) AS BIGINT) END",
    "policy": "CASE WHEN w % 3 = 0 THEN CASE WHEN (d + w) % 11 = 0 THEN 'sha256:other' ELSE 'sha256:policy' END END",
    "starts": "CASE WHEN w % 3 = 0 THEN CAST(0 AS BIGINT) END",
    "ends": "CASE WHEN w % 3 = 0 THEN CAST(5 + CASE WHEN (d + w) % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) END",
}
_TAMPERED = {  # by (w + 7 * revision) % 40, the digest left as it was or (True) made anew
    1: ("watermark", "CAST(4 AS BIGINT)", True),
    2: ("watermark", "watermark + 1", False),
    3: ("predecessor", "CAST(NULL AS STRING)", True),
    4: ("predecessor", "'sha256:0'", True),
    5: ("membership", "'sha256:0'", True),
    6: ("policy", "'sha256:other'", True),
    7: ("starts", "CAST(5 AS BIGINT)", True),
    8: ("revision", "revision + 1", True),
    9: ("protocol", "'sha256:none'", True),
    10: ("version", "'window-manifest/0'", True),
    11: ("traces", "'sha256:0'", True),
}


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("w"), F.expr(_DAY).alias("d"), "event_type")


def _first(spark, sf_dir):
    rule = F.struct(F.lit(ALGORITHM).alias("algorithm"), F.lit(SAMPLE).cast("bigint").alias("sample"), F.lit(SEED).alias("seed"))
    none = F.struct(F.lit("unavailable").alias("kind"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in manifests.CAPACITY.fields[1:]])
    windows = _events(spark, sf_dir).select(F.concat(F.lit("w"), F.col("w")).alias("window_id")).distinct()
    fixed = {"protocol": F.lit(PROTOCOL), "policy": F.lit(POLICY), "starts": F.lit(START).cast("bigint"), "ends": F.lit(END).cast("bigint"), "watermark": F.lit(9).cast("bigint"), "closure": F.lit("watermark")}
    return manifests.first(windows.withColumns({**fixed, "rule": rule, "traces": F.lit("sha256:none"), "evaluators": F.lit("sha256:none"), "capacity": none}))


def _revised(spark, sf_dir):
    events = _events(spark, sf_dir)
    window = F.concat(F.lit("w"), F.col("w")).alias("window_id")
    members = events.select(window, F.expr(_PLACE).alias("place"), F.when(F.col("event_type") == "error", "evaluator").otherwise("trace").alias("kind"), F.col("event_id").cast("string").alias("member"))
    days = events.select("w", "d").distinct().withColumn("window_id", window).withColumn("place", F.col("d"))
    sets = manifests.arrivals(members, days)
    capacity = F.struct(*[F.expr(_CAPACITY[f.name]).alias(f.name) for f in manifests.CAPACITY.fields])
    changes = days.withColumns({"watermark": F.expr(_WATERMARK), "closure": F.expr(_CLOSURE), "capacity": capacity}).join(sets, ["window_id", "place"])
    return manifests.revise(_first(spark, sf_dir), changes.select("window_id", "place", *manifests.CHANGED))


def window_revisions(spark, sf_dir):
    """What became of every proposed change: refused, or sealed as the next revision."""
    out = _revised(spark, sf_dir)
    return out.select("window_id", "place", "refusal", "revision", "watermark", "closure", "traces", "evaluators", "membership", "predecessor", "self_digest")


def manifest_faults(spark, sf_dir):
    """What is wrong with the sealed manifests after some were tampered with."""
    sealed = _revised(spark, sf_dir).where("refusal IS NULL").select(*manifests.MANIFEST).unionByName(_first(spark, sf_dir))
    turn = F.expr("(CAST(substring(window_id, 2) AS BIGINT) + 7 * revision) % 40")
    named = {c: F.col(c) for c in manifests.BODY}
    for k, (c, value, _) in _TAMPERED.items():
        named[c] = F.when(turn == k, F.expr(value)).otherwise(named[c])
    changed = sealed.select(turn.alias("turn"), "self_digest", F.col("revision").alias("sealed"), *[v.alias(c) for c, v in named.items()])
    anew = F.col("turn").isin(*[k for k, (_, _, a) in _TAMPERED.items() if a])
    changed = changed.withColumn("self_digest", F.when(anew, manifests.self_digest()).otherwise(F.col("self_digest")))
    known = spark.createDataFrame([(PROTOCOL, (ALGORITHM, SAMPLE, SEED))], "protocol string, rule struct<algorithm:string,sample:bigint,seed:string>")
    out = manifests.manifest_faults(changed, known)
    return out.select("window_id", "sealed", "revision", "self_digest", F.array_join("faults", ",").alias("faults"))


def queries() -> dict:
    return {f.__name__: f for f in (window_revisions, manifest_faults)}


def _tree(source: str, levels: int = 4) -> str:
    """SQL of the digest of each (w, place, kind)'s members ``m`` of a table."""
    keys = "w, place, kind"
    out = [f"h{levels} AS (SELECT {keys}, substring(h, 1, {2 * levels}) AS p, h || ':' || count(*) AS x FROM (SELECT {keys}, sha256(m) AS h FROM {source}) GROUP BY {keys}, h)"]
    for depth in range(levels, 0, -1):
        out.append(f"h{depth - 1} AS (SELECT {keys}, substring(p, 1, {2 * depth - 2}) AS p, p || ':' || sha256(string_agg(x, ',' ORDER BY x)) AS x FROM h{depth} GROUP BY {keys}, p)")
    return ",\n".join([*out, f"tree AS (SELECT {keys}, sha256(string_agg(x, ',' ORDER BY x)) AS digest FROM h0 GROUP BY {keys})"])


_TEXT = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_NUMBER = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'null')"
_RULE = f'{{"algorithm":"{ALGORITHM}","sample":{SAMPLE},"seed":"{SEED}"}}'
_CAPACITY_TEXT = "'{\"ends\":' || " + _NUMBER("c_ends") + " || ',\"kind\":' || " + _TEXT("c_kind") + " || ',\"policy\":' || " + _TEXT("c_policy") + " || ',\"requests\":' || " + _NUMBER("c_requests") + " || ',\"starts\":' || " + _NUMBER("c_starts") + " || '}'"
_NUMBERS = {"starts", "ends", "watermark", "revision"}


def _digest_sql(given: dict[str, str]) -> str:
    """SQL of the self digest; ``given`` says what stands for a field in place of its column (cap: the capacity's text)."""
    said = []
    for c in sorted(manifests.BODY):
        x = given.get(c, c)
        said.append(f"'\"{c}\":' || " + {"rule": f"'{_RULE}'", "capacity": given.get("cap", "cap")}.get(c, _NUMBER(x) if c in _NUMBERS else _TEXT(x)))
    return f"'sha256:' || sha256('{{\"domain\":\"{manifests.DOMAIN}\",\"value\":{{' || " + " || ',' || ".join(said) + " || '}}')"


_MEMBER = lambda protocol: f"'sha256:' || sha256('{{\"domain\":\"{manifests.MEMBERSHIP_DOMAIN}\",\"value\":{{\"protocol\":\"' || {protocol} || '\",\"rule\":{_RULE},\"window_id\":\"' || window_id || '\"}}}}')"
_UNREPORTED = '{"ends":null,"kind":"unavailable","policy":null,"requests":null,"starts":null}'
_FIXED = {"version": f"'{manifests.VERSION}'", "protocol": f"'{PROTOCOL}'", "policy": f"'{POLICY}'", "starts": f"{START}", "ends": f"{END}"}


def _chain() -> str:
    same = "n.traces = s.traces AND n.evaluators = s.evaluators AND n.cap = s.cap"
    given = {"watermark": "n.watermark", "closure": "n.closure", "traces": "n.traces", "evaluators": "n.evaluators", "cap": "n.cap", "window_id": "s.window_id", "membership": "s.membership", "revision": "(s.revision + 1)", "predecessor": "s.self_digest", **_FIXED}
    kept = lambda c: f"CASE WHEN refusal IS NULL THEN n_{c} ELSE s_{c} END AS {c}"
    both = ["watermark", "closure", "traces", "evaluators", "cap"]
    capacity = ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS c_{k}" for k, v in _CAPACITY.items())
    return f"""e AS (SELECT event_id, user_id AS w, {_DAY_SQL} AS d, event_type FROM events),
members AS (SELECT w, {_PLACE} AS place, CASE WHEN event_type = 'error' THEN 'evaluator' ELSE 'trace' END AS kind, CAST(event_id AS VARCHAR) AS m FROM e),
{_tree("members")},
days AS (SELECT DISTINCT w, d FROM e),
came AS (SELECT days.w, days.d, kind, digest, place FROM days JOIN tree ON tree.w = days.w AND place <= days.d),
sets AS (SELECT w, d, 'sha256:' || sha256(coalesce(string_agg(digest, ',' ORDER BY place) FILTER (kind = 'trace'), '')) AS traces, 'sha256:' || sha256(coalesce(string_agg(digest, ',' ORDER BY place) FILTER (kind = 'evaluator'), '')) AS evaluators
  FROM (SELECT days.w, days.d, kind, digest, place FROM days LEFT JOIN came USING (w, d)) GROUP BY w, d),
proposed AS (SELECT *, {_WATERMARK} AS watermark, {_CLOSURE} AS closure, {capacity}, row_number() OVER (PARTITION BY w ORDER BY d) AS nth FROM sets),
changes AS (SELECT *, {_CAPACITY_TEXT} AS cap FROM proposed),
base AS (SELECT w, window_id, {_MEMBER(f"'{PROTOCOL}'")} AS membership, CAST(1 AS BIGINT) AS revision, CAST(NULL AS VARCHAR) AS predecessor, CAST(9 AS BIGINT) AS watermark, 'watermark' AS closure, 'sha256:none' AS traces, 'sha256:none' AS evaluators, '{_UNREPORTED}' AS cap,
  'unavailable' AS c_kind, CAST(NULL AS VARCHAR) AS c_policy, CAST(NULL AS BIGINT) AS c_starts, CAST(NULL AS BIGINT) AS c_ends FROM (SELECT DISTINCT w, 'w' || w AS window_id FROM e)),
firsts AS (SELECT *, {_digest_sql(_FIXED)} AS self_digest FROM base),
steps AS (
  SELECT w, window_id, membership, CAST(0 AS BIGINT) AS nth, CAST(-1 AS BIGINT) AS place, CAST('first' AS VARCHAR) AS refusal, revision, predecessor, watermark, closure, traces, evaluators, cap, c_kind, c_policy, c_starts, c_ends, self_digest FROM firsts
  UNION ALL
  SELECT w, window_id, membership, nth, place, refusal, CASE WHEN refusal IS NULL THEN revision + 1 ELSE revision END, CASE WHEN refusal IS NULL THEN s_digest ELSE predecessor END, {", ".join(kept(c) for c in [*both, "c_kind", "c_policy", "c_starts", "c_ends"])}, CASE WHEN refusal IS NULL THEN n_digest ELSE s_digest END
  FROM (SELECT s.w, s.window_id, s.membership, n.nth, n.d AS place, s.revision, s.predecessor, s.self_digest AS s_digest, {_digest_sql(given)} AS n_digest, {", ".join(f"s.{c} AS s_{c}, n.{c} AS n_{c}" for c in [*both, "c_kind", "c_policy", "c_starts", "c_ends"])},
      CASE WHEN n.watermark < s.watermark THEN 'watermark-fell' WHEN {same} THEN 'nothing-changed' WHEN n.c_kind = 'reported' AND n.c_policy <> '{POLICY}' THEN 'capacity-policy' WHEN n.c_kind = 'reported' AND (n.c_starts <> {START} OR n.c_ends <> {END}) THEN 'capacity-bounds' END AS refusal
    FROM steps s JOIN changes n ON n.w = s.w AND n.nth = s.nth + 1))"""


def _faults_sql() -> str:
    values = {**{c: c for c in manifests.BODY if c not in ("rule", "capacity")}, **_FIXED}
    picked = []
    for c, now in values.items():
        cases = " ".join(f"WHEN turn = {k} THEN {v.replace('STRING', 'VARCHAR')}" for k, (name, v, _) in _TAMPERED.items() if name == c)
        picked.append(f"CASE {cases} ELSE {now} END AS {c}" if cases else f"{now} AS {c}")
    anew = ", ".join(str(k) for k, (_, _, a) in _TAMPERED.items() if a)
    differs = " OR ".join(f"t.{c} IS DISTINCT FROM b.{c}" for c in manifests.FROZEN if c != "rule")
    own = _MEMBER("protocol").replace("window_id ||", "t.window_id ||").replace("|| protocol ||", "|| t.protocol ||")
    digest = _digest_sql({c: f"t.{c}" for c in values} | {"cap": "t.cap"})
    rules = [
        ("interval-empty", "t.starts >= t.ends"),
        ("ends-after-watermark", "t.ends > t.watermark"),
        ("first-with-predecessor", "t.revision = 1 AND t.predecessor IS NOT NULL"),
        ("predecessor-missing", "t.revision > 1 AND t.predecessor IS NULL"),
        ("membership", f"t.membership <> {own}"),
        ("capacity-policy", "t.c_kind = 'reported' AND t.c_policy <> t.policy"),
        ("capacity-bounds", "t.c_kind = 'reported' AND (t.c_starts <> t.starts OR t.c_ends <> t.ends)"),
        ("self-digest", f"t.self_digest <> {digest}"),
        ("protocol-unknown", f"t.protocol <> '{PROTOCOL}'"),
        ("predecessor-unknown", "t.predecessor IS NOT NULL AND b.window_id IS NULL"),
        ("revision-gap", "t.revision <> b.revision + 1"),
        ("watermark-fell", "t.watermark < b.watermark"),
        ("nothing-changed", "t.traces = b.traces AND t.evaluators = b.evaluators AND t.cap = b.cap"),
        ("frozen-changed", f"b.window_id IS NOT NULL AND ({differs})"),
        ("fork", "t.predecessor IS NOT NULL AND t.children > 1"),
        ("revision-repeated", "t.twins > 1"),
    ]
    listed = ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in rules)
    return f"""WITH RECURSIVE {_chain()},
sealed AS (SELECT *, revision AS sealed, (w + 7 * revision) % 40 AS turn FROM steps WHERE refusal IS NULL OR refusal = 'first'),
changed AS (SELECT sealed, turn, self_digest AS old_digest, cap, c_kind, c_policy, c_starts, c_ends, {", ".join(picked)} FROM sealed),
digested AS (SELECT *, CASE WHEN turn IN ({anew}) THEN {_digest_sql({})} ELSE old_digest END AS self_digest FROM changed),
t AS (SELECT *, count(*) OVER (PARTITION BY window_id, predecessor) AS children, count(*) OVER (PARTITION BY window_id, revision) AS twins FROM digested)
SELECT t.window_id, t.sealed, t.revision, t.self_digest, array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') AS faults
FROM t LEFT JOIN digested b ON b.window_id = t.window_id AND b.self_digest = t.predecessor"""


def oracle_sql() -> dict[str, str]:
    return {
        "window_revisions": f"""WITH RECURSIVE {_chain()}
SELECT window_id, place, refusal, CASE WHEN refusal IS NULL THEN revision END AS revision, CASE WHEN refusal IS NULL THEN watermark END AS watermark, CASE WHEN refusal IS NULL THEN closure END AS closure, CASE WHEN refusal IS NULL THEN traces END AS traces,
  CASE WHEN refusal IS NULL THEN evaluators END AS evaluators, CASE WHEN refusal IS NULL THEN membership END AS membership, CASE WHEN refusal IS NULL THEN predecessor END AS predecessor, CASE WHEN refusal IS NULL THEN self_digest END AS self_digest
FROM steps WHERE nth > 0""",
        "manifest_faults": _faults_sql(),
    }
