"""Queries of event chains, snapshots and what is resumed from them, with SQL that gives the same rows.

The events table gives a chain for every user (with an expiry) and a long one for every event type.  What is planted in the
chains is one SQL text for both engines; the SQL replays them by recursion, event after event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_folder, stored
from ..operators import chains, snapshots
from ..streaming import stateful
from .control import _NEXT, LATER, LIFE

DAY_MS = 86_400_000
AT = 12  # events of each chain before its checkpoint
SIZES = {"segment": 64, "fan": 8}  # small, so that small tables take several rounds as well


def _texts(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _pick(values, place: str) -> str:
    """The value at a place from 0, in words of both engines."""
    return "CASE " + place + "".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _facts(sequence: str = "sequence", event: str = "event_id") -> str:
    """The fact and the result of an event at a place of its chain, in words of both engines."""
    return f"""CASE WHEN {sequence} <= {len(LIFE)} THEN {_pick(LIFE, f"{sequence} - 1")} WHEN every = 97 THEN {_pick(LATER, f"{event} % {len(LATER)}")}
      WHEN {sequence} % 2 = 0 THEN 'window-manifest-recorded' ELSE 'window-assessment-recorded' END AS fact,
    CASE WHEN every = 97 AND {event} % 31 = 0 THEN 'STALE' WHEN every = 97 AND {event} % 17 = 0 THEN 'HOLD' WHEN {sequence} = 4 THEN 'NOMINATED' ELSE 'PASS' END AS result"""


_NAMED = """
named AS (
  SELECT concat('u', CAST(user_id AS STRING)) AS controller, 97 AS every, event_id, ts FROM events
  UNION ALL SELECT concat('t', event_type), 1999, event_id, ts FROM events),
"""
_CHAIN = """chain AS (
  SELECT controller, CAST(sequence AS BIGINT) AS sequence, event_id AS source, fact, CASE WHEN pick = 4 THEN 'STALE' ELSE result END AS result, id AS event_id,
    CASE WHEN pick = 5 THEN 'other' ELSE 'study' END AS study, 'digest' AS protocol, CASE WHEN pick = 2 THEN 'elsewhere' ELSE previous END AS predecessor,
    CAST(sequence * 10 - CASE WHEN pick = 6 THEN 15 ELSE 0 END AS BIGINT) AS occurred_at FROM linked WHERE pick <> 0
  UNION ALL SELECT controller, CAST(sequence AS BIGINT), event_id, fact, result, concat('f', id), 'study', 'digest', previous, CAST(sequence * 10 AS BIGINT) FROM linked WHERE pick = 1
  UNION ALL SELECT controller, CAST(sequence AS BIGINT), event_id, fact, result, id, 'study', 'digest', previous, CAST(sequence * 10 AS BIGINT) FROM linked WHERE pick = 3),
genesis AS (
  SELECT DISTINCT controller, 'study' AS study, 'digest' AS protocol, CAST(0 AS BIGINT) AS created_at,
    CAST(CASE WHEN every = 97 THEN 401 ELSE 1000000000 END AS BIGINT) AS expires_at FROM named)
"""
_PICK = f"CASE WHEN sequence > {len(LIFE)} THEN event_id % every ELSE 96 END AS pick"

#: The SQL's text.  kind u: users' chains, kind t: long ones; ``pick`` plants one thing in each of the first numbers.
CHAINS = f"""{_NAMED}placed AS (SELECT *, row_number() OVER (PARTITION BY controller ORDER BY ts, event_id) AS sequence FROM named),
facts AS (
  SELECT *, {_facts()},
    {_PICK} FROM placed),
signed AS (SELECT *, {{sha}}(concat_ws('|', controller, CAST(sequence AS STRING), fact, result, CAST(event_id AS STRING)){{bits}}) AS id FROM facts),
linked AS (SELECT *, lag(id) OVER (PARTITION BY controller ORDER BY sequence) AS previous FROM signed),
{_CHAIN}"""
#: The same for Spark, where events know the one before them by its number, so that no digest goes through a window.
_PLACED = f"WITH {_NAMED.strip().rstrip(',')} SELECT controller, every, event_id, row_number() OVER w AS sequence, lag(event_id) OVER w AS before FROM named WINDOW w AS (PARTITION BY controller ORDER BY ts, event_id)"
_LINKED = f"""facts AS (SELECT *, {_facts()}, {_PICK} FROM named),
earlier AS (SELECT controller, every, sequence, event_id, before, pick, fact, result, {_facts("(sequence - 1)", "before").replace("AS fact", "AS fact_before").replace("AS result", "AS result_before")} FROM facts),
linked AS (
  SELECT controller, sequence, event_id, pick, fact, result, sha2(concat_ws('|', controller, CAST(sequence AS STRING), fact, result, CAST(event_id AS STRING)), 256) AS id,
    CASE WHEN sequence > 1 THEN sha2(concat_ws('|', controller, CAST(sequence - 1 AS STRING), fact_before, result_before, CAST(before AS STRING)), 256) END AS previous FROM earlier),
"""


def _chains(spark, sf_dir):
    """(events, genesis, identity); the events' places in their chains are written once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "ts")
    placed = stored(spark.sql(_PLACED.replace("FROM events", "FROM {events}"), events=events), 1_000_000)
    text = (_LINKED + _CHAIN).replace("FROM named", "FROM {named}")
    rows, genesis = (spark.sql(f"WITH {text} SELECT * FROM {t}", named=placed) for t in ("chain", "genesis"))
    body = [F.col("controller"), F.col("sequence").cast("string"), F.col("fact"), F.col("result"), F.col("source").cast("string")]
    return rows, genesis, F.sha2(F.concat_ws("|", *body), 256)


def replayed_chains(spark, sf_dir):
    """Where each chain leads, and the first event at fault."""
    events, genesis, identity = _chains(spark, sf_dir)
    return chains.replay(events, genesis, identity=identity, **SIZES).drop("last_event_at")


def _mark():
    return F.length("controller") * 7 + F.ascii(F.substring("controller", -1, 1)) * 3 + F.ascii(F.substring("controller", 2, 1))


def resumed_chains(spark, sf_dir):
    """Checkpoints taken after some events, a few of them changed, one in three pinned; and what follows the sound ones."""
    events, genesis, identity = _chains(spark, sf_dir)
    how = {"identity": identity, **SIZES}
    taken = chains.replay(events.where(F.col("sequence") <= AT), genesis, **how)
    state = F.when(_mark() % 10 == 1, "HOLD").otherwise(F.col("state"))
    taken = taken.select("controller", F.lit("digest").alias("protocol"), F.col("applied").alias("sequence"), F.col("last_event_id").alias("event_id"), F.col("last_event_at").alias("occurred_at"), state.alias("state"), F.sha2(F.concat_ws("|", "controller", "last_event_id"), 256).alias("snapshot_digest"))
    taken = cut(taken)
    pins = taken.where(_mark() % 3 == 0).select("controller", "protocol", "sequence", "event_id", F.when(_mark() % 4 == 0, "another").otherwise(F.col("snapshot_digest")).alias("snapshot_digest"))
    pins = pins.where(_mark() % 10 != 1)
    verified = cut(chains.verify_checkpoints(taken, events, genesis, pins, **how))
    verdicts = verified.select("controller", F.col("sequence").alias("checkpoint"), "verdict")
    after = chains.follow(verified, events, genesis, **how).select("controller", "state", "applied", "refused", "fault")
    return verdicts.join(after, "controller", "left")


#: Snapshots made of the orders, whole ones first, then one thing changed where a prime divides the order's key.
SNAPSHOTS = f"""
keyed AS (SELECT o_orderkey AS k, {_pick(chains.STATES, "o_orderkey % 13")} AS state FROM orders),
leveled AS (SELECT *, CASE k % 13 {" ".join(f"WHEN {i} THEN {n}" for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 3, 4, 8, 4]))} END AS level FROM keyed),
sized AS (SELECT *, CASE WHEN level >= 7 THEN 1 + k % 2 WHEN level >= 5 THEN k % 3 ELSE 0 END AS n_rev, CASE WHEN state = 'ROLLBACK_RECOMMENDED' THEN 2 WHEN level >= 7 THEN 1 ELSE 0 END AS n_win FROM leveled),
snaps AS (
  SELECT k, state, n_rev, n_win, level,
    CAST(CASE WHEN level < 5 THEN CASE WHEN state = 'HOLD' THEN 4 ELSE level END WHEN level = 5 THEN 5 + n_rev WHEN level < 8 THEN 6 + n_rev + n_win ELSE 7 + n_rev + n_win END + CASE WHEN k % 53 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sequence,
    CASE WHEN state <> 'DRAFT' AND k % 59 <> 0 THEN 'e' END AS last_event_id, CASE WHEN state <> 'DRAFT' THEN CASE WHEN k % 61 = 0 THEN 5 WHEN k % 67 = 0 THEN 1000 ELSE 900 END END AS last_event_at,
    CASE WHEN k % 71 = 0 THEN 1001 ELSE 10 END AS created_at, 1000 AS expires_at, CASE WHEN k % 73 = 0 THEN 'other' ELSE 'p' END AS protocol,
    CASE WHEN level >= 2 AND k % 31 <> 0 THEN 'c' END AS collection, CASE WHEN level >= 3 AND k % 37 <> 0 THEN CASE WHEN k % 41 = 0 THEN 'd2' ELSE 'd' END END AS dataset,
    CASE WHEN level >= 4 AND k % 43 <> 0 THEN CASE WHEN k % 47 = 0 THEN 'x' ELSE 'pol' END END AS policy, CASE WHEN k % 79 = 0 THEN 950 ELSE 100 END AS issued_at,
    CASE WHEN level >= 8 OR k % 83 = 0 THEN CASE WHEN k % 89 = 0 THEN 950 ELSE 800 END END AS observed_at, CASE WHEN (state = 'STALE' AND k % 29 <> 0) OR k % 97 = 0 THEN 'late' END AS reason FROM sized),
tested AS (
  SELECT k, 0 AS place, CASE WHEN k % 101 = 0 THEN 'holdout' ELSE 'development' END AS phase, CASE WHEN state = 'HOLD' THEN 'NO_CANDIDATE' WHEN k % 103 = 0 THEN 'STALE' ELSE 'NOMINATED' END AS status, concat('d', CAST(k AS STRING)) AS decision,
    't' AS traces, CASE WHEN state <> 'HOLD' THEN 'pol' END AS policy, CAST(NULL AS STRING) AS manifest FROM snaps WHERE level >= 4 OR state = 'HOLD'
  UNION ALL SELECT k, 1, 'holdout', CASE WHEN k % 107 = 0 THEN 'HOLD' ELSE 'PASS' END, concat('h', CAST(k AS STRING)), 't', 'pol', NULL FROM snaps WHERE level >= 6
  UNION ALL SELECT k, 2, 'window', 'PASS', CASE WHEN k % 109 = 0 THEN concat('h', CAST(k AS STRING)) ELSE concat('v', CAST(k AS STRING)) END, concat('t', CAST(n_rev AS STRING)), CASE WHEN k % 113 = 0 THEN 'y' ELSE 'pol' END, concat('m', CAST(n_rev AS STRING)) FROM snaps WHERE n_win >= 1
  UNION ALL SELECT k, 3, 'window', 'HOLD', concat('w', CAST(k AS STRING)), concat('t', CAST(n_rev AS STRING)), 'pol', CASE WHEN k % 3 = 0 THEN 'm9' ELSE concat('m', CAST(n_rev AS STRING)) END FROM snaps WHERE n_win >= 2),
sealed AS (
  SELECT k, CASE WHEN k % 17 = 0 THEN i + 1 ELSE i END AS revision, i, CASE WHEN i > 1 AND k % 19 <> 0 THEN concat('m', CAST(i - 1 AS STRING)) END AS predecessor, CASE WHEN k % 23 = 0 THEN 'm1' ELSE concat('m', CAST(i AS STRING)) END AS manifest,
    CASE WHEN k % 127 = 0 THEN 'q' ELSE 'p' END AS protocol, CASE WHEN k % 11 = 0 AND i = 2 THEN 210 ELSE 200 END AS starts, CASE WHEN k % 7 = 0 THEN 700 - i WHEN k % 131 = 0 THEN 990 ELSE 600 + i END AS watermark,
    CASE WHEN k % 5 = 0 THEN 't1' ELSE concat('t', CAST(i AS STRING)) END AS traces FROM snaps JOIN (SELECT 1 AS i UNION ALL SELECT 2) AS two ON i <= n_rev)
"""


def snapshot_faults(spark, sf_dir):
    """What is wrong with snapshots whose assessments and windows are nested in them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    text = SNAPSHOTS.replace("FROM orders", "FROM {orders}")
    flat, tested, sealed = (spark.sql(f"WITH {text} SELECT * FROM {t}", orders=orders) for t in ("snaps", "tested", "sealed"))
    policy = lambda digest, issued: F.when(digest.isNotNull(), F.struct(digest.alias("digest"), issued.alias("issued_at"), F.lit(1000).alias("expires_at")))
    each = F.struct("place", "phase", "status", "decision", F.lit("p").alias("protocol"), F.lit("d").alias("dataset"), "traces", F.lit("e").alias("evaluators"), policy(F.col("policy"), F.lit(100)).alias("policy"), "manifest")
    assessments = tested.groupBy("k").agg(F.array_sort(F.collect_list(each)).alias("assessments"))
    revision = F.struct("i", F.lit("w").alias("window"), "revision", "predecessor", "manifest", "protocol", F.lit("pol").alias("policy"), "starts", F.lit(500).alias("ends"), "watermark", "traces", F.lit("e").alias("evaluators"), F.lit("cap").alias("capacity"))
    windows = sealed.groupBy("k").agg(F.array(F.struct(F.lit("w").alias("window"), F.array_sort(F.collect_list(revision)).alias("revisions"))).alias("windows"))
    rows = flat.join(assessments, "k", "left").join(windows, "k", "left").select(
        "k", "state", "sequence", "last_event_id", "last_event_at", "created_at", "expires_at", "protocol", "collection", "assessments", "windows",
        F.when(F.col("dataset").isNotNull(), F.struct("dataset", F.lit("t").alias("traces"), F.lit("e").alias("evaluators"))).alias("evidence"),
        policy(F.col("policy"), F.col("issued_at")).alias("policy"), F.when(F.col("observed_at").isNotNull(), F.struct(F.lit("pol").alias("policy"), "observed_at")).alias("deployment"), F.array_compact(F.array("reason")).alias("stale"),
    )
    return snapshots.snapshot_faults(rows).select("k", F.array_join("faults", ",").alias("faults"))


def _streamed(rows, make, mode: str, end=None):
    """What a stream over the rows, in files of any order and those of ``end`` after them, has written when it has read all of them.

    A micro-batch is half a file a core, of a million rows at most, so it does not grow with the rows.
    """
    spark = rows.sparkSession
    home = f"{shared_folder(spark)}/evenkeel-stream-{uuid.uuid4().hex}"
    source = f"{home}/in"
    side = max(4, spark.sparkContext.defaultParallelism)
    rows.repartition(side).write.option("maxRecordsPerFile", 1_000_000).parquet(source)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", side // 2).parquet(source)
    stateful.start(make(stream), f"{home}/out", f"{home}/check", mode).awaitTermination()
    return spark.read.parquet(f"{home}/out")


def streamed_controllers(spark, sf_dir):
    """The users' chains, without forks and foreign events, folded by a stateful stream; a missing event is waited for."""
    events, _, _ = _chains(spark, sf_dir)
    rows = events.where("controller LIKE 'u%' AND length(event_id) = 64 AND study = 'study'").select("controller", "sequence", "predecessor", "event_id", F.col("occurred_at").alias("at"), "fact", "result")
    said = _streamed(rows, lambda s: stateful.controllers(s, 0, 401), "update")
    last = F.max_by(F.struct("state", "applied", "last_event_id", "refused", "fault"), F.struct("applied", F.coalesce("refused", F.lit(0))))
    return said.groupBy("controller").agg(last.alias("x")).select("controller", "x.*")


#: Both engines' text: the orders as attempts, accepted (some twice) and mostly ended, some after their lease.
JOURNAL = """
SELECT CAST(o_orderkey AS STRING) AS execution, CAST(1 + o_orderkey % 3 AS INT) AS attempt, 'accepted' AS kind, (o_orderkey + 1) * 1000 AS at_ms, CAST(30000 + o_custkey % 7 AS BIGINT) AS lease_ms, NULL AS category FROM orders
UNION ALL SELECT CAST(o_orderkey AS STRING), CAST(1 + o_orderkey % 3 AS INT), 'accepted', (o_orderkey + 1) * 1000 + 5000, 90000, NULL FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT CAST(o_orderkey AS STRING), CAST(1 + o_orderkey % 3 AS INT), CASE o_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'not_sent' ELSE 'completed' END, (o_orderkey + 1) * 1000 + 25000 + o_custkey % 11 * 1000, NULL,
  CASE o_custkey % 3 WHEN 0 THEN 'transport' WHEN 1 THEN 'policy' END FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT CAST(o_orderkey AS STRING), 9, 'completed', (o_orderkey + 1) * 1000, NULL, NULL FROM orders WHERE o_orderkey % 11 = 0
"""


def streamed_attempts(spark, sf_dir):
    """What became of leased attempts, said once by a stream when their leases are over."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    rows = spark.sql(JOURNAL.replace("FROM orders", "FROM {orders}"), orders=orders)
    first, last, over = rows.agg(F.min("at_ms"), F.max("at_ms"), F.max(F.col("at_ms") + 2 * F.coalesce("lease_ms", F.lit(0)))).first()
    delay = 0 if first is None else last - first + DAY_MS  # the files are in no order, so any row may come after the last one
    end = spark.createDataFrame([("end", 9, "failed", None, None, (over or 0) + delay + DAY_MS)], "execution string, attempt int, kind string, lease_ms bigint, category string, at_ms bigint")
    rows, end = (r.withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms") for r in (rows, end))
    return _streamed(rows, lambda s: stateful.settle(s, 3, f"{delay} milliseconds"), "append", end).select("execution", "attempt", "outcome", "at_ms", "again")


def queries() -> dict:
    return {f.__name__: f for f in (replayed_chains, resumed_chains, snapshot_faults, streamed_controllers, streamed_attempts)}


_REPLAY = f"""{CHAINS.format(sha="sha256", bits="").replace("STRING", "VARCHAR")},
sums AS (
  SELECT controller, sequence, min(event_id) AS event_id, count(DISTINCT event_id) AS ids, min(study) AS study, min(fact) AS fact, min(result) AS result,
    min(predecessor) AS predecessor, min(occurred_at) AS occurred_at, min(source) AS source FROM chain GROUP BY ALL),
seen AS (
  SELECT sums.*, created_at, expires_at, lag(event_id) OVER w AS before_id, lag(occurred_at) OVER w AS before_at, lag(sequence) OVER w AS before_place
  FROM sums JOIN genesis USING (controller) WINDOW w AS (PARTITION BY controller ORDER BY sequence)),
judged AS MATERIALIZED (
  SELECT *, CASE WHEN ids > 1 THEN 'fork' WHEN study <> 'study' THEN 'foreign' WHEN coalesce(before_place, 0) <> sequence - 1 THEN 'gap'
    WHEN predecessor IS DISTINCT FROM before_id THEN 'splice' WHEN event_id <> sha256(concat_ws('|', controller, CAST(sequence AS VARCHAR), fact, result, CAST(source AS VARCHAR))) THEN 'identity'
    WHEN occurred_at < before_at THEN 'time-regression'
    WHEN occurred_at >= expires_at AND fact NOT IN ('identity-drift-recorded', 'protocol-expiry-observed', 'controller-retired') THEN 'after-expiry' END AS wrong FROM seen),
r AS (
  SELECT controller, CAST(0 AS BIGINT) AS p, 'DRAFT' AS state, FALSE AS stopped, NULL::VARCHAR AS why FROM genesis
  UNION ALL SELECT controller, CASE WHEN after IS NULL THEN p ELSE p + 1 END, coalesce(after, state), after IS NULL, CASE WHEN after IS NULL THEN coalesce(wrong, 'transition') END
  FROM (SELECT r.*, wrong, {_NEXT.replace("(r.p + 1 > 40) AND fact NOT IN ('identity-drift-recorded', 'controller-retired')", "wrong IS NOT NULL")} AS after
    FROM r JOIN judged AS f ON f.controller = r.controller AND f.sequence = r.p + 1 WHERE NOT stopped) AS r),
ended AS (SELECT controller, arg_max(state, p) AS state, max(p) AS applied, bool_or(stopped) AS stopped, max(why) AS why FROM r GROUP BY controller),
gaps AS (SELECT ended.controller, min(sequence) AS g FROM ended JOIN judged ON ended.controller = judged.controller AND sequence > applied + 1 WHERE NOT stopped GROUP BY ended.controller),
whole AS (
  SELECT ended.controller, state, applied, CASE WHEN stopped THEN applied + 1 ELSE g END AS refused, CASE WHEN stopped THEN why WHEN g IS NOT NULL THEN 'gap' END AS fault
  FROM ended LEFT JOIN gaps USING (controller))"""

#: The same without forks, foreign events and the check of ids, which the stream does not make.
_WAITED = _REPLAY.replace("AS source FROM chain GROUP BY ALL", "AS source FROM chain WHERE length(event_id) = 64 AND study = 'study' GROUP BY ALL").replace("WHEN event_id <> sha256(concat_ws('|', controller, CAST(sequence AS VARCHAR), fact, result, CAST(source AS VARCHAR))) THEN 'identity'", "")
_CRC = "(length(controller) * 7 + ascii(right(controller, 1)) * 3 + ascii(controller[2]))"


_PROVED = "'HOLDOUT_CONFIRMED', 'PROMOTION_RECOMMENDED', 'MONITORING', 'ROLLBACK_RECOMMENDED'"
_SNAPSHOT_RULES = [
    ("validity-order", "created_at >= 1000"),
    ("last-event-halves", "(last_event_id IS NULL) <> (last_event_at IS NULL)"),
    ("genesis-identity", "(sequence = 0) <> (last_event_id IS NULL)"),
    ("genesis-not-empty", "sequence = 0 AND (state <> 'DRAFT' OR later OR reason IS NOT NULL)"),
    ("draft-after-genesis", "sequence <> 0 AND state = 'DRAFT'"),
    ("event-before-creation", "last_event_at < created_at"),
    ("expired-but-active", "active AND last_event_at >= 1000"),
    ("revision-lineage", "misplaced OR torn"),
    ("revision-policy", "revs > 0 AND (foreign_ AND protocol = 'p' OR NOT foreign_ AND protocol <> 'p' OR foreign_ AND protocol <> 'q' OR policy IS NULL OR policy <> 'pol')"),
    ("revision-outside-validity", "low < created_at OR high >= 1000"),
    ("revision-after-event", "high > last_event_at"),
    ("manifest-repeated", "manifests < revs"),
    ("revision-bounds", "moved"),
    ("revision-watermark", "back"),
    ("revision-unchanged", "same"),
    ("assessment-repeated", "decisions < n"),
    ("assessment-protocol", "n > 0 AND protocol <> 'p'"),
    ("holdout-without-nomination", "n_hold > 0 AND (NOT nominated OR n_hold > 1)"),
    ("window-without-holdout", "n_window > 0 AND NOT passed"),
    ("window-source", "source_"),
    ("policy-validity", "policy IS NOT NULL AND (issued_at < created_at OR issued_at > last_event_at)"),
    ("policy-nomination", "CASE WHEN policy IS NULL THEN nominated ELSE NOT nominated OR policy IS DISTINCT FROM dev_policy OR issued_at <> 100 END"),
    ("assessment-policy", "other_policy"),
    ("evidence-without-collection", "dataset IS NOT NULL AND collection IS NULL"),
    ("assessment-without-evidence", "n > 0 AND dataset IS NULL"),
    ("development-evidence", "n_dev > 0 AND dataset <> 'd'"),
    ("window-without-policy", "revs > 0 AND policy IS NULL"),
    ("deployment-incoherent", "observed_at IS NOT NULL AND (policy IS NULL OR NOT passed OR NOT some_pass OR policy <> 'pol' OR observed_at < created_at OR last_event_at IS NULL OR observed_at > last_event_at OR state NOT IN ('MONITORING', 'HOLD', 'ROLLBACK_RECOMMENDED', 'STALE', 'RETIRED'))"),
    ("stale-reasons-state", "reason IS NOT NULL AND active"),
    ("stale-without-reason", "reason IS NULL AND state = 'STALE'"),
    ("state-sequence", "sequence <> CASE state WHEN 'REGISTERED' THEN 1 WHEN 'COLLECTING' THEN 2 WHEN 'DEV_READY' THEN 3 WHEN 'NOMINATED' THEN 4 WHEN 'SHADOW_ASSESSING' THEN 5 + revs WHEN 'HOLDOUT_CONFIRMED' THEN 6 + revs + n_window WHEN 'PROMOTION_RECOMMENDED' THEN 6 + revs + n_window WHEN 'MONITORING' THEN 7 + revs + n_window WHEN 'ROLLBACK_RECOMMENDED' THEN 7 + revs + n_window WHEN 'HOLD' THEN CASE WHEN policy IS NULL THEN 3 + n ELSE 4 + n + revs + CASE WHEN observed_at IS NULL THEN 0 ELSE 1 END END END"),
    ("state-excludes", f"state = 'REGISTERED' AND (collection IS NOT NULL OR dataset IS NOT NULL OR later) OR state = 'COLLECTING' AND (dataset IS NOT NULL OR later) OR state = 'DEV_READY' AND later OR state = 'NOMINATED' AND (n_hold > 0 OR revs > 0 OR observed_at IS NOT NULL) OR state = 'SHADOW_ASSESSING' AND (n_hold > 0 OR observed_at IS NOT NULL) OR state IN ('HOLDOUT_CONFIRMED', 'PROMOTION_RECOMMENDED') AND observed_at IS NOT NULL"),
    ("state-requires", f"state IN ({_PROVED}, 'COLLECTING', 'DEV_READY', 'NOMINATED', 'SHADOW_ASSESSING', 'HOLD') AND collection IS NULL OR state IN ({_PROVED}, 'DEV_READY', 'NOMINATED', 'SHADOW_ASSESSING', 'HOLD') AND dataset IS NULL OR state IN ({_PROVED}, 'NOMINATED', 'SHADOW_ASSESSING') AND (policy IS NULL OR NOT nominated) OR state IN ({_PROVED}) AND NOT passed OR state IN ('MONITORING', 'ROLLBACK_RECOMMENDED') AND observed_at IS NULL"),
    ("state-last-assessment", "state = 'PROMOTION_RECOMMENDED' AND NOT coalesce(end_phase = 'window' AND end_status = 'PASS' AND end_manifest = end_sealed, FALSE) OR state = 'ROLLBACK_RECOMMENDED' AND NOT coalesce(end_phase = 'window' AND end_status = 'HOLD' AND end_manifest = end_sealed, FALSE) OR state = 'HOLD' AND coalesce(end_status IN ('NOMINATED', 'PASS', 'STALE'), TRUE)"),
]


def oracle_sql() -> dict[str, str]:
    return {
        "replayed_chains": f"WITH RECURSIVE {_REPLAY} SELECT whole.controller, state, applied, event_id AS last_event_id, refused, fault FROM whole LEFT JOIN sums ON whole.controller = sums.controller AND applied = sequence",
        "resumed_chains": f"""WITH RECURSIVE {_REPLAY},
verdicts AS (
  SELECT controller, least(applied, {AT}) AS checkpoint, CASE WHEN {_CRC} % 3 = 0 AND {_CRC} % 10 <> 1 THEN CASE WHEN {_CRC} % 4 = 0 THEN 'pin-mismatch' ELSE 'pinned' END
    WHEN {_CRC} % 10 = 1 AND (SELECT arg_max(r.state, r.p) FROM r WHERE r.controller = whole.controller AND r.p <= {AT}) <> 'HOLD' THEN 'prefix-mismatch' ELSE 'replayed' END AS verdict FROM whole)
SELECT verdicts.controller, checkpoint, verdict, state, applied, refused, fault FROM verdicts
LEFT JOIN whole ON whole.controller = verdicts.controller AND verdict IN ('pinned', 'replayed')""",
        "streamed_controllers": f"""WITH RECURSIVE {_WAITED} SELECT ended.controller, state, applied, event_id AS last_event_id, CASE WHEN stopped THEN applied + 1 END AS refused, CASE WHEN stopped THEN why END AS fault
FROM ended LEFT JOIN sums ON ended.controller = sums.controller AND applied = sequence WHERE ended.controller LIKE 'u%'""",
        "streamed_attempts": f"""WITH j AS ({JOURNAL.replace("STRING", "VARCHAR")}),
a AS (SELECT execution, attempt, min(at_ms) AS begun, arg_min(lease_ms, at_ms) + min(at_ms) AS lease FROM j WHERE kind = 'accepted' GROUP BY ALL),
e AS (SELECT execution, attempt, kind, at_ms, category FROM j WHERE kind <> 'accepted'),
b AS (SELECT a.execution, a.attempt, lease, kind, at_ms, category, coalesce(at_ms >= begun AND at_ms < lease, FALSE) AS inside FROM a LEFT JOIN e USING (execution, attempt))
SELECT execution, attempt, CASE WHEN inside THEN kind ELSE 'sent_unknown' END AS outcome, CAST(CASE WHEN inside THEN at_ms ELSE lease END AS BIGINT) AS at_ms,
  inside AND kind = 'not_sent' AND coalesce(category = 'transport', FALSE) AND attempt < 3 AS again FROM b""",
        "snapshot_faults": f"""WITH {SNAPSHOTS.replace("STRING", "VARCHAR")},
a AS (
  SELECT k, count(*) AS n, count(DISTINCT decision) AS decisions, count(*) FILTER (phase = 'development') AS n_dev, count(*) FILTER (phase = 'holdout') AS n_hold, count(*) FILTER (phase = 'window') AS n_window,
    arg_min(status, place) FILTER (phase = 'development') AS dev, arg_min(policy, place) FILTER (phase = 'development') AS dev_policy, arg_min(status, place) FILTER (phase = 'holdout') AS hold,
    bool_or(phase = 'window' AND status = 'PASS') AS some_pass, arg_max(phase, place) AS end_phase, arg_max(status, place) AS end_status, arg_max(coalesce(manifest, ''), place) AS end_manifest FROM tested GROUP BY k),
s AS (
  SELECT k, count(*) AS revs, count(DISTINCT manifest) AS manifests, arg_max(manifest, i) AS end_sealed, bool_or(revision <> i) AS misplaced, bool_or(protocol <> 'p') AS foreign_, max(watermark) AS high, min(starts) AS low FROM sealed GROUP BY k),
pairs AS (
  SELECT y.k, x.starts <> y.starts AS moved, y.watermark < x.watermark AS back, x.traces = y.traces AS same, y.predecessor IS DISTINCT FROM x.manifest AS torn FROM sealed x JOIN sealed y ON x.k = y.k AND x.i = 1 AND y.i = 2),
bad_source AS (SELECT DISTINCT t.k FROM tested t WHERE phase = 'window' AND NOT EXISTS (SELECT 1 FROM sealed WHERE sealed.k = t.k AND sealed.manifest = t.manifest AND sealed.traces = t.traces)),
bad_policy AS (
  SELECT DISTINCT t.k FROM tested t JOIN snaps USING (k) WHERE phase <> 'development' AND (snaps.policy IS NULL OR t.policy IS NULL OR t.policy <> snaps.policy OR issued_at <> 100)),
j AS (
  SELECT snaps.*, coalesce(a.n, 0) AS n, coalesce(decisions, 0) AS decisions, coalesce(n_dev, 0) AS n_dev, coalesce(n_hold, 0) AS n_hold, coalesce(n_window, 0) AS n_window, dev, dev_policy, hold, coalesce(some_pass, FALSE) AS some_pass,
    end_phase, end_status, end_manifest, coalesce(revs, 0) AS revs, coalesce(manifests, 0) AS manifests, end_sealed, coalesce(misplaced, FALSE) AS misplaced, coalesce(foreign_, FALSE) AS foreign_, high, low,
    coalesce(moved, FALSE) AS moved, coalesce(back, FALSE) AS back, coalesce(same, FALSE) AS same, coalesce(torn, FALSE) AS torn, bad_source.k IS NOT NULL AS source_, bad_policy.k IS NOT NULL AS other_policy,
    coalesce(dev = 'NOMINATED', FALSE) AS nominated, coalesce(hold = 'PASS', FALSE) AS passed, state NOT IN ('STALE', 'RETIRED') AS active,
    snaps.policy IS NOT NULL OR coalesce(a.n, 0) > 0 OR coalesce(revs, 0) > 0 OR observed_at IS NOT NULL AS later
  FROM snaps LEFT JOIN a USING (k) LEFT JOIN s USING (k) LEFT JOIN pairs USING (k) LEFT JOIN bad_source USING (k) LEFT JOIN bad_policy USING (k))
SELECT k, concat_ws(',', {", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in _SNAPSHOT_RULES)}) AS faults FROM j""",
    }
