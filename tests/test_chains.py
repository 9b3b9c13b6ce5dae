"""Event chains against a plain fold, whatever the size of segments; checkpoints, pins; snapshots whole and changed."""

import random

import pytest

from evenkeel.operators import chains, controller, snapshots

EVENT = "controller string, study string, protocol string, sequence bigint, predecessor string, event_id string, occurred_at bigint, fact string, result string"
GENESIS = "controller string, study string, protocol string, created_at bigint, expires_at bigint"


def made(rng, name, n):
    """A chain that mostly follows the rules, with some things wrong."""
    life = ["protocol-registered", "collection-started", "development-evidence-ready", "development-assessment-recorded", "shadow-assessment-started", "holdout-assessment-recorded", "window-manifest-recorded", "window-assessment-recorded", "deployment-observed"]
    rows, before = [], None
    for i in range(1, n + 1):
        fact = life[i - 1] if i <= 9 else rng.choice(["window-manifest-recorded", "window-assessment-recorded"] + ["identity-drift-recorded"] * (rng.random() < 0.02))
        row = [name, "s", "p", i, before, f"{name}-{i}", 10 * i, fact, "NOMINATED" if i == 4 else "PASS"]
        before = row[5]
        odd = rng.random()
        if odd < 0.01:
            continue
        if odd < 0.02:
            row[4] = "elsewhere"
        elif odd < 0.03:
            row[6] -= 15
        elif odd < 0.04:
            rows.append([*row[:5], "fork", *row[6:]])
        elif odd < 0.05:
            row[1] = "other"
        rows.append(row)
        if odd > 0.9:
            rows.append(row)
    return rows


def fold(rows, expires, state="DRAFT", at=0, last=None, last_at=None):
    """One event after another."""
    by = {}
    for r in rows:
        by.setdefault(r[3], set()).add(tuple(r))
    for place in sorted(p for p in by if p > at):
        ids = {r[5] for r in by[place]}
        r = min(by[place], key=lambda r: r[5])
        late = r[7] in controller.AFTER_EXPIRY
        after = next((a or state for f, s, w, a in controller.TRANSITIONS if f == r[7] and w in (None, r[8]) and (state != "RETIRED" if s == ["*"] else state in s)), None)
        for code, wrong in [("fork", len(ids) > 1), ("foreign", r[1] != "s"), ("gap", place != at + 1), ("splice", r[4] != last), ("time-regression", last_at is not None and r[6] < last_at), ("after-expiry", r[6] >= expires and not late), ("transition", after is None)]:
            if wrong:
                return state, at, last, place, code
        state, at, last, last_at = after, place, r[5], r[6]
    return state, at, last, None, None


@pytest.mark.parametrize("segment, fan", [(256, 64), (3, 2)])
def test_replay_is_the_fold(spark, segment, fan):
    rng = random.Random(segment)
    all_rows = {f"c{i}": made(rng, f"c{i}", rng.choice([0, 1, 5, 60])) for i in range(25)}
    events = spark.createDataFrame([r for rows in all_rows.values() for r in rows] + [["stranger", "s", "p", 1, None, "x", 1, "protocol-registered", None]], EVENT)
    genesis = spark.createDataFrame([(c, "s", "p", 0, 555) for c in all_rows], GENESIS)
    got = chains.replay(events, genesis, segment=segment, fan=fan).collect()
    assert {r.controller: (r.state, r.applied, r.last_event_id, r.refused, r.fault) for r in got} == {c: fold(rows, 555) for c, rows in all_rows.items()}


def test_checkpoints_and_what_follows(spark):
    rng = random.Random(9)
    rows = [r for r in made(rng, "a", 200) if r[1] == "s" and r[4] != "elsewhere" and r[5] != "fork"]
    rows = [r for r in rows if fold(rows, 9999)[3] is None or r[3] < fold(rows, 9999)[3]]
    half = fold(rows[: len(rows) // 2], 9999)
    many = [(f"{k}{i}", *half[:3]) for i, k in enumerate(["good", "state", "pin", "badpin", "unknown"])]
    events = spark.createDataFrame([[c, *r[1:]] for c, *_ in many for r in rows], EVENT)
    genesis = spark.createDataFrame([(c, "s", "p", 0, 9999) for c, *_ in many if c[0] != "u"], GENESIS)
    at = next(r[6] for r in rows if r[5] == half[2])
    checkpoints = spark.createDataFrame([(c, "p", n, e, at, "HOLD" if c[0] == "s" else s, "d") for c, s, n, e in many], "controller string, protocol string, sequence bigint, event_id string, occurred_at bigint, state string, snapshot_digest string")
    pins = spark.createDataFrame([(c, "p", n, e, "d" if c[0] == "p" else "x") for c, _, n, e in many if "pin" in c], "controller string, protocol string, sequence bigint, event_id string, snapshot_digest string")
    verdicts = {r.controller[:4]: r.verdict for r in chains.verify_checkpoints(checkpoints, events, genesis, pins).collect()}
    assert verdicts == {"good": "replayed", "stat": "prefix-mismatch", "pin2": "pinned", "badp": "pin-mismatch", "unkn": "unknown-controller"}
    got = {r.controller: (r.state, r.applied, r.last_event_id, r.refused) for r in chains.resume(checkpoints, events, genesis, pins, segment=7, fan=3).collect()}
    assert got == {c: fold(rows, 9999)[:4] for c in ("good0", "pin2")}


def test_another_event_in_the_anchors_place_is_a_fork(spark):
    rows = [["a", "s", "p", 1, None, "e1", 1, "protocol-registered", None], ["a", "s", "p", 1, None, "other", 1, "protocol-registered", None], ["a", "s", "p", 2, "e1", "e2", 2, "collection-started", None]]
    anchor = spark.createDataFrame([("a", 1, "e1", 1, "REGISTERED")], "controller string, sequence bigint, event_id string, occurred_at bigint, state string")
    genesis = spark.createDataFrame([("a", "s", "p", 0, 99)], GENESIS)
    got = chains.replay(spark.createDataFrame(rows, EVENT), genesis, anchor).first()
    assert (got.state, got.applied, got.refused, got.fault) == ("REGISTERED", 1, 1, "fork")
    got = chains.replay(spark.createDataFrame([rows[0], rows[2]], EVENT), genesis, anchor).first()
    assert (got.state, got.applied, got.last_event_id, got.refused) == ("COLLECTING", 2, "e2", None)
    assert chains.replay(spark.createDataFrame([], EVENT), genesis).first().state == "DRAFT"


def test_what_follows_a_missing_event_is_a_gap(spark):
    start = ["s", "p", 1, None, "e1", 1, "protocol-registered", None]
    third = ["s", "p", 3, "e2", "e3", 3, "development-evidence-ready", None]
    chains_ = {"fork": [third, [*third[:4], "other", *third[5:]]], "foreign": [["t", *third[1:]]], "twice": [third, [*third[:5], 4, *third[6:]]]}
    rows = [[c, *r] for c, after in chains_.items() for r in [start, *after]]
    genesis = spark.createDataFrame([(c, "s", "p", 0, 99) for c in chains_], GENESIS)
    got = {(r.controller, r.state, r.applied, r.refused, r.fault) for r in chains.replay(spark.createDataFrame(rows, EVENT), genesis).collect()}
    assert got == {(c, "REGISTERED", 1, 3, "gap") for c in chains_}


POLICY = ("pol", 100, 1000)
WHOLE = dict(
    state="MONITORING", sequence=10, last_event_id="e", last_event_at=900, created_at=10, expires_at=1000, protocol="p", collection="c", evidence=("d", "t", "e"), policy=POLICY,
    assessments=[("development", "NOMINATED", "a1", "p", "d", "t", "e", POLICY, None), ("holdout", "PASS", "a2", "p", "d", "t", "e", POLICY, None), ("window", "PASS", "a3", "p", "d", "t2", "e", POLICY, "m2")],
    windows=[("w", [("w", 1, None, "m1", "p", "pol", 200, 500, 600, "t1", "e", "cap"), ("w", 2, "m1", "m2", "p", "pol", 200, 500, 600, "t2", "e", "cap")])], deployment=("pol", 800), stale=[],
)
_POLICY = "struct<digest:string,issued_at:int,expires_at:int>"
SNAPSHOT = (
    "state string, sequence int, last_event_id string, last_event_at int, created_at int, expires_at int, protocol string, collection string, evidence struct<dataset:string,traces:string,evaluators:string>, "
    f"policy {_POLICY}, assessments array<struct<phase:string,status:string,decision:string,protocol:string,dataset:string,traces:string,evaluators:string,policy:{_POLICY},manifest:string>>, "
    "windows array<struct<window:string,revisions:array<struct<window:string,revision:int,predecessor:string,manifest:string,protocol:string,policy:string,starts:int,ends:int,watermark:int,traces:string,evaluators:string,capacity:string>>>>, "
    "deployment struct<policy:string,observed_at:int>, stale array<string>"
)


def test_snapshots(spark):
    window = WHOLE["windows"][0][1]
    changes = [
        ({}, []),
        ({"sequence": 11}, ["state-sequence"]),
        ({"windows": [("w", [window[0], (*window[1][:8], 599, *window[1][9:])])]}, ["revision-watermark"]),
        ({"windows": [("w", [window[0], (*window[1][:9], "t1", *window[1][10:])])]}, ["revision-unchanged", "window-source"]),
        ({"windows": [("w", window), ("v", [("v", 1, None, "m3", "p", "pol", 200, 500, 600, "t1", "e", "cap")])], "sequence": 11}, ["windows-unsorted"]),
        ({"deployment": ("pol", 950)}, ["deployment-incoherent"]),
        ({"deployment": None}, ["state-requires"]),
        ({"stale": ["late"]}, ["stale-reasons-state"]),
        ({"assessments": WHOLE["assessments"][:2]}, ["deployment-incoherent", "state-sequence"]),
        ({"policy": ("other", 100, 1000)}, ["revision-policy", "policy-nomination", "assessment-policy", "deployment-incoherent"]),
        ({"last_event_id": None}, ["last-event-halves", "genesis-identity"]),
        ({"assessments": None, "windows": None, "evidence": None, "policy": None, "deployment": None, "stale": None, "collection": None, "state": "DRAFT", "sequence": 0, "last_event_id": None, "last_event_at": None}, []),
        ({"state": "RETIRED"}, []),
        ({"state": "STALE"}, ["stale-without-reason"]),
    ]
    names = [c.split(" ")[0] for c in "state sequence last_event_id last_event_at created_at expires_at protocol collection evidence policy assessments windows deployment stale".split()]
    rows = [tuple({**WHOLE, **change}[n] for n in names) for change, _ in changes]
    got = [r.faults for r in snapshots.snapshot_faults(spark.createDataFrame(rows, SNAPSHOT).coalesce(1)).collect()]
    assert got == [want for _, want in changes]
