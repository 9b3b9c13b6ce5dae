"""Window manifests on rows that the query's table does not hold: forks, nulls, empty tables, repeated rows, more changes than are folded."""

import hashlib
import json

from pyspark.sql import functions as F

from evenkeel.operators import manifests

RULE = {"algorithm": "a", "sample": 10, "seed": "s"}
NONE = ("unavailable", None, None, None, None)
CHANGE = f"window_id string, place long, watermark long, closure string, traces string, evaluators string, capacity {manifests.CAPACITY.simpleString()}"


def windows(spark, *names):
    kind = f"window_id string, protocol string, policy string, starts long, ends long, rule {manifests.RULE.simpleString()}, watermark long, closure string, traces string, evaluators string, capacity {manifests.CAPACITY.simpleString()}"
    return manifests.first(spark.createDataFrame([(n, "p", "q", 0, 5, ("a", 10, "s"), 5, "c", "t0", "e0", NONE) for n in names], kind))


def sealed(domain, value):
    return "sha256:" + hashlib.sha256(json.dumps({"domain": domain, "value": value}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_digests_are_those_of_canonical_json(spark):
    row = windows(spark, 'w "1"').first().asDict(recursive=True)
    assert row["membership"] == sealed(manifests.MEMBERSHIP_DOMAIN, {"window_id": 'w "1"', "protocol": "p", "rule": RULE})
    own = row.pop("self_digest")
    assert own == sealed(manifests.DOMAIN, row)


def test_refused_changes_leave_the_chain(spark):
    rows = [
        ("w", 1, 6, "c", "t1", "e0", NONE),
        ("w", 2, 5, "c", "t2", "e0", NONE),
        ("w", 3, None, "c", "t2", "e0", NONE),
        ("w", 4, 6, "other", "t1", "e0", NONE),
        ("w", 5, 6, "c", "t1", "e0", ("reported", 1, "q", 0, 5)),
        ("w", 6, 7, "c", "t1", "e0", ("reported", 2, "x", 0, 5)),
        ("w", 7, 7, "c", "t1", "e0", ("reported", 2, "q", 0, None)),
        ("w", 8, 7, None, None, "e0", None),
        ("v", 1, 9, "c", "t1", "e0", NONE),
        (None, 1, 9, "c", "t1", "e0", NONE),
    ]
    out = manifests.revise(windows(spark, "w", "u"), spark.createDataFrame(rows, CHANGE)).collect()
    of = {(r.window_id, r.place): r for r in out}
    assert len(out) == len(rows)
    assert [of["w", i].refusal for i in range(1, 9)] == [None, "watermark-fell", "watermark-fell", "nothing-changed", None, "capacity-policy", "capacity-bounds", None]
    assert [of["w", i].revision for i in (1, 5, 8)] == [2, 3, 4] and of["w", 2].self_digest is None
    assert of["w", 5].predecessor == of["w", 1].self_digest and of["w", 8].predecessor == of["w", 5].self_digest
    assert of["v", 1].refusal == of[None, 1].refusal == "unknown-window"
    assert manifests.revise(windows(spark, "w"), spark.createDataFrame([], CHANGE)).collect() == []
    assert manifests.revise(windows(spark, "w").limit(0), spark.createDataFrame(rows, CHANGE)).where("refusal != 'unknown-window'").collect() == []


def test_more_changes_than_are_folded(spark, monkeypatch):
    monkeypatch.setattr(manifests, "CHANGES", 3)
    rows = [("w", i, 6 + i, "c", f"t{i}", "e", NONE) for i in range(1, 6)]
    out = manifests.revise(windows(spark, "w"), spark.createDataFrame(rows, CHANGE)).orderBy("place").collect()
    assert [(r.revision, r.refusal) for r in out] == [(2, None), (3, None), (4, None), (None, "too-many-changes"), (None, "too-many-changes")]


def test_arrivals(spark):
    rows = [("w", 1, "trace", "a"), ("w", 1, "trace", "b"), ("w", 3, "trace", "c"), ("w", 2, "evaluator", "a"), ("w", 2, "evaluator", "a"), ("w", 4, "evaluator", None)]
    seals = spark.createDataFrame([("w", i) for i in (1, 2, 3, 5)] + [("w", 5), ("v", 1)], "window_id string, place long")
    kind = "window_id string, place long, kind string, member string"
    take = lambda members: {(r.window_id, r.place): (r.traces, r.evaluators) for r in manifests.arrivals(spark.createDataFrame(members, kind), seals).collect()}
    got = take(rows)
    assert len(got) == 5 and got == take(rows[::-1])
    assert got["w", 1][0] == got["w", 2][0] != got["w", 3][0] == got["w", 5][0]
    assert got["w", 1][1] == got["v", 1][1] == "sha256:" + hashlib.sha256(b"").hexdigest()
    assert len({got["w", i][1] for i in (1, 2, 3, 5)}) == 3  # a place without a seal counts at the next
    assert take(rows[:4])["w", 2] != got["w", 2]  # a repeated member counts


def test_faults_of_links(spark):
    base = windows(spark, "w")
    changes = spark.createDataFrame([("w", 1, 6, "c", "t1", "e0", NONE), ("w", 2, 7, "c", "t2", "e0", NONE)], CHANGE)
    chain = base.unionByName(manifests.revise(base, changes).select(*manifests.MANIFEST))
    clean = manifests.manifest_faults(chain).collect()
    assert len(clean) == 3 and all(r.faults == [] for r in clean)
    digest_anew = lambda rows: rows.withColumn("self_digest", manifests.self_digest())
    fork = digest_anew(chain.where("revision = 3").withColumn("closure", F.lit("z")))
    got = manifests.manifest_faults(chain.unionByName(fork)).collect()
    assert sorted(tuple(r.faults) for r in got) == [(), (), ("fork", "revision-repeated"), ("fork", "revision-repeated")]
    same = digest_anew(chain.where("revision = 3").withColumn("traces", F.lit("t1")))
    assert manifests.manifest_faults(chain.where("revision < 3").unionByName(same)).where("revision = 3").first().faults == ["nothing-changed"]
    twice = manifests.manifest_faults(chain.unionByName(chain.where("revision = 2"))).collect()
    assert len(twice) == 4
    nulls = chain.where("revision = 1").select(*[F.lit(None).cast(chain.schema[c].dataType).alias(c) for c in chain.columns])
    assert set(manifests.manifest_faults(nulls).first().faults) == {"membership", "self-digest"}
    other = spark.createDataFrame([("p", ("a", 11, "s"))], f"protocol string, rule {manifests.RULE.simpleString()}")
    assert {tuple(r.faults) for r in manifests.manifest_faults(chain, other).collect()} == {("protocol-rule",)}
    assert {tuple(r.faults) for r in manifests.manifest_faults(chain, other.limit(0)).collect()} == {("protocol-unknown",)}
    assert manifests.manifest_faults(chain.limit(0)).collect() == []
