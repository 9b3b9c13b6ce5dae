"""Stateful streams give what the batch gives, whatever the order and the repetitions, and after a stop in the middle."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import chains
from evenkeel.streaming import stateful

from test_chains import EVENT, GENESIS, made


def deal(rows, spark, schema, folder, parts, rng):
    """Rows dealt out over files in any order, some twice."""
    rows = [r for r in rows for _ in range(rng.choice([1, 1, 2]))]
    rng.shuffle(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, make, folder, out, check, mode, stops):
    """One file a micro-batch; the query is stopped after the first, as often as ``stops`` says, and started anew."""
    schema = spark.read.parquet(folder).schema
    for left in range(stops, -1, -1):
        query = stateful.start(make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), out, check, mode)
        if left:
            while query.isActive and not query.recentProgress:
                time.sleep(0.1)
            query.stop()
        else:
            query.awaitTermination()


def test_controllers(spark, tmp_path):
    rng = random.Random(4)
    rows = [r for i in range(12) for r in made(rng, f"c{i}", 25) if r[1] == "s"]
    names = {r[0] for r in rows}
    folder = str(tmp_path / "in")
    stream_rows = [(r[0], r[3], r[4], r[5], r[6], r[7], r[8]) for r in rows]
    deal(stream_rows, spark, "controller string, sequence bigint, predecessor string, event_id string, at bigint, fact string, result string", folder, 4, rng)
    run(spark, lambda s: stateful.controllers(s, 0, 555), folder, str(tmp_path / "out"), str(tmp_path / "check"), "update", 1)
    said = spark.read.parquet(str(tmp_path / "out"))
    held = {r.controller: r.x for r in said.groupBy("controller").agg(F.max(F.struct("applied", F.coalesce("refused", F.lit(0)).alias("refused"), "state", "last_event_id", "fault")).alias("x")).collect()}
    whole = {r.controller: r for r in chains.replay(spark.createDataFrame(rows, EVENT), spark.createDataFrame([(c, "s", "p", 0, 555) for c in names], GENESIS)).collect()}
    assert set(held) == names
    for c, x in held.items():
        w = whole[c]
        assert (x.state, x.applied, x.last_event_id) == (w.state, w.applied, w.last_event_id)
        if w.fault != "gap" and w.fault != "fork":  # a stream waits for what is missing, and the first of two events may be applied before the second comes
            assert (x.refused or None, x.fault) == (w.refused, w.fault)


def test_attempts(spark, tmp_path):
    rng, base = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        at = base + datetime.timedelta(seconds=10 * i)
        rows.append((f"e{i}", 1 + i % 2, "accepted", at, 30_000, None))
        if i % 7 == 0:
            rows.append((f"e{i}", 1 + i % 2, "accepted", at + datetime.timedelta(seconds=5), 90_000, None))
        if i % 3:
            kind, category = rng.choice([("completed", None), ("failed", "provider"), ("not_sent", "transport"), ("not_sent", "policy")])
            rows.append((f"e{i}", 1 + i % 2, kind, at + datetime.timedelta(seconds=rng.choice([1, 29, 31])), None, category))
    rows.append(("orphan", 1, "completed", base, None, None))
    schema = "execution string, attempt int, kind string, at timestamp, lease_ms bigint, category string"
    end = [("end", 9, "failed", base + datetime.timedelta(days=1), None, None)]
    folder = str(tmp_path / "in")
    deal(rows, spark, schema, folder, 3, rng)
    spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(folder)
    run(spark, lambda s: stateful.settle(s, 2, "2 hours"), folder, str(tmp_path / "out"), str(tmp_path / "check"), "append", 1)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("execution", "attempt", "outcome", "at_ms", "again").collect()))
    want = sorted(map(tuple, stateful.settled(spark.createDataFrame(rows, schema), 2).collect()))
    assert got == want and len(want) == 60 and {r[2] for r in want} == {"sent_unknown", "completed", "failed", "not_sent"}


def test_attempts_settle_without_python(spark, tmp_path):
    schema = "execution string, attempt int, kind string, at timestamp, lease_ms bigint, category string"
    base = datetime.datetime(2024, 1, 1)
    second = lambda n: base + datetime.timedelta(seconds=n)
    rows = [("early", 1, "completed", second(-5), None, None), ("early", 1, "accepted", second(0), 30_000, None), ("again", 1, "accepted", second(0), 30_000, None), ("again", 1, "accepted", second(50), 30_000, None), ("again", 1, "completed", second(20), None, None)]
    folder = str(tmp_path / "in")
    for part in (rows[::2], rows[1::2], [("end", 9, "failed", second(86_400), None, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = stateful.settle(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), 2, "2 hours")
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString() and "TransformWithState" not in stream._jdf.queryExecution().analyzed().toString()
    stateful.start(stream, str(tmp_path / "out"), str(tmp_path / "check"), "append").awaitTermination()
    got = {(r.execution, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("early", "sent_unknown"), ("again", "completed")} == {(r.execution, r.outcome) for r in stateful.settled(spark.createDataFrame(rows, schema), 2).collect()}
