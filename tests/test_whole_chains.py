"""Streams and chains over tables that are longer than those given, against the same SQL."""

import duckdb

from evenkeel.plans import chains
from evenkeel.streaming import stateful


def test_attempts_over_more_days_than_a_hundred(spark, tmp_path, monkeypatch):
    def streamed(rows, make, mode, end):
        """As the query's own, in micro-batches of few rows, as there are many in a large table."""
        rows.repartition(5).write.parquet(str(tmp_path / "in"))
        end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stateful.start(make(stream), str(tmp_path / "out"), str(tmp_path / "check"), mode).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    monkeypatch.setattr(chains, "_streamed", streamed)
    spark.range(400).selectExpr("id * 100003 AS o_orderkey", "id * 7 % 1000 AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))  # 463 days
    got = sorted(map(tuple, chains.streamed_attempts(spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(duck.execute(chains.oracle_sql()["streamed_attempts"]).fetchall()) and len(got) == 400


def _shuffled(spark, run) -> int:
    """Bytes that stages have written for others while ``run`` went on."""
    context = spark.sparkContext._jsc.sc()

    def all_stages():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = all_stages()
    run()
    return all_stages() - before


def test_events_are_shuffled_once_for_a_replay(spark):
    """Less than two of an event's two digests of 64 letters, for each row of the chains, of which the events are half."""
    rows = 2 * spark.read.parquet("/root/testdata/sf0.1/events.parquet").count()
    assert _shuffled(spark, lambda: chains.replayed_chains(spark, "/root/testdata/sf0.1").collect()) < 256 * rows


def test_events_are_shuffled_once_for_what_follows_checkpoints(spark):
    """As for a replay: what comes before the checkpoints is little, and is verified once."""
    rows = 2 * spark.read.parquet("/root/testdata/sf0.1/events.parquet").count()
    assert _shuffled(spark, lambda: chains.resumed_chains(spark, "/root/testdata/sf0.1").collect()) < 256 * rows
