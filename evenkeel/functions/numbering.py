"""Numbers for rows in an order within each key, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import cut


def number_within(rows: DataFrame, keys: list[str], order: list[str], name: str = "at", size: str = "n") -> DataFrame:
    """Adds ``name``, the place of a row in its key from 0, and ``size``, the key's number of rows.

    Rows are dealt out by ranges of (keys, order); a range numbers its own, and each range's count of a key, one row a range and
    key, gives the places before it.  Rows of a key should differ in ``order``, else ties are placed anyhow.
    """
    dealt = cut(rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *order).withColumn("_range", F.spark_partition_id()))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1)
    ranges = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_place"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias(size))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_range") == F.col("_place")]
    return own.join(ranges, on).select(*rows.columns, (F.col("_own") + F.col("_before")).cast("bigint").alias(name), F.col(size).cast("bigint").alias(size))
