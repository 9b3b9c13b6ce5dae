"""Weighted and plain statistics with the exact rules of the assessment."""

from pyspark.sql import Column, DataFrame, Window, functions as F


RANGES = 64  # value ranges for each doubling of the magnitude


def value_range(value: Column) -> Column:
    """Number of the range that holds a value: never falls as the value grows, whatever the data."""
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-30))) * RANGES) + 100 * RANGES
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("bigint") * size)


def at_mass(df: DataFrame, keys: list[str], value: str, weight: str, targets: dict[str, Column]) -> DataFrame:
    """Per key: the least value whose cumulated weight reaches each target, an expression over the key's whole weight `_all`.

    Equal values are summed first.  The weights of value ranges, a few thousand a key at most, tell which ranges hold a
    target, and only the values of these are sorted, each range by itself.
    """
    mass = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w")).withColumn("_range", value_range(F.col(value).cast("double")))
    whole = mass.groupBy(*keys, "_range").agg(F.sum("_w").alias("_own"))
    key = Window.partitionBy(*keys)
    whole = whole.withColumn("_upto", F.sum("_own").over(key.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_own").over(key))
    before = F.col("_upto") - F.col("_own")
    holds = F.lit(False)
    for target in targets.values():
        holds = holds | ((F.col("_upto") >= target) & ((before < target) | (before <= 0)))
    whole = whole.where(holds).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), before.alias("_before"), "_all")
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    held = mass.join(F.broadcast(whole), on)  # as many rows as keys have targets, or nearly so
    run = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_upto", F.col("_before") + F.sum("_w").over(run))
    return held.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= target, F.col(value))).alias(name) for name, target in targets.items()])


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, ps: dict[str, float]) -> DataFrame:
    """Per key: the least value whose cumulated weight reaches p of the total, for each named p; no interpolation."""
    return at_mass(df, keys, value, weight, {name: F.lit(p) * F.col("_all") for name, p in ps.items()})


def r7_quantiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Per key: R-7 (linear) quantiles of the values that are not null, from their order statistics."""
    at = {name: (F.col("_all") - 1) * F.lit(float(p)) for name, p in ps.items()}
    targets = {f"{name}/{side}": f(x) + 1 for name, x in at.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    targets["_n"] = F.col("_all")
    known = df.where(F.col(value).isNotNull()).select(*keys, value, F.lit(1).cast("bigint").alias("_one"))
    got = at_mass(known, keys, value, "_one", targets).drop("_n").join(known.groupBy(*keys).agg(F.count("*").alias("_all")), keys)
    low, high = (lambda n: F.col(f"`{n}/low`")), (lambda n: F.col(f"`{n}/high`"))
    return got.select(*keys, *[(low(n) + (high(n) - low(n)) * (x - F.floor(x))).alias(n) for n, x in at.items()])


def r7(sorted_values: Column, p: float) -> Column:
    """R-7 (linear) quantile of a sorted array."""
    at = (F.size(sorted_values) - 1) * F.lit(float(min(1.0, max(0.0, p))))
    low = F.floor(at).cast("int")
    a, b = F.element_at(sorted_values, low + 1), F.element_at(sorted_values, F.ceil(at).cast("int") + 1)
    return a + (b - a) * (at - low)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Ratio of sums; 0 where there is no mass."""
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(0.0))
