"""Raw logs of throughput benchmarks: trials found over whole logs, checked, and summarised by R-7 quantiles.

A trial starts a line and may go on over further ones where its format has spaces; it ends a line.  Other text is passed over.  A log is one row,
as its writer bounds it, and all is expressions over the row, so the scan is a map.  White space and digits are those of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The format of a trial, line feeds being the only line ends; the numbers that it has besides its own.
TRIAL = r"(?md)^Trial\s+(\d+):\s+prompt_tps=([0-9.]+),\s+generation_tps=([0-9.]+),\s+peak_memory=([0-9.]+)$"
MEASURES = ["prompt", "generation", "memory"]
QUANTILES = {"p10": 0.1, "median": 0.5, "p95": 0.95}


def quantile(ordered: Column, p: float) -> Column:
    """The R-7 quantile of sorted numbers; null if there are none."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))


def scan(logs: DataFrame, body: str, expected: Column | None = None) -> DataFrame:
    """The logs with ``trials`` (structs trial, prompt, generation, memory), ``failure``, and, without one, p10, median and p95 of each measure and the greatest memory.

    Failures, the first that holds: invalid-number (a measure with several points or none but points), no-trials, trial-count (not the
    ``expected`` number; null expects none), trial-gap (the numbers are not 1, 2, ... in this order).  A null log has no trials.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    found = [F.regexp_extract_all(text, F.lit(TRIAL), F.lit(i)) for i in range(1, 5)]
    items = F.arrays_zip(*[x.alias(n) for x, n in zip(found, ("trial", *MEASURES))])
    number = lambda x: F.struct(x["trial"].try_cast("bigint").alias("trial"), *[x[n].try_cast("double").alias(n) for n in MEASURES])
    rows = logs.withColumn("trials", items).withColumn("trials", F.transform("trials", number))
    trials, n = F.col("trials"), F.size("trials")
    bad = F.exists(trials, lambda t: t["prompt"].isNull() | t["generation"].isNull() | t["memory"].isNull())
    contiguous = F.transform(trials, lambda t, i: t["trial"].eqNullSafe((i + 1).cast("bigint")))
    wrong_count = F.coalesce(n != expected, F.lit(False)) if expected is not None else F.lit(False)
    failure = F.when(bad, "invalid-number").when(n == 0, "no-trials").when(wrong_count, "trial-count").when(~F.forall(contiguous, lambda ok: ok), "trial-gap")
    rows = rows.withColumn("failure", failure)
    sound = F.col("failure").isNull()
    ordered = rows.withColumns({f"{m}_sorted": F.when(sound, F.array_sort(F.col("trials")[m])) for m in MEASURES})
    made = {f"{m}_{name}": quantile(F.col(f"{m}_sorted"), p) for m in MEASURES for name, p in QUANTILES.items()}
    return ordered.withColumns(made | {"memory_max": F.try_element_at("memory_sorted", F.lit(-1))}).drop(*[f"{m}_sorted" for m in MEASURES])
