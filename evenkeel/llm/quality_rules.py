"""Quality rules with adaptive thresholds, in Spark expressions only.

``measure`` counts, in each whole text, words, their code points, symbols, repeated lines, and the words inside 8-word
windows that occur twice.  ``sketch`` counts the documents of each language and source by metric and bucket (values cut to
their six leading binary digits: a relative error of 1/32 at most); sketches of parts add up.  ``thresholds`` reads
quartiles off them: a document fails a rule above q75 + FENCE * (q75 - q25) of its language and source, and never below a
rule's floor.  Groups of fewer than ENOUGH documents take the sketch of their language, and those the sketch of all,
which are sums of the finer ones.  ``judge`` joins the verdicts back.

Null texts have no words.  Null languages and sources are groups like others.  Repeated rows repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .util import write_table

FENCE, ENOUGH = 3, 50
#: Metric (parts in 10,000 but for word_length, in hundredths of a code point) and its floor.
FLOORS = {"symbols": 500, "dup_lines": 5000, "repeats": 2000, "word_length": 1500}
SYMBOLS = "#*$%&|<>"
_SPACES = "[ \\t-\\r]+"


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(docs[text_col], F.lit(""))
    docs = docs.withColumn("_words", F.filter(F.split(text, _SPACES), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    docs = docs.withColumn("_lines", lines).withColumn("_n", F.size("_words"))
    # hashes of all windows, sorted; a window occurs twice if a neighbour is equal
    hashes = F.expr("CASE WHEN _n >= 8 THEN sort_array(transform(sequence(0, _n - 8), i -> struct(xxhash64(slice(_words, i + 1, 8)) AS h, i AS i))) ELSE array() END")
    docs = docs.withColumn("_w", F.when(F.col("_n") >= 8, hashes))
    before = "array_prepend(slice(_w.h, 1, size(_w) - 1), CAST(NULL AS BIGINT))"
    after = "array_append(slice(_w.h, 2, size(_w) - 1), CAST(NULL AS BIGINT))"
    beside = f"zip_with(zip_with(_w, {before}, (x, b) -> struct(x.h AS h, x.i AS i, b AS b)), {after}, (x, a) -> CASE WHEN x.h = x.b OR x.h = a THEN x.i END)"
    twice = F.expr(f"sort_array(array_compact({beside}))")
    docs = docs.withColumn("_at", F.when(F.col("_n") >= 9, twice))
    # places covered by runs of 8 from each of these
    covered = F.expr("aggregate(_at, struct(CAST(0 AS BIGINT) AS n, CAST(-8 AS BIGINT) AS last), (s, i) -> struct(s.n + least(CAST(8 AS BIGINT), i - s.last) AS n, CAST(i AS BIGINT) AS last), s -> s.n)")
    out = docs.withColumns(
        {
            "n_words": F.col("_n").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        }
    ).drop("_words", "_lines", "_n", "_w", "_at")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def metrics() -> dict[str, Column]:
    """Whole numbers, so that every engine buckets them alike."""
    some = lambda c: F.greatest(F.col(c), F.lit(1))
    return {
        "symbols": F.expr("10000 * n_symbols div greatest(word_chars, 1)"),
        "dup_lines": F.expr("10000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeats": F.expr("10000 * n_repeat_words div greatest(n_words, 1)"),
        "word_length": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }


def bucket(value: Column) -> Column:
    """``value`` with all but its six leading binary digits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    low = F.pow(F.lit(2.0), shift).cast("bigint")
    return value - F.pmod(value, low)


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, bucket, n): counts that merge by addition.  Documents that failed a base rule don't enter."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics().items()]))
    rows = measured.where(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs.alias("m"))
    return rows.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def _quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys, "metric")
    run = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    return counts.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(25).alias("q25"), at(75).alias("q75"))


def thresholds(counts: DataFrame) -> DataFrame:
    """(lang, source, metric -> limit) for every language and source of a sketch."""
    fine = _quartiles(counts, ["lang", "source"]).toDF("lang", "source", "metric", "n0", "a0", "b0")
    mid = _quartiles(counts, ["lang"]).toDF("lang1", "metric1", "n1", "a1", "b1")
    all_ = _quartiles(counts.withColumn("one", F.lit(1)), ["one"]).drop("one").toDF("metric2", "n2", "a2", "b2")
    joined = fine.join(mid, fine["lang"].eqNullSafe(mid["lang1"]) & (fine["metric"] == mid["metric1"])).join(F.broadcast(all_), F.col("metric") == F.col("metric2"))  # one row a metric
    pick = lambda k: F.when(F.col("n0") >= ENOUGH, F.col(f"{k}0")).when(F.col("n1") >= ENOUGH, F.col(f"{k}1")).otherwise(F.col(f"{k}2"))
    floor = F.create_map(*[x for k, v in FLOORS.items() for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    limit = F.greatest(pick("b") + FENCE * (pick("b") - pick("a")), floor)
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, limit)).alias(f"limit_{k}") for k in FLOORS])


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``keep`` columns, the measures, base_failed and kept."""
    rows = measure(docs.select(*[docs[c] for c in dict.fromkeys([*keep, lang, source, text_col])]), text_col).drop(*({text_col} - set(keep)))
    rows, _ = write_table(rows, "measures")
    limits = thresholds(sketch(rows, lang, source)).withColumnsRenamed({"lang": "_l", "source": "_s"})
    rows = rows.join(limits, rows[lang].eqNullSafe(F.col("_l")) & rows[source].eqNullSafe(F.col("_s")), "left")
    over = [F.coalesce(v > F.col(f"limit_{k}"), F.lit(False)) for k, v in metrics().items()]
    fails = over[0] | over[1] | over[2] | over[3]
    return rows.withColumn("kept", ~F.col("base_failed") & ~fails).drop("_l", "_s", *[f"limit_{k}" for k in FLOORS])
