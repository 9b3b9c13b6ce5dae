"""Chat formatting with Spark expressions only.

A conversation's rows are put in order (turn, then role, then text), adjacent turns of one role are merged (texts joined
by a line feed), and each becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts ``&`` is written
``&amp;`` and ``<|`` is written ``&lt;|`` (a line feed in a role: ``&#10;``), so no text can imitate a control string and
``read_back`` restores every character.  ``loss_spans`` are the places (0-based, code points) of the assistant's texts, one
for each row; the line feed between two merged rows is not under the mask.

Null roles and texts read as empty; rows of a null conversation id form one conversation; repeated rows are turns of
their own; an empty table gives no rows; other columns may have any name.  All steps need a conversation's rows together, by one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans``."""
    rows = rows.select(rows[conv].alias("conv_id"), rows[turn].alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    order = Window.partitionBy("conv_id").orderBy("place")
    rows = rows.withColumn("new", (~F.lag("role").over(order).eqNullSafe(F.col("role"))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order))
    # places of a row's text: what the texts before it take up, a line feed after each
    rows = rows.withColumn("text", escape(F.col("text")))
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    said = F.array_sort(F.collect_list(F.struct("place", "text", "before")))
    runs = rows.groupBy("conv_id", "run").agg(F.first("role").alias("role"), said.alias("said"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    runs = runs.select("conv_id", "run", "role", "said", head.alias("head"), F.array_join(F.col("said.text"), "\n").alias("body"))
    runs = runs.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    first = F.col("said")[0]["before"]
    spans = F.transform("said", lambda x: F.struct((F.col("start") + x["before"] - first).alias("start"), F.length(x["text"]).cast("bigint").alias("length")))
    spans = F.when(F.col("role") == LOSS_ROLE, spans).otherwise(F.slice(spans, 1, 0))
    pieces = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", "piece", spans.alias("spans")))).alias("p"))
    return pieces.select("conv_id", F.array_join("p.piece", "").alias("formatted"), F.flatten("p.spans").alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per formatted conversation: its ``turns`` (role, text) and ``loss_texts`` (what the spans cover, unescaped)."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(p.substr(F.length(role) + 2, F.length(p) - F.length(role) - F.lit(1 + len(END)))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), loss.alias("loss_texts"))
