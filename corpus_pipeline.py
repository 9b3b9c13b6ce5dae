"""A training corpus from ``documents``: quality classifier, near duplicates, decontamination, PII surrogates, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and read again.  All stages but the last return the columns of ``docs``.

Rows with a null id or a null text pass through all stages like others; verdicts go back to rows by id and a hash of the text,
so rows that share an id but not a text are judged apart.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.llm import bpe, decontam, fm, jaccard, pii, queries
from evenkeel.llm.util import read, sweep, tables, write_table

ACCEPT = 0.7  # least score of the quality classifier


FEW = 500_000  # keys (two numbers) that may be broadcast; beyond, a shuffled join


def classify(spark, docs, sf_dir):
    """Drops documents that the quality classifier rejects."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    scored = fm.score(rows, queries.quality_model(spark, sf_dir), out="quality")
    return scored.where(F.col("quality") >= ACCEPT).select("row.*")


def keyed(docs):
    """(row, doc_id, text_hash): rows of one id and one text get one verdict; no column can clash with the key's."""
    return docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"))


def meet(rows, keys, how: str):
    """Rows that have (`left_semi`) or have not (`left_anti`) one of the distinct ``keys`` (doc_id, text_hash); null ids are equal."""
    keys = keys.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    side = F.broadcast(keys) if keys.count() <= FEW else keys
    return rows.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), how)


def deduplicate(spark, docs, sf_dir):
    """Keeps one document of each class of near duplicates (five-word shingles, similarity 0.8), that of the least id.

    Of repeated rows (one id, one text) that are to stay one stays.  Documents without words are no duplicates.
    """
    found = jaccard.join(docs.select("doc_id", "text"), k=5, percent=80).where("n_shingles > 0")
    heads = found.where("first").select("doc_id", "text_hash")
    others = found.where("not first").select("doc_id", "text_hash").distinct()
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    renamed = heads.toDF("d", "h")
    rows = meet(keyed(docs), others.join(renamed, same, "left_anti"), "left_anti")
    repeated = others.join(renamed, same, "left_semi")  # keys with a row that stays and others that go
    if repeated.isEmpty():
        return rows.select("row.*")
    once = meet(rows, repeated, "left_semi").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    return meet(rows, repeated, "left_anti").select("row.*").unionByName(once.select("row.*"))


def decontaminate(spark, docs, sf_dir):
    """Drops documents that hold a window of ten words of a benchmark item."""
    own = docs.select(F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash")).alias("key"), docs["text"].alias("text"))
    found = decontam.decontaminate(own, read(spark, sf_dir, "benchmark"), id_col="key").where("n_hit > 0")
    return meet(keyed(docs), found.select("doc_id.doc_id", "doc_id.text_hash").distinct(), "left_anti").select("row.*")


def replace_pii(spark, docs, sf_dir):
    """Puts surrogates in the place of personal data, and counts the characters anew where there were any."""
    done = pii.replace_entities(docs, queries.PII_KEY)
    length = F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[length.alias(c) if c == "n_chars" else c for c in docs.columns])


def encode(spark, docs, sf_dir):
    """The documents' byte-level BPE ids, as digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, f"{queries.tokenizers_home()}/{queries.RANKS}", queries.pattern(), digests=True)


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminate), ("PII", replace_pii), ("byte-level BPE", encode)]

#: The classifier's fit and the keyed surrogates have no SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows.  A stage's input and all tables that it made on its way go once its output is written."""
    docs, last, before = read(spark, sf_dir, "documents"), None, tables(spark)
    for _, stage in STAGES:
        docs, last = write_table(stage(spark, docs, sf_dir), "stage")
        sweep(spark, before, last)
    return docs
