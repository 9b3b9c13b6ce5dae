"""What each filter of a chain removes, under every order of the chain.

``fail_masks`` gives every document's failures as bits; ``cells`` counts documents by part and mask, so what follows
does not grow with the documents; ``audit`` unpivots each cell against the steps of every order, where a running bit-or
over the steps before tells failures that an earlier filter has already removed.

A null text is empty.  A null lang is the part of the empty string.  Filter E compares whole texts by a 128-bit digest;
repeated rows of one id and text are no smaller id's copies, and a null id has no smaller one and is none.  A document's labels
are those of any of its label rows.  An empty table gives no rows.  Only the columns named are read, so further columns of
any name do not matter.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, Window

from .util import NOT_SPACE, blocks, column_bytes, hash_spans, lean, ship, words, write_table, EXACT_BYTE

FILTERS = "ABCDE"
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_BEGINS = np.ones(256, bool)  # bytes that begin a code point
_BEGINS[0x80:0xC0] = False


def _sums(of: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(of) + 1, np.int64)
    np.cumsum(of, out=total[1:])
    return np.diff(total[offs])


def masks(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits 1 (A), 2 (B), 4 (C), 8 (D) of the conditions that each text fails."""
    starts, ends, counts = words(buf, offs, NOT_SPACE)
    row = np.repeat(np.arange(len(counts)), counts)
    hashes = hash_spans(buf, starts, ends, EXACT_BYTE)
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(r[new], minlength=len(counts))
    capitals, points, symbols = _sums(_CAPITAL[buf], offs), _sums(_BEGINS[buf], offs), _sums(_SYMBOL[buf], offs)
    return (counts < 200) + 2 * (100 * distinct < 50 * counts) + 4 * (100 * capitals > 3 * points) + 8 * (symbols > 0)


def fail_masks(docs, labels):
    """(part, mask, good, toxic) of each document; E's bit is 16.  Texts are read once, and are shuffled as digests only."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            buf, offs = column_bytes(batch.column(2))
            own = [masks(b, o) for _, _, b, o in blocks(buf, offs)]
            mask = np.concatenate(own) if own else np.zeros(0, np.int64)
            raw = memoryview(buf)
            same = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask.astype(np.int32)), pa.array(same, pa.binary())], names=["doc_id", "part", "mask", "same"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["lang"], F.lit("")).alias("part"), docs["text"].alias("text"))
    found, _ = write_table(named.mapInArrow(lean(run), f"doc_id {kind}, part string, mask int, same binary"), "masks")
    first = found.groupBy(F.col("same").alias("text_key")).agg(F.min("doc_id").alias("least"))
    leads = F.col("doc_id") == F.col("least")
    later = found.join(first, (F.col("same") == F.col("text_key")) & leads, "left")
    marks = labels.groupBy(labels["doc_id"].alias("label_id")).agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("toxic"))
    late = F.when(F.col("doc_id").isNotNull() & F.col("least").isNull(), 16).otherwise(0)
    both = later.join(marks, F.col("doc_id") == F.col("label_id"), "left")
    return both.select("part", F.col("mask").bitwiseOR(late).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def cells(failed):
    """(part, mask, n, good, toxic): documents by part and mask, at most 32 rows a part."""
    return failed.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(counted, filters: str = FILTERS):
    """One row per part, filter_order and step: what the step's filter keeps, removes and finds removed before."""
    steps = [F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i).alias("step"), F.lit(1 << filters.index(f)).alias("bit")) for order in permutations(filters) for i, f in enumerate(order, 1)]
    long = counted.select("*", F.explode(F.array(*steps)).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    seen = long.withColumn("fails", fails > 0).withColumn("gone", F.coalesce(F.bit_or(fails).over(before), F.lit(0)) > 0)
    sums = {"kept": ~F.col("gone") & ~F.col("fails"), "removed": ~F.col("gone") & F.col("fails"), "redundant": F.col("gone") & F.col("fails"), "unique_fails": F.col("mask") == F.col("bit")}
    total = lambda what, where: F.sum(F.when(where, F.col(what)).otherwise(0))
    measured = seen.groupBy("part", "filter_order", "step", "bit").agg(*[total("n", c).alias(k) for k, c in sums.items()], total("good", sums["removed"]).alias("good_lost"), total("toxic", sums["removed"]).alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return measured.withColumn("shapley", shapley).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
