"""Spelling variants by symmetric deletes: words at an edit distance of exactly one, their preferred forms, and the roots.

``count_words`` takes maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, lower-cases A-Z, and damages a share of
them by a fixed rule (below), as the contract of op11 asks; ``near_pairs`` joins words that share one of their keys, a key
being the word itself or one of its distinct single deletions, and verifies that the distance is one; ``forms`` picks for each
word the near word of largest n that has at least ``ratio`` times its own n (ties: smallest in code-point order);
``roots`` follows the forms to the last.

Two words at distance one share exactly one key, so no pair is found twice.  A key's words are the key and those with one more
letter, so an alphabet and a word's length bound them, whatever the data.  Counts rise at least ``ratio``-fold from a word to
its form, so ways to a root are short; they are followed by doubling.  All joins are merges: the written tables are small as
files, and Spark, which goes by the size of the files, would send the keys of all words through the driver.

Null and empty texts have no words; repeated rows count each; a null id leaves its runs whole.  An empty table
gives no rows.  Only the columns named are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from .util import drop_table, lean, ship, write_table

LEAST_LETTERS, LEAST_COUNT, DAMAGE = 5, 3, 97
HELD = 200_000  # different words that a task holds before it passes their counts on
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # U+00C0 to U+00FF are the two-byte characters that begin with C3


def damaged(doc_id, word: bytes, start: int) -> bytes:
    """The run without its code point h % length where DAMAGE divides h, the CRC-32 of ``<doc_id>:<run>`` (``start``: that of ``<doc_id>:``)."""
    h = zlib.crc32(word, start)
    if doc_id is None or h % DAMAGE:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def count_words(docs, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text"):
    """(word, n): words of at least ``least_letters`` code points that occur at least ``least_count`` times in all texts."""
    ship(docs.sparkSession)

    def run(batches):
        total: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                if not text:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().lower())).items():
                    if len(word) >= least_letters:
                        word = damaged(doc_id, word, start)
                        if len(word) - word.count(b"\xc3") >= least_letters:
                            total[word] += n
                if len(total) >= HELD:
                    yield out()
        yield out()

    counted = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def near_pairs(words):
    """(word, n, near, near_n), both ways, of the different words of ``words`` at distance one."""
    at = F.sequence(F.lit(1), F.length("word"))
    cut = F.transform(at, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    keyed = words.select("word", "n", F.explode(F.array_append(F.array_distinct(cut), F.col("word"))).alias("key")).select("word", "n", F.xxhash64("key").alias("key"))
    other = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("key").alias("other_key"))
    found = keyed.join(other.hint("merge"), (F.col("key") == F.col("other_key")) & (F.col("word") < F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    one, two = F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.select(F.explode(F.array(one, two)).alias("p")).select("p.*")


def forms(words, ratio: int = 2):
    """(word, n, n_near, form, form_n) for every word; form and form_n are null where no near word is frequent enough."""
    pairs = near_pairs(words).select("word", "n", F.lit(1).alias("one"), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")).alias("best"))
    alone = words.select("word", "n", F.lit(0).alias("one"), F.lit(None).cast(pairs.schema["best"].dataType).alias("best"))
    best = pairs.unionByName(alone).groupBy("word", "n").agg(F.sum("one").alias("n_near"), F.min("best").alias("best"))
    fit = -F.col("best.m") >= ratio * F.col("n")
    return best.select("word", "n", "n_near", F.when(fit, F.col("best.w")).alias("form"), F.when(fit, -F.col("best.m")).alias("form_n"))


def roots(edges):
    """(word, root) for each (word, form) of ``edges``, which has no circles: every round doubles the steps that are taken."""
    own, path = write_table(edges.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = own.select(F.col("word").alias("w"), F.col("root").alias("further"))
        step = own.join(on.hint("merge"), F.col("root") == F.col("w"), "left")
        following, next_path = write_table(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_table(own.sparkSession, path)
        path, moved = next_path, following.where("moved").isEmpty()
        own = following.select("word", "root")
        if moved:
            return own


def group(docs, ratio: int = 2):
    """One row per word: word, form, root, n, n_near, form_n."""
    words, _ = write_table(count_words(docs), "words")
    found, _ = write_table(forms(words, ratio), "forms")
    ends = roots(found.where("form IS NOT NULL")).select(F.col("word").alias("w"), "root")
    out = found.join(ends.hint("merge"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
