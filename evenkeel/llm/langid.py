"""Language ID of spans: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty.

A word's score for a language is the sum of log-probabilities of its byte n-grams (two to four bytes, the edges
included).  Its script (the leading bytes' Unicode ranges) admits only languages that were learned in that script, unless
none was.  Viterbi then picks the best sequence of languages, where each change costs ``PENALTY``.

The model is learned language by language, each in a task of its own, from about ``SAMPLE`` distinct texts of it at most, picked by a
hash (a stated bound: a language's table has a fixed size, predictions cover all rows); every language of the labelled
rows is learned, however rare.  The tables go out by broadcast, half a MB a language.  A text that is null or has no letter
(\\p{L}) gets `und` and no spans; repeated rows repeat.  Of languages that score alike the first by name is taken.  Without
anything learned every text gets `und`; an empty table gives no rows; columns lang_pred, score and spans are replaced, others
may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F, types as T

from .util import blocks, column_bytes, lean, mix, NOT_SPACE, share, ship, SPACES, words

TABLE, SAMPLE, PENALTY = 1 << 17, 2_500, 6.0  # slots, distinct texts a language, cost of a change
GRAMS = (2, 3, 4)
_LETTER = regex.compile(r"\p{L}")
SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "east_asian", "other")
#: Script by the first byte of a character: ranges of Unicode as UTF-8 leads with them; -1 is no letter, -2 goes on.
_SCRIPT = np.full(256, -1, np.int8)
_SCRIPT[65:91] = _SCRIPT[97:123] = 0
_SCRIPT[0x80:0xC0] = -2
_SCRIPT[0xC3:0xCA] = 0
_SCRIPT[0xCD:0xD0] = 1
_SCRIPT[0xD0:0xD5] = 2
_SCRIPT[0xD6:0xDC] = 3
_SCRIPT[0xE0] = 4
_SCRIPT[0xE3:0xEE] = 5
_SCRIPT[0xDC:0xE0] = _SCRIPT[0xE1] = 6

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACES] = 32
_FOLD[48:58] = 48


def _grams(buf: np.ndarray, offs: np.ndarray):
    """For each n: (slot of the n-gram that ends at each byte, of the text with a blank before it)."""
    folded = _FOLD[buf].astype(np.uint64)
    for n in GRAMS:
        key = np.full(len(folded), n, np.uint64)
        for k in range(n):
            shifted = np.full(len(folded), 32, np.uint64)
            shifted[k:] = folded[: len(folded) - k] if k else folded
            key |= shifted << np.uint64(8 * (k + 1))
        yield (mix(key) & np.uint64(TABLE - 1)).astype(np.int64)


def _word_scripts(buf, starts, ends) -> np.ndarray:
    """The commonest script of each word's letters, -1 without any."""
    kinds = _SCRIPT[buf]
    best, script = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    for k in range(len(SCRIPTS)):
        if k and not (kinds == k).any():
            continue
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        n = total[ends] - total[starts]
        script = np.where(n > best, k, script)
        best = np.maximum(best, n)
    return script


def count(text: bytes, sums=None):
    """(counts of n-grams [n, slot], of letters by script), ``sums`` included, which is changed."""
    counts, seen = sums or (np.zeros((len(GRAMS), TABLE)), np.zeros(len(SCRIPTS)))
    buf = np.frombuffer(text, np.uint8)
    if len(buf):
        for g, slot in enumerate(_grams(buf, np.array([0, len(buf)]))):
            counts[g] += np.bincount(slot, minlength=TABLE)
        kinds = _SCRIPT[buf]
        seen += np.bincount(kinds[kinds >= 0], minlength=len(SCRIPTS))
    return counts, seen


def learn(sums) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities [n, slot], scripts) of one language's counts."""
    counts, seen = sums
    return np.log((counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * TABLE)), seen >= 0.01 * max(1, seen.sum())


def compared(tables: np.ndarray) -> np.ndarray:
    """Only differences between languages count; one n-gram of each length ends at every byte: about a third of its evidence each."""
    return np.maximum(tables - tables.max(0, keepdims=True), -4.0) / len(GRAMS)


def train(docs, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE):
    """Learns from the rows of ``docs`` that have a language: about ``sample`` distinct texts of each at most."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # one row a language: how many distinct texts it has, by a sketch that merges
    shares = rows.groupBy("lang").agg((F.lit(sample) / F.approx_count_distinct("h", 0.02)).alias("share"))
    picked = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * F.col("share"))
    texts = picked.groupBy("lang", "h").agg(F.first("text").alias("text"))  # copies of a text count once

    def run(batches):
        lang, sums = None, None
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != lang:
                    if lang is not None:
                        yield packed(lang, sums)
                    lang, sums = own, None
                sums = count(text.encode(), sums)
        if lang is not None:
            yield packed(lang, sums)

    def packed(lang, sums):
        t, s = learn(sums)
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([t.astype("<f4").tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["lang", "t", "s"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = texts.repartition(parts, "lang").sortWithinPartitions("lang").select("lang", "text").mapInArrow(lean(run), "lang string, t binary, s binary").collect()
    if not got:
        return [], np.zeros((0, len(GRAMS), TABLE), np.float32), np.zeros((0, len(SCRIPTS)), bool)
    got = sorted(got, key=lambda r: r["lang"])
    tables = np.stack([np.frombuffer(r["t"], np.float32).reshape(len(GRAMS), TABLE) for r in got])
    return [r["lang"] for r in got], compared(tables).astype(np.float16).astype(np.float32), np.stack([np.frombuffer(r["s"], bool) for r in got])


def word_scores(model, buf, offs, starts, ends) -> np.ndarray:
    """[word, language]: summed log-probabilities, very low where the word's script rules a language out."""
    langs, tables, scripts = model
    out = np.empty((len(starts), len(langs)), np.float32)
    slots = list(_grams(buf, offs))
    total = np.zeros(len(buf) + 1)
    for i in range(len(langs)):
        each = tables[i, 0][slots[0]]
        for g in range(1, len(GRAMS)):
            each = each + tables[i, g][slots[g]]
        np.cumsum(each, out=total[1:])
        out[:, i] = total[ends] - total[starts]
    script = _word_scripts(buf, starts, ends)
    allowed = np.concatenate([scripts, np.ones((len(langs), 1), bool)], 1).T[script]  # -1 picks the last column
    allowed |= ~allowed.any(1, keepdims=True)
    out[script < 0] = 0  # no letter: goes with its neighbours
    return np.where(allowed, out, out - 50)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of every word: all texts of a block step together, the longest first."""
    n_words, n_langs = scores.shape
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    order = np.argsort(-counts, kind="stable")
    begin, size = begin[order], counts[order]
    path = np.zeros(n_words, np.int16)
    back = np.zeros((n_words, n_langs), np.int16)
    own = np.arange(n_langs, dtype=np.int16)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more words than t
    v = np.zeros((int(active[0]) if longest else 0, n_langs), np.float32)
    last = np.zeros((len(size), n_langs), np.float32)
    for t in range(longest):
        a = active[t]
        v = v[:a]
        if t:
            top = v.argmax(1)
            best = v[np.arange(a), top] - penalty
            stay = v >= best[:, None]
            back[begin[:a] + t] = np.where(stay, own, top[:, None])
            v = np.maximum(v, best[:, None])
        v = v + scores[begin[:a] + t]
        last[:a] = v
    state = last.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        path[at] = state[:a]
        if t:
            state[:a] = back[at, state[:a]]
    return path


def _predict(model, buf, offs):
    """(language or -1, score, spans) of each text of a block."""
    langs = model[0]
    starts, ends, counts = words(buf, offs, NOT_SPACE)
    n_rows = len(offs) - 1
    plain = np.concatenate(([0], np.cumsum(_ASCII_LETTER[buf])))
    lettered = plain[offs[1:]] > plain[offs[:-1]]
    for r in np.flatnonzero(~lettered & (np.diff(offs) > 0)):
        lettered[r] = bool(_LETTER.search(buf[offs[r] : offs[r + 1]].tobytes().decode()))
    if not langs:
        return np.full(n_rows, -1), np.zeros(n_rows), [[] for _ in range(n_rows)]
    scores = word_scores(model, buf, offs, starts, ends)
    path = viterbi(scores, counts)
    row = np.repeat(np.arange(n_rows), counts)
    mass = np.bincount(row * len(langs) + path, ends - starts, n_rows * len(langs)).reshape(n_rows, len(langs))
    pred = mass.argmax(1)
    score = mass[np.arange(n_rows), pred] / np.maximum(mass.sum(1), 1)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (path[1:] != path[:-1])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(row))[: len(at)] - 1
    cut = np.searchsorted(row[at], np.arange(n_rows + 1))
    begin, end, lang = starts[at], ends[stop], path[at]
    spans = [[{"start": int(begin[k] - offs[r]), "end": int(end[k] - offs[r]), "lang": langs[lang[k]]} for k in range(cut[r], cut[r + 1])] if lettered[r] else [] for r in range(n_rows)]
    return np.where(lettered, pred, -1), np.where(lettered, score, 0.0), spans


def label(docs, model, text_col: str = "text"):
    """``docs`` with lang_pred, score (the share of the text's bytes in that language) and spans (in bytes of UTF-8)."""
    langs = model[0]
    shared = share(docs.sparkSession, model)
    docs = docs.drop("lang_pred", "score", "spans")
    at = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            names, scores, spans = [], [], []
            for _, _, buf, offs in blocks(*column_bytes(batch.column(at))):
                pred, score, spanned = _predict(shared.value, buf, offs)
                names += [langs[p] if p >= 0 else "und" for p in pred.tolist()]
                scores += score.tolist()
                spans += spanned
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], names=[*batch.schema.names, "lang_pred", "score", "spans"])

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", kind)]))
