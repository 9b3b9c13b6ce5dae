"""Benchmark decontamination over a distributed positional inverted index of the documents.

``build_index`` stores, for each block of documents, one row with the documents' places and, term after term, the sorted
positions at which the test terms stand.  ``search`` starts from a window's rarest term in the block and intersects the
offset-adjusted posting lists of the others, rarest first; ``slack`` above 0 lets each next word stand that many places
off (proximity instead of a phrase).

Documents and items without words (null, empty, or punctuation only) have no windows and hit nothing; a null item id
reads as an empty string; repeated items count once; repeated documents are documents of their own.  Without documents
there are no rows; without items nothing is hit.  Only the columns named are read, so others may have any name.  The index
is dropped when the search is done; its result, a few numbers a document, is a stored table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .util import blocks, column_bytes, drop_table, hash_spans, lean, share, words, write_table

IS_WORD = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    IS_WORD[_low : _high + 1] = False
IS_WORD[65:91] = True  # lower-cased first
GAP = 64  # empty places between documents: above any slack
BLOCK = 4 << 20
QUERY_BYTES = 32 << 20  # text of the items that are searched for in one pass; more items take more passes


def item_windows(items: list[tuple[str, str]], width: int) -> tuple[np.ndarray, list[tuple[np.ndarray, list[int]]]]:
    """(sorted hashes of the test terms, [(a window's term numbers, its items)])."""
    texts = pa.array([t for _, t in items], pa.string())
    buf, offs = column_bytes(texts)
    starts, ends, counts = words(buf, offs, IS_WORD)
    hashes = hash_spans(buf, starts, ends)
    terms, number = np.unique(hashes, return_inverse=True)
    found: dict[bytes, set[int]] = {}
    at = 0
    for item, n in enumerate(counts.tolist()):
        own = number[at : at + n].astype(np.int32)
        at += n
        for i in range(max(1, n - width + 1) if n else 0):
            found.setdefault(own[i : i + width].tobytes(), set()).add(item)
    return terms, [(np.frombuffer(k, np.int32), sorted(v)) for k, v in found.items()]


def build_index(docs, terms, id_col: str = "doc_id", text_col: str = "text"):
    """One row per block of documents: ids, first places, words, and the postings of ``terms`` (a broadcast array)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known = terms.value
        for batch in batches:
            buf, offs = column_bytes(batch.column(1))
            for i, j, own, at in blocks(buf, offs, BLOCK):
                counts, keys, places = [], [], []
                first, done = [], 0
                for k, m, part, off in blocks(own, at):
                    starts, ends, n = words(part, off, IS_WORD)
                    hashes = hash_spans(part, starts, ends)
                    term = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hit = known[term] == hashes
                    base = done + np.concatenate(([0], np.cumsum(n + GAP)[:-1]))
                    place = np.repeat(base - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(starts))
                    done = int(base[-1] + n[-1] + GAP)
                    first.append(base)
                    counts.append(n)
                    keys.append(term[hit])
                    places.append(place[hit])
                key, place = np.concatenate(keys), np.concatenate(places).astype(np.int32)
                order = np.argsort(key, kind="stable")
                term, begin = np.unique(key[order], return_index=True)
                gaps = np.diff(place[order], prepend=np.int32(0))  # within a term, small
                kind = pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(batch.column(0).type)),
                        *(pa.array([np.concatenate(x).astype("<i4").tobytes()], kind) for x in (first, counts)),
                        *(pa.array([x.astype("<i4").tobytes()], kind) for x in (term, begin, gaps)),
                    ],
                    names=["doc_ids", "first", "n_words", "term", "begin", "gaps"],
                )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), f"doc_ids array<{id_type}>, first binary, n_words binary, term binary, begin binary, gaps binary")


def occurrences(post: dict[int, np.ndarray], window: np.ndarray, slack: int = 0) -> np.ndarray:
    """Places at which ``window`` begins (with slack: at which its rarest term stands), by intersecting posting lists."""
    order = sorted(range(len(window)), key=lambda k: len(post[window[k]]))
    base = post[window[order[0]]] - (0 if slack else order[0])
    for k in order[1:]:
        if not len(base):
            break
        if slack:
            lists, want = post[window[k]], base + (k - order[0])
            at = np.searchsorted(lists, want - slack)
            base = base[(at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] <= want + slack)]
        else:
            lists, want = post[window[k]], base + k
            at = np.minimum(np.searchsorted(lists, want), len(lists) - 1)
            base = base[lists[at] == want]
    return base


def search(index, windows, names: list[str], slack: int = 0):
    """One row per indexed document: n_words, its hit words as bits, and the ids of the items with occurring windows."""
    if not 0 <= slack < GAP:
        raise ValueError(f"slack must be below {GAP}")
    spark = index.sparkSession
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    shared = share(spark, (windows, names))

    def run(batches):
        windows, names = shared.value
        by_width: dict[int, list[int]] = {}
        for w, (own, _) in enumerate(windows):
            by_width.setdefault(len(own), []).append(w)
        stacked = [(np.array(ws), np.stack([windows[w][0] for w in ws])) for ws in by_width.values()]
        size = 1 + max((int(m.max()) for _, m in stacked), default=0)
        for batch in batches:
            for row in batch.to_pylist():
                first, n_words, term, begin, gaps = (np.frombuffer(row[k], "<i4") for k in ("first", "n_words", "term", "begin", "gaps"))
                place = np.cumsum(gaps)
                end = np.append(begin[1:], len(place))
                post = {t: place[a:b] for t, a, b in zip(term.tolist(), begin.tolist(), end.tolist())}
                there = np.zeros(size, bool)
                there[term] = True
                hit = np.zeros(int(first[-1] + n_words[-1] + GAP + 1) if len(first) else 1, np.int32)
                items: dict[int, set[str]] = {}
                for ws, matrix in stacked:
                    for w in ws[there[matrix].all(axis=1)].tolist():
                        own, of = windows[w]
                        at = occurrences(post, own, slack)
                        if len(at):
                            np.add.at(hit, at, 1)
                            np.add.at(hit, at + (1 if slack else len(own)), -1)
                            for d in set(np.searchsorted(first, at, "right").tolist()):
                                items.setdefault(d - 1, set()).update(names[i] for i in of)
                depth = np.concatenate(([0], np.cumsum(np.cumsum(hit) > 0)))
                n_hit = depth[first + n_words] - depth[first]
                flags = np.cumsum(hit) > 0
                mask = [np.packbits(flags[f : f + n]).tobytes() if h else None for f, n, h in zip(first.tolist(), n_words.tolist(), n_hit.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], batch.schema.field(0).type.value_type),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array(mask, pa.binary()),
                        pa.array([sorted(items.get(d, ())) for d in range(len(first))], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "n_words", "n_hit", "hit_mask", "items"],
                )

    return index.mapInArrow(lean(run), f"doc_id {id_type}, n_words bigint, n_hit bigint, hit_mask binary, items array<string>")


def decontaminate(docs, benchmark, width: int = 10, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"):
    """One row per document: n_words, n_hit (words inside any occurrence of a window of ``width`` item words), hit_mask, items.

    Items are held in whole by each task, so they are searched for in passes of at most QUERY_BYTES of their text; each
    pass builds the postings of its own terms.  The passes' hit words and items are united.
    """
    spark = docs.sparkSession
    keyed = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"), F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")).alias("text"))
    bytes_ = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    passes = int(bytes_ // QUERY_BYTES) + 1
    if passes > 1:  # a stored number tells rows apart, whatever their ids
        row = F.struct(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("uid"))
        docs, numbered = write_table(docs.select(row.alias("row"), docs[text_col].alias("text")), "numbered")
        id_col, text_col = "row", "text"
    done, small = None, []
    for k in range(passes):
        own = keyed if passes == 1 else keyed.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        items = sorted({(r["item"], r["text"]) for r in own.toLocalIterator()})
        terms, windows = item_windows(items, width)
        if not len(terms):
            terms = np.zeros(1, np.uint64)
        index, path = write_table(build_index(docs, share(spark, terms), id_col, text_col), "postings")
        got, got_path = write_table(search(index, windows, [i for i, _ in items], slack), "found")
        drop_table(spark, path)
        small.append(got_path)
        done = got if done is None else done.unionByName(got)
    if passes == 1:
        return done
    done, _ = write_table(_unite(done), "united")
    for path in [*small, numbered]:
        drop_table(spark, path)
    return done


def _unite(rows):
    """Unites what several passes found of each document, by its row id: the passes read one table of numbered documents."""
    bits = F.udf(lambda masks: _or(masks), "binary")
    got = rows.groupBy("doc_id.uid").agg(F.first("doc_id.doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hit_mask").alias("masks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    mask = bits("masks")
    return got.select("doc_id", "n_words", F.coalesce(F.udf(lambda m: int(np.unpackbits(np.frombuffer(m, np.uint8)).sum()) if m else 0, "bigint")(mask), F.lit(0)).alias("n_hit"), mask.alias("hit_mask"), "items")


def _or(masks):
    out = None
    for m in masks:
        own = np.frombuffer(m, np.uint8)
        out = own if out is None else out | own
    return None if out is None else out.tobytes()
