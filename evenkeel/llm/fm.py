"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata (the length).

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the number of features.

Features are made by numpy over whole blocks of bytes.  The model is fitted in one task on at most about ``SAMPLE``
labelled documents, picked by a hash of their id (a stated bound: the fit's size is fixed, scoring covers all rows); its
weights, (HASHED + len(STRUCTURE)) * (FACTORS + 2) floats, are broadcast.

Null and empty texts have the features of an empty text and get a score.  Repeated rows repeat.  Without any labelled
document, or with one label only, every score is that label's share (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .util import blocks, column_bytes, hash_spans, lean, NOT_SPACE, share, ship, words

HASHED, FACTORS, SAMPLE, EPOCHS = 1 << 14, 8, 12_000, 6
#: Shares of bytes or words, in this order; each is a feature of its own after the hashed words.
STRUCTURE = ("symbols", "marks", "bars", "upper", "digits", "not_ascii", "line_ends", "letters", "same_as_last", "distinct", "word_length", "very_long_words", "log_length", "one")
_CLASS = {"symbols": b"#*$%&<>^~_=+@\\", "marks": b"!?", "bars": b"|", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "not_ascii": bytes(range(128, 256)), "line_ends": b"\n", "letters": bytes(range(97, 123))}


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), sorted by row and feature, of all texts of a block."""
    n_rows = len(offs) - 1
    starts, ends, counts = words(buf, offs, NOT_SPACE)
    hashes = hash_spans(buf, starts, ends)
    row = np.repeat(np.arange(n_rows), counts)
    key, times = np.unique(row << 14 | (hashes >> np.uint64(50)).astype(np.int64), return_counts=True)
    r, feature = key >> 14, key & (HASHED - 1)
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(r, value * value, n_rows))
    value = value / np.maximum(norm, 1e-9)[r]
    size, n = np.maximum(np.diff(offs), 1), np.maximum(counts, 1)
    stats = np.zeros((n_rows, len(STRUCTURE)))
    for k, name in enumerate(STRUCTURE[:8]):
        table = np.zeros(256, np.int64)
        table[list(_CLASS[name])] = 1
        total = np.concatenate(([0], np.cumsum(table[buf])))
        stats[:, k] = (total[offs[1:]] - total[offs[:-1]]) / size
    same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    stats[:, 8] = np.bincount(row[1:][same], minlength=n_rows) / n
    stats[:, 9] = np.bincount(r, minlength=n_rows) / n
    length = ends - starts
    stats[:, 10] = np.bincount(row, length, n_rows) / n / 20
    stats[:, 11] = np.bincount(row, length > 30, n_rows) / n
    stats[:, 12] = np.log1p(np.diff(offs)) / 10
    stats[:, 13] = 1
    every = np.arange(n_rows)
    r = np.concatenate([r, np.repeat(every, len(STRUCTURE))])
    feature = np.concatenate([feature, np.tile(HASHED + np.arange(len(STRUCTURE)), n_rows)])
    value = np.concatenate([value, stats.ravel()])
    order = np.argsort(r, kind="stable")
    return r[order], feature[order], value[order].astype(np.float32)


def raw_scores(model, row, feature, value, n_rows: int) -> np.ndarray:
    b, w, v = model
    at = np.searchsorted(row, np.arange(n_rows))
    vx = v[feature] * value[:, None]
    pair = np.square(np.add.reduceat(vx, at)) - np.add.reduceat(vx * vx, at)
    return b + np.add.reduceat(w[feature] * value, at) + 0.5 * pair.sum(1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7):
    """Adagrad on the logistic loss, the rarer label weighted up to a third of the mass; (b, w, v)."""
    y = np.array([r[2] for r in rows], np.float64)
    rng = np.random.default_rng(seed)
    size = HASHED + len(STRUCTURE)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    share = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return float(np.log((share + 1e-4) / (1 - share + 1e-4))), w.astype(np.float32), np.zeros_like(v, np.float32)
    up = max(1.0, 0.5 * max(share, 1 - share) / min(share, 1 - share))
    weight = np.where(y == (share < 0.5), up, 1.0)
    b, gw, gv, gb = 0.0, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for s in range(0, len(rows), 64):
            pick = order[s : s + 64]
            feature = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
            lens = np.array([len(rows[i][0]) for i in pick])
            row = np.repeat(np.arange(len(pick)), lens)
            at = np.concatenate(([0], np.cumsum(lens)[:-1]))
            vx = v[feature] * value[:, None]
            total = np.add.reduceat(vx, at)
            z = b + np.add.reduceat(w[feature] * value, at) + 0.5 * (np.square(total) - np.add.reduceat(vx * vx, at)).sum(1)
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            used, to = np.unique(feature, return_inverse=True)
            dw = np.bincount(to, g[row] * value) + 1e-6 * w[used]
            each = g[row, None] * value[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(to, each[:, f]) for f in range(FACTORS)], 1) + 1e-5 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            w[used] -= 0.15 * dw / np.sqrt(gw[used])
            v[used] -= 0.03 * dv / np.sqrt(gv[used])
            b -= 0.1 * g.sum() / np.sqrt(gb)
    return float(b), w.astype(np.float32), v.astype(np.float32)


def _blocks(column):
    buf, offs = column_bytes(column)
    return blocks(buf, offs)


def train(docs, labels, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """Fits on the labelled documents (``labels``: id, label; one row per id), about ``sample`` of them at most."""
    spark = docs.sparkSession
    ship(spark)
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    # at most about `sample` rows of two numbers: a proven bound
    joined = docs.select(docs[id_col], docs[text_col].alias("text")).join(F.broadcast(labels), id_col).select(F.col(id_col).cast("string").alias("id"), "text", "y")

    def prepare(batches):
        for batch in batches:
            ys, ids = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            for i, j, buf, offs in _blocks(batch.column(1)):
                row, feature, value = features(buf, offs)
                at = np.searchsorted(row, np.arange(j - i + 1))
                parts = [(feature[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary()), pa.array(ys[i:j], pa.int32())], names=["id", "f", "x", "y"])

    def learn(batches):
        rows = []
        for batch in batches:
            for i, f, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows.append((i, np.frombuffer(f, "<i4"), np.frombuffer(x, "<f4"), y))
        rows.sort(key=lambda r: (r[0], r[1].tobytes()))  # the same fit whatever the order of arrival
        b, w, v = fit([r[1:] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["b", "w", "v"])

    got = joined.mapInArrow(lean(prepare), "id string, f binary, x binary, y int").repartition(1).mapInArrow(lean(learn), "b double, w binary, v binary").collect()
    if not got:
        return fit([])
    return got[0]["b"], np.frombuffer(got[0]["w"], np.float32), np.frombuffer(got[0]["v"], np.float32).reshape(-1, FACTORS)


def score(docs, model, text_col: str = "text", out: str = "score"):
    """``docs`` with its rows' score (0 to 1) in column ``out``, which is replaced if it is there."""
    shared = share(docs.sparkSession, model)
    docs = docs.drop(out)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for i, j, buf, offs in _blocks(batch.column(at)):
                z = raw_scores(shared.value, *features(buf, offs), j - i)
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores).astype(np.float64))], names=[*batch.schema.names, out])

    from pyspark.sql import types as T

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
