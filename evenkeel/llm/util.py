"""Shared parts of the training-data operators: shared-folder tables and byte-level text blocks.

Texts reach Python as Arrow buffers.  ``blocks`` walks a batch in slices of about ``BLOCK`` bytes
(a longer text is a block of its own, never cut), and ``words``/``hash_spans`` find and hash all
words of a block with a handful of numpy passes, so no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_U = np.uint64


def shared_root(spark) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of its own in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="evenkeel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Tables that write_table has made and nobody has dropped yet, by Spark context.
_made: dict[int, set[str]] = {}


def sweep(spark, before: set[str], *keep: str) -> None:
    """Drop the tables made since ``before`` (a former ``tables``), but for ``keep``."""
    for path in tables(spark) - before - set(keep):
        drop_table(spark, path)


def tables(spark) -> set[str]:
    return set(_made.get(id(spark.sparkContext), ()))


def write_table(df, name: str, partition_by: str | None = None):
    """Write ``df`` as Parquet in the shared folder and read it back: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/evenkeel-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _made.setdefault(id(spark.sparkContext), set()).add(path)
    free(spark)
    return spark.read.schema(df.schema).parquet(path), path


def free(spark) -> None:
    """Have Spark remove shuffle files that nothing can read any more: it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(spark, path: str) -> None:
    """Remove a table that nothing reads any more."""
    _made.get(id(spark.sparkContext), set()).discard(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(buf: np.ndarray, offs: np.ndarray, size: int = BLOCK):
    """Slices (first row, last row + 1, bytes, offsets) of about ``size`` bytes of whole texts."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
    """(starts, ends, counts) of the maximal runs of word bytes in each text; counts is per text."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    w = is_word[buf]
    edge = np.zeros(len(w) + 1, bool)
    edge[offs] = True  # a text's first byte, and the end
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    at = np.searchsorted(starts, offs)
    return starts, ends, np.diff(at)


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_BYTE = _BYTE[_LOWER]
EXACT_BYTE = _BYTE
_powers: dict[str, np.ndarray] = {}


def _power(base, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if size == BLOCK + 1:
            _powers[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER_BYTE) -> np.ndarray:
    """64-bit hashes of byte spans from one running sum: a polynomial over a random table, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.empty(len(buf) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[buf] * _power(_P, len(buf)), out=total[1:])
        h = (total[ends] - total[starts]) * _power(_PINV, len(buf))[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
NOT_SPACE = ~SPACES


#: Rows and bytes that go to a Python worker at a time: whole documents, index blocks and sets are long rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark) -> None:
    """Bound the batches of Python workers, and send them this package, once for each context."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) in (None, "10000", "-1"):
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_evenkeel_shipped", False):
        return
    import zipfile
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="evenkeel-")) / "evenkeel.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    context.addPyFile(str(target))
    context._evenkeel_shipped = True


def lean(run):
    """``run`` for mapInArrow, after which a Python worker gives the memory it no longer uses back: workers are used again."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # the GNU C library only
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def share(spark, value):
    """Broadcast ``value`` to workers that have this package."""
    ship(spark)
    return spark.sparkContext.broadcast(value)
