"""N-gram Jaccard join: exact links between documents by their sets of word shingles, and the classes the links form.

1. ``sets``: one row per document: size of its set, a fingerprint of it, a bitmap (2 to 4 bits a shingle), and its prefix,
   the size - need + 1 first shingles under one order of all shingles (need: the least overlap of any link).  Two linked
   documents share a shingle of their prefixes.  Documents of equal fingerprint are one node from here on.
2. Documents whose prefixes share a shingle form a group, named after its least document (its pivot).  Groups are cut into
   blocks of at most 2 * ``CHUNK`` documents and 2 * ``SHINGLES`` shingles: by zones of size, of which a link reaches the
   next at most, and inside a zone by a hash.  A group that is smaller is one block.
3. A block is a signature tree, or two that face each other: leaves are documents, nodes hold the OR of their bitmaps, the
   range of their sizes and whether they are of one class.  A dual traversal drops node pairs whose largest possible
   overlap is too small, or that are one class.  What comes out is the block's documents that are in any pair left.
4. Only these documents' whole sets go to their blocks, where the trees are walked again and the pairs left are compared, the
   most alike first.  Pairs that the block has already drawn into one class are passed by, so a block lists fewer links
   than it has documents.  Classes over all blocks are found by alternating stars.

Steps 3 and 4 run several times: first each document faces only the pivot of the groups of its first ``FIRST`` places, which
draws most near copies together; then one document of each class of the large groups, again and again while that unites
many; then all of the groups that still hold several classes.  Every pair of documents of different classes is ruled out by
its trees or compared by its whole sets (64 bits a shingle), so no class is cut.

The order of shingles puts those last that stand in several documents of a hash sample, by a map of a fixed size that goes out
by broadcast; any order gives the same result, this one keeps common passages from bringing unrelated documents together.

Null, blank and empty texts have an empty set and are a class each.  Repeated rows, and rows of one id, are documents of
their own; a class is named after its least id, null where all are null.  An empty table gives no rows.  Only the columns
named are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F, Window

from .util import blocks, column_bytes, drop_table, hash_spans, lean, mix, NOT_SPACE, share, ship, words, write_table

SAMPLED, MARKS, DEMOTED = 16, 1 << 24, 1 << 20  # one document in so many is read for the order; bits of the map of shingles that come last, and how many may set one
FIRST, CHUNK, SHINGLES, FAN = 8, 128, 1 << 20, 8  # prefix places of the first round, bounds of a block's side, children of a node
BROADCAST_ROWS = 500_000  # rows of a few numbers that may be broadcast; beyond, a shuffled join
_U = np.uint64


def shingle_rows(buf: np.ndarray, offs: np.ndarray, k: int):
    """The sorted set of shingle hashes of each text of a block."""
    starts, ends, counts = words(buf, offs, NOT_SPACE)
    h = hash_spans(buf, starts, ends)
    with np.errstate(over="ignore"):
        s = h[: max(0, len(h) - k + 1)]
        for j in range(1, k):
            s = mix(s) * _U(0x9E3779B97F4A7C15) + h[j : j + len(s)]
        s = mix(s)
        at = 0
        for n in counts.tolist():
            if n >= k:
                yield np.unique(s[at : at + n - k + 1])
            elif n:
                yield np.array([xxhash.xxh3_64_intdigest(h[at : at + n].tobytes(), seed=n)], np.uint64)
            else:
                yield s[:0]
            at += n


def bitmap(own: np.ndarray) -> np.ndarray:
    """OR of one bit a shingle, of a power of two (64 at least) of two to four bits a shingle."""
    m = 64
    while m < 2 * len(own):
        m *= 2
    bits = np.zeros(m, np.uint8)
    bits[((own >> _U(17)) & _U(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def need(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-percent * n // 100)


def sets(docs, k: int, percent: int, last, id_col: str, text_col: str):
    """Rows (doc_id, text_hash, uid, n, fp, bits, prefix); ``last`` is the broadcast map of shingles that come last."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        late = last.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, buf, offs in blocks(*column_bytes(batch.column(1))):
                out: list[list] = [[], [], [], []]
                for own in shingle_rows(buf, offs, k):
                    n = len(own)
                    if n:
                        first = own
                        at = _marks(own)
                        is_late = (late[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                        if is_late.any():
                            first = np.concatenate([own[~is_late], own[is_late]])
                        row = (n, xxhash.xxh3_128_digest(own.tobytes()), bitmap(own).tobytes(), first[: n - need(n, percent) + 1].astype(np.int64))
                    else:
                        row = (0, None, None, None)
                    for kept, value in zip(out, row):
                        kept.append(value)
                ids = pa.array(range(uid, uid + j - i), pa.int64())
                uid += j - i
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), ids, *(pa.array(v, t) for v, t in zip(out, kinds))], names=["doc_id", "text_hash", "uid", "n", "fp", "bits", "prefix"])

    read = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    return read.mapInArrow(lean(run), f"doc_id {id_type}, text_hash bigint, uid bigint, n int, fp binary, bits binary, prefix array<bigint>")


def _marks(own: np.ndarray) -> np.ndarray:
    """Place of each shingle in the map of those that come last."""
    return ((own >> _U(24)) & _U(MARKS - 1)).astype(np.int64)


def _often(docs, k: int, id_col: str, text_col: str) -> np.ndarray:
    """A map, of a size that doesn't grow, of shingles that stand twice or more in a hash sample of the documents: for the order only.

    The most frequent ones only where there are more than ``DEMOTED``.
    """
    spark = docs.sparkSession

    def run(batches):
        for batch in batches:
            for _, _, buf, offs in blocks(*column_bytes(batch.column(0))):
                rows = list(shingle_rows(buf, offs, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).astype(np.int64))], names=["token"])

    picked = docs.where(F.pmod(F.xxhash64(docs[id_col]), F.lit(SAMPLED)) == 0).select(docs[text_col].cast("string").alias("text"))
    counted = picked.mapInArrow(lean(run), "token bigint").groupBy("token").agg(F.least(F.count("*"), F.lit(4096)).alias("n")).where("n > 1")
    counted, path = write_table(counted, "often")
    left, least = DEMOTED, 4096
    for r in counted.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).collect():  # 4,095 rows at most
        left -= r["tokens"]
        if left < 0:
            break
        least = r["n"]

    def fold(batches):
        found = np.zeros(MARKS, bool)
        for batch in batches:
            found[_marks(batch.column(0).to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(found).tobytes()], pa.binary())], names=["map"])

    out = np.zeros(MARKS // 8, np.uint8)
    for r in counted.where(F.col("n") >= least).select("token").coalesce(4).mapInArrow(lean(fold), "map binary").toLocalIterator():
        out |= np.frombuffer(r["map"], np.uint8)
    drop_table(spark, path)
    return out


class Tree:
    """Signature tree over documents sorted by size; level 0 are the documents."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, classes: np.ndarray):
        excess = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, excess, classes)]
        while len(self.levels[-1][0]) > FAN:
            maps, low, high, excess, one = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            same = np.minimum.reduceat(one, at) == np.maximum.reduceat(one, at)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.where(same, one[at], -1)))


def tree_pairs(a: Tree, b: Tree | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Document pairs that a dual traversal of two trees (or one with itself) can't rule out."""
    other = b or a
    top = max(len(a.levels), len(other.levels)) - 1
    lift = lambda t, lv: t.levels[min(lv, len(t.levels) - 1)]
    x, y = np.meshgrid(np.arange(len(lift(a, top)[0])), np.arange(len(lift(other, top)[0])), indexing="ij")
    x, y = x.ravel(), y.ravel()
    for level in range(top, -1, -1):
        maps, low, high, excess, one = lift(a, level)
        maps2, low2, high2, excess2, one2 = lift(other, level)
        keep = (one[x] != one2[y]) | (one[x] < 0)
        keep &= (100 * high[x] >= percent * low2[y]) & (100 * high2[y] >= percent * low[x])
        if b is None:
            keep &= (x < y) if level == 0 else (x <= y)
        x, y = x[keep], y[keep]
        parts = []
        for s in range(0, len(x), 4096):  # bounds the memory of the bitmaps that are laid side by side
            i, j = x[s : s + 4096], y[s : s + 4096]
            common = np.bitwise_count(maps[i] & maps2[j]).sum(1).astype(np.int64)
            most = np.minimum(np.minimum(high[i], high2[j]), common + np.minimum(excess[i], excess2[j]))
            parts.append((100 + percent) * most >= percent * (low[i] + low2[j]))
        keep = np.concatenate(parts) if parts else np.zeros(0, bool)
        x, y = x[keep], y[keep]
        if level:
            down = []
            for t, z in ((a, x), (other, y)):
                step = FAN if level < len(t.levels) else 1
                down.append((z, step, len(lift(t, level - 1)[0])))
            (x, sx, nx), (y, sy, ny) = down
            x = (x[:, None, None] * sx + np.arange(sx)[None, :, None] + np.zeros((1, 1, sy), int)).ravel()
            y = (y[:, None, None] * sy + np.arange(sy)[None, None, :] + np.zeros((1, sx, 1), int)).ravel()
            inside = (x < nx) & (y < ny)
            x, y = x[inside], y[inside]
    return x, y


def _fold(raw: bytes, size: int) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8)
    return np.bitwise_or.reduce(own.reshape(-1, size), axis=0)


def step(percent: int) -> float:
    """Logarithm of a little more than the ratio of a link's two sizes: in zones of this width they differ by one at most."""
    return float(np.log(100 / percent) * 1.000001)


def _faced(n, bits, cls, left, right, percent: int):
    """Pairs of rows of ``left`` and ``right``, or among ``left`` where that is None, that trees leave."""
    size = min(len(bits[i]) for rows in (left, right) if rows is not None for i in rows)
    trees = []
    for rows in (left, right):
        if rows is not None:
            maps = np.stack([_fold(bits[i], size) for i in rows]).view(np.uint64)
            trees.append(Tree(n[rows], maps, cls[rows]))
    x, y = tree_pairs(trees[0], trees[1] if right is not None else None, percent)
    return left[x], (left if right is None else right)[y]


def block_pairs(n, bits, cls, side, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a block that its trees leave: among all rows where all are of side 0, else between sides 0 and 1."""
    order = np.arange(len(n))
    if len(n) > FAN:
        _, of, times = np.unique(cls, return_inverse=True, return_counts=True)
        order = np.lexsort((n, np.where(times[of] > 1, cls, np.iinfo(np.int64).max)))  # classes of several rows together, then by size
    right = order[side[order] == 1]
    if len(right):
        left = order[side[order] == 0]
        return _faced(n, bits, cls, left, right, percent) if len(left) else (left, left)
    zone = np.floor(np.log(n) / step(percent)).astype(np.int64)[order]
    found, last = [], None
    for z in np.unique(zone).tolist():
        own = order[zone == z]
        if len(own) > 1:
            found.append(_faced(n, bits, cls, own, None, percent))
        if last is not None and last[0] == z - 1:
            found.append(_faced(n, bits, cls, last[1], own, percent))
        last = z, own
    return tuple(np.concatenate([f[i] for f in found]) if found else order[:0] for i in range(2))


def _blocks(batches, keys: int):
    """(table, edges): whole blocks, rows of equal first ``keys`` columns, which come sorted by them; edges are where blocks begin and end."""
    held = None
    for batch in batches:
        table = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for i in range(keys):
            key = table.column(i).to_numpy()
            new[1:] |= key[1:] != key[:-1]
        at = np.flatnonzero(new)
        last = int(at[-1]) if len(at) else 0
        if last:
            yield table.slice(0, last), [0, *at.tolist()]
        held = table.slice(last)
    if held is not None:
        yield held, [0, held.num_rows]


_BLOCK = ["pivot", "zone", "i", "j"]
_KEYS = "pivot bigint, zone int, i int, j int"


def _survivors(percent: int):
    """Of blocks (columns _BLOCK, side, uid, cls, n, bits; by size in a block): the rows in any pair that the trees leave."""

    def run(batches):
        for table, edges in _blocks(batches, len(_BLOCK)):
            n, cls, side = (table.column(c).to_numpy() for c in ("n", "cls", "side"))
            n, bits = n.astype(np.int64), table.column("bits").combine_chunks()
            near = 100 * n[:-1] >= percent * n[1:]
            near[np.array(edges[1:-1], np.int64) - 1] = False
            near = np.append(near, False) | np.insert(near, 0, False)  # has a neighbour of a size to link with
            rows = np.flatnonzero(near)
            cut = np.searchsorted(rows, edges)
            kept = []
            for a, b in zip(cut.tolist(), cut[1:].tolist()):
                if b - a > 1:
                    own = rows[a:b]
                    x, y = block_pairs(n[own], [bits[i].as_buffer() for i in own.tolist()], cls[own], side[own], percent)
                    if len(x):
                        kept.append(own[np.unique(np.concatenate([x, y]))])
            if kept:
                yield from table.select([*_BLOCK, "side", "uid", "cls"]).take(pa.array(np.concatenate(kept))).combine_chunks().to_batches()

    return run


def _compare(percent: int):
    """Of blocks (columns _BLOCK, side, uid, cls, n, body): links between documents that the block had in different classes."""

    def run(batches):
        for table, edges in _blocks(batches, len(_BLOCK)):
            out = [[], []]
            for a, b in zip(edges, edges[1:]):
                own = table.slice(a, b - a)
                uid, at = np.unique(own.column("uid").to_numpy(), return_index=True)  # repeated rows give a body twice
                cls, side = (own.column(c).to_numpy()[at] for c in ("cls", "side"))
                bodies = own.column("body")
                for i, j in united([np.frombuffer(bodies[i].as_buffer(), np.uint64) for i in at.tolist()], cls, side, percent):
                    out[0].append(min(uid[i], uid[j]))
                    out[1].append(max(uid[i], uid[j]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["a", "b"])

    return run


def united(own: list[np.ndarray], cls: np.ndarray, side: np.ndarray, percent: int):
    """Links of a block's sets that unite its classes; the pairs of the most common bits come first."""
    n = np.array([len(s) for s in own], np.int64)
    maps = [bitmap(s) for s in own]
    x, y = block_pairs(n, maps, cls, side, percent)
    size = min(map(len, maps))
    small = np.stack([_fold(m, size) for m in maps]).view(np.uint64)
    common = np.zeros(len(x))
    for s in range(0, len(x), 4096):
        common[s : s + 4096] = np.bitwise_count(small[x[s : s + 4096]] & small[y[s : s + 4096]]).sum(1)
    order = np.argsort(-common / np.maximum(n[x], n[y]), kind="stable")
    root = {c: c for c in cls.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for i, j in zip(x[order].tolist(), y[order].tolist()):
        a, b = top(int(cls[i])), top(int(cls[j]))
        if a != b:
            both = len(own[i]) + len(own[j])
            same = both - len(np.union1d(own[i], own[j]))
            if 100 * same >= percent * (both - same):
                root[max(a, b)] = min(a, b)
                yield i, j


def _dealt(rows, *more: str):
    """Blocks together, in Spark's number of shuffle partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*_BLOCK, "side", "uid", "cls", "n", *more).repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK, "n")


def settle(docs, nodes, maps, rows, k: int, percent: int, id_col: str, text_col: str):
    """Links between documents of different classes in the blocks ``rows`` (_BLOCK, side, uid, cls), as a stored table.

    ``nodes``: uid, doc_id, text_hash, fp; ``maps``: uid, n, bits.  Texts come by id and hash, so rows that share an id (null ones too) meet only
    their own.
    """
    spark = docs.sparkSession
    left = _dealt(rows.join(maps, "uid"), "bits").mapInArrow(lean(_survivors(percent)), f"{_KEYS}, side int, uid bigint, cls bigint")
    left, left_path = write_table(left, "survivors")
    wanted = left.groupBy("uid").agg(F.collect_list(F.struct(*_BLOCK, "side", "cls")).alias("blocks"))  # as many as its groups have blocks
    wanted, wanted_path = write_table(nodes.join(wanted, "uid"), "wanted")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("hash"))
    few = left.count() <= BROADCAST_ROWS
    own = (F.col("hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, own).select("uid", "fp", "text", "blocks")

    def run(batches):
        for batch in batches:
            uids, fps = batch.column(0), batch.column(1).to_pylist()
            for i, j, buf, offs in blocks(*column_bytes(batch.column(2))):
                own = list(shingle_rows(buf, offs, k))
                hits = [r for r in range(i, j) if xxhash.xxh3_128_digest(own[r - i].tobytes()) == fps[r]]  # not another text of this hash
                at = pa.array(hits, pa.int64())
                yield pa.RecordBatch.from_arrays([uids.take(at), pa.array([own[r - i].tobytes() for r in hits], pa.binary()), batch.column(3).take(at)], names=["uid", "body", "blocks"])

    kind = wanted.schema["blocks"].dataType.simpleString()
    bodies = texts.mapInArrow(lean(run), f"uid bigint, body binary, blocks {kind}").select("uid", "body", F.explode("blocks").alias("at")).select("uid", "body", "at.*", F.octet_length("body").alias("n"))
    links = _dealt(bodies, "body").mapInArrow(lean(_compare(percent)), "a bigint, b bigint")
    links, path = write_table(links, "links")
    for p in (left_path, wanted_path):
        drop_table(spark, p)
    return links, path


def classes(links):
    """(node, cls), and its path: each linked node's class, named after its least node; alternating large and small stars."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, path = write_table(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new, new_path = write_table(new, "edges")
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_table(spark, path)
        edges, path = new, new_path
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("cls")), path
        before = now


def _meet(batches):
    """Of rows (token, marked) in this order: those whose token another document has too, with the least document as pivot."""
    last, held = None, None  # the token and pivot of the row before; that row's mark where it is not given out yet
    for batch in batches:
        token, marked = (batch.column(i).to_numpy() for i in range(2))
        if not len(token):
            continue
        uid = marked >> 1
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        new[0] = last is None or token[0] != last[0]
        at = np.flatnonzero(new)
        pivot = np.full(len(token), -1 if last is None else last[1])
        if len(at):
            pivot[at[0] :] = np.repeat(uid[at], np.diff(np.append(at, len(token))))
        keep = ~new
        keep[:-1] |= new[:-1] & ~new[1:]
        give = [token[keep], marked[keep], pivot[keep]]
        if held is not None and not new[0]:
            give = [np.concatenate([[h], g]) for h, g in zip((last[0], held, last[1]), give)]
        last, held = (token[-1], pivot[-1]), (marked[-1] if new[-1] else None)
        token, marked, pivot = give
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(marked >> 1), pa.array((marked & 1).astype(bool)), pa.array(pivot)], names=["token", "uid", "early", "pivot"])


def _mixed(shared, found, sizes, percent: int):
    """(pivot, uid, cls, n, zone) of the groups with tokens that stand in several classes; -1 for zone in a group of one chunk.

    Groups of one pivot are one group, so that near copies, which share many shingles, meet once or twice and not once a
    shingle.
    """
    rows = shared.select("token", "pivot", "uid").join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("cls", F.coalesce("cls", "uid"))
    several = rows.groupBy("token").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 != c1").select("token")
    rows = rows.join(several, "token").select("pivot", "uid", "cls").distinct().join(sizes, "uid")
    whole = rows.groupBy("pivot").agg(((F.count("*") <= CHUNK) & (F.sum("n") <= SHINGLES)).alias("whole"))
    zone = F.when(F.col("whole"), -1).otherwise(F.floor(F.log("n") / F.lit(step(percent)))).cast("int")
    rows = rows.join(whole, "pivot").select("pivot", "uid", "cls", "n", zone.alias("zone"))
    # in a group of one chunk only documents with another of a size to link with; a row of a larger group is alone here
    place = Window.partitionBy("pivot", F.when(F.col("zone") >= 0, F.col("uid"))).orderBy("n", "uid")
    near = F.coalesce(100 * F.lag("n").over(place) >= percent * F.col("n"), F.lit(False)) | F.coalesce(100 * F.col("n") >= percent * F.lead("n").over(place), F.lit(False))
    return rows.withColumn("near", near | (F.col("zone") >= 0)).where("near").drop("near")


def _merge(docs, nodes, maps, rows, found, found_path, *args):
    """``found`` (node, cls), and its path, with the classes united that the blocks ``rows`` link; the old table goes."""
    more, more_path = settle(docs, nodes, maps, rows, *args)
    of = found.select(F.col("node").alias("a"), F.col("cls").alias("ca"))
    both = more.join(of, "a", "left").join(of.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    out = classes(both.unionByName(found.toDF("a", "b")))
    for p in (more_path, found_path):
        drop_table(docs.sparkSession, p)
    return out


def join(docs, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document: doc_id, n_shingles, component_id (the least id of its class), text_hash, and ``first``.

    ``first`` marks one document of each class, of the least id, a null id last; text_hash is xxhash64 of the text.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = share(spark, _often(docs, k, id_col, text_col))
    everything, sets_path = write_table(sets(docs, k, percent, last, id_col, text_col), "sets")
    filled = everything.where("n > 0")
    least = filled.groupBy("fp").agg(F.min("uid").alias("node"), F.count("*").alias("g")).where("g > 1").select("fp", "node")
    copies, copies_path = write_table(filled.select("uid", "fp").join(least, "fp").where("uid != node").select("uid", "node"), "copies")
    few = copies.count() <= BROADCAST_ROWS
    small = F.broadcast(copies.select("uid")) if few else copies.select("uid")
    kept = filled.select("uid", "prefix").join(small, "uid", "left_anti")  # one document for each set
    # two numbers a row: the shingle, and the document with a mark for its first places; they are shuffled once
    marked = F.col("uid") * 2 + (F.col("place") < FIRST).cast("bigint")
    tokens = kept.select("uid", F.posexplode("prefix").alias("place", "token")).select("token", marked.alias("marked"))
    met = tokens.repartition(parts, "token").sortWithinPartitions("token", "marked").mapInArrow(lean(_meet), "token bigint, uid bigint, early boolean, pivot bigint")
    shared, shared_path = write_table(met, "shared")
    nodes = everything.select("uid", "doc_id", "text_hash", "fp")
    maps = filled.select("uid", "n", "bits")
    sizes = filled.select("uid", "n")
    n_blocks = lambda n, total: F.ceil(F.greatest(n / CHUNK, total / SHINGLES)).cast("int")

    # each document and the pivots of its first places
    stars = shared.where("early and uid != pivot").select("pivot", "uid").distinct().join(sizes, "uid").join(sizes.toDF("pivot", "m"), "pivot")
    stars = stars.where(f"100 * n >= {percent} * m and 100 * m >= {percent} * n")
    count = stars.groupBy("pivot").agg(n_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    stars = stars.join(count, "pivot").select("pivot", F.lit(-1).alias("zone"), F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("i"), F.lit(0).alias("j"), "uid")
    middle = stars.select("pivot", "zone", "i", "j", F.col("pivot").alias("uid")).distinct()
    rows = middle.withColumn("side", F.lit(0)).unionByName(stars.withColumn("side", F.lit(1))).withColumn("cls", F.col("uid"))
    links, links_path = settle(docs, nodes, maps, rows, k, percent, id_col, text_col)
    found, found_path = classes(links)
    drop_table(spark, links_path)

    # groups of more than one chunk: one document of each class in them, chunk by chunk, as long as that unites many classes;
    # a large group of near copies becomes few classes so, and its documents need not all face each other
    before = None
    met, met_path = write_table(_mixed(shared, found, sizes, percent), "met")
    drop_table(spark, shared_path)
    while True:
        large = met.groupBy("pivot", "zone").agg(F.count("*").alias("g"), F.sum("n").alias("total"), F.min("cls").alias("c0"), F.max("cls").alias("c1"))
        large = large.where((n_blocks(F.col("g"), F.col("total")) > 1) & (F.col("c0") != F.col("c1"))).select("pivot", "zone")
        heads, heads_path = write_table(met.join(large, ["pivot", "zone"]).groupBy("pivot", "zone", "cls").agg(F.min("uid").alias("uid"), F.max("n").alias("n")), "heads")
        now = heads.count()
        if not now or before is not None and now > 0.8 * before:
            drop_table(spark, heads_path)
            break
        before = now
        count = heads.groupBy("pivot", "zone").agg(n_blocks(F.count("*"), F.sum("n")).alias("blocks"))
        rows = heads.join(count, ["pivot", "zone"]).select("pivot", "zone", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "uid", "cls")
        found, found_path = _merge(docs, nodes, maps, rows, found, found_path, k, percent, id_col, text_col)
        now_of = found.select(F.col("node").alias("uid"), F.col("cls").alias("now"))
        fresh = met.join(now_of, "uid", "left").select("pivot", "uid", F.coalesce("now", "uid").alias("cls"), "n", "zone")
        several = fresh.groupBy("pivot").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 != c1").select("pivot")
        fresh, fresh_path = write_table(fresh.join(several, "pivot"), "met")
        for p in (met_path, heads_path):
            drop_table(spark, p)
        met, met_path = fresh, fresh_path

    # all documents of what is left.  In each zone of a group the commonest class stands apart and does not face itself
    each = met.groupBy("pivot", "zone", "cls").agg(F.count("*").alias("g"), F.sum("n").alias("total"))
    top = F.max_by(F.struct("cls", "g", "total"), F.struct("g", "cls"))
    span = each.groupBy("pivot", "zone").agg(top.alias("top"), F.sum("g").alias("g"), F.sum("total").alias("total"))
    span = span.select("pivot", "zone", F.col("top.cls").alias("main"), n_blocks(F.col("top.g"), F.col("top.total")).alias("mains"), n_blocks(F.col("g") - F.col("top.g"), F.col("total") - F.col("top.total")).alias("rest"))
    far = span.select("pivot", (F.col("zone") - 1).alias("zone"), F.struct("main", "mains", "rest").alias("up"))
    near = span.select("pivot", (F.col("zone") + 1).alias("zone"), F.struct("main", "mains", "rest").alias("down"))
    span = span.join(far, ["pivot", "zone"], "left").join(near, ["pivot", "zone"], "left")
    of_main = F.col("cls") == F.col("main")
    # chunks of a zone: its commonest class first, then the rest
    chunk = F.when(of_main, F.pmod(F.xxhash64("uid"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("uid"), F.col("rest"))).cast("int")
    cut = met.join(span, ["pivot", "zone"]).withColumn("chunk", chunk)
    at = lambda zone, i, j, side: F.struct(zone.cast("int").alias("zone"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    c, z = F.col("chunk"), F.col("zone") * 2  # 2 * zone: inside a zone; one more: the zone and the next

    def chunks(mains, rest, skip):
        """Numbers of a zone's chunks; without those of its commonest class where ``skip``."""
        low, high = F.when(skip, mains).otherwise(0), mains + rest
        return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))

    def beside(zone: str):
        return F.coalesce(chunks(F.col(f"{zone}.mains"), F.col(f"{zone}.rest"), of_main & (F.col(f"{zone}.main") == F.col("main"))), F.array().cast("array<int>"))

    inside = F.transform(chunks(F.col("mains"), F.col("rest"), of_main), lambda x: F.when(x >= c, at(z, c, x, 0)).otherwise(at(z, x, c, 1)))
    above = F.transform(beside("up"), lambda x: at(z + 1, c, x, 0))
    below = F.transform(beside("down"), lambda x: at(z - 1, x, c, 1))
    rows = cut.select("pivot", "uid", "cls", F.explode(F.concat(inside, above, below)).alias("at")).select("pivot", "at.*", "uid", "cls")
    found, found_path = _merge(docs, nodes, maps, rows, found, found_path, k, percent, id_col, text_col)
    drop_table(spark, met_path)

    own = everything.select("doc_id", "text_hash", "uid", "n").join(copies, "uid", "left").withColumn("node", F.coalesce("node", "uid"))
    named = own.join(found, "node", "left").select("doc_id", "text_hash", "uid", "n", F.coalesce("cls", "node").alias("cls"))
    named, named_path = write_table(named, "named")
    for p in (sets_path, copies_path, found_path):
        drop_table(spark, p)
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"]
    least = named.groupBy("cls").agg(F.min("doc_id").alias("component_id"), head.alias("head"))
    done = named.join(least, "cls").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id", "text_hash", (F.col("uid") == F.col("head")).alias("first"))
    done, _ = write_table(done, "joined")
    drop_table(spark, named_path)
    return done
