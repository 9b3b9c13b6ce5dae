"""Sharding by a permutation-filled lookup table.

Each shard orders the slots of a table of prime size by (offset + i * skip) of its own; the shards take turns claiming
their next free slot until the table is full.  Shares differ by at most one slot, and when a shard leaves, few keys of
the others move.  A key's slot is its hash modulo the prime, so its shard is one look-up.

Null keys share one slot; equal keys share a shard.  The table has ``size`` rows whatever the data, so it is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = 65537) -> list[int]:
    """Index of the shard that owns each slot."""
    if not _prime(size) or len(set(shards)) != len(shards) or not 0 < len(shards) < size:
        raise ValueError("the table's size must be a prime above the number of distinct shards")
    state = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        state.append([int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1])
    table, left = [-1] * size, size
    while left:
        for shard, own in enumerate(state):
            while table[own[0]] >= 0:
                own[0] = (own[0] + own[1]) % size
            table[own[0]] = shard
            left -= 1
            if not left:
                break
    return table


def assign(df, key, shards: list[str], size: int = 65537):
    """``df`` with its rows' ``slot`` and ``shard`` (a name of ``shards``); columns of these names are replaced."""
    spark = df.sparkSession
    table = spark.createDataFrame([(slot, shards[s]) for slot, s in enumerate(lookup_table(shards, size))], "slot int, shard string")
    df = df.drop("shard").withColumn("slot", F.pmod(F.xxhash64(key), F.lit(size)).cast("int"))
    return df.join(F.broadcast(table), "slot").select(*[c for c in df.columns if c != "slot"], "slot", "shard")
