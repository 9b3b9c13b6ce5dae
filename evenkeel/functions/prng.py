"""Mulberry32 as column expressions: draw n depends on the seed and n alone, so draws need no order."""

from pyspark.sql import Column, functions as F

_M = 0xFFFFFFFF


def _mul32(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(65535)) * b
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(65535)), 16)
    return (low + high).bitwiseAND(F.lit(_M))


def draw(n: Column, seed: int) -> Column:
    """The n-th (from 0) uniform double in [0, 1) of the generator seeded with ``seed`` (32 bits)."""
    s = (F.lit(seed) + F.pmod(n + 1, F.lit(1 << 32)) * F.lit(1831565813).cast("decimal(38,0)")).cast("decimal(38,0)")
    t = F.pmod(s, F.lit(1 << 32).cast("decimal(38,0)")).cast("bigint")
    t = _mul32(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1).cast("bigint")))
    u = t.bitwiseXOR((t + _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("bigint")))).bitwiseAND(F.lit(_M)))
    return u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(4294967296.0)


def seed_of(text_digest: Column) -> Column:
    """Seed from a hex digest: the whole number modulo 2^32, which is its last eight digits."""
    return F.conv(F.right(text_digest, F.lit(8)), 16, 10).cast("bigint")
