"""Buckets from whole SHA-256 digests: the 256-bit number modulo the number of buckets, by Horner's rule over eight limbs."""

from pyspark.sql import Column, functions as F


def canonical_strings(fields: dict[str, Column]) -> Column:
    """Canonical JSON of an object of strings: keys sorted, JSON escapes.  Strings without anything to escape are only quoted."""
    parts = []
    for k in sorted(fields):
        quoted = F.regexp_replace(F.to_json(F.struct(fields[k].alias("x"))), r'^\{"x":|\}$', "")
        plain = ~F.rlike(fields[k], F.lit(r'["\\\x00-\x1f]'))
        parts.append(F.concat(F.lit(f'"{k}":'), F.when(plain, F.concat(F.lit('"'), fields[k], F.lit('"'))).otherwise(quoted)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def domain_digest(domain: str, value: Column) -> Column:
    """Hex SHA-256 of the canonical JSON of {domain, value}."""
    return F.sha2(F.concat(F.lit(f'{{"domain":"{domain}","value":'), value, F.lit("}")), 256)


def modulo(hex_digest: Column, n: int) -> Column:
    """The whole digest, as an unsigned number, modulo n (below 2^31)."""
    base = (1 << 32) % n

    def rest(digest: Column) -> Column:
        acc = F.lit(0).cast("bigint")
        for i in range(8):
            limb = F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("bigint")
            acc = F.pmod(acc * F.lit(base) + F.pmod(limb, F.lit(n)), F.lit(n))
        return acc

    return F.get(F.transform(F.array(hex_digest), rest), F.lit(0))  # bound once: a filter would work the digest out for every limb


def group_bucket(domain: str, algorithm: str, seed: str, group: Column, n: int) -> Column:
    return modulo(domain_digest(domain, canonical_strings({"algorithm": F.lit(algorithm), "groupId": group, "seed": F.lit(seed)})), n)


def window_bucket(domain: str, algorithm: str, seed: str, case: Column, replicate: Column) -> Column:
    """Bucket in basis points of a (case, replicate)."""
    return modulo(domain_digest(domain, canonical_strings({"algorithm": F.lit(algorithm), "caseId": case, "replicateId": replicate, "seed": F.lit(seed)})), 10_000)
