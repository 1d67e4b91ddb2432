"""A digest of a set of rows that can be added to and taken from.

Each row's SHA-256 is eight numbers of 32 bits; the digest of a set with repeats is their sums, each modulo 2**32, and
the count.  So it is the same in any order, of two sets together it is the sum, and a batch of changes needs what it adds
and what it replaces, nothing else.  It tells changed stores from unchanged ones; it is no proof against forgery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS, MODULUS = 8, 1 << 32
#: Parts that are summed on their own before the modulus, so that 64 bits hold the sums of 2**31 rows each.
PARTS = 1024


def row_digest(*columns: str) -> Column:
    """64 hexadecimal digits; a null is no empty string, and no column runs into the next."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def _limb(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: n, limbs."""
    h = rows.select(row_digest(*columns).alias("h"))
    # no row leaves its task before it is summed; the parts only bound the sums
    sums = h.groupBy(F.pmod(F.crc32("h"), F.lit(PARTS)).alias("part")).agg(F.count(F.lit(1)).alias("n"), *[F.pmod(F.sum(_limb(F.col("h"), i)), F.lit(MODULUS)).alias(f"l{i}") for i in range(LIMBS)])
    zero = F.lit(0).cast("long")
    return sums.agg(F.coalesce(F.sum("n"), zero).alias("n"), F.array(*[F.pmod(F.coalesce(F.sum(f"l{i}"), zero), F.lit(MODULUS)) for i in range(LIMBS)]).alias("limbs"))


def value(one: DataFrame) -> list[int]:
    """A digest as numbers: n and the limbs."""
    r = one.first()
    return [r.n, *r.limbs]


def added(a: list[int], b: list[int], times: int = 1) -> list[int]:
    """The digest of two sets together; with times -1, of the first without the second."""
    return [a[0] + times * b[0], *((x + times * y) % MODULUS for x, y in zip(a[1:], b[1:], strict=True))]


def text(d: list[int]) -> str:
    return "".join(f"{x:08x}" for x in d[1:])


NONE = [0] * (LIMBS + 1)
