"""Checksums of binary columns.  CRC-32 is Spark's own ``crc32``; XXH64 with seed 42 its ``xxhash64``.

Those that are expressions fold over the bytes and suit short values; XXH64 of any seed is Arrow-batched.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reflected polynomials, fixed values of the checksums: Castagnoli's, and that of ECMA-182.
CRC32C, CRC64 = 0x82F63B78, 0xC96C5795D7870F42


def _bytes(x: Column) -> Column:
    """The bytes as an array of longs; none for an empty value."""
    pairs = F.regexp_extract_all(F.hex(x.cast("binary")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))


def _reflected(x: Column, polynomial: int, ones: int) -> Column:
    signed = polynomial - (1 << 64) if polynomial >> 63 else polynomial
    start = F.lit(ones - (1 << 64) if ones >> 63 else ones).cast("long")
    bit = lambda c, _: F.shiftrightunsigned(c, 1).bitwiseXOR(F.lit(signed).cast("long") * c.bitwiseAND(F.lit(1).cast("long")))
    eight = F.array_repeat(F.lit(0), 8)
    return F.aggregate(_bytes(x), start, lambda c, b: F.aggregate(eight, c.bitwiseXOR(b), bit), lambda c: c.bitwiseXOR(start))


def crc32c(x: Column) -> Column:
    return _reflected(x, CRC32C, (1 << 32) - 1)


def crc64(x: Column) -> Column:
    """As a signed long."""
    return _reflected(x, CRC64, (1 << 64) - 1)


def adler32(x: Column) -> Column:
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def step(s: Column, b: Column) -> Column:
        a = (s["a"] + b) % 65521
        return F.struct(a.alias("a"), ((s["b"] + a) % 65521).alias("b"))

    return F.aggregate(_bytes(x), F.struct(one.alias("a"), zero.alias("b")), step, lambda s: F.shiftleft(s["b"], 16).bitwiseOR(s["a"]))


def xxh64(x: Column, seed: int = 0) -> Column:
    """Unsigned, as a decimal: a long can't hold it."""

    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: str(xxhash.xxh64_intdigest(v, seed)), na_action="ignore")

    return hashed(x.cast("binary")).cast("decimal(20,0)")
