"""Sizes of integer codecs and the adaptive choice, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the adaptive rule.
TINY_BYTES, LARGE_BYTES = 128, 10240
DEEP_RANGE, FLAT_RANGE = 1000, 10000
DEEP_REPEAT, FLAT_REPEAT = 0.5, 0.3
DICTIONARY_MOST, LITERAL_BYTES, CODE_BYTES = 32767, 16, 2


def width(low: Column, high: Column) -> Column:
    """Bits of an offset in [low, high]: 64 where the range leaves half of the 64-bit integers,
    one where all are equal."""
    span = high.cast("decimal(20,0)") - low.cast("decimal(20,0)")
    half = F.lit((1 << 62)).cast("decimal(20,0)") * 2 - 1
    return F.when(span > F.floor(half / 2), F.lit(64)).otherwise(F.length(F.bin(span.cast("bigint")))).cast("int")


def wrapped(a: Column, b: Column) -> Column:
    """a - b modulo 2**64, as the codecs store differences."""
    d = a.cast("decimal(20,0)") - b.cast("decimal(20,0)")
    whole, half = F.lit(1 << 62).cast("decimal(20,0)") * 4, F.lit(1 << 62).cast("decimal(20,0)") * 2
    return F.when(d >= half, d - whole).when(d < -half, d + whole).otherwise(d).cast("bigint")


def varint_bytes(delta: Column) -> Column:
    """Bytes of a difference as a zigzag varint: one bit more than the difference, or its complement, has."""
    return F.floor((F.length(F.bin(F.when(delta >= 0, delta).otherwise(F.bitwise_not(delta)))) + 7) / 7).cast("bigint")


def adaptive(level: Column, raw_bytes: Column, sequential: Column, key_range: Column, repetition: Column) -> Column:
    """Codec by level: nothing at level 0 and for tiny blocks, fast at 1, by shape below."""
    deep = (
        F.when(sequential, "delta")
        .when(key_range < DEEP_RANGE, "bit_pack")
        .when(repetition > DEEP_REPEAT, "dictionary")
        .otherwise("lz4")
    )
    return (
        F.when(raw_bytes < TINY_BYTES, "none")
        .when(level == 0, "none")
        .when(level == 1, "snappy")
        .when(level == 2, F.when(sequential, "delta").otherwise("snappy"))
        .otherwise(deep)
    )


def adaptive_flat(raw_bytes: Column, sequential: Column, key_range: Column, repetition: Column) -> Column:
    """The rule where no level is known."""
    return (
        F.when(raw_bytes < TINY_BYTES, "none")
        .when(sequential, "delta")
        .when(key_range < FLAT_RANGE, "bit_pack")
        .when(repetition > FLAT_REPEAT, "dictionary")
        .when(raw_bytes > LARGE_BYTES, "lz4")
        .otherwise("snappy")
    )


def for_level(level: Column, own: dict[int, str], first: str, lower: str) -> Column:
    """A level's own codec, else that of level 0 or of the levels below."""
    out = F.when(level == 0, first).otherwise(lower)
    for k, name in own.items():
        out = F.when(level == k, name).otherwise(out)
    return out


def lz4_estimate(raw_bytes: Column) -> Column:
    return F.lit(4) + F.floor(raw_bytes * 3 / 4)
