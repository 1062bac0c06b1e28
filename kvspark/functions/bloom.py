"""Bloom filter arithmetic that Spark and any SQL engine compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the two position hashes, all modulo PRIME.
PRIME = 2147483647
HASHES = ((1103515245, 12345), (69069, 1))

#: Fixed values of the level-aware sizing rule.
L0_BITS, LEAST_BITS, LEAST_HASHES, MOST_HASHES = 32, 2, 1, 10
#: Target false-positive rates of the dynamic sizing rule, by level; the last holds beyond.
TARGET_RATES = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)
DYNAMIC_LEAST, DYNAMIC_MOST = 2.0, 32.0
BLOCK_BITS = 512


def positions(key: Column, bits: int) -> list[Column]:
    """The bits of a key. Products stay below 2**63; negative keys are normalised first."""
    k = (key % PRIME + PRIME) % PRIME
    return [(k * a + b) % PRIME % bits for a, b in HASHES]


def probes(key: Column, bits: Column, hashes: Column) -> Column:
    """As many bits of a key as ``hashes`` says, an array: the first position hash and multiples of the second."""
    k = (key % PRIME + PRIME) % PRIME
    first, step = ((k * a + b) % PRIME for a, b in HASHES)
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: (first + i * step) % PRIME % bits)


def blocked_probes(key: Column, bits: Column, hashes: Column) -> Column:
    """The same within one block of BLOCK_BITS bits, which the first hash chooses: one cache line a key."""
    k = (key % PRIME + PRIME) % PRIME
    first, step = ((k * a + b) % PRIME for a, b in HASHES)
    block = first % F.floor(bits / BLOCK_BITS).cast("bigint")
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: block * BLOCK_BITS + (step + i * (1 + first % (BLOCK_BITS - 1))) % BLOCK_BITS)


#: Filters by name.
VARIANTS = {"standard": probes, "blocked": blocked_probes}


def level_bits(level: Column, fanout: int = 4) -> Column:
    """Bits for each entry by level: fewer the deeper, at least LEAST_BITS."""
    return F.greatest(F.lit(float(L0_BITS)) / F.pow(F.lit(float(fanout)), level / F.lit(2.0)), F.lit(float(LEAST_BITS)))


def hashes_for(bits: Column) -> Column:
    return F.least(F.greatest(F.round(F.lit(0.6931471805599453) * bits), F.lit(float(LEAST_HASHES))), F.lit(float(MOST_HASHES))).cast("int")


def dynamic_bits(level: Column, least: float = DYNAMIC_LEAST, most: float = DYNAMIC_MOST) -> Column:
    rates = F.array(*map(F.lit, TARGET_RATES))
    rate = F.element_at(rates, F.least(level, F.lit(len(TARGET_RATES) - 1)).cast("int") + 1)
    return F.least(F.greatest(-F.log2(rate) / F.lit(0.6931471805599453), F.lit(least)), F.lit(most))


def block_bits(entries: Column, bits_per_entry: Column) -> Column:
    """Whole blocks, a power of two of them: the size that is really allocated."""
    blocks = F.ceil(entries * bits_per_entry / BLOCK_BITS)
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(blocks, F.lit(1)).cast("double")))).cast("bigint") * BLOCK_BITS


def theoretical_fp(keys: Column, bits: Column, hashes: Column) -> Column:
    return F.pow(1 - F.exp(-hashes * keys / bits.cast("double")), hashes)


def quick_fp(bits_per_key: Column) -> Column:
    """The estimate for six probes at a load factor of 0.7."""
    return F.pow(1 - F.exp(-0.7 * bits_per_key), F.lit(6.0))
