"""Data model: mutation logs, runs, manifests, configuration and errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: A put of this value is a delete.
TOMBSTONE = -(1 << 63)
ENTRY_BYTES, PAGE_BYTES = 16, 4096

#: seq is the arrival order: unique, and the only notion of recency. op is p, g, r or d.
MUTATIONS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("key", T.LongType()),
    T.StructField("value", T.LongType()),
    T.StructField("key_end", T.LongType()),
])

ENTRIES = T.StructType([
    T.StructField("key", T.LongType()),
    T.StructField("value", T.LongType()),
    T.StructField("dead", T.BooleanType()),
    T.StructField("seq", T.LongType()),
])

MANIFEST = T.StructType([
    T.StructField("level", T.IntegerType()),
    T.StructField("run_seq", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("min_key", T.LongType()),
    T.StructField("max_key", T.LongType()),
    T.StructField("entries", T.LongType()),
    T.StructField("tombstones", T.LongType()),
    T.StructField("blocks", T.LongType()),
    T.StructField("max_seq", T.LongType()),
])


class StoreError(Exception):
    """Base of the library's errors."""


class InvalidInput(StoreError, ValueError):
    """A command, option or name that is not known or not well formed."""


class InvalidRange(StoreError, ValueError):
    """A range whose bounds are not integers."""


class KeyNotFound(StoreError, KeyError):
    """Raised only where a caller asks for a value that must exist."""


class CorruptRun(StoreError):
    """A run's files disagree with its manifest row."""


#: Formats of run files by name; both are columnar and keep minima, maxima and Bloom filters of keys.
STORAGES = ("parquet", "orc")


@dataclass(frozen=True)
class StoreConfig:
    """Options of a store; defaults are those users of such a store expect."""

    buffer_pages: int = 128
    fanout: int = 4
    policy: str = "tiered"
    threshold: int = 4
    max_runs: int = 3
    selection: str = "oldest"
    block_entries: int = 256
    adaptive_codec: bool = True
    l0_codec: str = "none"
    lower_codec: str = "snappy"
    level_codecs: dict[int, str] = field(default_factory=dict)
    #: Format of run files, a name of STORAGES.
    storage: str = "parquet"

    @property
    def buffer_entries(self) -> int:
        return self.buffer_pages * PAGE_BYTES // ENTRY_BYTES


def run_name(level: int, run_seq: int) -> str:
    return f"L{level:02d}_R{run_seq:010d}"
