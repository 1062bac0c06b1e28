"""Block-cache policies replayed over an access trace."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import InvalidInput

#: Score multipliers of priorities, width of expiry buckets in seconds.
PRIORITIES = {"low": 0, "normal": 1, "high": 3, "critical": 5}
TTL_BUCKET = 10
SKETCH_ROWS, SKETCH_LEAST, SKETCH_HALVE, SKETCH_MOST = 4, 16, 10_000, 255


class CachePolicy(Protocol):
    def access(self, key: int, at: int) -> bool:
        """Whether the key was held; afterwards the policy decides what it holds."""


class Lru:
    def __init__(self, capacity: int):
        self.capacity, self.held, self.evicted = capacity, OrderedDict(), 0

    def access(self, key, at):
        hit = key in self.held
        if hit:
            self.held.move_to_end(key)
            return True
        if len(self.held) >= self.capacity:
            self.held.popitem(last=False)
            self.evicted += 1
        self.held[key] = at
        return False


class Frequency:
    """A count-min sketch whose counters are halved as it ages."""

    def __init__(self, capacity: int):
        self.width = max(SKETCH_LEAST, capacity // 4)
        self.rows = [[0] * self.width for _ in range(SKETCH_ROWS)]
        self.added = 0

    def _cells(self, key: int) -> Iterable[tuple[int, int]]:
        for r in range(SKETCH_ROWS):
            yield r, ((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64) >> 17) % self.width

    def add(self, key: int) -> None:
        for r, c in self._cells(key):
            self.rows[r][c] = min(SKETCH_MOST, self.rows[r][c] + 1)
        self.added += 1
        if self.added >= SKETCH_HALVE:
            self.rows = [[v // 2 for v in row] for row in self.rows]
            self.added //= 2

    def estimate(self, key: int) -> int:
        return min(self.rows[r][c] for r, c in self._cells(key))


class TinyLfu(Lru):
    """Recency order, but a newcomer must be more frequent than what it would replace."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.frequency = Frequency(capacity)

    def score(self, key: int) -> float:
        return self.frequency.estimate(key)

    def access(self, key, at):
        self.frequency.add(key)
        if key in self.held:
            self.held.move_to_end(key)
            return True
        if len(self.held) < self.capacity:
            self.held[key] = at
            return False
        victim = next(iter(self.held))
        if self.score(key) > self.score(victim):
            del self.held[victim]
            self.evicted += 1
            self.held[key] = at
        return False


class TinyLfuTtl(TinyLfu):
    """TinyLfu whose entries expire by buckets of TTL_BUCKET seconds."""

    def __init__(self, capacity: int, ttl: int = 600):
        super().__init__(capacity)
        self.ttl, self.expired = ttl, 0

    def access(self, key, at):
        born = self.held.get(key)
        if born is not None and at // TTL_BUCKET >= (born + self.ttl) // TTL_BUCKET:
            del self.held[key]
            self.expired += 1
        return super().access(key, at)


class PriorityLfu(TinyLfu):
    """TinyLfu whose frequencies are multiplied by the key's priority."""

    def __init__(self, capacity: int, priority=lambda key: "normal"):
        super().__init__(capacity)
        self.priority = priority

    def score(self, key):
        return self.frequency.estimate(key) * PRIORITIES[self.priority(key)]


POLICIES = {"lru": Lru, "tinylfu": TinyLfu, "tinylfu_ttl": TinyLfuTtl, "priority_lfu": PriorityLfu}


def make_cache(name: str, capacity: int, **options) -> CachePolicy:
    if name not in POLICIES:
        raise InvalidInput(f"unknown cache policy: {name}")
    return POLICIES[name](capacity, **options)


def simulate(trace: DataFrame, policy: str, capacity: int, shards: int = 16, shard=None, **options) -> DataFrame:
    """(shard, accesses, hits, misses, evictions) of a sharded cache over a trace (seq, key and, for expiry,
    at in seconds); ``shard`` is a column 0..shards-1, a hash of the key if not given. A shard's accesses are replayed in order by one task, in batches; shards share nothing."""

    def run(frames):
        caches: dict[int, CachePolicy] = {}
        counts: dict[int, list[int]] = {}
        for pdf in frames:  # in order of seq within each shard
            for shard, own in pdf.groupby("shard", sort=False):
                cache = caches.setdefault(shard, make_cache(policy, max(1, capacity // shards), **options))
                count = counts.setdefault(shard, [0, 0])
                count[0] += len(own)
                count[1] += sum(cache.access(k, s) for s, k in zip(own["at"].tolist(), own["key"].tolist()))
        rows = [(s, n, h, n - h, caches[s].evicted) for s, (n, h) in counts.items()]
        yield pd.DataFrame(rows, columns=["shard", "accesses", "hits", "misses", "evictions"]).astype({"shard": "int32"})

    where = F.pmod(F.xxhash64("key"), F.lit(shards)) if shard is None else shard
    dealt = trace.select(where.cast("int").alias("shard"), "seq", "key", F.col("at" if "at" in trace.columns else "seq").cast("long").alias("at"))
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "seq").mapInPandas(run, "shard int, accesses long, hits long, misses long, evictions long")


def frequencies(trace: DataFrame) -> DataFrame:
    return trace.groupBy("key").agg(F.count("*").alias("freq"), F.max("seq").alias("last_seq"))


def priority_rank(freq: DataFrame, priority, most: int) -> DataFrame:
    """The ``most`` keys by frequency times priority multiplier; ties by key."""
    factor = F.lit(None)
    for name, m in PRIORITIES.items():
        factor = F.when(priority == name, m).otherwise(factor)
    scored = freq.withColumn("priority", priority).withColumn("score", F.col("freq") * factor)
    return scored.orderBy(F.desc("score"), "key").limit(most)


def ttl_buckets(trace: DataFrame, seconds, ttl: int = 600) -> DataFrame:
    """Entries by the 10-second bucket in which they expire."""
    return trace.groupBy("key").agg(F.max(seconds).alias("born")).groupBy(F.floor((F.col("born") + ttl) / TTL_BUCKET).cast("bigint").alias("bucket")).agg(F.count("*").alias("entries"))
