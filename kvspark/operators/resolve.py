"""Last-writer-wins resolution of mutation logs and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mutations of one key are ordered in chunks of so many sequence numbers, so that a key which
#: holds much of the log is worked on by many tasks.
CHUNK = 1_000_000


def entries(log: DataFrame) -> DataFrame:
    """Puts and deletes as versioned entries (key, value, dead, seq)."""
    dead = F.col("op") == "d"
    return log.where(F.col("op").isin("p", "d")).select("key", F.when(~dead, F.col("value")).alias("value"), dead.alias("dead"), "seq")


def merge(*runs: DataFrame) -> DataFrame:
    """The newest entry of each key; tombstones stay. Fixed-width maxima aggregate by hash and
    before the shuffle, so a hot key costs one row a task."""
    every = reduce(DataFrame.unionByName, [r.select("key", "value", "dead", "seq") for r in runs])
    return every.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max_by("dead", "seq").alias("dead"), F.max("seq").alias("seq"))


def image(*runs: DataFrame) -> DataFrame:
    """Live keys: resolve first, drop tombstones after."""
    return merge(*runs).where(~F.col("dead")).select("key", "value", "seq")


def as_of(points: DataFrame, log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``points`` (seq, key, ...) with ``live`` and ``value`` of their key just before seq.

    Points and mutations meet in one window per key and chunk of the log; what a chunk starts
    from comes from the last mutation of the earlier chunks, aggregated first. A point that is a
    mutation itself shares its seq with it, so the frame ends before seq, not before the row."""
    extra = [c for c in points.columns if c not in ("seq", "key")]
    part = F.floor(F.col("seq") / chunk).cast("bigint")
    muts = entries(log).withColumn("part", part)
    last = muts.groupBy("key", "part").agg(F.max_by("value", "seq").alias("value"), F.max_by("dead", "seq").alias("dead"))
    state = F.struct(F.col("dead").alias("dead"), F.col("value").alias("value"))
    # a struct is not null for a delete, so the newest mutation is found even if it has no value
    both = points.select(F.col("seq"), F.col("key"), part.alias("part"), F.lit(None).cast("struct<dead:boolean,value:bigint>").alias("m"), F.struct(F.lit(True).alias("is_point"), *extra).alias("p"))
    rows = both.unionByName(muts.select("seq", "key", "part", state.alias("m")), allowMissingColumns=True)
    near = Window.partitionBy("key", "part").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("found", F.last("m", ignorenulls=True).over(near)).where("p.is_point")
    earlier = Window.partitionBy("key").orderBy("part")
    carry = last.select("key", "part", state.alias("m"))
    # a chunk's start: the last mutation of any earlier chunk of the key
    starts = found.where("found is null").select("key", "part").distinct().select("key", "part", F.lit(None).cast("struct<dead:boolean,value:bigint>").alias("m"))
    carry = carry.unionByName(starts).groupBy("key", "part").agg(F.max("m").alias("m")).withColumn("before", F.last("m", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.join(carry.select("key", "part", "before"), ["key", "part"], "left")
    m = F.coalesce("found", "before")
    return found.select("seq", "key", *(F.col(f"p.{c}").alias(c) for c in extra), F.coalesce(~m["dead"], F.lit(False)).alias("live"), F.when(~m["dead"], m["value"]).alias("value"))


def versions(log: DataFrame) -> DataFrame:
    """Each version's life: visible at t if it is a put and lo < t < hi."""
    w = Window.partitionBy("key").orderBy("seq")
    return entries(log).select("key", "value", "dead", F.col("seq").alias("lo"), F.coalesce(F.lead("seq").over(w), F.lit((1 << 63) - 1)).alias("hi"))


def previous(log: DataFrame) -> DataFrame:
    """What each put replaced: the live value of its key just before, or null."""
    puts = log.where("op = 'p'").select("seq", "key", F.col("value").alias("new_value"))
    found = as_of(puts, log)
    return found.select("seq", "key", F.col("new_value").alias("value"), F.col("value").alias("previous"))


def chunk_of(seq: Column, size: int) -> Column:
    return F.floor(seq / size).cast("bigint")
