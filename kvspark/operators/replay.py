"""Replay of a log: what every get, range and delete saw at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import range_join
from .resolve import as_of


def gets(log: DataFrame) -> DataFrame:
    """(seq, key, live, value) of each get."""
    return as_of(log.where("op = 'g'").select("seq", "key"), log)


def deletes(log: DataFrame) -> DataFrame:
    """(seq, key, succeeded): a delete succeeds if its key was live."""
    return as_of(log.where("op = 'd'").select("seq", "key"), log).select("seq", "key", F.col("live").alias("succeeded"))


def ranges(log: DataFrame) -> DataFrame:
    """(seq, key, value) of each range's live keys at its time.

    Ranges meet the distinct keys, not their versions; each (range, key) is then a point in
    time like a get. Work follows the output, however often keys change."""
    wanted = log.where("op = 'r'").select("seq", F.col("key").alias("start"), F.col("key_end").alias("end"))
    keys = log.where("op = 'p'").select("key").distinct()
    points = range_join(wanted, keys).select("seq", "key")
    return as_of(points, log).where("live").select("seq", "key", "value")


def report(log: DataFrame, loads: int = 0) -> DataFrame:
    """One row of counters over the whole log."""
    g = gets(log).agg(F.count_if("live").alias("successful_gets"), F.count_if(~F.col("live")).alias("failed_gets"))
    d = deletes(log).agg(F.count_if("succeeded").alias("successful_dels"), F.count_if(~F.col("succeeded")).alias("failed_dels"))
    sizes = ranges(log).groupBy("seq").agg(F.count("*").alias("n"))
    r = sizes.agg(F.count("*").alias("non_empty_ranges"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest_range"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_range"))
    ops = log.agg(F.count_if(F.col("op") == "p").alias("puts"), F.count_if(F.col("op") == "r").alias("ranges"))
    # single rows: the joins have one row on either side
    one = [x.withColumn("one", F.lit(1)) for x in (ops, g, r, d)]
    out = one[0]
    for x in one[1:]:
        out = out.join(x, "one")
    return out.select("puts", "successful_gets", "failed_gets", "ranges", "non_empty_ranges", "smallest_range", "largest_range", "successful_dels", "failed_dels", F.lit(loads).cast("bigint").alias("loads"))
