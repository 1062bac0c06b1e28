"""Fixed-size blocks of key-sorted runs, zone maps and fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import range_join

#: Rows are numbered in cells of about so many rows, if a run's keys are spread evenly.
CELL = 65_536


def number(entries: DataFrame, run: str = "run") -> DataFrame:
    """Adds ``row``, each entry's place in its run by key, without a window over a whole run:
    cells are counted first, and a row's place is that of its cell plus that in the cell. A run's cells
    are as wide as its span and number of rows say, so sparse keys make no more cells than dense ones."""
    wide = lambda c: c.cast("decimal(20,0)")
    shape = entries.groupBy(run).agg(F.min("key").alias("_low"), F.max("key").alias("_high"), F.count("*").alias("_rows"))
    width = F.greatest(F.lit(1).cast("decimal(38,0)"), F.ceil((wide(F.col("_high")) - wide(F.col("_low")) + 1) * CELL / F.col("_rows")).cast("decimal(38,0)"))
    shape = shape.select(run, "_low", width.alias("_width"))
    cell = F.floor((wide(F.col("key")) - wide(F.col("_low"))) / F.col("_width")).cast("bigint")
    e = entries.join(shape, run).withColumn("_cell", cell).drop("_low", "_width")
    counts = e.groupBy(run, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(run).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(run, "_cell", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(run, "_cell").orderBy("key")) - 1
    return e.withColumn("_place", place).join(counts, [run, "_cell"]).withColumn("row", F.col("_before") + F.col("_place")).drop("_cell", "_place", "_before")


def blocks(entries: DataFrame, size: int, run: str = "run") -> DataFrame:
    return number(entries, run).withColumn("block", F.floor(F.col("row") / size).cast("bigint"))


def zone_map(blocked: DataFrame, run: str = "run") -> DataFrame:
    return blocked.groupBy(run, "block").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"))


def load_blocks(blocked: DataFrame, wanted: DataFrame, run: str = "run") -> DataFrame:
    """The entries of the wanted (run, block) rows, once each."""
    return blocked.join(wanted.select(run, "block").distinct(), [run, "block"], "left_semi")


def find_points(zones: DataFrame, probes: DataFrame, run: str = "run") -> DataFrame:
    """(key, run, block) of each block that may hold a probe's key."""
    z = zones.select(run, "block", F.col("min_key").alias("start"), F.col("max_key").alias("end"))
    return range_join(z, probes.select("key"), closed=True).select("key", run, "block")


def find_ranges(zones: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks that may hold keys of [start, end); none where start >= end."""
    return zones.where(F.lit(start < end) & (F.col("min_key") < end) & (F.col("max_key") >= start))


def guide(zones: DataFrame, ratio: int = 10, run: str = "run") -> DataFrame:
    """A sparse level over a zone map: one row for each ``ratio`` blocks."""
    ratio = max(2, ratio)
    return zones.groupBy(run, F.floor(F.col("block") / ratio).cast("bigint").alias("guide")).agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.count("*").alias("blocks"))


def find_in_two(zones: DataFrame, key: int, ratio: int = 10, run: str = "run") -> DataFrame:
    """Blocks that may hold a key, found through the guide."""
    holds = (F.col("min_key") <= key) & (F.col("max_key") >= key)
    g = guide(zones, ratio, run).where(holds).select(run, "guide")
    return zones.withColumn("guide", F.floor(F.col("block") / max(2, ratio)).cast("bigint")).where(holds).join(g, [run, "guide"], "left_semi")


def prefix_groups(keys: DataFrame, key: str = "key", bits: int = 32) -> DataFrame:
    """Keys grouped by their upper bits, which are stored once: (prefix, n, min_suffix, max_suffix)."""
    low = (1 << bits) - 1
    suffix = F.col(key).bitwiseAND(F.lit(low))
    return keys.groupBy(F.call_function("shiftright", F.col(key), F.lit(bits)).alias("prefix")).agg(F.count("*").alias("n"), F.min(suffix).alias("min_suffix"), F.max(suffix).alias("max_suffix"))


def join_prefix(prefix: Column, suffix: Column, bits: int = 32) -> Column:
    return F.call_function("shiftleft", prefix, F.lit(bits)).bitwiseOR(suffix)
