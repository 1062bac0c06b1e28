"""Point, batch and half-open range lookups over a resolved image."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.commands import reply

#: So many ranges are broadcast at most; the points, of which each makes a row a size, never are.
BROADCAST_RANGES = 50_000


def get(spark: SparkSession, image: DataFrame, key: int) -> DataFrame:
    """One row (key, value); value is null on a miss. The key reaches the scan as a filter."""
    one = spark.range(1).select(F.lit(key).cast("long").alias("key"))
    return one.join(image.where(F.col("key") == key).select("key", "value"), "key", "left")


def multi_get(image: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) for each row of ``keys``."""
    return keys.select("key").join(image.select("key", "value"), "key", "left")


def scan(image: DataFrame, start: int, end: int) -> DataFrame:
    """Live pairs of [start, end) in key order; empty where start >= end."""
    return image.where((F.col("key") >= start) & (F.col("key") < end)).select("key", "value").orderBy("key")


def range_join(ranges: DataFrame, points: DataFrame, point: str = "key", start: str = "start", end: str = "end", closed: bool = False) -> DataFrame:
    """Inner join on start <= point < end, or start <= point <= end if ``closed``, as an equi-join.

    A range of length n takes the aligned cells of the least power of two >= n: at most two.
    Points take their cell at each of the sizes in use (at most 64). So neither a long range nor
    many ranges make a nested loop, and each pair meets in exactly one cell. Lengths are exact for
    all 64-bit bounds: of the longest ranges, up to 2**64, the cells are the two signs.

    Spark takes the points for as small as they are before they get a row a size, so how they join is
    not left to it: few ranges are broadcast, else both sides are shuffled."""
    last = F.col(end) if closed else F.col(end) - 1
    r = ranges.where(F.col(start) <= F.col(end) if closed else F.col(start) < F.col(end)).withColumn("_last", last)
    steps = F.col("_last").cast("decimal(20,0)") - F.col(start).cast("decimal(20,0)")
    size = F.when(steps == 0, 0).when(steps > F.lit((1 << 63) - 1).cast("decimal(20,0)"), 63).otherwise(F.length(F.bin(steps.cast("bigint")))).cast("int")
    r = r.withColumn("_size", size)
    counts = dict(map(tuple, r.groupBy("_size").count().collect()))
    sizes = sorted(counts)
    cell = lambda c: F.call_function("shiftright", c, F.col("_size"))
    r = r.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col(start)), cell(F.col("_last"))))))
    p = points.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"))).withColumn("_cell", cell(F.col(point)))
    r, p = (F.broadcast(r), p) if sum(counts.values()) <= BROADCAST_RANGES else (r, p.hint("merge"))
    return r.join(p, ["_size", "_cell"]).where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col("_last"))).drop("_size", "_cell", "_last")


def range_batch(image: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, key, value) of every range of ``ranges`` (id, start, end)."""
    return range_join(ranges, image.select("key", "value")).select("id", "key", "value")


def _dealt(cuts: np.ndarray):
    def deal(batches):
        for b in batches:
            part = np.searchsorted(cuts, b.column("at").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    return deal


def range_counts(image: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, n, low, high) of every range of ``ranges`` (id, start, end) that holds keys: how many, the
    first and the last.

    Each distinct key or bound learns how many keys are below it and which are next to it, in parts of
    the sorted values with what the other parts add. Work follows keys and ranges, not their pairs."""
    ends = ranges.where(F.col("start") < F.col("end")).select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    bounds = ends.withColumn("at", F.explode(F.array("start", "end")))
    keys = image.where(F.col("key").isNotNull()).select(F.col("key").cast("long").alias("at"), F.lit(1).cast("bigint").alias("c"), F.lit(False).alias("asked"))
    values = keys.unionAll(bounds.select("at", F.lit(0).cast("bigint"), F.lit(True)))
    parts = int(image.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # where the parts begin decides only how even they are
    cuts = values.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)])).first()[0] if parts > 1 else None
    rows = values.groupBy("at").agg(F.sum("c").alias("c"), F.bool_or("asked").alias("asked"))
    rows = rows.mapInArrow(_dealt(np.unique(np.array(cuts or [], np.int64))), "at long, c long, asked boolean, part int").withColumn("key", F.when(F.col("c") > 0, F.col("at")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    up, down = (Window.partitionBy("part").orderBy(o) for o in (F.col("at"), F.col("at").desc()))
    seen = rows.select("part", "at", "asked", F.sum("c").over(before(up)).alias("below"), F.last("key", True).over(before(up)).alias("prev"), F.last("key", True).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("next"))
    # a row a part
    totals = rows.groupBy("part").agg(F.sum("c").alias("c"), F.min("key").alias("first"), F.max("key").alias("last"))
    up, down = Window.orderBy("part"), Window.orderBy(F.col("part").desc())
    carried = totals.select("part", F.sum("c").over(before(up)).alias("c"), F.last("last", True).over(before(up)).alias("last"), F.last("first", True).over(before(down)).alias("first"))
    found = seen.where("asked").join(F.broadcast(carried), "part").select("at", (F.coalesce("below", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("below"), F.coalesce("prev", "last").alias("prev"), F.coalesce("next", "first").alias("next"))
    starts = F.col("at") == F.col("start")
    each = bounds.join(found, "at").groupBy("id", "start", "end").agg(F.sum(F.when(starts, -F.col("below")).otherwise(F.col("below"))).alias("n"), F.max(F.when(starts, F.col("next"))).alias("low"), F.max(F.when(~starts, F.col("prev"))).alias("high"))
    return each.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def range_replies(image: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, n, reply) of every range, empty ones with an empty reply."""
    found = range_batch(image, ranges).groupBy("id").agg(F.count("*").alias("n"), reply(F.collect_list(F.struct("key", "value"))).alias("reply"))
    return ranges.select("id").join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("reply", F.lit("")).alias("reply"))
