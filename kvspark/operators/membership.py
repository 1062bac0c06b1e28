"""Membership filters: portable Bloom filters as tables, JVM sketches, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column

from ..functions import bloom
from ..functions.bloom import positions
from ..schema import InvalidInput


def build(keys: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """The set bits of a filter: at most ``bits`` rows, whatever the number of keys."""
    return keys.select(F.explode(F.array(*positions(F.col(key), bits))).alias("bit")).distinct()


def sized(runs: DataFrame, level: str = "level", run: str = "run") -> DataFrame:
    """(level, run, n, bits_per_entry, hashes, bits) of the filters of some runs, by the level-aware rule."""
    n = runs.groupBy(level, run).agg(F.count("*").alias("n"))
    per = bloom.level_bits(F.col(level))
    return n.select(level, run, "n", per.alias("bits_per_entry"), bloom.hashes_for(per).alias("hashes"), bloom.block_bits(F.col("n"), per).alias("bits"))


def run_filters(runs: DataFrame, variant: str = "standard") -> DataFrame:
    """(run, bit): the set bits of each run's filter."""
    if variant not in bloom.VARIANTS:
        raise InvalidInput(f"unknown filter: {variant}")
    at = bloom.VARIANTS[variant](F.col("key"), F.col("bits"), F.col("hashes"))
    return runs.select("level", "run", "key").join(F.broadcast(sized(runs)), ["level", "run"]).select("level", "run", F.explode(at).alias("bit")).distinct()


def run_statistics(runs: DataFrame, keys: DataFrame, variant: str = "standard") -> DataFrame:
    """Per run: checks, positives and false positives of asking its filter for each row of ``keys``
    (key), with the filter's size and theoretical rate. Keys are aggregated first; one row of ``sized`` for
    each run is broadcast to them."""
    asked = keys.groupBy("key").agg(F.count("*").alias("times"))
    size = sized(runs)
    at = bloom.VARIANTS[variant](F.col("key"), F.col("bits"), F.col("hashes"))
    filters = size.agg(F.collect_list(F.struct("level", "run", "bits", "hashes")).alias("filters"))
    every = asked.withColumn("one", F.lit(1)).join(F.broadcast(filters.withColumn("one", F.lit(1))), "one").select("key", "times", F.explode("filters").alias("f")).select("key", "times", "f.*")
    bits = every.select("level", "run", "key", "times", F.explode(F.array_distinct(at)).alias("bit"))
    set_bits = run_filters(runs, variant).withColumn("set", F.lit(1))
    told = bits.join(set_bits, ["level", "run", "bit"], "left").groupBy("level", "run", "key").agg(F.first("times").alias("times"), (F.count("*") == F.count("set")).alias("may"))
    held = runs.select("level", "run", "key", F.lit(True).alias("held"))
    told = told.join(held, ["level", "run", "key"], "left")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("times"))), F.lit(0))
    out = told.groupBy("level", "run").agg(F.sum("times").alias("checks"), n(F.col("may")).alias("positives"), n(F.col("may") & F.col("held").isNull()).alias("false_positives"), n(~F.col("may") & F.col("held").isNotNull()).alias("false_negatives"))
    return out.join(size, ["level", "run"]).withColumn("theoretical_fp", bloom.theoretical_fp(F.col("n"), F.col("bits"), F.col("hashes")))


#: Filters of up to so many bits are a constant of the plan; larger ones are joined.
CONSTANT_BITS = 1 << 18


def probe(keys: DataFrame, filter_bits: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """Adds ``may_contain``. A small filter becomes a constant array of words, so that probing is
    one expression; a large one is joined bit by bit."""
    where = positions(F.col(key), bits)
    if bits > CONSTANT_BITS:
        numbered = keys.withColumn("_row", F.monotonically_increasing_id()).persist()
        asked = numbered.select("_row", F.explode(F.array_distinct(F.array(*where))).alias("bit"))
        missing = asked.join(filter_bits, "bit", "left_anti").select("_row").distinct().withColumn("_missing", F.lit(True))
        return numbered.join(missing, "_row", "left").withColumn("may_contain", F.col("_missing").isNull()).drop("_row", "_missing")
    packed = filter_bits.groupBy(F.floor(F.col("bit") / 32).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 32).cast("int"))).alias("m"))
    words = dict(packed.collect())
    table = F.lit([int(words.get(i, 0)) for i in range(-(-bits // 32))]).cast("array<bigint>")
    ok = F.lit(True)
    for p in where:
        word = F.get(table, F.floor(p / 32).cast("int"))
        ok = ok & (F.lit(1).cast("bigint").bitwiseAND(F.call_function("shiftright", word, (p % 32).cast("int"))) == 1)
    return keys.withColumn("may_contain", ok)


def sketch(df: DataFrame, col: str, expected: int, rate: float):
    """Spark's own Bloom filter sketch, merged map-side on the executors."""
    return df._jdf.stat().bloomFilter(col, expected, rate)


def missed(df: DataFrame, made, col: str) -> int:
    """How many rows with a value in the long column ``col`` the sketch denies, counted on the executors."""
    out = df.sparkSession._jvm.java.io.ByteArrayOutputStream()
    made.writeTo(out)
    jvm = df.sparkSession._jvm.org.apache.spark.sql
    bits, value = (jvm.classic.ExpressionUtils.expression(c._jc) for c in (F.lit(bytes(out.toByteArray())), F.col(col)))
    kept = Column(jvm.classic.ExpressionUtils.column(jvm.catalyst.expressions.BloomFilterMightContain(bits, value)))
    return df.where(~kept).count()


def rates(probed: DataFrame, present: DataFrame, key: str = "key") -> DataFrame:
    """checks, positives, false_positives and the false-positive rate among absent keys."""
    known = present.select(F.col(key), F.lit(True).alias("present")).distinct()
    j = probed.join(known, key, "left")
    absent = F.col("present").isNull()
    c = j.agg(F.count("*").alias("checks"), F.count_if("may_contain").alias("positives"), F.count_if(F.col("may_contain") & absent).alias("false_positives"), F.count_if(~F.col("may_contain") & ~absent).alias("false_negatives"))
    return c.withColumn("observed_fp", F.coalesce(F.try_divide(F.col("false_positives").cast("double"), F.col("positives").cast("double")), F.lit(0.0)))


def summary(stats: DataFrame) -> DataFrame:
    """Per level and in total (level null): sums, unweighted means of bits and theoretical rate,
    and false positives over positives, 0 without positives."""
    out = stats.rollup("level").agg(F.count("*").alias("runs"), F.sum("checks").alias("checks"), F.sum("positives").alias("positives"), F.sum("false_positives").alias("false_positives"), F.avg("bits_per_entry").alias("bits_per_entry"), F.avg("theoretical_fp").alias("theoretical_fp"))
    return out.withColumn("observed_fp", F.coalesce(F.try_divide(F.col("false_positives").cast("double"), F.col("positives").cast("double")), F.lit(0.0)))
