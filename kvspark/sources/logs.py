"""Sources of mutation logs: command text, packed integer pairs, sockets and tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.commands import parse
from ..schema import TOMBSTONE


def commands(lines: DataFrame, line: str = "value", seq: str | None = None) -> DataFrame:
    """(seq, line, op, key, value, key_end, path, valid) of lines of command text. Without a
    ``seq`` column lines are numbered in the order of their partitions."""
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    out = lines.select(order.cast("long").alias("seq"), F.col(line).alias("line"), parse(F.col(line)).alias("c"))
    return out.select("seq", "line", "c.*")


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    return commands(spark.read.text(path))


def stream_commands(spark: SparkSession, path: str) -> DataFrame:
    """Files of command text as they arrive."""
    return commands(spark.readStream.text(path))


def socket_commands(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP server, for demonstration; sockets can't be replayed after a failure."""
    return commands(spark.readStream.format("socket").option("host", host).option("port", port).load())


def mutations(parsed: DataFrame) -> DataFrame:
    """Valid keyed commands as a mutation log; a put of the tombstone value is a delete."""
    keyed = parsed.where(F.col("valid") & F.col("op").isin("p", "g", "r", "d"))
    dead = (F.col("op") == "p") & (F.col("value") == TOMBSTONE)
    return keyed.select("seq", F.when(dead, "d").otherwise(F.col("op")).alias("op"), "key", F.when(~dead, F.col("value")).alias("value"), "key_end")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("valid")).select("seq", "line")


def load_report(parsed: DataFrame) -> DataFrame:
    """loaded, failed and the reply of a bulk load: puts and deletes count, all else fails."""
    ok = F.coalesce(F.col("op").isin("p", "d"), F.lit(False))
    counts = parsed.agg(F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("failed"))
    return counts.withColumn("reply", F.format_string("Loaded %d commands from file (%d failed)", "loaded", "failed"))


def _pairs(batches):
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            x = np.frombuffer(content.as_buffer(), "<i4")
            x = x[: len(x) // 2 * 2].reshape(-1, 2)
            n = len(x)
            cols = [pa.array([path] * n, pa.string()), pa.array(np.arange(n)), pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["path", "position", "key", "value"])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, key, value) of files of little-endian 32-bit integer pairs."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_pairs, "path string, position long, key long, value long")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a mutation log."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "view", "g").when(F.col("event_type") == "click", "r").otherwise("p")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), F.round(F.col("value") * 100).cast("bigint").alias("value"), (F.col("user_id") + 10).alias("key_end"))


def orders_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("value"))
