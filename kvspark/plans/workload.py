"""A seeded generator of command workloads."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


@dataclass(frozen=True)
class Workload:
    """Numbers of commands, and how keys are drawn. Shards are independent key histories: each
    is generated by one task in order, so a workload of any size is spread over the cluster."""

    puts: int = 1000
    gets: int = 0
    ranges: int = 0
    deletes: int = 0
    misses: float = 0.5
    skew: float = 0.0
    gaussian: bool = False
    max_range: int = 100
    seed: int = 13141
    shards: int = 1


def _share(total: int, shards: int, k: int) -> int:
    return total // shards + (k < total % shards)


def _commands(w: Workload, shard: int) -> pd.DataFrame:
    rng = np.random.default_rng([w.seed, shard])
    left = {"p": _share(w.puts, w.shards, shard), "g": _share(w.gets, w.shards, shard), "r": _share(w.ranges, w.shards, shard), "d": _share(w.deletes, w.shards, shard)}
    ops = np.array([op for op, n in left.items() for _ in range(n)])
    rng.shuffle(ops)  # each next command is drawn in proportion to what is left
    draw = lambda: int(np.clip(rng.normal(0, INT_MAX / 3), INT_MIN, INT_MAX)) if w.gaussian else int(rng.integers(INT_MIN, INT_MAX))
    put_keys: list[int] = []
    got: list[int] = []
    rows = []
    for i, op in enumerate(ops):
        key = value = end = None
        if op == "p":
            key, value = draw(), int(rng.integers(INT_MIN, INT_MAX))
            put_keys.append(key)
        elif op == "g":
            if got and rng.random() < w.skew:
                key = got[int(rng.integers(len(got)))]
            elif not put_keys or rng.random() < w.misses:
                key = draw()
            else:
                key = put_keys[int(rng.integers(len(put_keys)))]
            got.append(key)
        elif op == "r":
            a = draw()
            b = a + int(rng.integers(-w.max_range, w.max_range + 1))
            key, end = min(a, b), max(a, b)
        else:
            key = put_keys[int(rng.integers(len(put_keys)))] if put_keys else draw()
        rows.append((i * w.shards + shard, op, key, value, end))
    return pd.DataFrame(rows, columns=["seq", "op", "key", "value", "key_end"]).astype({"key": "Int64", "value": "Int64", "key_end": "Int64"})


def generate(spark: SparkSession, w: Workload) -> DataFrame:
    """A mutation log (seq, op, key, value, key_end); equal seeds give equal logs."""

    def run(frames):
        for pdf in frames:
            for shard in pdf["id"]:
                yield _commands(w, int(shard))

    return spark.range(0, w.shards, 1, w.shards).mapInPandas(run, "seq long, op string, key long, value long, key_end long")


def text(log: DataFrame) -> DataFrame:
    """(seq, value): the log as command lines."""
    from pyspark.sql import functions as F

    line = F.concat_ws(" ", "op", F.col("key").cast("string"), F.when(F.col("op") == "p", F.col("value")).cast("string"), F.col("key_end").cast("string"))
    return log.select("seq", line.alias("value"))
