"""Packing by optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import save

#: Longest sequence, buckets, padded tokens of one batch, and documents that one task numbers.
MAX_LENGTH, BUCKETS, BATCH_TOKENS, SHARD_ROWS = 4096, 16, 65_536, 50_000


def words_of(text: Column) -> Column:
    """Length of a text in white-space separated words, with one for its end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)) + 1


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding, by
    dynamic programming over the histogram: cost(i, j) pads lengths i..j to the j-th."""
    order = np.argsort(lengths)
    size, n = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    m = len(size)
    if not m:
        return []
    c, t = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    best = size * c[1:] - t[1:]
    back = [np.zeros(m, np.int64)]
    for _ in range(1, min(buckets, m)):
        new, cut = best.copy(), np.full(m, -1)
        for j in range(m):
            # the last bucket begins after i
            cost = best[:j] + size[j] * (c[j + 1] - c[1 : j + 1]) - (t[j + 1] - t[1 : j + 1])
            if j and (i := int(cost.argmin())) >= 0 and cost[i] < new[j]:
                new[j], cut[j] = cost[i], i
        back.append(cut)
        best = new
    out, j, k = [], m - 1, len(back) - 1
    while j >= 0:
        out.append(int(size[j]))
        while k > 0 and back[k][j] < 0:
            k -= 1
        if k == 0:
            break
        j, k = int(back[k][j]), k - 1
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """doc_id, piece, first, length, bucket, padded, batch and slot of each piece of each row.

    A row of more than ``max_length`` tokens is cut into pieces; first is the piece's first
    token. Over the histogram of all pieces' lengths at most ``buckets`` upper bounds are chosen
    that minimise padding. Each bucket is filled into batches of floor(batch_tokens / padded)
    pieces (one at least); batch counts from 0 in its bucket and slot in its batch. Only the last
    batch of a bucket can have room left.

    Null or empty text has one piece of one token, its end. Null doc_ids and repeated rows are
    pieces like others, spread by their texts. Order within a bucket follows a hash of doc_id, text and piece. Other columns
    are ignored; an empty table gives an empty result."""
    size = words_of(F.col("text").cast("string")) if length is None else length
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h") if "text" in docs.columns else F.lit(0).cast("long").alias("h"), size.cast("long").alias("n"))
    cut = F.expr(f"sequence(0L, cast((greatest(n, 1L) - 1) div {max_length} as bigint))")
    pieces = rows.select("doc_id", "h", "n", F.explode(cut).alias("piece"))
    pieces = pieces.select("doc_id", "h", F.col("piece").cast("int").alias("piece"), (F.col("piece") * max_length).alias("first"), F.least(F.lit(max_length), F.greatest(F.col("n"), F.lit(1)) - F.col("piece") * max_length).cast("int").alias("length"))
    pieces = save(pieces.withColumn("h", F.xxhash64("doc_id", "h", "piece")), "pieces")
    # at most max_length rows
    histogram = pieces.groupBy("length").count().collect()
    bounds = boundaries(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    total = sum(r[1] for r in histogram)
    shards = max(1, -(-total // SHARD_ROWS))
    bucket = F.lit(0)
    for k, b in enumerate(bounds[:-1]):
        bucket = bucket + (F.col("length") > b).cast("int")
    padded = F.element_at(F.array(*map(F.lit, bounds or [1])), F.col("bucket") + 1)
    dealt = pieces.withColumn("bucket", bucket).withColumn("padded", padded).withColumn("shard", F.pmod("h", F.lit(shards)))
    # numbers within a bucket: those of the earlier shards, then the place in the own shard
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.sum("c").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("bucket", "shard", F.coalesce("before", F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "doc_id", "piece")) - 1
    dealt = dealt.withColumn("place", place).join(before, ["bucket", "shard"]).withColumn("number", F.col("before") + F.col("place"))
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("padded"))).cast("long")
    return dealt.select("doc_id", "piece", "first", "length", "bucket", "padded", F.floor(F.col("number") / room).cast("long").alias("batch"), F.pmod("number", room).cast("int").alias("slot"))
