"""Exact top-k by inner product with block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import lean, save, ship, spread

#: Rows of one forward-index block, blocks of one group, and queries that are scored together.
BLOCK_ROWS, GROUP_BLOCKS, QUERY_ROWS = 256, 64, 512
#: A task holds one slice of so many groups at most, and one set of queries after the other. Each set is sent
#: to each slice once.
SLICE_GROUPS = 4

_PACK = "slice int, ids binary, matrix binary"
_TOP = "query_id long, vec_id long, score long"


def _usable(batches, scale: float):
    """Integer vectors of the usable rows of some batches."""
    for b in batches:
        ids = b.column("vec_id").to_pylist()
        for i, v in zip(ids, b.column("v").to_pylist()):
            if i is None or v is None or any(x is None for x in v):
                continue
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all():
                yield i, np.floor(scale * x)


def _pack(scale: float, rows: int):
    def run(batches):
        from pyspark import TaskContext

        own = TaskContext.get().partitionId() << 12
        done, ids, vectors = 0, [], []

        def close():
            width = max(map(len, vectors), default=0)
            m = np.zeros((len(ids), width))
            for r, v in enumerate(vectors):
                m[r, : len(v)] = v
            if np.abs(m).max(initial=0) < 1 << 15:
                m = m.astype(np.int16)
            return pa.RecordBatch.from_arrays([pa.array([own + done // SLICE_GROUPS], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([bytes([m.itemsize]) + m.tobytes()])], ["slice", "ids", "matrix"])

        for i, v in _usable(batches, scale):
            ids.append(i)
            vectors.append(v)
            if len(ids) == rows:
                yield close()
                done, ids, vectors = done + 1, [], []
        if ids:
            yield close()

    return run


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles hold them exactly below 2**53; beyond, whole numbers do."""
    k = min(a.shape[1], b.shape[1])
    a, b = a[:, :k], b[:, :k]
    if k == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * k < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).dot(np.array([[int(x) for x in r] for r in b], object).T)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _matrix(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b.column("ids")[i].as_buffer(), np.int64)
    raw = memoryview(b.column("matrix")[i].as_buffer())
    m = np.frombuffer(raw[1:], np.int16 if raw[0] == 2 else np.float64)
    return ids, m.reshape(len(ids), -1).astype(np.float64)


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One matrix of some; shorter rows end in zeros."""
    ids = np.concatenate([x for x, _ in parts])
    m = np.zeros((len(ids), max(x.shape[1] for _, x in parts)))
    at = 0
    for _, x in parts:
        m[at : at + len(x), : x.shape[1]] = x
        at += len(x)
    return ids, m


def extremes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term maxima and minima of each block."""
    starts = range(0, len(c), BLOCK_ROWS)
    return np.stack([c[s : s + BLOCK_ROWS].max(0, initial=-np.inf) for s in starts]), np.stack([c[s : s + BLOCK_ROWS].min(0, initial=np.inf) for s in starts])


def search_group(q_ids, q, c_ids, c, k: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best k of one group for each query: (query, candidate, score), and the number of
    (query, block) pairs that were scored. ``known``: :func:`extremes` of ``c``.

    A block's bound is the sum over terms of the larger of query x block maximum and query x
    block minimum. Each query takes the blocks by falling bound and ends where the bound is
    below its k-th score."""
    starts = np.arange(0, len(c_ids), BLOCK_ROWS)
    width = min(q.shape[1], c.shape[1])
    high, low = (x[:, :width] for x in known or extremes(c))
    x = q[:, :width]
    bound = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T if width else np.zeros((len(q), len(starts)))
    # doubles may round large sums: the bound is raised by more than that
    bound += 1 + np.abs(bound) * 1e-9
    order = np.argsort(-bound, axis=1, kind="stable")
    n = len(q_ids)
    best_s = np.full((n, k), -(2**63), np.int64)
    best_i = np.full((n, k), 2**63 - 1, np.int64)
    filled = np.zeros(n, np.int64)
    scored = 0
    active = np.arange(n)
    for step in range(len(starts)):
        block = order[active, step]
        kth = best_s[active, k - 1].astype(np.float64)
        active = active[(filled[active] < k) | (bound[active, block] >= kth)]
        if not len(active):
            break
        block = order[active, step]
        scored += len(active)
        for bl in np.unique(block):
            own = active[block == bl]
            s = starts[bl]
            ids = c_ids[s : s + BLOCK_ROWS]
            sc = _scores(q[own], c[s : s + BLOCK_ROWS])
            same = q_ids[own][:, None] == ids[None, :]
            all_s = np.concatenate([best_s[own], np.where(same, -(2**63), sc)], axis=1)
            all_i = np.concatenate([best_i[own], np.where(same, 2**63 - 1, np.broadcast_to(ids, sc.shape))], axis=1)
            top = np.lexsort((all_i, ~all_s), axis=1)[:, :k]  # ~x falls as x grows, for every integer
            best_s[own], best_i[own] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            filled[own] = np.minimum(k, filled[own] + (~same).sum(1))
    row, col = np.nonzero(np.arange(k)[None, :] < filled[:, None])
    return q_ids[row], best_i[row, col], best_s[row, col], scored


def _search(k: int):
    """The best of each slice for each query. Rows come in order of slices, a slice's index before its queries."""

    def run(batches):
        last, parts, c = None, [], None
        for b in batches:
            for i, (own, asked) in enumerate(zip(b.column("slice").to_pylist(), b.column("asked").to_pylist())):
                if own != last:
                    last, parts, c = own, [], None
                if not asked:
                    parts.append(_matrix(b, i))
                    continue
                if c is None:
                    c_ids, c = _together(parts)
                    known, parts = extremes(c), []
                who, what, score, _ = search_group(*_matrix(b, i), c_ids, c, k, known)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(what), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` other rows with the largest integer inner
    product for each row that ``queries`` admits; ties go to the smaller vec_id.

    A component x counts as floor(scale * x). Rows are packed in document ranges, forward-index
    blocks with their term maxima and minima; each set of queries meets each slice of blocks once
    and prunes within it, and the slices' best are merged. Queries are sent to the slices in
    packed sets, never row by row; the index is sent once. Nothing is joined or broadcast.

    Vectors that are null or hold null, NaN or infinite components, and rows with null vec_id, take
    no part. Shorter vectors count as if zeros followed. A row is never its own result: neither is
    another row with the same vec_id; other repeated rows are candidates each. Other columns are
    ignored; empty tables give an empty result."""
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q")).where("vec_id is not null and v is not null")
    n = rows.count()
    per_group = BLOCK_ROWS * GROUP_BLOCKS
    groups = max(1, -(-n // per_group))
    slices = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // SLICE_GROUPS)))
    ranged = rows.repartitionByRange(slices, "vec_id").sortWithinPartitions("vec_id").select("vec_id", "v")
    index = save(ranged.mapInArrow(lean(_pack(scale, per_group)), _PACK), "index")
    asked = rows.where("q").repartition(max(1, -(-n // (20 * 4 * QUERY_ROWS)))).select("vec_id", "v")
    asked = save(asked.mapInArrow(lean(_pack(scale, QUERY_ROWS)), _PACK), "asked")
    used = sorted(r[0] for r in index.select("slice").distinct().collect())
    everywhere = F.explode(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>"))
    both = index.withColumn("asked", F.lit(False)).unionByName(asked.select(everywhere.alias("slice"), "ids", "matrix", F.lit(True).alias("asked")))
    parts = max(1, len(used))
    # a partition for each slice
    to = F.create_map(*(F.lit(x) for pair in zip(used, spread(spark, parts)) for x in pair))[F.col("slice")] if used else F.col("slice")
    dealt = both.withColumn("to", to).repartition(parts, "to").sortWithinPartitions("slice", "asked")
    found = dealt.select("slice", "asked", "ids", "matrix").mapInArrow(lean(_search(k)), _TOP)
    best = F.row_number().over(_window())
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
