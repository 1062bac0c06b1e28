"""Quality scores: random Fourier features, ridge regression and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import save, ship

#: The model is fitted on at most about so many labelled rows, chosen by a hash of doc_id.
FIT_ROWS = 200_000
FOURIER = 384
RIDGE = 1e-3
FIT_TASKS = 16

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "blank": (0x20, 0x09),
    "line": (0x0A,),
    "stop": (0x2E, 0x2C),
    "bang": (0x21, 0x3F),
    "symbol": b"#$%&*@^~+=",
    "bar": b"|<>{}[]\\/_",
    "quote": b"\"'`()",
    "wide": range(0x80, 0x100),
    "control": [*range(0x09), *range(0x0B, 0x20), 0x7F],
}


def statistics(col: pa.Array) -> np.ndarray:
    """A row of numbers for each text: sizes, shares of character classes, word and line
    shapes and repetition."""
    buf, bounds = K.text_buffers(col)
    return np.concatenate([_statistics(buf, bounds[i : j + 1]) for i, j in K.slices(bounds)] or [np.zeros((0, N_STATISTICS), np.float32)])


def _statistics(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    own = buf[bounds[0] : bounds[-1]]
    n_rows = len(bounds) - 1
    at = bounds - bounds[0]
    n = np.diff(at)
    one = np.maximum(n, 1)
    which = np.full(256, len(_CLASSES), np.uint8)
    for k, members in enumerate(_CLASSES.values()):
        which[list(members)] = k
    cls = which[own]

    def summed(x: np.ndarray) -> np.ndarray:
        c = np.zeros(len(x) + 1, np.int64)
        np.cumsum(x, out=c[1:])
        return c

    out = [np.log1p(n)]
    counts = {}
    for k, name in enumerate(_CLASSES):
        c = summed(cls == k)
        counts[name] = c[at[1:]] - c[at[:-1]]
        out.append(counts[name] / one)
    w = K.words(buf, bounds, K.alphabet("space", True))
    n_words = np.diff(w.first)
    some = np.maximum(n_words, 1)
    size = w.ends - w.starts
    row = np.repeat(np.arange(n_rows), n_words)
    mean = np.bincount(row, size, n_rows) / some
    out += [np.log1p(n_words), mean, np.sqrt(np.maximum(np.bincount(row, size.astype(float) ** 2, n_rows) / some - mean**2, 0))]
    out += [np.bincount(row, size <= 3, n_rows) / some, np.bincount(row, size >= 12, n_rows) / some]
    # words that end in a symbol, begin in upper case, or have no letter
    if len(size):
        out.append(np.bincount(row, np.isin(cls[w.ends - 1], [6, 7, 8]), n_rows) / some)
        out.append(np.bincount(row, cls[w.starts] == 0, n_rows) / some)
        letters = summed((cls == 0) | (cls == 1) | (cls == 10))
        out.append(np.bincount(row, letters[w.ends] == letters[w.starts], n_rows) / some)
    else:
        out += [np.zeros(n_rows)] * 3
    order = np.lexsort((w.hashes, row))
    new = np.r_[True, (w.hashes[order][1:] != w.hashes[order][:-1]) | (row[order][1:] != row[order][:-1])][: len(order)]
    distinct = np.bincount(row[order], new, n_rows)
    out += [distinct / some, np.log1p(n_words) - np.log1p(distinct)]
    bold, last = row[1:] == row[:-1], w.hashes[1:] == w.hashes[:-1]
    out.append(np.bincount(row[1:], bold & last, n_rows) / some)
    lines = counts["line"] + (n > 0)
    out += [np.log1p(lines), np.log1p(n / np.maximum(lines, 1))]
    return np.stack([np.asarray(x, np.float64) for x in out], axis=1).astype(np.float32)


N_STATISTICS = 1 + len(_CLASSES) + 5 + 3 + 2 + 1 + 2


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos(Wx + b) with Gaussian W: inner products approximate a Gaussian kernel of the
        standardised statistics."""
        rng = np.random.RandomState(20)
        w = rng.standard_normal((x.shape[1], FOURIER)) / np.sqrt(x.shape[1] / 2)
        b = rng.uniform(0, 2 * np.pi, FOURIER)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ w + b) * np.sqrt(2 / FOURIER), np.ones((len(x), 1))], axis=1)

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.ridge(x), self.knots, self.values), 0, 1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators; the knots are the blocks' mean scores, between which values
    are interpolated, so that order within a block is kept where neighbours differ."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order].tolist(), label[order].tolist()):
        blocks.append([1.0, s, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            n, a, b = blocks.pop()
            last = blocks[-1]
            last[0] += n
            last[1] += a
            last[2] += b
    n, a, b = np.array(blocks).T
    return a / n, (b + 0.5 * (b <= 0)) / (n + 0.5 * (b <= 0) + 0.5 * (b >= n))




def _arrays(b: pa.RecordBatch) -> np.ndarray:
    col = b.column("x")
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), N_STATISTICS).astype(np.float64)


def _moments(batches):
    total = np.zeros((2, N_STATISTICS))
    n = 0
    for b in batches:
        x = _arrays(b)
        total += x.sum(0), (x * x).sum(0)
        n += len(x)
    yield pa.RecordBatch.from_pylist([{"n": n, "a": total.tobytes(), "b": b""}], _SUMS)


_SUMS = pa.schema([("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _normal(model: Model):
    def run(batches):
        a, b, n = np.zeros((FOURIER + 1, FOURIER + 1)), np.zeros(FOURIER + 1), 0
        for batch in batches:
            z = model.features(_arrays(batch))
            y = batch.column("label").to_numpy().astype(float)
            a += z.T @ z
            b += z.T @ y
            n += len(y)
        yield pa.RecordBatch.from_pylist([{"n": n, "a": a.tobytes(), "b": b.tobytes()}], _SUMS)

    return run


def _held(model: Model):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.ridge(_arrays(b))), b.column("label").cast(pa.float64())], ["s", "y"])

    return run


def fit(stats: DataFrame, labels: DataFrame, where: Column, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on the labelled rows that ``where`` (over doc_id) admits; a fifth of them calibrates."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & where)
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000))
    rows = stats.join(known.where(part < int(1_000_000 * min(1.0, fit_rows / max(n, 1)))), "doc_id")
    rows = save(rows.select("x", "label", (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0).alias("held")).repartition(FIT_TASKS), "fit")
    blank = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), None, np.zeros(1), np.full(1, 0.5))
    sums = rows.select("x").mapInArrow(_moments, "n long, a binary, b binary").collect()
    n = sum(r["n"] for r in sums)
    if n < 10:
        return blank
    total = sum(np.frombuffer(r["a"]).reshape(2, -1) for r in sums) / n
    model = Model(total[0], np.sqrt(np.maximum(total[1] - total[0] ** 2, 1e-8)), None, np.zeros(1), np.full(1, 0.5))
    sums = rows.where("not held").select("x", "label").mapInArrow(_normal(model), "n long, a binary, b binary").collect()
    n = sum(r["n"] for r in sums)
    a = sum(np.frombuffer(r["a"]).reshape(FOURIER + 1, -1) for r in sums)
    b = sum(np.frombuffer(r["b"]) for r in sums)
    penalty = np.eye(FOURIER + 1) * RIDGE * max(n, 1) / FOURIER
    penalty[-1, -1] = 1e-9
    model.weight = np.linalg.solve(a + penalty, b)
    held = rows.where("held").select("x", "label").mapInArrow(_held(model), "s double, y double").toArrow()
    s, y = held.column("s").to_numpy(), held.column("y").to_numpy()
    if len(s) < 5:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        model.knots, model.values = isotonic(s, y)
    return model


def _measure(batches):
    for b in batches:
        x = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])


def _apply(model):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.score(_arrays(b)))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, where: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id and score, the calibrated probability of quality 1.

    Statistics of each whole text are written once. Labelled rows that ``where`` admits give
    a model: standardised statistics, FOURIER random cosine features, normal equations summed
    over partitions, a ridge solution, and an isotonic map fitted on rows that the ridge did
    not see.

    Null or empty text has the statistics of an empty text and gets a score. Labels other than
    0 and 1 and labels without a document are not used; with under 10 usable ones every score
    is 0.5. A null doc_id is scored and never fitted; repeated rows are scored alike. Other
    columns are ignored."""
    spark = ship(docs.sparkSession)
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, "doc_id long, x binary")
    stats = save(stats, "statistics")
    model = spark.sparkContext.broadcast(fit(stats, labels, F.lit(True) if where is None else where, fit_rows))
    return stats.mapInArrow(_apply(model), "doc_id long, score double")
