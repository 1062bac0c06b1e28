"""Toxic passages: maximal scoring segments over token log-odds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .quality import isotonic
from .tables import save, ship

#: The model is fitted on at most about so many labelled rows, chosen by a hash of doc_id, and
#: keeps at most so many tokens, those whose log-odds are the most certain.
FIT_ROWS, FIT_TOKENS = 40_000, 50_000
PRIOR = 50.0  # pseudo-documents of the Dirichlet prior
SURE = 3.0  # standard errors that a token's log-odds must be from 0
DRIFT = 0.15  # cost of each token without evidence
MOST = 6.0
#: A word's tokens are the word and its beginnings of so many bytes, which stand for its
#: inflected and compound forms; the word takes the one that says most. What a token says is its
#: log-odds less SAFE standard errors.
PREFIXES = (4, 5, 6, 7, 8, 10, 12)
SAFE = 1.5

RESULT = "doc_id long, score double, best_segment double, n_segments int, segments array<struct<first:int,last:int,score:double>>"


@dataclass
class Model:
    token: np.ndarray  # sorted hashes
    value: np.ndarray
    rate: float = 1.0  # lambda of the segment score's extreme-value law
    log_k: float = 0.0
    cut: float = 0.0  # evidence at which a text is as likely toxic as not
    knots: np.ndarray | None = None  # monotone map of evidence to probability
    values: np.ndarray | None = None

    def scores(self, w: K.Words) -> np.ndarray:
        out = np.zeros(len(w.hashes))
        if len(self.token):
            for hashes, own in _tokens(w):
                at = np.minimum(np.searchsorted(self.token, hashes), len(self.token) - 1)
                hit = (self.token[at] == hashes) & (np.abs(self.value[at]) > np.abs(out[own]))
                out[own[hit]] = self.value[at[hit]]
        return out - DRIFT

    def evidence(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far the best segment lies above what a clean text of n tokens is likely to have."""
        return self.rate * best - np.log(np.maximum(n, 1)) - self.log_k

    def probability(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        e = self.evidence(best, n)
        logistic = 1 / (1 + np.exp(-np.clip(e - self.cut, -40, 40)))
        if self.knots is None:
            return logistic
        # the logistic part only orders texts that the monotone map leaves equal
        return 0.99 * np.interp(e, self.knots, self.values) + 0.01 * logistic


def _tokens(w: K.Words):
    """(hashes, word numbers) of the words, then of their beginnings."""
    yield w.hashes, np.arange(len(w.hashes))
    for size in PREFIXES:
        yield w.prefixes(size)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in linear time (Ruzzo and Tompa, 1999).
    Only runs of positive scores are visited; what lies between them is one negative step."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, end, sum before, sum after, nearest earlier segment with a smaller sum before
    for i in up.tolist():
        new = [i, i + 1, total[i], total[i + 1], -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


def _rows(batch: pa.RecordBatch):
    buf, bounds = K.text_buffers(batch.column("text"))
    for i, j in K.slices(bounds):
        w = K.words(buf, bounds[i : j + 1], K.alphabet("alnum", True))
        yield i, j, w


def _count(batches):
    """Documents of each label that have a token, and all documents, for a few documents at a time."""
    for b in batches:
        label = b.column("label").to_numpy()
        for i, j, w in _rows(b):
            row = np.repeat(np.arange(i, j), np.diff(w.first))
            docs, names = [], []
            for hashes, own in _tokens(w):
                order = np.lexsort((hashes, row[own]))
                r, h = row[own][order], hashes[order]
                new = np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])][: len(r)]
                docs.append(r[new])
                names.append(h[new])
            r, h = np.concatenate(docs), np.concatenate(names)
            token, at = np.unique(h, return_inverse=True)
            toxic = np.bincount(at, label[r] == 1, len(token)).astype(np.int64)
            every = np.bincount(at, minlength=len(token)).astype(np.int64)
            for k in range(0, len(token), 50_000):
                part = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)[part]), pa.array(toxic[part]), pa.array((every - toxic)[part])], ["token", "t", "c"])


def _best(model: Model):
    def run(batches):
        for b in batches:
            best, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i, j, w in _rows(b):
                s = model.scores(w)
                n[i:j] = np.diff(w.first)
                for r in range(i, j):
                    best[r] = max((x[2] for x in maximal_segments(s[w.first[r - i] : w.first[r - i + 1]])), default=0.0)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(best), pa.array(n)], ["label", "best", "n"])

    return run


def _rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E exp(lambda s) = 1 over clean tokens."""
    f = lambda x: float(np.log(np.average(np.exp(x * values), weights=weights)))
    lo, hi = 1e-3, 1.0
    while f(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def fit(docs: DataFrame, labels: DataFrame, where: Column, fit_rows: int = FIT_ROWS, fit_tokens: int = FIT_TOKENS) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & where)
    share = min(1.0, fit_rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * share))
    rows = docs.join(known, "doc_id").where("text is not null")
    # copies of one text count once
    rows = save(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label", (F.pmod("h", F.lit(4)) == 0).alias("held")), "fit")
    size = dict(rows.where("not held").groupBy("label").count().collect())
    empty = np.zeros(0, np.uint64)
    if min(size.get(0, 0), size.get(1, 0)) < 3:
        return Model(empty, np.zeros(0), cut=np.inf)
    nt, nc = size[1], size[0]
    counted = rows.where("not held").select("text", "label").mapInArrow(_count, "token long, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t + c >= 3")
    # informative Dirichlet prior: PRIOR pseudo-documents of either kind at the pooled rate
    prior = PRIOR * (F.col("t") + F.col("c")) / (nt + nc)
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(t / (nt + PRIOR - t + 1)) - F.log(c / (nc + PRIOR - c + 1))
    counted = counted.select("token", "c", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z")).where(F.abs("z") >= SURE)
    top = counted.orderBy(F.desc(F.abs("z")), "token").limit(fit_tokens).toArrow()
    z = np.abs(top.column("z").to_numpy())
    token, odds, c = top.column("token").to_numpy().view(np.uint64), top.column("odds").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(token)
    model = Model(token[order], np.clip(odds * np.maximum(1 - SAFE / z, 0), -MOST, MOST)[order])
    held = rows.select("text", "label", "held").where("held").select("text", "label").mapInArrow(_best(model), "label int, best double, n long").toArrow()
    label, best, n = (held.column(x).to_numpy() for x in ("label", "best", "n"))
    clean = label == 0
    if not clean.any() or clean.all():
        return model
    # token scores of clean texts: those of the list as often as clean documents have them
    listed = c[order].astype(float)
    other = max(float(n[clean].mean()) * nc - listed.sum(), 1.0)
    model.rate = _rate(np.r_[model.value - DRIFT, -DRIFT], np.r_[listed, other])
    # log K from the mean of the Gumbel law of clean texts' best segments
    model.log_k = float(np.mean(model.rate * best[clean] - np.log(np.maximum(n[clean], 1)))) - 0.5772
    e = model.evidence(best, n)
    model.knots, model.values = isotonic(e, label.astype(float))
    over = np.flatnonzero(model.values >= 0.5)
    model.cut = float(model.knots[over[0]]) if len(over) else float(e.max()) + 1
    return model


def _apply(model):
    def run(batches):
        m = model.value
        for b in batches:
            best, n, segs = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), []
            for i, j, w in _rows(b):
                s = m.scores(w)
                n[i:j] = np.diff(w.first)
                for r in range(i, j):
                    own = maximal_segments(s[w.first[r - i] : w.first[r - i + 1]])
                    best[r] = max((x[2] for x in own), default=0.0)
                    # significant alone: over the cut at which a text is more likely toxic than not
                    limit = m.cut + m.log_k + np.log(max(n[r], 1))
                    segs.append([{"first": a, "last": z - 1, "score": v} for a, z, v in own if m.rate * v >= limit])
            score = m.probability(best, n) if len(m.token) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(best), pa.array([len(x) for x in segs], pa.int32()), pa.array(segs, _SEGMENTS)], ["doc_id", "score", "best_segment", "n_segments", "segments"])

    return run


_SEGMENTS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, labels: DataFrame, where: Column | None = None, fit_rows: int = FIT_ROWS, fit_tokens: int = FIT_TOKENS) -> DataFrame:
    """Per row of ``docs``: doc_id, score (probability of a toxic text), best_segment, n_segments
    and segments (word positions and score of each significant passage).

    Words and their beginnings get log-odds of toxic against clean documents under a Dirichlet
    prior; words without clear evidence cost a little. All maximal scoring segments are found in linear time. The
    best one's score, held against the extreme-value law of clean texts of equal length, is
    mapped to a probability on fit rows that gave no token counts.

    Null or empty text has no segments and the lowest score for its size. Labels other than 0
    and 1 are not used; without at least three fit texts of either kind every score is 0. A null
    doc_id is scored and never fitted; repeated rows are scored alike and fitted once. Other
    columns are ignored."""
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(fit(docs, labels, F.lit(True) if where is None else where, fit_rows, fit_tokens))
    return docs.mapInArrow(_apply(model), RESULT)
