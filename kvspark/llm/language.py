"""Language identification by prediction by partial matching (PPM)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .tables import ship

ORDER = 3  # bytes of the longest context
UNKNOWN = "und"
#: The model is fitted on about so many labelled documents of each language, chosen by a
#: hash of doc_id, and on all languages.
FIT_DOCS = 2_000
UNITS = 1024  # costs are kept in 1/1024 bit, so that sums are exact

RESULT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]


def _byte_map() -> np.ndarray:
    """ASCII letters and all other bytes from 0x80 on stay, the rest is one blank."""
    b = np.arange(256)
    return np.where(((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80), b, 0x20).astype(np.uint8)


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the lower-cased texts the code of it and its ORDER predecessors (blanks
    before the text), and the texts' bounds."""
    buf, bounds = K.text_buffers(pc.utf8_lower(col.cast(pa.large_string())))
    lo, hi = int(bounds[0]), int(bounds[-1])
    x, bounds = _byte_map()[buf[lo:hi]], bounds - lo
    code = x.astype(np.uint32)
    begin = bounds[:-1][bounds[:-1] < len(x)]
    prev = x
    for k in range(1, ORDER + 1):
        prev = np.concatenate([np.full(1, 0x20, np.uint8), prev[:-1]]) if len(x) else prev
        prev[begin] = 0x20
        code |= prev.astype(np.uint32) << np.uint32(8 * k)
    return code, bounds


@dataclass
class Trees:
    """Context trees of all languages: for each order the counts of contexts, of the distinct
    symbols after them, and of the symbols, one column a language."""

    langs: list[str]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    symbols: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, langs: list[str], lang: np.ndarray, code: np.ndarray, count: np.ndarray) -> Trees:
        contexts, symbols = [], []
        for k in range(ORDER + 1):
            # all 4-byte grams, cut to a context of k bytes
            cut = (code.astype(np.uint64) & np.uint64((1 << (8 * (k + 1))) - 1)).astype(np.int64)
            names, at = np.unique(cut, return_inverse=True)
            n = np.zeros((len(names), len(langs)), np.int64)
            np.add.at(n, (at, lang), count)
            symbols.append((names, n))
            heads, at = np.unique(names >> 8, return_inverse=True)
            total, distinct = (np.zeros((len(heads), len(langs)), np.int64) for _ in range(2))
            np.add.at(total, at, n)
            np.add.at(distinct, at, (n > 0).astype(np.int64))
            contexts.append((heads, total, distinct))
        return cls(langs, contexts, symbols)

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the others, for each language: the
        longest known context that has the byte codes it, and each longer one costs an escape
        (method C: distinct symbols over total and distinct). Unseen bytes cost 8 bits."""
        out = np.zeros((len(code), len(self.langs)))
        coded = np.zeros(out.shape, bool)
        for k in range(ORDER, -1, -1):
            cut = (code.astype(np.uint64) & np.uint64((1 << (8 * (k + 1))) - 1)).astype(np.int64)
            (heads, total, distinct), (names, n) = self.contexts[k], self.symbols[k]
            t, d, c = _take(heads, total, cut >> 8), _take(heads, distinct, cut >> 8), _take(names, n, cut)
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(~coded & (c > 0), np.log2((t + d) / np.maximum(c, 1)), 0)
                out += np.where(~coded & (c == 0) & (t > 0), np.log2((t + d) / np.maximum(d, 1)), 0)
            coded |= c > 0
        out += np.where(coded, 0, 8)
        return np.rint(out * UNITS).astype(np.int64)


def _take(names: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where((names[at] == wanted)[:, None], values[at], 0)


class Coder:
    """Code lengths of texts. Costs of grams are computed once and kept in a table that is
    looked up by hash; a gram that another has displaced is computed again."""

    BITS = 21

    def __init__(self, trees: Trees):
        self.trees = trees
        self.key = np.full(1 << self.BITS, 0, np.uint32)
        self.row = np.full(1 << self.BITS, -1, np.int32)
        self.cost = np.zeros((0, len(trees.langs)), np.int64)

    def rows(self, code: np.ndarray) -> np.ndarray:
        slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)).astype(np.int32)
        row = self.row[slot]
        missing = np.flatnonzero((row < 0) | (self.key[slot] != code))
        if len(missing):
            if self.cost.size > 16_000_000:
                self.row[:], self.cost = -1, self.cost[:0]
                return self.rows(code)
            new, at = np.unique(code[missing], return_inverse=True)
            first = len(self.cost)
            self.cost = np.concatenate([self.cost, self.trees.costs(new)])
            place = ((new * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)).astype(np.int32)
            self.key[place], self.row[place] = new, first + np.arange(len(new), dtype=np.int32)
            row[missing] = first + at
        return row

    def lengths(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Units of code length of each text in each language, and the texts' bytes."""
        code, bounds = grams(col)
        row = self.rows(code)
        out = np.zeros((len(bounds) - 1, len(self.trees.langs)), np.int64)
        sums = np.zeros(len(code) + 1, np.int64)
        for k in range(out.shape[1]):
            np.cumsum(np.ascontiguousarray(self.cost[:, k])[row], out=sums[1:])
            out[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
        return out, np.diff(bounds)


def _count(langs: list[str]):
    number = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for b in batches:
            which = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            code, bounds = grams(b.column("text"))
            of = np.repeat(which, np.diff(bounds))
            both, n = np.unique(of << 32 | code.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((both >> 32).astype(np.int32)), pa.array(both & 0xFFFFFFFF), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    return run


def fit(docs: DataFrame, where: Column, fit_docs: int = FIT_DOCS) -> Trees | None:
    """Context trees from text and lang of the rows of ``docs`` that ``where`` admits."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(where & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return None
    share = {r["lang"]: min(1.0, fit_docs / r["count"]) for r in counts}
    limit = F.coalesce(F.create_map([F.lit(x) for p in share.items() for x in p])[F.col("lang")], F.lit(0.0)) * 1_000_000
    some = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit))
    found = some.select("text", "lang").mapInArrow(_count(langs), "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    t = found.toArrow()
    lang, code, n = (t.column(c).to_numpy() for c in ("lang", "code", "n"))
    return Trees.fit(langs, lang.astype(np.int64), code, n) if len(code) else None


def _identify(model):
    def run(batches):
        trees = model.value
        coder = Coder(trees) if trees else None
        for b in batches:
            row = b.column("row")
            text = row.field(row.type.get_field_index("text")).cast(pa.large_string())
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score, bits = np.full(len(text), UNKNOWN, object), np.zeros(len(text)), np.full(len(text), np.nan)
            if coder:
                _, bounds = K.text_buffers(text)
                for i, j in K.slices(bounds):
                    units, n = coder.lengths(text.slice(i, j - i))
                    best = units.argmin(axis=1)
                    least = units[np.arange(j - i), best]
                    odds = np.exp2(-np.minimum((units - least[:, None]) / UNITS, 1000)).sum(axis=1)
                    own = letter[i:j]
                    pred[i:j][own] = np.array(trees.langs, object)[best[own]]
                    score[i:j][own] = 1 / odds[own]
                    bits[i:j][own] = least[own] / UNITS / np.maximum(n[own], 1)
            yield pa.RecordBatch.from_arrays([row, pa.array(pred, pa.string()), pa.array(score), pa.array(bits, from_pandas=True)], names=["row", *(f.name for f in RESULT)])

    return run


def identify(docs: DataFrame, where: Column | None = None, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per row of ``docs``: ``row`` (the whole row), lang_pred, score and bits_per_byte.

    For each language of the fit rows (non-null lang, ``where``) byte contexts of up to ORDER
    bytes are counted once; then the whole text's exact code length is summed for each
    language, and the shortest wins (ties: the smaller name). score is the probability of
    that language given equal priors.

    Null text and text without a letter: ``und`` with score 0 and null bits_per_byte; so is every
    text if nothing could be learned. Null doc_id or lang, repeated rows and further columns of
    any name are kept as they are inside ``row``; lang is never used for a prediction."""
    spark = ship(docs.sparkSession)
    trees = fit(docs, F.lit(True) if where is None else where, fit_docs)
    model = spark.sparkContext.broadcast(trees)
    schema = T.StructType([T.StructField("row", docs.schema), *RESULT])
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).mapInArrow(_identify(model), schema)
