"""Benchmark decontamination by a prefix-filtered join with item-sized windows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .tables import ship

#: Items are matched in blocks of about so many words: what is broadcast never exceeds that,
#: however large the benchmark is; a larger one takes more passes over the documents.
BLOCK_WORDS = 1_000_000

#: What the operator adds to each row.
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hits", T.BinaryType()),
]


@dataclass
class Index:
    """Windows of one block of items, by prefix word."""

    prefix: np.ndarray  # sorted word hashes
    bounds: np.ndarray  # windows of each prefix word
    window: np.ndarray  # window numbers, by prefix word
    offset: np.ndarray  # where in the window its prefix word is
    size: np.ndarray  # words of each window
    hash: np.ndarray
    text: list[bytes]
    items: list[list[str]]


def _tokens(text: str) -> K.Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    return K.words(raw, np.array([0, len(raw)]), K.alphabet("alnum", True))


def _windows(items: list[tuple[str, str]], size: int) -> dict[tuple[int, ...], tuple[bytes, set[str]]]:
    found: dict[tuple[int, ...], tuple[bytes, set[str]]] = {}
    for item, text in items:
        w = _tokens(text)
        n = len(w.hashes)
        for i in range(max(0, n - size) + 1) if n else ():
            j = min(n, i + size)
            words = b" ".join(w.text(k).lower() for k in range(i, j))
            found.setdefault(tuple(w.hashes[i:j].tolist()), (words, set()))[1].add(item)
    return found


def build_index(items: list[tuple[str, str]], count: dict[int, int], size: int) -> Index:
    """Of each window the rarest word is its prefix: a text that contains the window has it."""
    found = _windows(items, size)
    rows = []
    for k, words in enumerate(found):
        o = min(range(len(words)), key=lambda i: (count.get(words[i], 0), words[i], i))
        rows.append((words[o], k, o))
    rows.sort()
    prefix = np.array([r[0] for r in rows], np.uint64)
    first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(rows) else np.zeros(0, np.int64)
    hashes = [int(K.window_hashes(np.array(w, np.uint64), len(w))[0]) for w in found]
    return Index(prefix[first], np.r_[first, len(rows)], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.array([len(w) for w in found], np.int64), np.array(hashes, np.uint64), [v[0] for v in found.values()], [sorted(v[1]) for v in found.values()])


def _vocabulary_counts(words: np.ndarray):
    """How often each benchmark word occurs in this task's documents."""

    def run(batches):
        total = np.zeros(len(words), np.int64)
        for b in batches:
            buf, bounds = K.text_buffers(b.column("text"))
            for i, j in K.slices(bounds):
                h = K.words(buf, bounds[i : j + 1], K.alphabet("alnum", True)).hashes
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                total += np.bincount(at[words[at] == h], minlength=len(words))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["word", "n"])

    return run


def _matches(w: K.Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of all occurrences in the rows of ``w``."""
    h = w.hashes
    none = np.zeros(0, np.int64)
    if not len(h) or not len(index.prefix):
        return none, none
    quick = np.zeros(1 << 16, bool)
    quick[(index.prefix >> np.uint64(48)).astype(np.int64)] = True
    p = np.flatnonzero(quick[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.prefix, h[p]), len(index.prefix) - 1)
    keep = index.prefix[at] == h[p]
    p, at = p[keep], at[keep]
    n = index.bounds[at + 1] - index.bounds[at]
    each = np.repeat(np.arange(len(p)), n)
    k = index.bounds[at][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    window = index.window[k]
    start = p[each] - index.offset[k]
    # position and length: the window lies within the row of its prefix word
    row = np.searchsorted(w.first, p, side="right") - 1
    lo, hi = w.first[row][each], w.first[row + 1][each]
    keep = (start >= lo) & (start + index.size[window] <= hi)
    window, start = window[keep], start[keep]
    ok = np.zeros(len(start), bool)
    for size in np.unique(index.size[window]):
        own = index.size[window] == size
        ok[own] = K.window_hashes(h, int(size))[start[own]] == index.hash[window[own]]
    window, start = window[ok], start[ok]
    exact = [index.text[v] == b" ".join(w.text(i).lower() for i in range(s, s + index.size[v])) for v, s in zip(window.tolist(), start.tolist())]
    exact = np.array(exact, bool)
    return window[exact], start[exact]


def _mark(index):
    """Adds one block's hits to those found so far."""

    def run(batches):
        block = index.value
        for b in batches:
            row = b.column("row")
            text = row.field(row.type.get_field_index("text"))
            buf, bounds = K.text_buffers(text)
            before = {n: b.column(n).to_pylist() for n in ("items", "hits")}
            n_words, n_hit, items, hits = [], [], [], []
            for i, j in K.slices(bounds):
                w = K.words(buf, bounds[i : j + 1], K.alphabet("alnum", True))
                window, start = _matches(w, block)
                mask = np.zeros(len(w.hashes) + 1, np.int32)
                np.add.at(mask, start, 1)
                np.add.at(mask, start + block.size[window], -1)
                mask = np.cumsum(mask)[:-1] > 0
                owner = np.searchsorted(w.first, start, side="right") - 1
                found: dict[int, set[str]] = {}
                for o, v in zip(owner.tolist(), window.tolist()):
                    found.setdefault(o, set()).update(block.items[v])
                for r in range(i, j):
                    own = mask[w.first[r - i] : w.first[r - i + 1]]
                    known = before["hits"][r]
                    if known is not None:
                        own = own | np.unpackbits(np.frombuffer(known, np.uint8), count=len(own)).astype(bool)
                    names = sorted(found.get(r - i, set()) | set(before["items"][r] or ()))
                    n_words.append(len(own))
                    n_hit.append(int(own.sum()))
                    items.append(names)
                    hits.append(np.packbits(own).tobytes() if names else None)
            cols = [row, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", *(f.name for f in RESULT)])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``row`` (the whole row as a struct), n_words, n_hit, n_items,
    items (their ids as strings, sorted) and hits (a bit for each word, null without items).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded. A window is
    ``window`` consecutive words of an item; an item of fewer, but not none, is one window. A
    document word is hit if it is inside an occurrence of a window.

    The words of the benchmark are counted over all documents. Each window is joined by its
    rarest word (for exact containment the necessary prefix is one word); an occurrence must
    fit its row before and after that word, and is then compared word by word. The benchmark
    is broadcast in blocks of bounded size, one pass for each.

    Null or empty text: no words, no hits. An item with null id or no words has no windows; rows
    of equal item_id are one item. Repeated documents are judged alike, each on its own. Other
    columns, whatever their names, stay inside ``row``. Without items nothing is hit."""
    spark = ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n_words = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / 5
    n_blocks = max(1, int(-(-n_words // block_words)))
    schema = T.StructType([T.StructField("row", docs.schema), *RESULT])
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    for f in RESULT:
        out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = spark.createDataFrame([], schema) if not docs.columns else out.select(*(f.name for f in schema))
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        rows = [(r[0], r[1]) for r in block.collect()]
        words = np.unique(np.array([h for _, text in rows for h in _tokens(text).hashes.tolist()], np.uint64))
        count: dict[int, int] = {}
        if len(words):
            counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_vocabulary_counts(words), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
            count = {int(words[i]): n for i, n in counted.collect()}
        index = spark.sparkContext.broadcast(build_index(rows, count, window))
        out = out.mapInArrow(_mark(index), schema)
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
