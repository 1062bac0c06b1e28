"""Exact substring dedup by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import PACKED, Packer, lean, only_ids, partitions, save, ship, spread, unpack

#: For any two positions some shift below 7 takes both into this set modulo 7.
PERIOD, COVER = 7, (0, 1, 3)

_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _within(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's row, position in the row, and the words from it to the row's end."""
    count = np.diff(w.first)
    row = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(row)) - w.first[row]
    return row, pos, count[row] - pos


def anchors(w: K.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, row, hash) of the anchors: short windows at cover positions, in rows that
    have a whole window. Two equal windows share an anchor at the same shift below PERIOD."""
    size = window - PERIOD + 1
    row, pos, left = _within(w)
    ok = np.isin(pos % PERIOD, COVER) & (left >= size) & (pos + left >= window)
    at = np.flatnonzero(ok)
    return at, row[at], K.window_hashes(w.hashes, size)[at]


def _slices(batch: pa.RecordBatch, col: str = "text") -> Iterator[tuple[int, int, K.Words]]:
    buf, bounds = K.text_buffers(batch.column(col))
    for i, j in K.slices(bounds):
        yield i, j, K.words(buf, bounds[i : j + 1], K.alphabet("space", False))


def _emit_anchors(window: int, labels: list[int]):
    def run(batches):
        packer = Packer(labels)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, w in _slices(b):
                _, row, key = anchors(w, window)
                if len(key):
                    yield from packer.add(ids[i:j], key, row)
        yield from packer.flush()

    return run


def _send(packer: Packer, doc: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sends values back to their documents, packed by a hash of doc_id."""
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    names, at = np.unique(doc, return_inverse=True)
    route = K.mix(names.view(np.uint64))
    for k in range(0, len(names), 20_000):
        lo, hi = np.searchsorted(at, [k, k + 20_000])
        for s in range(lo, hi, 1_000_000):
            own = at[s : min(hi, s + 1_000_000)]
            yield from packer.add(names[k : k + 20_000], route[own], own - k, value[s : min(hi, s + 1_000_000)])


def _shared(labels: list[int]):
    """The anchors that documents share with another document, sent back to them."""

    def run(batches):
        packer = Packer(labels)
        for key, doc, _ in unpack(batches).values():
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            keep = np.repeat(doc[start] != doc[start + size - 1], size)
            yield from _send(packer, doc[keep], key[keep])
        yield from packer.flush()

    return run


def _gather(batches):
    """One row for each document with all that was sent back to it."""
    for _, doc, value in unpack(batches).values():
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        ends = np.r_[cuts[1:], len(doc)]
        for k in range(0, len(cuts), 5000):
            blobs = [value[s:e].tobytes() for s, e in zip(cuts[k : k + 5000], ends[k : k + 5000])]
            yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[k : k + 5000]], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "hits"])


def _marked(b: pa.RecordBatch, row: int) -> np.ndarray:
    """The values that a document got back, sorted."""
    return np.sort(np.frombuffer(b.column("hits")[row].as_buffer(), np.uint64))


def _isin(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(found, x), len(found) - 1)
    return found[at] == x


def _forward(mask: np.ndarray, n: int, size: int) -> np.ndarray:
    """Word positions within ``size`` of a marked start, up to ``n``."""
    steps = np.zeros(n + size + 1, np.int32)
    at = np.flatnonzero(mask)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps)[:n] > 0


def _emit_windows(window: int, labels: list[int]):
    """Windows around shared anchors, the only ones that can repeat."""

    def run(batches):
        packer = Packer(labels)
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for i, j, w in _slices(b):
                at, row, key = anchors(w, window)
                low = key & np.uint64(0xFFFF_FFFF_FFFF)
                one = K.window_hashes(w.hashes, window)
                two = K.window_hashes(w.hashes, window, 0x7F4A7C15)
                for r in range(i, j):
                    lo, hi = w.first[r - i], w.first[r - i + 1]
                    if hi - lo < window:
                        continue
                    own = slice(*np.searchsorted(row, [r - i, r - i + 1]))
                    hit = at[own][_isin(low[own], _marked(b, r))] - lo
                    starts = np.zeros(hi - lo + PERIOD, bool)
                    for s in range(PERIOD):
                        starts[hit + PERIOD - 1 - s] = True  # the window begins s words before its anchor
                    starts = np.flatnonzero(starts) - (PERIOD - 1)
                    starts = starts[(starts >= 0) & (starts <= hi - lo - window)] + lo
                    if len(starts):
                        yield from packer.add(ids[r : r + 1], one[starts], np.zeros(len(starts), np.int64), two[starts])
        yield from packer.flush()

    return run


def _later(labels: list[int]):
    """Those windows of documents that a smaller document has, sent back to them."""

    def run(batches):
        packer = Packer(labels)
        for key, doc, extra in unpack(batches).values():
            order = np.lexsort((doc, extra, key))
            key, extra, doc = key[order], extra[order], doc[order]
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (extra[1:] != extra[:-1])])
            late = doc > np.repeat(doc[start], np.diff(np.r_[start, len(key)]))
            yield from _send(packer, doc[late], extra[late])
        yield from packer.flush()

    return run


def _cut(window: int, repeats: bool):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            out: dict[str, list] = {"n": [], "gone": [], "sha": [], "text": []}
            for i, j, w in _slices(b):
                two = K.window_hashes(w.hashes, window, 0x7F4A7C15) if repeats else None
                for r in range(i, j):
                    lo, hi = w.first[r - i], w.first[r - i + 1]
                    gone = None
                    if repeats and hi - lo >= window:
                        marked = _isin(two[lo : hi - window + 1], _marked(b, r))
                        gone = _forward(marked, hi - lo, window)
                    at = np.arange(lo, hi) if gone is None else np.arange(lo, hi)[~gone]
                    text = _join(w.buf, w.starts[at], w.ends[at])
                    out["n"].append(hi - lo)
                    out["gone"].append(0 if gone is None else int(gone.sum()))
                    out["sha"].append(hashlib.sha256(text).hexdigest())
                    out["text"].append(text.decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out["n"], pa.int64()), pa.array(out["gone"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["text"], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _join(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    total = int(size.sum())
    first = np.cumsum(size) - size
    at = np.arange(total) + np.repeat(starts - first, size)
    last = first + size - 1
    at[last] = 0
    out = buf[at]
    out[last] = 0x20
    return out[:-1].tobytes()


def remove_repeats(docs: DataFrame, window: int = 13, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept.

    Words are runs without ASCII white space, as they are. Each word covered by a window of
    ``window`` words that also starts in a document with a smaller doc_id is removed; windows
    are judged on the input. kept is the other words joined by one space.

    Anchors are hashed at cover positions only (3 of 7). Equal windows of two documents
    share an anchor at the same shift, so only windows around anchors that two documents
    share are extended to full length, compared by 112 bits of hash and traced to their
    smallest document.

    Null or empty text: no words. Rows with equal doc_id are one document to each other
    (neither is the smaller), and each gets its result. A null doc_id is neither smaller nor
    larger than another: its row keeps all words. Other columns are ignored."""
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD}")
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    n_bytes = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # about one anchor for 15 bytes of text, 8 bytes each
    parts = partitions(spark, n_bytes * 0.55)
    labels = spread(spark, parts)

    def traced(packed: DataFrame, find, name: str) -> DataFrame:
        back = packed.repartition(parts, "part").mapInArrow(lean(find(labels)), PACKED)
        return save(back.repartition(parts, "part").mapInArrow(lean(_gather), "doc_id long, hits binary"), name)

    def returned(hits: DataFrame) -> DataFrame:
        return only_ids(known, hits.select("doc_id"), "doc_id").join(hits, "doc_id").select("doc_id", "text", "hits")

    shared = traced(known.mapInArrow(lean(_emit_anchors(window, labels)), PACKED), _shared, "anchors")
    late = traced(returned(shared).mapInArrow(lean(_emit_windows(window, labels)), PACKED), _later, "windows")
    schema = _RESULT + ", kept string"
    ids = late.select("doc_id")
    out = returned(late).mapInArrow(lean(_cut(window, True)), schema).union(only_ids(docs, ids, "doc_id", "left_anti").select("doc_id", "text").mapInArrow(lean(_cut(window, False)), schema))
    return out if keep_text else out.drop("kept")
