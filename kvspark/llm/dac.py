"""Token ids as directly addressable codes: a binary file format with random access."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import known, partitions, ship

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512  # one directory entry for so many bits
#: A segment of a file holds about so many ids: writers and readers need memory for one segment.
SEGMENT_IDS = 1 << 20

FILE = "first_doc long, n_docs long, n_null long, n_ids long, doc_ids binary, lengths binary, codes binary, shard int, segment int, shard_start long"


def encode(ids: np.ndarray) -> bytes:
    """Level k holds the k-th lowest byte of every id that has one, a bit for each that tells
    whether a further level follows, and the number of such bits before each 512th."""
    rest = ids.astype(np.uint32)
    levels = []
    while True:
        more = rest >= (1 << CHUNK_BITS)
        bits = np.packbits(more, bitorder="little")
        ranks = np.zeros(len(more) // RANK_BITS + 1, np.uint32)
        full = np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.int64)
        ranks[1:] = np.cumsum(full)[: len(ranks) - 1]
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            break
    head = MAGIC + np.array([len(levels), *(x[0] for x in levels)], "<u4").tobytes()
    return b"".join([head, *(part for x in levels for part in x[1:])])


class Dac:
    """Reads a coded sequence. ``dac[i]`` touches one byte and at most one directory block a level."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a DAC sequence")
        n_levels = int(np.frombuffer(raw, "<u4", 1, 4)[0])
        counts = np.frombuffer(raw, "<u4", n_levels, 8)
        at = 8 + 4 * n_levels
        self.levels = []
        for n in map(int, counts):
            chunks = np.frombuffer(raw, np.uint8, n, at)
            at += n
            bits = np.frombuffer(raw, np.uint8, -(-n // 8), at)
            at += -(-n // 8)
            ranks = np.frombuffer(raw, "<u4", n // RANK_BITS + 1, at)
            at += 4 * (n // RANK_BITS + 1)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(ranks[block]) + int(inside.sum())
        raise ValueError("truncated sequence")

    def decode(self) -> np.ndarray:
        """All ids, level by level from the deepest."""
        out = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            value[more] |= out << np.uint32(CHUNK_BITS)
            out = value
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes whole texts. No token of a vocabulary that drops white space crosses it, so each
    distinct run between white space is encoded once and the texts' ids are put together.
    A worker keeps what it has encoded."""

    GROUP = 2000  # runs that are encoded in one text, between marks
    KNOWN = 2_000_000  # runs whose ids a worker keeps

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end = _tokenizer(path), end_id
        # an added token that is cut out of a text before anything else parts the runs
        self.mark, self.mark_id = min(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.normalized or t.single_word)), key=lambda x: x[1], default=(None, -1))
        self._forget()

    def _forget(self) -> None:
        self.hash, self.half = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _look_up(self, w: K.Words) -> np.ndarray:
        """Where each run's ids are in the table of known runs; new runs are added."""
        distinct, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        half = K.mix((w.sums[(w.starts[first] + w.ends[first]) // 2] - w.sums[w.starts[first]]) * K.powers(len(w.buf) + 1)[0][w.starts[first]]) + (w.ends[first] - w.starts[first]).astype(np.uint64)
        if len(self.hash) > self.KNOWN:
            self._forget()
        at = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
        if len(self.hash):
            found = self.hash[at] == distinct
            if (self.half[at[found]] != half[found]).any():  # two runs with one hash
                self._forget()
                return self._look_up(w)
        else:
            found = np.zeros(len(distinct), bool)
        new = np.flatnonzero(~found)
        if len(new):
            raw = w.buf.tobytes()
            own = first[new]
            flat, begin, size = self._ids([raw[s:e].decode(errors="replace") for s, e in zip(w.starts[own].tolist(), w.ends[own].tolist())])
            order = np.argsort(np.concatenate([self.hash, distinct[new]]), kind="stable")
            self.hash, self.half, self.begin, self.size = (np.concatenate(x)[order] for x in ((self.hash, distinct[new]), (self.half, half[new]), (self.begin, begin + len(self.flat)), (self.size, size)))
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.hash, distinct)
        return at[which]

    def _ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of some runs, where each run's begin, and how many it has."""
        # a run that holds the mark, or any run if there is no mark, is a text of its own
        alone = [self.mark is None or self.mark in x for x in runs]
        texts: list[str] = []
        spans: list[list[int]] = []
        group: list[int] = []
        for i, own in enumerate(alone):
            if own:
                texts.append(runs[i])
                spans.append([i])
            else:
                group.append(i)
        for k in range(0, len(group), self.GROUP):
            part = group[k : k + self.GROUP]
            texts.append(self.mark.join([runs[i] for i in part]))
            spans.append(part)
        size = np.zeros(len(runs), np.int64)
        order, ids = [], []
        for span, e in zip(spans, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = np.array(e.ids, np.uint32)
            if len(span) > 1:
                cut = np.flatnonzero(own == self.mark_id)
                size[span] = np.diff(np.r_[-1, cut, len(own)]) - 1
                own = own[own != self.mark_id]
            else:
                size[span] = len(own)
            order += span
            ids.append(own)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        begin = np.zeros(len(runs), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return flat, begin, size

    def encode(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows, each row's followed by the end id, and how many each has."""
        w = K.words(buf, bounds, K.alphabet("space", False))
        at = self._look_up(w) if len(w.hashes) else np.zeros(0, np.int64)
        n = self.size[at]
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(w.first))
        per_row = np.bincount(row, weights=n, minlength=len(bounds) - 1).astype(np.int64) + 1
        out = np.full(int(per_row.sum()), self.end, np.uint32)
        total = int(n.sum())
        if total:
            source = np.arange(total) + np.repeat(self.begin[at] - (np.cumsum(n) - n), n)
            target = np.arange(total) + np.repeat(row, n)  # one end id for each earlier row
            out[target] = self.flat[source]
        return out, per_row


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def _write(path: str, end_id: int, segment_ids: int):
    def run(batches):
        from pyspark import TaskContext

        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        encoder = _encoder(path, end_id)
        docs, sizes, ids, n, n_null = [], [], [], 0, 0

        def close():
            nonlocal segment, before
            d = np.concatenate(docs)
            row = {"first_doc": int(d[0]) if n_null < len(d) else None, "n_docs": len(d), "n_null": n_null, "n_ids": n, "doc_ids": d.tobytes(), "lengths": np.concatenate(sizes).astype("<u4").tobytes(), "codes": encode(np.concatenate(ids)), "shard": shard, "segment": segment, "shard_start": before}
            segment, before = segment + 1, before + n
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            doc = pc.fill_null(b.column("doc_id"), 0).to_numpy()
            buf, bounds = K.text_buffers(b.column("text"))
            for i, j in K.slices(bounds):
                out, per_row = encoder.encode(buf, bounds[i : j + 1])
                docs.append(doc[i:j])
                n_null += b.column("doc_id").slice(i, j - i).null_count
                sizes.append(per_row)
                ids.append(out)
                n += len(out)
                if n >= segment_ids:
                    yield close()
                    docs, sizes, ids, n, n_null = [], [], [], 0, 0
        if docs:
            yield close()

    schema = pa.schema([("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("codes", pa.binary()), ("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64())])
    return run


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes the whole texts, appends ``end_id`` to each and writes the ids to ``out`` in
    ascending doc_id order: a Parquet container of one row for each segment with its documents'
    ids and lengths and the DAC sequence of their token ids.

    Null text is empty: only the end id. Rows with equal doc_id are kept, ordered by text. Rows
    with null doc_id come after all others; the last ``n_null`` documents of a segment are such. Other columns are ignored. ``tokenizer`` is the path of a
    tokenizers file whose pre-tokenizer drops white space."""
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = partitions(spark, n_bytes, 32 << 20)
    order = F.col("doc_id").asc_nulls_last()
    # many rows of one doc_id, or of none, are parted by how their texts begin, which keeps the order
    docs = docs.repartitionByRange(n, order, F.substring("text", 1, 32)).sortWithinPartitions(order, "text")
    docs.mapInArrow(_write(tokenizer, end_id, segment_ids), FILE).write.option("compression", "none").parquet(out)


def _digest(batches):
    for b in batches:
        starts = b.column("start").to_pylist()
        for i, start in enumerate(starts):
            doc = np.frombuffer(b.column("doc_ids")[i].as_buffer(), np.int64)
            null = np.arange(len(doc)) >= len(doc) - b.column("n_null")[i].as_py()
            size = np.frombuffer(b.column("lengths")[i].as_buffer(), "<u4").astype(np.int64)
            ids = Dac(b.column("codes")[i].as_py()).decode().astype("<u4")
            end = np.cumsum(size)
            crc = [zlib.crc32(ids[e - s : e]) for e, s in zip(end.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array(start + end - size), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark, path: str) -> DataFrame:
    """Segments of the written files, each with ``start``, the number of ids before it."""
    files = spark.read.schema(FILE).parquet(path)
    # a row for each shard: as many as the writing job had partitions
    totals = sorted(files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    begin, rows = 0, []
    for shard, n in totals:
        rows.append((shard, begin))
        begin += n
    starts = spark.createDataFrame(rows, "shard int, before long")
    return files.join(known(starts), "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before")


def document_digests(spark, path: str) -> DataFrame:
    """Per document of the written files: doc_id, start, n_tokens and ids_crc32."""
    return read_ids(spark, path).select("doc_ids", "n_null", "lengths", "codes", "start").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
