"""Integer block codecs: size models in SQL functions, real bytes in Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..schema import ENTRY_BYTES, InvalidInput


def bit_pack_sizes(blocked: DataFrame) -> DataFrame:
    """Per block: widths of key and value offsets and the packed size in bytes."""
    b = blocked.groupBy("run", "block").agg(F.count("*").alias("n"), F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("value").alias("v0"), F.max("value").alias("v1"))
    kw, vw = codecs.width(F.col("k0"), F.col("k1")), codecs.width(F.col("v0"), F.col("v1"))
    out = b.select("run", "block", "n", kw.alias("key_bits"), vw.alias("value_bits"))
    # two minima and the two widths, then the offsets
    return out.withColumn("bytes", F.lit(18) + F.ceil(F.col("n") * (F.col("key_bits") + F.col("value_bits")) / 8))


def delta_sizes(blocked: DataFrame) -> DataFrame:
    """Per block: bytes of zigzag varints of consecutive differences, the first pair whole."""
    w = Window.partitionBy("run", "block").orderBy("key")
    d = blocked.select("run", "block", *(codecs.wrapped(F.col(c), F.lag(c).over(w)).alias(name) for c, name in (("key", "dk"), ("value", "dv"))))
    size = lambda c: F.coalesce(codecs.varint_bytes(F.col(c)), F.lit(0))
    return d.groupBy("run", "block").agg(F.count("*").alias("n"), (F.lit(ENTRY_BYTES) + F.sum(size("dk")) + F.sum(size("dv"))).cast("bigint").alias("bytes"))


def dictionary(pairs: DataFrame, most: int = codecs.DICTIONARY_MOST) -> DataFrame:
    """(key, value, n, code) of the most frequent pairs; ties by key and value. Only the top
    ``most`` rows are numbered, however many pairs there are."""
    top = pairs.groupBy("key", "value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key", "value").limit(most)
    return top.withColumn("code", F.row_number().over(Window.orderBy(F.desc("n"), "key", "value")) - 1)


def shapes(blocked: DataFrame) -> DataFrame:
    """What the adaptive rule looks at, per block."""
    w = Window.partitionBy("run", "block").orderBy("key")
    d = blocked.select("run", "block", "key", "value", codecs.wrapped(F.col("key"), F.lag("key").over(w)).alias("dk"))
    out = d.groupBy("run", "block").agg(
        F.count("*").alias("n"),
        (F.max("key").cast("decimal(20,0)") - F.min("key").cast("decimal(20,0)")).alias("key_range"),
        F.coalesce(F.min("dk") == F.max("dk"), F.lit(False)).alias("sequential"),
        (1 - F.count_distinct("value") / F.count("*")).alias("repetition"),
    )
    return out.withColumn("raw_bytes", F.col("n") * ENTRY_BYTES)


def _pack(x: np.ndarray) -> bytes:
    low = int(x.min())
    off = np.array([int(v) - low for v in x.tolist()], dtype=np.uint64)
    bits = max(1, int(off.max()).bit_length())
    m = ((off[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.array([low], "<i8").tobytes() + bytes([bits]) + np.packbits(m, bitorder="little").tobytes()


def _unpack(raw: bytes, n: int) -> tuple[np.ndarray, bytes]:
    low, bits = int(np.frombuffer(raw, "<i8", 1)[0]), raw[8]
    size = -(-n * bits // 8)
    m = np.unpackbits(np.frombuffer(raw, np.uint8, size, 9), count=n * bits, bitorder="little").reshape(n, bits)
    off = (m.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return (off + np.uint64(low & (2**64 - 1))).view(np.int64), raw[9 + size :]


def _varints(x: np.ndarray) -> bytes:
    out = bytearray()
    for v in x.tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _read_varints(raw: bytes, n: int) -> tuple[np.ndarray, bytes]:
    out, at = np.zeros(n, np.uint64), 0
    for i in range(n):
        v = shift = 0
        while raw[at] & 128:
            v |= (raw[at] & 127) << shift
            shift += 7
            at += 1
        out[i] = v | raw[at] << shift
        at += 1
    return out, raw[at:]


def encode_block(codec: str, key: np.ndarray, value: np.ndarray) -> bytes:
    """One block of pairs; differences wrap, so every 64-bit integer can be coded."""
    if codec in ("none", "snappy", "lz4"):
        raw = np.stack([key, value], 1).astype("<i8").tobytes()
        return raw if codec == "none" else pa.Codec({"snappy": "snappy", "lz4": "lz4_raw"}[codec]).compress(raw, asbytes=True)
    if codec == "bit_pack":
        return _pack(key) + _pack(value)
    if codec == "delta":
        out = np.array([key[0], value[0]], "<i8").tobytes()
        for x in (key, value):
            d = x.view(np.uint64)[1:] - x.view(np.uint64)[:-1]
            s = d.view(np.int64)
            out += _varints((d << np.uint64(1)) ^ (s >> np.int64(63)).view(np.uint64))
        return out
    if codec == "dictionary":
        pairs, code, n = np.unique(np.stack([key, value], 1), axis=0, return_inverse=True, return_counts=True)
        rank = np.lexsort((pairs[:, 1], pairs[:, 0], -n))
        if len(pairs) > codecs.DICTIONARY_MOST:
            raise InvalidInput("too many distinct pairs for one block's dictionary")
        new = np.empty(len(rank), np.int64)
        new[rank] = np.arange(len(rank))
        return np.array([len(pairs)], "<u2").tobytes() + pairs[rank].astype("<i8").tobytes() + new[code.ravel()].astype("<u2").tobytes()
    raise InvalidInput(f"unknown codec: {codec}")


def decode_block(codec: str, raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    if codec in ("none", "snappy", "lz4"):
        if codec != "none":
            raw = pa.Codec({"snappy": "snappy", "lz4": "lz4_raw"}[codec]).decompress(raw, n * ENTRY_BYTES, asbytes=True)
        x = np.frombuffer(raw, "<i8").reshape(n, 2)
        return x[:, 0].copy(), x[:, 1].copy()
    if codec == "bit_pack":
        key, raw = _unpack(raw, n)
        return key, _unpack(raw, n)[0]
    if codec == "delta":
        first, raw, out = np.frombuffer(raw, "<i8", 2), raw[16:], []
        for k in range(2):
            z, raw = _read_varints(raw, n - 1)
            d = (z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))
            out.append(np.cumsum(np.concatenate([first[k : k + 1].view(np.uint64), d]), dtype=np.uint64).view(np.int64))
        return out[0], out[1]
    if codec == "dictionary":
        m = int(np.frombuffer(raw, "<u2", 1)[0])
        pairs = np.frombuffer(raw, "<i8", 2 * m, 2).reshape(m, 2)
        x = pairs[np.frombuffer(raw, "<u2", n, 2 + 16 * m)]
        return x[:, 0].copy(), x[:, 1].copy()
    raise InvalidInput(f"unknown codec: {codec}")


def encode(blocked: DataFrame, codec: str) -> DataFrame:
    """(run, block, n, codec, checksum, payload); the codec is stored with its data."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        raw = encode_block(codec, pdf["key"].to_numpy(np.int64), pdf["value"].to_numpy(np.int64))
        return pd.DataFrame({"run": [pdf["run"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(pdf)], "codec": [codec], "checksum": [zlib.crc32(raw)], "payload": [raw]})

    return blocked.select("run", "block", "key", "value").groupBy("run", "block").applyInPandas(pack, "run long, block long, n long, codec string, checksum long, payload binary")


def decode(encoded: DataFrame) -> DataFrame:
    """(run, block, key, value) of encoded blocks; a wrong checksum is an error."""

    def unpack(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if zlib.crc32(r.payload) != r.checksum:
                    raise ValueError(f"checksum of run {r.run}, block {r.block}")
                key, value = decode_block(r.codec, r.payload, r.n)
                yield pd.DataFrame({"run": r.run, "block": r.block, "key": key, "value": value})

    return encoded.mapInPandas(unpack, "run long, block long, key long, value long")
