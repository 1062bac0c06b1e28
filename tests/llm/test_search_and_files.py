"""Top-k search, packing and token files against brute force and round trips."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kvspark.llm import dac, packing, topk

from .cases import DOCS, rows, split

VECTORS = "vec_id long, embedding array<double>, label int, score string"


def topk_brute(data, k):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in rows:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
            out |= {(q, r, i, -d) for r, (d, i) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("k", [1, 5, 300])
def test_topk(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 4)
    rng = random.Random(k)
    data = [(i, [round(rng.gauss(0, 1), 1) for _ in range(6)], None, None) for i in range(150)]
    data += [(i, data[i - 150][1], None, None) for i in range(150, 180)]  # ties
    data += [(200, None, 1, None), (None, [1.0] * 6, 1, None), (201, [1.0, None], 1, None), (202, [float("nan")] * 6, 1, None), (203, [float("inf")], 1, None), (204, [], 1, None), (205, [2.0, -1.0], 1, None), (220, [3e9] * 6, 1, None)]
    found = topk.top_k(spark.createDataFrame(data, VECTORS), F.col("vec_id") % 20 == 0, k)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == topk_brute(data, k)


def test_topk_empty(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 1, "x")], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_pruning_skips_blocks():
    rng = np.random.default_rng(3)
    c = np.floor(rng.normal(0, 20, (4096, 16)))
    c[:256] += 60  # one block holds the best
    q = np.full((4, 16), 30.0)
    who, what, score, scored = topk.search_group(np.arange(4) + 10_000, q, np.arange(4096), c, 10)
    assert scored < 4 * 16 / 2
    exact = (q @ c.T).astype(int)
    for i in range(4):
        assert sorted(score[who == 10_000 + i].tolist(), reverse=True) == sorted(exact[i].tolist(), reverse=True)[:10]


def padding_brute(lengths, k):
    names = sorted(set(lengths))
    best = None
    from itertools import combinations

    for r in range(min(k, len(names))):
        for cut in combinations(names[:-1], r):
            bounds = [*cut, names[-1]]
            cost = sum(min(b for b in bounds if b >= n) - n for n in lengths)
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries():
    rng = random.Random(5)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 25))]
        k = rng.randint(1, 4)
        c = Counter(lengths)
        bounds = packing.boundaries(np.array(list(c)), np.array(list(c.values())), k)
        assert len(bounds) <= k and bounds == sorted(bounds) and bounds[-1] == max(lengths)
        assert sum(min(b for b in bounds if b >= n) - n for n in lengths) == padding_brute(lengths, k)
    assert packing.boundaries(np.array([]), np.array([]), 3) == []


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 9)
    data = rows()
    got = packing.pack(spark.createDataFrame(data, DOCS), max_length=100, buckets=4, batch_tokens=250).collect()
    want = Counter()
    for r in data:
        n = len(split(r[1])) + 1
        for p in range(-(-n // 100)):
            want[(r[0], p, p * 100, min(100, n - p * 100))] += 1
    assert Counter((r.doc_id, r.piece, r.first, r.length) for r in got) == want
    padded = sorted({r.padded for r in got})
    c = Counter(r.length for r in got)
    assert padded == packing.boundaries(np.array(list(c)), np.array(list(c.values())), 4)
    assert all(r.padded == min(b for b in padded if b >= r.length) for r in got)
    batches = defaultdict(list)
    for r in got:
        batches[(r.bucket, r.batch)].append(r)
    for (bucket, batch), own in batches.items():
        room = max(1, 250 // own[0].padded)
        last = max(b for k, b in batches if k == bucket)
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == room if batch < last else len(own) <= room
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1, 0, 7], list(range(0, 70_000, 7))])
def test_codes(ids):
    raw = dac.encode(np.array(ids, np.uint32))
    d = dac.Dac(raw)
    assert len(d) == len(ids) and d.decode().tolist() == ids
    for i in [*range(0, len(ids), 37), len(ids) - 1] if ids else []:
        assert d[i] == ids[i]
    with pytest.raises(IndexError):
        d[len(ids)]
    with pytest.raises(ValueError):
        dac.Dac(b"nope" + raw[4:])


def test_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    data = rows() + [(500 + i, t, *[None] * 9) for i, t in enumerate(["<|startoftext|> a <|endoftext|>b", "a<|startoftext|>b <|startoftext|>", "don't İstanbul ΟΔΟΣ ́x y　12 ½\x85z\x0bq\x1cr", "é é"])]
    data += [(None, t, *[None] * 9) for t in (None, "no number", "z " * 2500, "no number")]
    out = str(tmp_path / "ids")
    dac.write_ids(spark.createDataFrame(data, DOCS), out, path, segment_ids=2000)
    got = dac.document_digests(spark, out).orderBy("start").collect()
    own = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    start = 0
    assert len(got) == len(own)
    for r, g in zip(own, got):
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    seg = dac.read_ids(spark, out).orderBy("start").collect()
    assert len(seg) > 3 and dac.Dac(bytes(seg[1].codes))[5] == dac.Dac(bytes(seg[1].codes)).decode()[5]


def test_files_empty(spark, tmp_path):
    out = str(tmp_path / "none")
    dac.write_ids(spark.createDataFrame([], DOCS), out, public_tokenizers.path("word_bpe_49k.json"))
    assert dac.document_digests(spark, out).count() == 0
