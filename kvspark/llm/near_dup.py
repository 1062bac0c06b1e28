"""N-gram Jaccard join by parity sketches (exact links, one row per document)."""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import CANDIDATES, PACKED, Candidates, Packer, drop, joined, known, known_bytes, lean, link, only_ids, partitions, runs_of, save, ship, spread, unpack

#: Sizes of one band differ by less than this factor. Linked sets are in one band or in two adjacent ones.
BAND = 4 / 3
#: A shingle in at least so many documents, and in at least this share of all, is called
#: frequent. At most (mean set size / share) shingles are, which bounds the broadcast list.
FREQUENT_DOCS, FREQUENT_SHARE = 50, 2e-4

#: Candidate pairs are compared in so many passes, one after the other: the disk holds the shuffles of one.
PASSES = 2

_STATS = "node long, doc_id long, text_hash long, n long, d1 long, d2 long, band int, own binary, next binary, shingles binary"


@lru_cache(maxsize=1 << 16)
def band_of(n: int) -> int:
    k = int(math.log(n) / math.log(BAND))
    while math.ceil(BAND ** (k + 1)) <= n:
        k += 1
    while k and math.ceil(BAND**k) > n:
        k -= 1
    return k


@lru_cache(maxsize=1 << 10)
def _most(band: int) -> int:
    return math.ceil(BAND ** (band + 1)) - 1


def sketch(shingles: np.ndarray, band: int) -> bytes:
    """One bit per hash bucket: the parity of the shingles in it. The Hamming distance of
    two sketches never exceeds the sets' symmetric difference."""
    bits = 64 * max(1, math.ceil(3 * _most(band) / 64))
    at = K.scale(K.mix(shingles + K.U64(band * 2 + 1)), bits).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def most_apart(a, b, threshold: float):
    """The largest symmetric difference of linked sets of sizes a and b."""
    p = round(threshold * 100)
    return (a + b) * (100 - p) // (100 + p)


def block_keys(shingles: np.ndarray, band: int, threshold: float, frequent: np.ndarray) -> np.ndarray:
    """Keys of which any two linked sets of this band (the larger one's) share one.

    The bucket space is cut into B blocks, and each block's parity hash is the XOR of its
    shingles' hashes. Linked sets differ in at most d shingles and so in at most d blocks:
    any order of block contents that all sets use alike makes their first d + 1 share one.
    Blocks with many infrequent shingles come first, empty ones last."""
    most = _most(band)
    d = int(most_apart(most, most, threshold))
    blocks = 2 * (d + 1) + 8
    at = K.scale(K.mix(shingles ^ K.U64(band * 7919 + 1)), blocks).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, s = at[order], shingles[order]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    xor = np.bitwise_xor.reduceat(s, start)
    at, size = at[start], np.diff(np.r_[start, len(s)])
    rare = size
    if len(frequent):
        pos = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        rare = np.add.reduceat((frequent[pos] != s).astype(np.int64), start)
    if len(at) <= d:  # too few blocks are filled: empty ones belong to the first d + 1 as well
        empty = np.setdiff1d(np.arange(blocks), at)
        at, xor = np.r_[at, empty], np.r_[xor, np.zeros(len(empty), K.U64)]
        size, rare = np.r_[size, np.zeros(len(empty), np.int64)], np.r_[rare, np.zeros(len(empty), np.int64)]
    key = K.mix(xor + K.mix(at.astype(K.U64) * K.U64(4096) + K.U64(band)))
    return key[np.lexsort((key, -size, -rare))[: d + 1]]


def slice_keys(sets: list[np.ndarray], threshold: float, frequent: np.ndarray, which: tuple[int, ...] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of :func:`block_keys` in each set's own and next band, for many sets; ``which``: of
    these in even bands, odd bands or both."""
    n = np.array([len(s) for s in sets])
    whole = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    common = np.zeros(len(whole), bool)
    if len(frequent):
        pos = np.minimum(np.searchsorted(frequent, whole), len(frequent) - 1)
        common = frequent[pos] == whole
    first = np.array([band_of(k) for k in n.tolist()])
    names, keys = [], []
    for odd in which:
        band = first + ((first ^ odd) & 1)
        most = np.array([_most(k) for k in band.tolist()])
        d = most_apart(most, most, threshold)
        blocks = 2 * (d + 1) + 8
        seed = (band * 7919 + 1).astype(np.uint64)[owner]
        at = ((K.mix(whole ^ seed) >> K.U64(32)) * blocks.astype(np.uint64)[owner] >> K.U64(32)).astype(np.int64)
        place = owner << 32 | at
        order = np.argsort(place)
        place, h = place[order], whole[order]
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        xor = np.bitwise_xor.reduceat(h, start)
        size = np.diff(np.r_[start, len(h)])
        rare = np.add.reduceat((~common[order]).astype(np.int64), start)
        own, at = place[start] >> 32, place[start] & 0xFFFFFFFF
        key = K.mix(xor + K.mix(at.astype(K.U64) * K.U64(4096) + band.astype(np.uint64)[own]))
        # by set, then many rare shingles, many shingles, small key
        order = np.argsort(key)
        rank = own[order] << 40 | (0xFFFFF - np.minimum(rare, 0xFFFFF))[order] << 20 | (0xFFFFF - np.minimum(size, 0xFFFFF))[order]
        order = order[np.argsort(rank, kind="stable")]
        own, key = own[order], key[order]
        begin = np.searchsorted(own, np.arange(len(sets) + 1))
        keep = np.arange(len(own)) - begin[own] <= d[own]
        full = np.diff(begin) > d
        keep &= full[own]
        names.append(own[keep])
        keys.append(key[keep])
        for k in np.flatnonzero(~full).tolist():  # empty blocks belong to these sets' keys
            more = block_keys(sets[k], int(band[k]), threshold, frequent)
            names.append(np.full(len(more), k))
            keys.append(more)
    return np.concatenate(names), np.concatenate(keys)


def _sets(batch: pa.RecordBatch, size: int):
    """Rows that have words and their sets of distinct shingles, a slice at a time."""
    alpha = K.alphabet("space", True)
    buf, bounds = K.text_buffers(batch.column("text"))
    for i, j in K.slices(bounds):
        w = K.words(buf, bounds[i : j + 1], alpha)
        g = K.window_hashes(w.hashes, size)
        rows, sets = [], []
        for r, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist()), i):
            if hi > lo:
                rows.append(r)
                sets.append(_distinct(g[lo : hi - size + 1]) if hi - lo >= size else K.shingle_set(w.hashes[lo:hi], size))
        if rows:
            yield rows, sets


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[:1] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def digest(s: np.ndarray) -> tuple[int, int]:
    n = np.uint64(len(s))
    with np.errstate(over="ignore"):
        x = K.mix(np.array([np.bitwise_xor.reduce(s) + n, np.add.reduce(K.mix(s ^ K.U64(0x5851F42D4C957F2D))) ^ n], K.U64))
    return int(x.view(np.int64)[0]), int(x.view(np.int64)[1])


def tag_of(d1: int, n: int) -> int:
    """A set's name in blobs: 44 bits of its digest and its size, up to 20 bits."""
    return (d1 & ~0xFFFFF) | min(n, 0xFFFFF)


def _stats(size: int, local: int):
    """Rows of documents, and lists of shingles that are in ``local`` or more documents nearby."""

    def run(batches):
        from pyspark import TaskContext

        node = TaskContext.get().partitionId() << 40
        near: list[np.ndarray] = []
        pending = 0

        def often():
            s, c = np.unique(np.concatenate(near), return_counts=True)
            s, c = s[c >= local], c[c >= local]
            blob = s.tobytes() + c.astype(np.int64).tobytes()
            return pa.RecordBatch.from_pylist([{"shingles": blob}], schema)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = {x: [] for x in ("n", "d1", "d2", "band", "own", "next")}
            found = dict.fromkeys(range(len(ids)))
            for rows, sets in _sets(batch, size):
                for r, s in zip(rows, sets):
                    band = band_of(len(s))
                    found[r] = (len(s), *digest(s), band, sketch(s, band), sketch(s, band + 1))
                near += sets
                pending += sum(map(len, sets))
                if pending > 1_000_000:
                    yield often()
                    near, pending = [], 0
            for r in range(len(ids)):
                for k, v in zip(out, found[r] or (0, None, None, None, None, None)):
                    out[k].append(v)
            cols = {"node": range(node, node + len(ids)), "doc_id": ids, "text_hash": batch.column("text_hash"), **out, "shingles": [None] * len(ids)}
            node += len(ids)
            yield pa.RecordBatch.from_arrays([cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type) for f in schema], schema=schema)
        if near:
            yield often()

    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("band", pa.int32()), ("own", pa.binary()), ("next", pa.binary()), ("shingles", pa.binary())])
    return run


def _unlist(batches):
    for b in batches:
        for blob in b.column(0).to_pylist():
            x = np.frombuffer(blob, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[: len(x) // 2]), pa.array(x[len(x) // 2 :])], ["s", "c"])


def _keys(size: int, threshold: float, frequent: np.ndarray, labels: list[int], odd: int):
    def run(batches):
        packer = Packer(labels)
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for _, sets in _sets(batch, size):
                new, tags = [], []
                for s in sets:
                    d = digest(s)
                    if d not in done:  # a copy in the same task adds nothing
                        done.add(d)
                        new.append(s)
                        tags.append(tag_of(d[0], len(s)))
                if new:
                    index, keys = slice_keys(new, threshold, frequent, (odd,))
                    yield from packer.add(np.array(tags), keys, index)
                if len(done) > 200_000:
                    done.clear()
        yield from packer.flush()

    return run


def _pair_up(small: int, threshold: float):
    p = round(threshold * 100)

    def run(batches):
        for key, node, _ in unpack(batches).values():
            _, node, start, size = runs_of(key, node)
            n = node & 0xFFFFF

            def near(i, j, n=n):
                return np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * p

            yield from Candidates(small).emit(node, start, size, near)

    return run


def _near_sketches(threshold: float):
    """Keeps pairs whose sizes and sketches, in the larger one's band, allow a link."""
    p = round(threshold * 100)

    def run(batches):
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            step = b.column("ba").to_numpy() - b.column("bb").to_numpy()
            most = most_apart(na, nb, threshold)
            keep = (np.abs(step) <= 1) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * p)
            for i in np.flatnonzero(keep).tolist():
                u, v = (np.frombuffer(b.column(("next" if d else "own") + x)[i].as_buffer(), np.uint64) for x, d in (("a", step[i] < 0), ("b", step[i] > 0)))
                keep[i] = int(np.bitwise_count(u ^ v).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _near_in_run(threshold: float):
    """Which pairs of some nodes can link: sizes first, then sketches in the larger one's band."""
    p = round(threshold * 100)

    def near(infos):
        n, band = infos.field("n").to_numpy(), infos.field("band").to_numpy()
        rows = np.zeros(len(n), np.int64)
        sketches = {}
        for k in np.unique(band).tolist():
            at = np.flatnonzero(band == k)
            rows[at] = np.arange(len(at))
            for which in ("own", "next"):
                col = infos.field(which)
                sketches[k, which] = np.stack([np.frombuffer(col[int(i)].as_buffer(), np.uint64) for i in at])

        def close(i, j):
            out = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * p
            most = most_apart(n[i], n[j], threshold)
            step = band[i] - band[j]
            out &= np.abs(step) <= 1
            for k in np.unique(band[i[out]]).tolist():
                for d, mine, theirs in ((0, "own", "own"), (-1, "next", "own"), (1, "own", "next")):
                    at = np.flatnonzero(out & (band[i] == k) & (step == d))
                    for c in range(0, len(at), 50_000):
                        own = at[c : c + 50_000]
                        x = sketches[k, mine][rows[i[own]]] ^ sketches[k - d, theirs][rows[j[own]]]
                        out[own] = np.bitwise_count(x).sum(axis=1) <= most[own]
            return out

        return close

    return near


def _texts(size: int):
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            d1, d2, packed = [], [], []
            for rows, sets in _sets(batch, size):
                for r, s in zip(rows, sets):
                    d = digest(s)
                    d1.append(d[0])
                    d2.append(d[1])
                    packed.append(zlib.compress(text[r].as_py().encode(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(packed, pa.binary())], ["d1", "d2", "packed"])

    return run


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    """The set of a compressed text."""
    raw = zlib.decompress(packed)
    return K.shingle_set(K.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), K.alphabet("space", True)).hashes, size)


def _same(size: int, threshold: float):
    """Pairs whose sets' exact Jaccard similarity reaches the threshold."""
    p = round(threshold * 100)

    def run(batches):
        last, left = None, None
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            a = b.column("a").to_pylist()
            for i in range(b.num_rows):
                sets = []
                for col, have in (("ta", a[i] == last), ("tb", False)):
                    if not have:
                        sets.append(_unpacked(b.column(col)[i].as_py(), size))
                    else:
                        sets.append(left)
                last, left = a[i], sets[0]
                both = len(np.intersect1d(*sets, assume_unique=True))
                keep[i] = 100 * both >= p * (len(sets[0]) + len(sets[1]) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _same_in_run(size: int, threshold: float):
    """Which pairs of some nodes link, set against set; a node's set is made once."""
    p = round(threshold * 100)

    def match(infos):
        packed, sets = infos.field("packed"), {}

        def of(k):
            if k not in sets:
                sets[k] = _unpacked(packed[k].as_py(), size)
            return sets[k]

        def same(i, j):
            out = np.zeros(len(i), bool)
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                x, y = of(x), of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out[k] = 100 * both >= p * (len(x) + len(y) - both)
            return out

        return same

    return match


def jaccard_components(docs: DataFrame, size: int = 5, threshold: float = 0.75, small: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, component (a number for
    each component), node (a number for each row) and text_hash (xxhash64 of the text).

    Words are runs without ASCII white space, A-Z folded. A text's set holds its distinct
    ``size``-word shingles, or the whole word sequence if it is shorter. Two texts link when
    the Jaccard similarity of their sets is at least ``threshold`` (in hundredths, exact).

    Equal sets are one node. Nodes that can link share a parity-block key (see
    :func:`block_keys`) in their size band; pairs whose bit sketches are too far apart are
    dropped, and the rest are compared set against set. component_id is the smallest doc_id
    of the component.

    Null text, or text without words: n_shingles 0, component_id is the row's own doc_id.
    Rows with equal doc_id are separate documents. A null doc_id links like others and is
    never the component_id, unless the component has no other (then null). Other columns are
    ignored; an empty table gives an empty result."""
    spark = ship(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    table = save(docs.mapInArrow(lean(_stats(size, 3)), _STATS), "stats")
    rows = table.where("shingles is null").drop("shingles")
    n_docs, n_shingles = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = table.where("shingles is not null").select("shingles").mapInArrow(_unlist, "s long, c long")
    often = often.groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= max(FREQUENT_DOCS, int(FREQUENT_SHARE * n_docs)))
    frequent = np.sort(np.array([r[0] for r in often.select("s").collect()], np.int64).view(np.uint64))

    # keys hold their band's number: those of even and of odd bands are shuffled one after the other
    parts = partitions(spark, n_shingles * 0.4 * 8)
    labels, found = spread(spark, parts), []
    for odd in (0, 1):
        packed = docs.mapInArrow(lean(_keys(size, threshold, frequent, labels, odd)), PACKED)
        found.append(save(packed.repartition(parts, "part").mapInArrow(lean(_pair_up(small, threshold)), CANDIDATES), "candidates", small=True))
    found = joined(found)

    nodes = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("node").alias("node"), F.min("doc_id").alias("doc_id"))
    nodes = save(nodes, "nodes")
    # unlike sets with one tag would be two nodes with one name: both are compared
    tagged = nodes.withColumn("tag", F.col("d1").bitwiseAND(F.lit(~0xFFFFF)).bitwiseOR(F.least("n", F.lit(0xFFFFF))))
    ids = found.select(F.explode(F.coalesce("members", F.array("a", "b"))).alias("tag")).distinct()
    wanted = save(tagged.join(ids, "tag", "left_semi"), "wanted")
    some = save(rows.where("n > 0").select("node", "n", "band", "own", "next").join(known(wanted.select("node")), "node", "left_semi"), "sketches")
    sketches = known_bytes(some, "own", "next")

    def fetch(ids: DataFrame) -> DataFrame:
        own = known(save(wanted.join(known(ids), "node", "left_semi").select("d1", "d2", "node", "doc_id"), "named"))
        texts = only_ids(docs.where("doc_id is not null"), own.select("doc_id").where("doc_id is not null").distinct(), "doc_id").select("text")
        if own.where("doc_id is null").take(1):
            texts = texts.union(docs.where("doc_id is null").select("text"))
        texts = texts.mapInArrow(lean(_texts(size)), "d1 long, d2 long, packed binary")
        return save(texts.join(own.select("d1", "d2", "node"), ["d1", "d2"]).select("node", "packed").dropDuplicates(["node"]), "texts")

    def screen(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(sketches.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("band").alias("b" + x), F.col("own").alias("own" + x), F.col("next").alias("next" + x)), x)
        return pairs.mapInArrow(lean(_near_sketches(threshold)), "a long, b long")

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        texts = known_bytes(texts, "packed")
        ta, tb = (texts.select(F.col("node").alias(x), F.col("packed").alias("t" + x)) for x in "ab")
        both = pairs.join(tb, "b").join(ta, "a").sortWithinPartitions("a")
        return both.mapInArrow(lean(_same(size, threshold)), "a long, b long")

    # from here on nodes stand for tags
    names = known(save(wanted.select("tag", "node"), "names"))
    pairs = found.where("members is null").select("a", "b")
    pairs = pairs.join(names.select(F.col("tag").alias("a"), F.col("node").alias("x")), "a").join(names.select(F.col("tag").alias("b"), F.col("node").alias("y")), "b")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(None).cast("array<bigint>").alias("members"))
    runs = found.where("members is not null").select(F.xxhash64("members").alias("run"), F.explode("members").alias("tag"))
    runs = runs.join(names, "tag").groupBy("run").agg(F.sort_array(F.collect_list("node")).alias("members"))
    runs = runs.select(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "members")
    def info(texts: DataFrame) -> DataFrame:
        return sketches.join(known_bytes(texts, "packed"), "node").select("node", F.struct("n", "band", "own", "next", "packed").alias("info"))

    named = save(pairs.union(runs), "named", small=True)
    drop(found)
    comps = link(named, screen, fetch, verify, info, _near_in_run(threshold), _same_in_run(size, threshold), PASSES)
    drop(wanted, some)

    classes = nodes.join(comps, "node", "left").select("d1", "d2", "node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    lowest = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = save(classes.join(lowest, "comp").select("d1", "d2", "component_id", F.col("comp").alias("component")), "classes", small=True)
    drop(nodes)
    own = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "component", "node", "text_hash"]
    full = rows.where("n > 0").join(classes, ["d1", "d2"]).select(*own)
    return full.union(rows.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.col("node")).select(*own))


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then of
    the smallest text_hash. Rows without words are components of their own and all stay."""
    found = save(jaccard_components(docs, size, threshold), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "text_hash")
    kept = found.groupBy("component").agg(F.min(rank).alias("r")).select(F.col("r.x").alias("_kept_x"), F.col("r.doc").alias("_kept_doc"), F.col("r.text_hash").alias("_kept_hash"))
    kept = save(kept.distinct(), "kept")
    row = [F.col("doc_id").isNull().alias("_kept_x"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_kept_doc"), F.xxhash64(F.col("text").cast("string")).alias("_kept_hash")]
    keys = ["_kept_x", "_kept_doc", "_kept_hash"]
    named = docs.select(*row, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = only_ids(named, kept, keys)
    again = found.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1")
    if again.take(1):  # whole rows that repeat
        twice = save(again.select(F.col("doc_id").isNull().alias("_kept_x"), F.coalesce("doc_id", F.lit(0)).alias("_kept_doc"), F.col("text_hash").alias("_kept_hash")), "again")
        out = only_ids(out, twice, keys, "left_anti").unionByName(only_ids(out, twice, keys).dropDuplicates(keys))
    return out.select("row.*")
