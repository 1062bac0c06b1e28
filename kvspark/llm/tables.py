"""Written tables, packed shuffles and connected components for the operators here."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A set of ids is broadcast as a filter only up to so many rows (about 16 bytes each).
MAX_BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is set and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(_remove_local, path)
    return path


#: Rows of one Arrow batch: what a Python worker holds at a time is so many texts. A session that
#: has its own setting keeps it.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> SparkSession:
    """Sends this subpackage to the executors, once for each application, and makes Arrow batches
    smaller than Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", None) is None:
        here = Path(__file__).resolve().parent
        where = Path(tempfile.mkdtemp(prefix="llm-code-"))
        atexit.register(_remove_local, str(where))
        with zipfile.ZipFile(where / "kvspark_llm.zip", "w") as z:
            for f in [here.parent / "__init__.py", *sorted(here.glob("*.py"))]:
                z.write(f, f.relative_to(here.parent.parent))
        sc.addPyFile(str(where / "kvspark_llm.zip"))
        sc._llm_shipped = True
    return spark


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which the worker gives the memory it has freed back to the system:
    workers are kept for later tasks, and so would be their largest size."""

    def inner(batches):
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Shuffle partitions for each file of a small table.
TASKS_A_FILE = 8


def save(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a
    lost executor takes nothing with it. The shuffle files of the write go at its end, the written
    ones with :func:`drop` or when the application ends. ``small``: rows are few for the tasks that make them
    and are gathered into fewer files (Hadoop starts processes for the permissions of each local file)."""
    spark = df.sparkSession
    if small:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // TASKS_A_FILE))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    where, fs = _located(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved = [path]
    return out


def joined(tables: list[DataFrame]) -> DataFrame:
    """The rows of some tables that :func:`save` returned."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    out._saved = [path for t in tables for path in t._saved]
    return out


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`save` returned and that nothing reads any more."""
    for t in tables:
        for path in t._saved:
            where, fs = _located(t.sparkSession, path)
            fs.delete(where, True)


def only_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (``left_anti``: is not). ``ids`` is counted
    first; up to MAX_BROADCAST_IDS it is broadcast, beyond that both sides are shuffled."""
    small = ids.count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, how)


def partitions(spark: SparkSession, n_bytes: float, each: int = 8 << 20) -> int:
    """Enough shuffle partitions for ``n_bytes`` at ``each`` bytes, and no fewer than configured."""
    return int(min(60_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each))))


def known(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A small written table to join with: broadcast only if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


#: Rows with long columns are broadcast up to so many bytes.
MAX_BROADCAST_BYTES = 12 << 20


def known_bytes(df: DataFrame, *long: str) -> DataFrame:
    """A written table to join with: broadcast only if its ``long`` columns and 64 bytes a row are
    at most MAX_BROADCAST_BYTES."""
    size = df.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in long), F.lit(64))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df


def spread(spark: SparkSession, n: int) -> list[int]:
    """For each partition 0..n-1 an int that Spark's hash partitioning sends there, so
    that n labels fill n partitions evenly."""
    if n > 4096:
        return list(range(n))
    found: dict[int, int] = {}
    rows = spark.range(n * 24 + 200).select(F.col("id").cast("int").alias("x")).select("x", F.expr(f"pmod(hash(x), {n})").alias("p"))
    for x, p in rows.groupBy("p").agg(F.min("x").alias("x")).select("x", "p").collect():
        found[p] = x
    return [found.get(p, p) for p in range(n)]


PACKED = "part int, blob binary"
#: Blobs go to the JVM in batches of about so many bytes.
MAX_BATCH_BYTES = 4 << 20


def _packed(parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


class Packer:
    """Collects (64-bit key, node) entries of one task and turns them into one blob for
    each shuffle part: 8 bytes an entry instead of a row."""

    def __init__(self, labels: list[int], flush: int = 1_000_000):
        self.labels, self.most = labels, flush
        self.nodes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        self.extra: list[np.ndarray] = []
        self.n_nodes = self.n_keys = 0

    def add(self, nodes: np.ndarray, keys: np.ndarray, index: np.ndarray, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``index``: for each key the position in ``nodes``; at most 30,000 nodes a call.
        ``extra``: 64 more bits for each key, or a row of over two 32-bit numbers; in all calls or in none."""
        if self.n_nodes + len(nodes) > 60_000 or self.n_keys + len(keys) > self.most:
            yield from self.flush()
        self.nodes.append(nodes.astype(np.int64, copy=False))
        self.keys.append(keys)
        self.index.append((index + self.n_nodes).astype(np.uint16))
        if extra is not None:
            self.extra.append(extra)
        self.n_nodes += len(nodes)
        self.n_keys += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n_keys:
            nodes, keys, index = map(np.concatenate, (self.nodes, self.keys, self.index))
            extra = np.concatenate(self.extra) if self.extra else None
            n = len(self.labels)
            part = (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n + 1))
            parts, blobs, pending = [], [], 0
            for p in range(n):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    used, at = np.unique(index[own], return_inverse=True)
                    k = keys[own]
                    head = np.array([len(own), len(used), 0 if extra is None else extra[:1].nbytes // 4], np.int64)
                    parts.append(self.labels[p])
                    blobs.append(b"".join((head.tobytes(), nodes[used].tobytes(), k.astype(np.uint32).tobytes(), ((k >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), at.astype(np.uint16).tobytes(), b"" if extra is None else extra[own].tobytes())))
                    pending += len(blobs[-1])
                    if pending > MAX_BATCH_BYTES:
                        yield _packed(parts, blobs)
                        parts, blobs, pending = [], [], 0
            if parts:
                yield _packed(parts, blobs)
        self.nodes, self.keys, self.index, self.extra, self.n_nodes, self.n_keys = [], [], [], [], 0, 0


def unpack(batches: Iterable[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of this partition: its 48-bit keys, their nodes and what is extra."""
    out: dict[int, list] = {}
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1)):
            raw = memoryview(blob.as_buffer())
            n, m, more = np.frombuffer(raw, np.int64, 3).tolist()
            at = 24
            nodes = np.frombuffer(raw, np.int64, m, at)
            at += 8 * m
            key = np.frombuffer(raw, np.uint32, n, at).astype(np.uint64)
            at += 4 * n
            key |= np.frombuffer(raw, np.uint16, n, at).astype(np.uint64) << np.uint64(32)
            at += 2 * n
            node = nodes[np.frombuffer(raw, np.uint16, n, at)]
            extra = np.frombuffer(raw[at + 2 * n :], np.uint32).reshape(n, more) if more > 2 else np.frombuffer(raw[at + 2 * n :], np.uint64)
            out.setdefault(part, []).append((key, node, extra))
    return {p: tuple(np.concatenate(c) for c in zip(*x)) for p, x in out.items()}


def runs_of(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) entries in order, and start and size of each key's run."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    if len(key):
        keep = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[keep], node[keep]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    else:
        start = np.zeros(0, np.int64)
    return key, node, start, np.diff(np.r_[start, len(key)])


#: Up to so many edges (16 bytes each) that are left of the tasks' own forests, one task finds the components.
ONE_TASK_EDGES = 2_000_000


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def _forest(batches):
    """Each node of the task's edges with the smallest of its component there: no more edges than nodes."""
    held = [(np.zeros(0, np.int64),) * 2]
    n = 0

    def joined():
        return labels_of(*map(np.concatenate, zip(*held)))

    for x in batches:
        held.append((x.column("a").to_numpy(), x.column("b").to_numpy()))
        n += x.num_rows
        if n > ONE_TASK_EDGES:  # as many nodes can't be exceeded by their forest: it is sent on
            nodes, least = joined()
            yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(nodes)], ["a", "b"])
            held, n = [(np.zeros(0, np.int64),) * 2], 0
    nodes, least = joined()
    yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(nodes)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every linked node; comp is the smallest node of its component.

    Tasks reduce their edges to forests first. What is left goes to one task up to ONE_TASK_EDGES edges;
    beyond, large-star and small-star steps (Kiveris et al., 2014) alternate until the edges no
    longer change, with minima aggregated before the shuffle, so a node with very many links
    costs no more than others. ``links`` has longs a and b."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edges = save(edges.mapInArrow(lean(_forest), "a long, b long"), "edges", small=True)
    if edges.count() <= ONE_TASK_EDGES:
        return edges.repartition(1).mapInArrow(lean(_forest), "a long, b long").select(F.col("b").alias("node"), F.col("a").alias("comp"))
    return stars(edges.where("a < b"))


def stars(edges: DataFrame) -> DataFrame:
    """:func:`components` of more edges than one task may have."""
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = save(least.select(F.col("m").alias("a"), "b").union(moved).distinct(), "edges", small=True)
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(edges.select("a", "a").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


#: Runs of more nodes are not taken apart before they are linked.
WHOLE_NODES = 8192

CANDIDATES = "a long, b long, members array<bigint>"


class Candidates:
    """Turns runs of nodes that share a key into candidate pairs. A run of at most ``small``
    nodes gives all its pairs; a larger one gives the pairs of its first node, and its
    members are kept for :func:`link`. With ``shatter`` a larger run of up to WHOLE_NODES nodes gives the pairs
    that ``near`` admits, so that nodes which merely share a key don't stay together; if these are more than
    ``small`` for each node, it falls into the parts that they connect."""

    def __init__(self, small: int = 16, shatter: bool = False):
        self.small, self.shatter = small, shatter

    def _shattered(self, s: int, n: int, near: Callable) -> tuple[np.ndarray, np.ndarray] | list[np.ndarray]:
        """The pairs of the positions s to s + n that ``near`` admits; if they are too many, the positions in parts
        of two or more that they connect."""
        held, count, many = [(np.zeros(0, np.int64),) * 2], 0, False
        for x in range(s, s + n, 256):
            i, j = (v.ravel() for v in np.meshgrid(np.arange(x, min(x + 256, s + n)), np.arange(x, s + n), indexing="ij"))
            ok = i < j
            ok[ok] = near(i[ok], j[ok])
            held.append((i[ok], j[ok]))
            count += int(ok.sum())
            many |= count > self.small * n
            if many:  # no more edges than nodes are kept
                held = [labels_of(*map(np.concatenate, zip(*held)))]
        if not many:
            return tuple(map(np.concatenate, zip(*held)))
        nodes, least = held[0]
        order = np.argsort(least, kind="stable")
        return np.split(nodes[order], np.flatnonzero(np.diff(least[order])) + 1) if len(nodes) else []

    def emit(self, node: np.ndarray, start: np.ndarray, size: np.ndarray, near: Callable | None = None) -> Iterator[pa.RecordBatch]:
        """``near`` tells of positions i and j of ``node`` whether they can link."""
        left, right, large = [], [], []
        for n in range(2, self.small + 1):
            at = start[size == n]
            if len(at):
                i, j = np.triu_indices(n, 1)
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
        for s, n in zip(start[size > self.small].tolist(), size[size > self.small].tolist()):
            parts = self._shattered(s, n, near) if self.shatter and n <= WHOLE_NODES else [np.arange(s, s + n)]
            if isinstance(parts, tuple):
                left.append(parts[0])
                right.append(parts[1])
                continue
            for at in parts:
                if len(at) <= self.small:
                    i, j = np.triu_indices(len(at), 1)
                    left.append(at[i])
                    right.append(at[j])
                else:
                    large.append(at)
                    left.append(np.full(len(at) - 1, at[0]))
                    right.append(at[1:])
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            if near is not None:
                ok = near(i, j)
                i, j = i[ok], j[ok]
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)] & (a != b)
            a, b = a[keep], b[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.list_(pa.int64()))], ["a", "b", "members"])
        # the same members often share many keys: each set of members is kept once
        seen = {node[at].tobytes(): node[at] for at in large}
        for m in seen.values():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([m], pa.list_(pa.int64()))], ["a", "b", "members"])


#: Nodes of a group of runs in one tile. Two tiles, or one with itself, meet in a task.
TILE = 256


def link(found: DataFrame, screen: Callable[[DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], info: Callable[[DataFrame], DataFrame], near: Callable, match: Callable, passes: int = 1, few: int | None = None) -> DataFrame:
    """(node, comp) over all verified links among the candidates in ``found``.

    Pairs come first: ``screen`` drops those (a, b) that can't link, ``verify`` keeps those that do. Texts are
    written by ``fetch`` only for the distinct nodes that need them (a table with node; it returns a saved table): those
    of pairs that passed the screen, and when these are done, those of runs that are still apart. Of each node the pair with its
    smallest partner is verified before the rest, so that of the rest those inside a component can be passed over.
    Then the large runs whose nodes are still in different components are compared inside
    tasks. Runs that begin with the same node mostly belong to one family and make a group; its nodes are
    dealt to tiles of about TILE, and each two tiles meet in a task of their own, so no task holds more
    than two tiles however large the group is. Pairs inside a component add nothing to it and
    are passed over, links found in the task included, and only links leave it.

    ``info``, made of what ``fetch`` returned, has (node, info) with what a task needs of each node; ``near(infos)`` and ``match(infos)`` give
    functions of two arrays of positions that tell which pairs can link and which of those do. ``found`` is a
    saved table and is dropped. Pairs are screened and verified in so many ``passes``: the disk holds the shuffles of one.
    ``few``: as FEW_PAIRS, for a ``match`` that many pairs at once make cheap."""
    spark = found.sparkSession

    def part(pairs: DataFrame, p: int) -> DataFrame:
        return pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == p)

    pairs = found.where("members is null").select("a", "b")
    tested = joined([save(screen(part(pairs, p).distinct()), "close", small=True) for p in range(passes)])
    ids = save(tested.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids", small=True)
    texts = fetch(ids)
    first = save(tested.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first", small=True)
    links = save(verify(first, texts), "links", small=True)
    comps = known(save(components(links), "comps"))
    rest = tested.join(first, ["a", "b"], "left_anti")
    for x in "ab":
        rest = rest.join(comps.select(F.col("node").alias(x), F.col("comp").alias("c" + x)), x, "left")
    rest = save(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest", small=True)
    links = joined([links, *(save(verify(part(rest, p), texts), "links", small=True) for p in range(passes))])
    drop(ids, texts, first, rest)
    comps = save(components(links), "comps")
    runs = found.where("members is not null").select("members").distinct().select(F.xxhash64("members").alias("run"), "members")
    labelled = runs.select("run", F.explode("members").alias("node")).join(known(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    still = labelled.groupBy("run").agg(F.min("node").alias("r"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    still = save(labelled.join(still.select("run", "r"), "run").select("r", "run", "node", "comp"), "open", small=True)
    drop(found, tested)
    if not still.take(1):
        return comps
    nodes = save(still.groupBy("r", "node", "comp").agg(F.collect_list("run").alias("runs")), "grouped", small=True)
    ids = save(nodes.select("node").distinct(), "ids", small=True)
    texts = fetch(ids)
    drop(still)
    tiles = nodes.groupBy("r").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = nodes.join(info(texts), "node").join(known(save(tiles, "tiles")), "r").withColumn("t", F.expr("pmod(xxhash64(node), tiles)"))
    placed = placed.select("r", "node", "comp", "runs", "info", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
    meet = ["r", "x", "y"]
    placed = placed.select("r", F.least("t", "u").cast("int").alias("x"), F.greatest("t", "u").cast("int").alias("y"), (F.col("t") <= F.col("u")).alias("first"), "node", "comp", "runs", "info")
    dealt = placed.repartition(partitions(spark, 8192 * nodes.count()), *meet).sortWithinPartitions(*meet)
    new = save(dealt.mapInArrow(lean(_meet(near, match, few or FEW_PAIRS)), "a long, b long"), "links", small=True)
    drop(ids, texts, nodes)
    if not new.take(1):
        return comps
    return save(components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(new)), "comps")


#: Pairs of two tiles that are compared at a time: few at first and wherever many link, as
#: each link may make others needless.
FEW_PAIRS, MANY_PAIRS = 64, 4096


def _meet(near: Callable, match: Callable, few: int = FEW_PAIRS):
    """Links between nodes of two tiles that share a run and are in unlike components. Rows come in
    order of tiles."""

    def links(x, y, held):
        whole = pa.Table.from_batches(held)
        nodes, comp, first = (whole.column(c).to_numpy().copy() for c in ("node", "comp", "first"))
        infos = whole.column("info").combine_chunks()
        runs = whole.column("runs").combine_chunks()
        run, at = runs.flatten().to_numpy(), np.repeat(np.arange(len(nodes)), runs.value_lengths().to_numpy())
        order = np.argsort(run, kind="stable")
        run, at = run[order], at[order]
        met = np.zeros((len(nodes), len(nodes)), bool)
        for m in np.split(at, np.flatnonzero(run[1:] != run[:-1]) + 1):
            if len(m) > 1:
                met[np.ix_(m, m)] = True
        met &= comp[:, None] != comp[None, :]
        met &= np.triu(np.ones_like(met), 1) if x == y else first[:, None] & ~first[None, :]
        i, j = np.nonzero(met)
        ok = near(infos)(i, j)
        i, j, same, step = i[ok], j[ok], match(infos), few
        out = []
        while len(i):
            p, q = i[:step], j[:step]
            i, j = i[step:], j[step:]
            ok = same(p, q)
            for u, v in zip(p[ok].tolist(), q[ok].tolist()):
                if comp[u] != comp[v]:
                    out.append((nodes[u], nodes[v]))
                    comp[comp == comp[u]] = comp[v]
            if ok.any():
                apart = comp[i] != comp[j]
                i, j = i[apart], j[apart]
            step = min(2 * step, MANY_PAIRS) if 4 * ok.sum() < len(ok) else few
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        tiles, held = None, []
        for b in batches:
            at = [b.column(c).to_numpy() for c in ("r", "x", "y")]
            new = np.zeros(b.num_rows, bool)
            new[:1] = True
            for c in at:
                new[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(new).tolist()
            for s, e in zip(cuts, [*cuts[1:], b.num_rows]):
                own = tuple(int(c[s]) for c in at)
                if own != tiles:
                    if held:
                        yield links(*tiles[1:], held)
                    tiles, held = own, []
                held.append(b.slice(s, e - s))
        if held:
            yield links(*tiles[1:], held)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.col(col).cast("string")
