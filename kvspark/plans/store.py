"""A store of runs: flush, manifest, recovery, lookups, statistics and compaction.

A run is a key-sorted Parquet folder; the manifest is a small table, one file a version, whose
newest version names the live runs. Readers use one version throughout; writers add files and
then a version, so a failed job leaves no trace in what is read.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bloom import TARGET_RATES
from ..operators import resolve
from ..schema import ENTRIES, ENTRY_BYTES, STORAGES, InvalidInput, StoreConfig, StoreError, run_name
from ..sources import logs
from .compaction import PartialTiered, Policy, RunInfo, make_policy

#: Rows of one file of a run.
FILE_ROWS = 4_000_000
#: The folder of a run within a store, from the name of one of its files.
RUN_FOLDER = r"(runs/\d+/[^/]+(?:/window=[^/]+)?)/[^/]+$"


class Store:
    """Runs under ``path``, any folder Spark can write. ``pending`` is the part of the log that is
    not flushed yet: it is not durable, and a recovered store begins without it."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None):
        self.spark, self.path, self.config = spark, path, config or StoreConfig()
        options = {"max_runs": self.config.max_runs, "selection": self.config.selection} if self.config.policy.replace("_", "") == "partialtiered" else {}
        self.policy: Policy = make_policy(self.config.policy, self.config.threshold, **options)
        if self.config.storage not in STORAGES:
            raise InvalidInput(f"unknown storage: {self.config.storage}")
        self.manifest: list[dict] = []
        self.pending: DataFrame | None = None
        self.ingested = self.written = self._version = 0
        self._load()

    # manifest -------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        where, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())

    def _load(self) -> None:
        for version in reversed(self._versions()):
            rows = self._committed(version)
            if rows is not None:
                self.manifest, self._version = rows, version
                return

    def _commit(self, rows: list[dict]) -> None:
        rows = sorted(rows, key=lambda x: (x["level"], x["run_seq"]))
        lines = [json.dumps(x) for x in rows] + [json.dumps({"end": len(rows)})]
        # written aside and renamed: a commit that dies leaves no version, and what is half there is stepped over
        aside = f"{self.path}/manifest/_{uuid.uuid4().hex}"
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(aside)
        version = max([self._version, *self._versions()]) + 1
        where, fs = self._fs(aside)
        if not fs.rename(where, self._fs(f"{self.path}/manifest/{version}")[0]):
            raise StoreError(f"manifest version {version} can't be written; another writer may have it")
        self.manifest, self._version = rows, version

    def _committed(self, version: int) -> list[dict] | None:
        """The rows of a version, or none if it was never committed in full."""
        lines = [json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/manifest/{version}").collect()]
        if not any("end" in x for x in lines):
            return None
        return sorted((x for x in lines if "path" in x), key=lambda x: (x["level"], x["run_seq"]))

    def runs(self, level: int) -> list[RunInfo]:
        return [RunInfo(x["level"], x["run_seq"], x["min_key"], x["max_key"], x["entries"]) for x in self.manifest if x["level"] == level]

    def _next(self, level: int, rows: list[dict]) -> int:
        return max((x["run_seq"] for x in rows if x["level"] == level), default=-1) + 1

    # runs -----------------------------------------------------------------

    def codec(self, level: int) -> str:
        """Parquet compression of a level: its own, else that of the first or of lower levels."""
        c = self.config
        if level in c.level_codecs:
            name = c.level_codecs[level]
        elif c.adaptive_codec:
            name = "none" if level == 0 else "snappy"
        else:
            name = c.l0_codec if level == 0 else c.lower_codec
        known = {"none": "uncompressed", "snappy": "snappy", "lz4": "lz4_raw", "bit_pack": "uncompressed", "delta": "uncompressed", "dictionary": "uncompressed"}
        if name not in known:
            raise InvalidInput(f"unknown codec: {name}")
        return known[name]

    def _options(self, writer, level: int, entries: int = FILE_ROWS):
        """Integers take delta encoding; a key's Bloom filter, sized for the level's target rate, lets
        point reads skip files of up to ``entries`` keys."""
        keys = max(1, min(FILE_ROWS, entries))
        rate = TARGET_RATES[min(level, len(TARGET_RATES) - 1)]
        options = {
            "compression": self.codec(level),
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.bloom.filter.enabled#key": "true",
            "parquet.bloom.filter.expected.ndv#key": str(keys),
            "parquet.bloom.filter.fpp#key": str(rate),
            "parquet.bloom.filter.max.bytes": str(64 << 20),
        }
        if self.config.storage == "orc":
            codec = options["compression"]
            options = {"compression": {"uncompressed": "none", "lz4_raw": "lz4"}.get(codec, codec), "orc.bloom.filter.columns": "key", "orc.bloom.filter.fpp": str(rate)}
        return writer.format(self.config.storage).options(**options)

    def _reader(self, schema):
        return self.spark.read.format(self.config.storage).schema(schema)

    def _write(self, merged: DataFrame, level: int, run_seq: int, entries: int = FILE_ROWS) -> dict | None:
        folder = f"runs/{level}/{run_name(level, run_seq)}-{uuid.uuid4().hex[:8]}"
        writer = merged.repartitionByRange("key").sortWithinPartitions("key").write.option("maxRecordsPerFile", FILE_ROWS)
        self._options(writer, level, entries).save(f"{self.path}/{folder}")
        s = self._reader(ENTRIES).load(f"{self.path}/{folder}").agg(F.count("*"), F.min("key"), F.max("key"), F.count_if("dead"), F.max("seq")).first()
        if not s[0]:
            return None
        self.written += s[0]
        return {"level": level, "run_seq": run_seq, "path": folder, "entries": s[0], "min_key": s[1], "max_key": s[2], "tombstones": s[3], "max_seq": s[4], "blocks": -(-s[0] // self.config.block_entries)}

    def read(self, rows: list[dict] | None = None) -> DataFrame:
        """Entries of the given runs, of all if none are given."""
        paths = [f"{self.path}/{x['path']}" for x in (self.manifest if rows is None else rows)]
        return self._reader(ENTRIES).load(paths) if paths else self.spark.createDataFrame([], ENTRIES)

    # writes ---------------------------------------------------------------

    def append(self, log: DataFrame) -> None:
        """Adds mutations to the pending part; nothing is dropped, whatever its size."""
        self.pending = log if self.pending is None else self.pending.unionByName(log)

    def flush(self) -> bool:
        """Moves the pending part into a new run of level 0. Nothing pending: no-op."""
        if self.pending is None:
            return False
        entries = resolve.entries(self.pending)
        row = self._write(resolve.merge(entries), 0, self._next(0, self.manifest))
        self.pending = None
        if row is None:
            return False
        self.ingested += row["entries"]
        self._commit([*self.manifest, row])
        return True

    def ingest(self, log: DataFrame, size: int | None = None, compact: bool = True) -> int:
        """Flushes a whole log in windows of ``size`` sequence numbers (the buffer's size), in one job: a
        run for each window, older windows first. Compaction follows where it is due. Returns the
        number of runs."""
        self.flush()
        window = F.floor(F.col("seq") / (size or self.config.buffer_entries)).cast("bigint")
        merged = resolve.entries(log).withColumn("window", window).groupBy("window", "key").agg(F.max_by("value", "seq").alias("value"), F.max_by("dead", "seq").alias("dead"), F.max("seq").alias("seq"))
        folder = f"runs/0/batch-{uuid.uuid4().hex[:8]}"
        writer = merged.repartitionByRange("window", "key").sortWithinPartitions("window", "key").select("window", *ENTRIES.names).write.option("maxRecordsPerFile", FILE_ROWS)
        self._options(writer, 0, size or self.config.buffer_entries).partitionBy("window").save(f"{self.path}/{folder}")
        written = self._reader("key long, value long, dead boolean, seq long, window long").load(f"{self.path}/{folder}")
        stats = written.groupBy("window").agg(F.count("*"), F.min("key"), F.max("key"), F.count_if("dead"), F.max("seq")).collect()
        first, rows = self._next(0, self.manifest), []
        for i, r in enumerate(sorted(stats)):
            rows.append({"level": 0, "run_seq": first + i, "path": f"{folder}/window={r[0]}", "entries": r[1], "min_key": r[2], "max_key": r[3], "tombstones": r[4], "max_seq": r[5], "blocks": -(-r[1] // self.config.block_entries)})
            self.written += r[1]
            self.ingested += r[1]
        if rows:
            self._commit([*self.manifest, *rows])
            if compact:
                self.compact_if_needed()
        return len(rows)

    def load(self, path: str) -> dict:
        """Executes the puts and deletes of command files as one change, then flushes: readers see
        all of them or none. Returns loaded, failed and the reply. Sequence numbers follow those
        that the store has."""
        parsed = logs.commands(self.spark.read.text(path))
        report = logs.load_report(parsed).first().asDict()
        seen = [x["max_seq"] for x in self.manifest]
        if self.pending is not None:
            seen.append(self.pending.agg(F.max("seq")).first()[0])
        last = max((x for x in seen if x is not None), default=-1)
        self.append(logs.mutations(parsed).withColumn("seq", F.col("seq") + last + 1))
        self.flush()
        self.compact_if_needed()
        return report

    # compaction -----------------------------------------------------------

    def compact_level(self, level: int) -> bool:
        """One merge of a level into the next, then of the next if it is due; tombstones stay."""
        picked = {r.run_seq for r in self.policy.pick(level, self.runs(level))}
        if not picked:
            return False
        source = [x for x in self.manifest if x["level"] == level and x["run_seq"] in picked]
        if self.policy.joins_target:
            source += [x for x in self.manifest if x["level"] == level + 1]
        if len(source) == 1 and isinstance(self.policy, PartialTiered):
            return False
        rest = [x for x in self.manifest if x not in source]
        row = self._write(resolve.merge(self.read(source)), level + 1, self._next(level + 1, self.manifest), sum(x["entries"] for x in source))
        self._commit([*rest, *([row] if row else [])])
        if self.policy.due(level + 1, self.runs(level + 1)):
            self.compact_level(level + 1)
        return True

    def compact_if_needed(self) -> None:
        for level in sorted({x["level"] for x in self.manifest}):
            if self.policy.due(level, self.runs(level)):
                self.compact_level(level)

    def force_compact_all(self) -> None:
        for level in sorted({x["level"] for x in self.manifest}):
            self.compact_level(level)

    def move(self, level: int, run_seq: int, to: int) -> None:
        """Puts a run on another level without rewriting it."""
        rows = [dict(x) for x in self.manifest]
        for x in rows:
            if (x["level"], x["run_seq"]) == (level, run_seq):
                x["level"], x["run_seq"] = to, self._next(to, self.manifest)
        self._commit(rows)

    def collect_garbage(self, retain: int = 1) -> int:
        """Deletes run folders that none of the newest ``retain`` manifest versions names, and the older
        versions; returns how many folders went. Until then compaction deletes nothing, so
        readers that opened an earlier version go on. Folders of a batch go with their last run."""
        kept: dict[int, list[dict]] = {}
        for version in reversed(self._versions()):
            rows = self._committed(version) if len(kept) < max(1, retain) else None
            if rows is not None:
                kept[version] = rows
            else:
                where, fs = self._fs(f"{self.path}/manifest/{version}")
                fs.delete(where, True)
        live = {x["path"].split("/")[2] for rows in kept.values() for x in rows}
        gone = 0
        top, fs = self._fs(f"{self.path}/runs")
        for level in fs.listStatus(top) if fs.exists(top) else []:
            for s in fs.listStatus(level.getPath()):
                if s.getPath().getName() not in live:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    # reads ----------------------------------------------------------------

    def _overlapping(self, low: int, high: int) -> list[dict]:
        return [x for x in self.manifest if x["min_key"] <= high and x["max_key"] >= low]

    def tables(self) -> DataFrame:
        """The entries of all runs with their level and run. All runs are one read, told apart by the names
        of their files, so the plan doesn't grow with their number."""
        if not self.manifest:
            return self.spark.createDataFrame([], ENTRIES).select(F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("run"), *ENTRIES.names)
        runs = self.spark.createDataFrame([(x["path"], x["level"], x["run_seq"]) for x in self.manifest], "folder string, level int, run long")
        entries = self.read().withColumn("folder", F.regexp_extract("_metadata.file_path", RUN_FOLDER, 1))
        return entries.join(F.broadcast(runs), "folder").select("level", "run", *ENTRIES.names)

    def image(self, rows: list[dict] | None = None) -> DataFrame:
        parts = [self.read(rows)] + ([resolve.entries(self.pending)] if self.pending is not None else [])
        return resolve.image(*parts)

    def get(self, key: int) -> int | None:
        """The newest value of a key. Only runs whose keys may hold it are read."""
        found = self.image(self._overlapping(key, key)).where(F.col("key") == key).select("value").take(1)
        return found[0][0] if found else None

    def scan(self, start: int, end: int) -> DataFrame:
        """Live pairs of [start, end) in key order."""
        rows = self._overlapping(start, end - 1) if start < end else []
        return self.image(rows).where((F.col("key") >= start) & (F.col("key") < end)).select("key", "value").orderBy("key")

    # statistics and checks ------------------------------------------------

    def stats(self) -> DataFrame:
        """(level, runs, blocks, entries, tombstones) of levels that have runs."""
        rows = [(x["level"], x["run_seq"], x["blocks"], x["entries"], x["tombstones"]) for x in self.manifest]
        m = self.spark.createDataFrame(rows, "level int, run_seq long, blocks long, entries long, tombstones long")
        return m.groupBy("level").agg(F.count("*").alias("runs"), F.sum("blocks").alias("blocks"), F.sum("entries").alias("entries"), F.sum("tombstones").alias("tombstones"))

    def memory(self) -> dict:
        n = resolve.merge(resolve.entries(self.pending)).count() if self.pending is not None else 0
        return {"pages": self.config.buffer_pages, "used_bytes": n * ENTRY_BYTES, "total_bytes": self.config.buffer_entries * ENTRY_BYTES, "fragmentation": 0.0}

    def write_amplification(self) -> float:
        return self.written / self.ingested if self.ingested else 0.0

    def validate(self) -> DataFrame:
        """Runs whose files disagree with their manifest row: none in a sound store."""
        bad = []
        for x in self.manifest:
            s = self.read([x]).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.countDistinct("key").alias("k"))
            want = (F.col("n") != x["entries"]) | (F.col("a") != x["min_key"]) | (F.col("b") != x["max_key"]) | (F.col("k") != F.col("n"))
            bad.append(s.where(want).select(F.lit(run_name(x["level"], x["run_seq"])).alias("run")))
        return reduce(DataFrame.union, bad) if bad else self.spark.createDataFrame([], "run string")
