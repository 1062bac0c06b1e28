"""Flush, recovery and compaction keep the answers of a dict replay."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kvspark.plans.compaction import LazyLeveled, Leveled, PartialTiered, RunInfo, Tiered, make_policy, most_overlap, oldest, smallest
from kvspark.plans.store import Store
from kvspark.plans.workload import Workload, generate, text
from kvspark.schema import InvalidInput, StoreConfig

from .test_core import Dict, log_of, random_log

POLICIES = [("tiered", "oldest"), ("leveled", "oldest"), ("lazy_leveled", "oldest"), ("partial_tiered", "oldest"), ("partial_tiered", "most_overlap"), ("partial_tiered", "smallest")]


def content(store):
    return {r.key: r.value for r in store.image().collect()}


def put(spark, store, rows, start):
    from pyspark.sql import functions as F

    store.append(log_of(spark, rows).withColumn("seq", F.col("seq") + start))
    return start + len(rows)


@pytest.mark.parametrize("policy,selection", POLICIES)
def test_random_logs(spark, tmp_path, policy, selection):
    rng = random.Random(sum(map(ord, policy + selection)))
    rows = random_log(rng, 160, 20)
    store = Store(spark, str(tmp_path), StoreConfig(policy=policy, selection=selection, threshold=3, max_runs=2))
    at = 0
    for i in range(0, 160, 20):
        at = put(spark, store, rows[i : i + 20], at)
        store.flush()
        store.compact_if_needed()
        assert content(store) == Dict(rows[: i + 20]).live
    store.force_compact_all()
    assert content(store) == Dict(rows).live
    again = Store(spark, str(tmp_path), store.config)
    assert content(again) == Dict(rows).live and again.validate().count() == 0
    if policy == "leveled":
        assert all(len(again.runs(x["level"])) == 1 for x in again.manifest if x["level"] > 0)
    live = Dict(rows).live
    for k in (-21, 0, 5):
        assert again.get(k) == live.get(k)
    assert [tuple(r) for r in again.scan(-5, 6).collect()] == sorted((k, v) for k, v in live.items() if -5 <= k < 6)


def test_newest_wins_over_flushes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    put(spark, store, [("p", 1, 10)], 0)
    store.flush()
    put(spark, store, [("p", 1, 20)], 5)
    store.flush()
    assert store.get(1) == 20 and [tuple(r) for r in store.scan(0, 5).collect()] == [(1, 20)]
    store.force_compact_all()
    assert store.get(1) == 20
    put(spark, store, [("d", 1, None)], 9)
    assert store.get(1) is None
    store.flush()
    put(spark, store, [("p", 1, 7)], 12)
    assert store.get(1) == 7


def test_nothing_is_dropped(spark, tmp_path):
    """More keys than the buffer holds."""
    config = StoreConfig(buffer_pages=1)
    assert config.buffer_entries == 256
    store = Store(spark, str(tmp_path), config)
    assert store.ingest(log_of(spark, [("p", i, i) for i in range(1100)])) == 5
    assert store.image().count() == 1100 and [x["level"] for x in store.manifest] == [1]
    rows = random_log(random.Random(3), 700, 9)
    other = Store(spark, str(tmp_path / "b"), StoreConfig(buffer_pages=1, threshold=10))
    put(spark, other, rows[:5], 0)
    other.ingest(log_of(spark, rows).where("seq >= 5"))
    assert len(other.manifest) == 4 and content(other) == Dict(rows).live == content(Store(spark, str(tmp_path / "b"), other.config))
    assert other.collect_garbage() == 0 and other.validate().count() == 0
    assert store.write_amplification() >= 1


def test_recovery_loses_only_what_was_pending(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = put(spark, store, [("p", 1, 100), ("p", 2, 200), ("p", 3, 300)], 0)
    store.flush()
    put(spark, store, [("p", 4, 400), ("p", 5, 500)], at)
    assert len(content(store)) == 5
    assert content(Store(spark, str(tmp_path))) == {1: 100, 2: 200, 3: 300}
    # a version that was not finished is not read
    spark.createDataFrame([("{}",)], "value string").write.text(f"{tmp_path}/manifest/99")
    assert content(Store(spark, str(tmp_path))) == {1: 100, 2: 200, 3: 300}


def test_tombstones_survive(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = put(spark, store, [("p", i, i * 100_000) for i in range(1, 20)], 0)
    store.flush()
    put(spark, store, [("d", i, None) for i in (5, 10, 15)], at)
    store.flush()
    store.force_compact_all()
    again = Store(spark, str(tmp_path))
    assert [again.get(i) for i in (5, 10, 15)] == [None] * 3 and len(content(again)) == 16
    assert sum(x["tombstones"] for x in again.manifest) == 3


def test_load(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    put(spark, store, [("p", 10, 1), ("p", 30, 1)], 7)
    (tmp_path / "a.txt").write_text("p 10 1000\np 20 2000\np 30 3000\nd 30\n")
    assert store.load(str(tmp_path / "a.txt"))["reply"] == "Loaded 4 commands from file (0 failed)"
    assert content(store) == {10: 1000, 20: 2000} == content(Store(spark, str(tmp_path / "s")))
    (tmp_path / "b.txt").write_text("p 10\ng\nx 10 20\nd 20\n")
    assert store.load(str(tmp_path / "b.txt"))["failed"] == 3 and content(store) == {10: 1000}


def test_flush_of_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert not store.flush() and store.manifest == []
    assert store.image().count() == 0 and store.get(1) is None and store.scan(0, 9).count() == 0
    assert store.memory()["used_bytes"] == 0


def test_stats_and_garbage(spark, tmp_path):
    store = Store(spark, str(tmp_path), StoreConfig(block_entries=2))
    at = put(spark, store, [("p", i, i) for i in range(5)], 0)
    assert store.memory()["used_bytes"] == 80
    store.flush()
    put(spark, store, [("d", 1, None)], at)
    store.flush()
    assert tuple(store.stats().first()) == (0, 2, 4, 6, 1)
    store.read().write.parquet(f"{tmp_path}/runs/0/left-over")
    assert store.collect_garbage() == 1 and len(content(store)) == 4


def info(*entries, level=0):
    return [RunInfo(level, i, a, b, n) for i, (a, b, n) in enumerate(entries)]


def test_selection():
    runs = info((0, 9, 10), (0, 2, 3), (0, 4, 5))
    assert [r.run_seq for r in oldest(runs, 2)] == [0, 1]
    assert sorted(r.run_seq for r in smallest(runs, 2)) == [1, 2]
    assert [r.run_seq for r in most_overlap(info((0, 1, 1), (2, 3, 1), (4, 100, 1)), 2)] == [1, 2]


def test_triggers():
    runs = info(*[(0, 1, 1)] * 4)
    assert Tiered(4).due(0, runs) and not Tiered(4).due(0, runs[:3])
    assert Leveled().due(0, runs[:2]) and not Leveled().due(1, runs[:1])
    assert LazyLeveled(4).due(0, runs) and not LazyLeveled(4).due(0, runs[:3]) and LazyLeveled(4).due(1, runs[:2])
    assert len(PartialTiered(4, 3).pick(0, runs)) == 3
    assert make_policy("LazyLeveled").joins_target and make_policy("partialtiered", 4, max_runs=2).max_runs == 2
    for bad in ("nope", ""):
        with pytest.raises(InvalidInput):
            make_policy(bad)
    with pytest.raises(InvalidInput):
        make_policy("partial_tiered", selection="nope")


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 60), st.integers(1, 99)), min_size=2, max_size=8), st.integers(2, 5))
def test_selectors_stay_within_bounds(spans, most):
    runs = info(*((a, a + w, n) for a, w, n in spans))
    for pick in (oldest, smallest, most_overlap):
        got = pick(runs, most)
        assert len(got) == min(most, len(runs)) and len({r.run_seq for r in got}) == len(got)


def test_workload(spark):
    w = Workload(puts=200, gets=100, ranges=50, deletes=20, misses=0.3, skew=0.2, max_range=50, shards=3)
    a, b = (generate(spark, w).orderBy("seq").collect() for _ in range(2))
    assert a == b and len({r.seq for r in a}) == 370
    assert all(r.key <= r.key_end and r.key_end - r.key <= 50 for r in a if r.op == "r")
    assert text(generate(spark, w)).where("value rlike '^(p -?[0-9]+ -?[0-9]+|[gd] -?[0-9]+|r -?[0-9]+ -?[0-9]+)$'").count() == 370
    other = generate(spark, Workload(puts=200, seed=1)).collect()
    assert {r.key for r in other} != {r.key for r in a}


def test_torn_commit_is_stepped_over(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = put(spark, store, [("p", 1, 100)], 0)
    store.flush()
    # a version that was begun, without its end, under the number that comes next
    spark.createDataFrame([('{"level": 0}',)], "value string").write.text(f"{tmp_path}/manifest/2")
    again = Store(spark, str(tmp_path))
    assert content(again) == {1: 100}
    put(spark, again, [("p", 2, 200)], at)
    assert again.flush() and content(Store(spark, str(tmp_path))) == {1: 100, 2: 200}


def test_readers_outlive_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = 0
    for i in range(3):
        at = put(spark, store, [("p", i, i), ("p", 9, i)], at)
        store.flush()
    reader = Store(spark, str(tmp_path))
    before = reader.image()
    store.force_compact_all()
    assert {r.key: r.value for r in before.collect()} == {0: 0, 1: 1, 2: 2, 9: 2} == content(store)
    assert store.collect_garbage(retain=2) == 0 and content(reader) == content(store)
    assert store.collect_garbage() == 3 and content(Store(spark, str(tmp_path))) == content(store)


def test_storage_by_name(spark, tmp_path):
    store = Store(spark, str(tmp_path), StoreConfig(storage="orc"))
    put(spark, store, [("p", 1, 10), ("p", -(1 << 63), 5), ("p", (1 << 63) - 1, 6)], 0)
    store.flush()
    store.force_compact_all()
    again = Store(spark, str(tmp_path), store.config)
    assert content(again) == {1: 10, -(1 << 63): 5, (1 << 63) - 1: 6} and again.validate().count() == 0
    with pytest.raises(InvalidInput):
        Store(spark, str(tmp_path), StoreConfig(storage="nope"))


def test_move(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    put(spark, store, [("p", 1, 10)], 0)
    store.flush()
    store.move(0, 0, 1)
    assert [(x["level"], x["run_seq"]) for x in store.manifest] == [(1, 0)] and store.get(1) == 10


def test_small_runs_are_small_files(spark, tmp_path):
    """Filters of a run's keys follow the window, not the largest run: they had 8 MB for each window."""
    store = Store(spark, str(tmp_path))
    assert store.ingest(log_of(spark, [("p", i, i) for i in range(500)]), 100, compact=False) == 5
    assert sum(f.stat().st_size for f in (tmp_path / "runs").rglob("*.parquet")) < 200_000
    assert [store.get(i) for i in (0, 250, 499, 500)] == [0, 250, 499, None]


def scans(df):
    return sum(x.lstrip(" +-:").startswith(("Relation ", "LogicalRelation")) for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_tables_are_one_read(spark, tmp_path):
    """The plan doesn't grow with the runs; windows, flushed and compacted runs keep their level and number."""
    store = Store(spark, str(tmp_path / "runs" / "0" / "a b=%20"), StoreConfig(policy="partial_tiered", max_runs=2))
    rows = random_log(random.Random(7), 240, 30)
    store.ingest(log_of(spark, rows), 40, compact=False)
    put(spark, store, [("p", 99, 1)], 240)
    store.flush()
    store.compact_level(0)
    got = store.tables()
    want = {(x["level"], x["run_seq"], *r) for x in store.manifest for r in store.read([x]).collect()}
    assert len({(x["level"], x["run_seq"]) for x in store.manifest}) == 6 and {x["level"] for x in store.manifest} == {0, 1}
    assert len(want) == got.count() and {tuple(r) for r in got.collect()} == want
    assert scans(got) == 1


def test_overlap_compaction_is_one_read(spark):
    from kvspark.queries import FOUND

    got = FOUND["compact_partial_overlap"](spark, "/root/testdata/sf0.01")
    assert scans(got) == 1
    assert got.count() == 450 and {r.run for r in got.where("level = 1").select("run").distinct().collect()} == {0} and got.where("level = 0").select("run").distinct().count() == 2


def test_smallest_compaction_is_one_read(spark):
    from kvspark.queries import FOUND

    got = FOUND["compact_partial_smallest"](spark, "/root/testdata/sf0.01")
    assert scans(got) == 1
    assert got.count() == 450 and {r.run for r in got.where("level = 1").select("run").distinct().collect()} == {0} and got.where("level = 0").select("run").distinct().count() == 2
