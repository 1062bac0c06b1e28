"""Commands, resolution, lookups and replay."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvspark.functions.commands import parse
from kvspark.operators import lookup, replay, resolve
from kvspark.schema import MUTATIONS, TOMBSTONE, run_name
from kvspark.sources import logs

LOW, HIGH = -(1 << 63), (1 << 63) - 1
SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def log_of(spark, rows):
    """Rows (op, key, value or key_end) in order of arrival."""
    out = [(i, op, k, v if op == "p" else None, v if op == "r" else None) for i, (op, k, v) in enumerate(rows)]
    return spark.createDataFrame(out, MUTATIONS)


class Dict:
    """Replay into a dict: what every command sees."""

    def __init__(self, rows):
        self.live, self.gets, self.dels, self.ranges, self.before = {}, {}, {}, {}, {}
        for i, (op, k, v) in enumerate(rows):
            if op == "p":
                self.before[i] = self.live.get(k)
                self.live[k] = v
            elif op == "g":
                self.gets[i] = self.live.get(k)
            elif op == "d":
                self.dels[i] = k in self.live
                self.live.pop(k, None)
            else:
                self.ranges |= {(i, x): y for x, y in self.live.items() if k <= x < v}


def random_log(rng, n, keys=12):
    rows = []
    for _ in range(n):
        op, k = rng.choice("ppppgrdd"), rng.randrange(-keys, keys)
        rows.append((op, k, rng.randrange(-50, 50) if op == "p" else k + rng.randrange(-2, 9) if op == "r" else None))
    return rows


ops = st.lists(st.one_of(st.tuples(st.just("p"), st.integers(-5, 5), st.integers(-9, 9)), st.tuples(st.sampled_from("gd"), st.integers(-5, 5), st.none()), st.tuples(st.just("r"), st.integers(-5, 5), st.integers(-6, 9))), max_size=30)


@pytest.mark.parametrize("line,want", [
    ("p 10 42", ("p", 10, 42, None, None)), ("g -7", ("g", -7, None, None, None)), ("r 1 5", ("r", 1, None, 5, None)), ("d 3", ("d", 3, None, None, None)),
    ('l "a/b.txt"', ("l", None, None, None, "a/b.txt")), ("s", ("s", *[None] * 4)), ("f", ("f", *[None] * 4)), ("q", ("q", *[None] * 4)), ("  p\t1   2 ", ("p", 1, 2, None, None)),
    (f"p {LOW} {HIGH}", ("p", LOW, HIGH, None, None)),
])
def test_commands(spark, line, want):
    r = spark.createDataFrame([(line,)], "v string").select(parse(F.col("v")).alias("c")).select("c.*").first()
    assert r.valid and tuple(r)[:5] == want


def test_rejects(spark):
    bad = ["", "x", "p", "p 10", "p 10 42 extra", "p x y", "g x", "g", "r 10", "d", "s extra", "q extra", "f extra", "l", "p 1.5 2", "p 9223372036854775808 1", "P 1 2"]
    df = logs.commands(spark.createDataFrame([(x,) for x in bad], "value string"))
    assert df.where("valid").count() == 0
    assert {r.line for r in logs.rejected(df).collect()} == set(bad)


def test_load_report(spark):
    lines = lambda *x: logs.commands(spark.createDataFrame([(v,) for v in x], "value string"))
    assert tuple(logs.load_report(lines("p 10 1000", "p 20 2000", "p 30 3000", "d 30")).first())[:2] == (4, 0)
    assert logs.load_report(lines("p 10", "g", "x 10 20")).first().reply == "Loaded 0 commands from file (3 failed)"


def test_text_and_pairs(spark, tmp_path):
    (tmp_path / "c.txt").write_text("p 1 2\nd 1\nbad\n" + f"p 5 {TOMBSTONE}\n")
    muts = logs.mutations(logs.read_commands(spark, str(tmp_path / "c.txt"))).orderBy("seq").collect()
    assert [(m.op, m.key, m.value) for m in muts] == [("p", 1, 2), ("d", 1, None), ("d", 5, None)]
    import numpy as np

    pairs = np.array([[1, -2], [3, 4], [-(1 << 31), (1 << 31) - 1]], "<i4")
    (tmp_path / "0.dat").write_bytes(pairs.tobytes())
    got = logs.read_pairs(spark, str(tmp_path / "0.dat")).orderBy("position").collect()
    assert [(r.key, r.value) for r in got] == [tuple(map(int, p)) for p in pairs]


def test_extreme_keys(spark):
    log = log_of(spark, [("p", LOW, 100), ("p", HIGH, 200), ("p", 0, 300), ("p", -1, 400), ("p", LOW, 150)])
    image = resolve.image(resolve.entries(log))
    assert [tuple(r) for r in lookup.scan(image, LOW, LOW + 1).collect()] == [(LOW, 150)]
    assert lookup.scan(image, HIGH - 1, HIGH).count() == 0 and lookup.scan(image, 5, 4).count() == 0
    assert [tuple(r) for r in lookup.scan(image, -1, 1).collect()] == [(-1, 400), (0, 300)]


@SLOW
@given(ops)
def test_replay_is_a_dict(spark, rows):
    log, d = log_of(spark, rows), Dict(rows)
    assert {r.key: r.value for r in resolve.image(resolve.entries(log)).collect()} == d.live
    assert {r.seq: r.value for r in replay.gets(log).collect()} == d.gets
    assert {r.seq: r.succeeded for r in replay.deletes(log).collect()} == d.dels
    assert {(r.seq, r.key): r.value for r in replay.ranges(log).collect()} == d.ranges


def test_chunks_carry_state(spark):
    rows = random_log(random.Random(1), 400)
    log, d = log_of(spark, rows), Dict(rows)
    for chunk in (1, 7, 50, 1000):
        got = resolve.as_of(log.where("op = 'g'").select("seq", "key"), log, chunk)
        assert {r.seq: r.value for r in got.collect()} == d.gets
    assert {r.seq: r.previous for r in resolve.previous(log).collect()} == d.before


@pytest.fixture
def unstable_sorts(spark):
    """Sorts that spill after every second row: rows with equal keys leave them in any order, as they do on large tables."""
    conf, name = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "2")
    yield
    conf.remove(name)


def test_deletes_do_not_see_themselves(spark, unstable_sorts):
    rows = random_log(random.Random(5), 600, 6)
    assert {r.seq: r.succeeded for r in replay.deletes(log_of(spark, rows)).collect()} == Dict(rows).dels


def test_puts_do_not_see_themselves(spark, unstable_sorts):
    rows = random_log(random.Random(6), 600, 6)
    assert {r.seq: r.previous for r in resolve.previous(log_of(spark, rows)).collect()} == Dict(rows).before


def test_report(spark):
    rows = random_log(random.Random(2), 500)
    d = Dict(rows)
    sizes = {}
    for s, _ in d.ranges:
        sizes[s] = sizes.get(s, 0) + 1
    r = replay.report(log_of(spark, rows)).first()
    assert r.successful_gets == sum(v is not None for v in d.gets.values()) and r.failed_gets == len(d.gets) - r.successful_gets
    assert (r.successful_dels, r.failed_dels) == (sum(d.dels.values()), len(d.dels) - sum(d.dels.values()))
    assert (r.non_empty_ranges, r.smallest_range, r.largest_range) == (len(sizes), min(sizes.values()), max(sizes.values()))
    assert r.puts == sum(op == "p" for op, *_ in rows) and r.ranges == sum(op == "r" for op, *_ in rows)
    assert tuple(replay.report(log_of(spark, [])).first()) == (0,) * 10


def test_known_counts(spark):
    """An independent replay of the event log at this size."""
    r = replay.report(logs.events_log(spark, "/root/testdata/sf0.01")).first()
    assert (r.successful_gets, r.failed_gets, r.ranges, r.non_empty_ranges) == (1266, 1982 - 1266, 2006, 1994)


def test_range_join(spark):
    rng = random.Random(4)
    points = [(rng.randrange(-1000, 1000),) for _ in range(300)] + [(LOW,), (HIGH - 1,)]
    ranges = [(i, a, a + rng.choice((-3, 0, 1, 2, 3, 17, 500, 5000))) for i, a in enumerate(rng.randrange(-1200, 1200) for _ in range(80))]
    got = lookup.range_join(spark.createDataFrame(ranges, "id long, start long, end long"), spark.createDataFrame(points, "key long")).select("id", "key").collect()
    want = sorted((i, k) for i, a, b in ranges for (k,) in points if a <= k < b)
    assert sorted(map(tuple, got)) == want
    plan = lookup.range_join(spark.createDataFrame(ranges, "id long, start long, end long"), spark.createDataFrame(points, "key long"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lookups(spark):
    image = resolve.image(resolve.entries(log_of(spark, [("p", i, 10 * i) for i in range(10)] + [("d", 3, None)])))
    assert tuple(lookup.get(spark, image, 4).first()) == (4, 40) and lookup.get(spark, image, 3).first().value is None
    ranges = spark.createDataFrame([(1, -1, 1), (2, 0, 5), (3, 100, 200), (4, 8, 15)], "id long, start long, end long")
    got = {r.id: r.reply for r in lookup.range_replies(image, ranges).collect()}
    assert got == {1: "0:0", 2: "0:0 1:10 2:20 4:40", 3: "", 4: "8:80 9:90"}


def test_names():
    assert run_name(0, 7) == "L00_R0000000007"


def test_range_counts(spark):
    """Like the pairs of range_join, with repeated keys, ids and ranges, nulls, and bounds of all sizes."""
    rng = random.Random(8)
    keys = [rng.choice((LOW, HIGH, 0, rng.randrange(-40, 40), rng.randrange(LOW, HIGH))) for _ in range(300)] + [None] * 3
    some = [None, LOW, HIGH, *[k for k in keys[:40] if k is not None], *range(-45, 45, 7)]
    ranges = [(i // 2, rng.choice(some), rng.choice(some)) for i in range(150)]
    ranges += ranges[:10]
    want = {}
    for i, a, b in ranges:
        for k in keys:
            if None not in (a, b, k) and a <= k < b:
                n, low, high = want.get(i, (0, k, k))
                want[i] = (n + 1, min(low, k), max(high, k))
    image, asked = spark.createDataFrame([(k, 0) for k in keys], "key long, value long"), spark.createDataFrame(ranges, "id long, start long, end long")
    assert {r.id: (r.n, r.low, r.high) for r in lookup.range_counts(image, asked).collect()} == want
    assert lookup.range_counts(image.limit(0), asked).count() == lookup.range_counts(image, asked.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 50_000])
def test_points_of_ranges_are_not_broadcast(spark, monkeypatch, most):
    """Each point has a row a size of range, of which Spark's estimate of their size knows nothing."""
    monkeypatch.setattr(lookup, "BROADCAST_RANGES", most)
    ranges = spark.range(30).selectExpr("id", "id - 15 as start", "id - 15 + (1L << id) as end")
    points = spark.range(-50, 50).selectExpr("id as key")
    found = lookup.range_join(ranges, points)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" not in plan and ("BuildLeft" in plan) == (most > 0) and ("SortMergeJoin" in plan) == (most == 0)
    assert sorted((r.id, r.key) for r in found.collect()) == sorted((i, k) for i in range(30) for k in range(-50, 50) if i - 15 <= k < i - 15 + (1 << i))


def test_range_extremes_makes_no_pairs(spark):
    from kvspark.queries import FOUND

    plan = FOUND["range_extremes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "_cell" not in plan
