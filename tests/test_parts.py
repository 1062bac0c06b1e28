"""Blocks, filters, codecs, caches and streams."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kvspark import oracle, queries
from kvspark.functions import bloom, codecs
from kvspark.operators import blocks, cache, encode, lookup, membership, resolve
from kvspark.plans.store import Store
from kvspark.schema import InvalidInput
from kvspark.sources import logs
from kvspark.streaming import ingest

from .test_core import HIGH, LOW, Dict, log_of, random_log

PAIRS = "run long, key long, value long"


def test_blocks(spark):
    rng = random.Random(1)
    data = [(r, k, k) for r in range(3) for k in rng.sample(range(-200_000, 200_000), 50 + r)]
    got = blocks.blocks(spark.createDataFrame(data, PAIRS), 8).collect()
    for r in range(3):
        keys = sorted(k for x, k, _ in data if x == r)
        assert {(g.key, g.row, g.block) for g in got if g.run == r} == {(k, i, i // 8) for i, k in enumerate(keys)}


def test_fences(spark):
    rng = random.Random(2)
    data = [(r, k, 0) for r in range(2) for k in rng.sample(range(1000), 120)]
    zones = blocks.zone_map(blocks.blocks(spark.createDataFrame(data, PAIRS), 10)).persist()
    z = zones.collect()
    probes = [-1, 0, 5, 333, 999, 5000]
    got = blocks.find_points(zones, spark.createDataFrame([(p,) for p in probes], "key long")).collect()
    assert {tuple(g) for g in got} == {(p, x.run, x.block) for p in probes for x in z if x.min_key <= p <= x.max_key}
    for p in probes:
        two = blocks.find_in_two(zones, p, 4).collect()
        assert {(x.run, x.block) for x in two} == {(x.run, x.block) for x in z if x.min_key <= p <= x.max_key}
    for a, b in ((0, 10), (100, 500), (7, 7), (9, 3), (-50, 5000)):
        got = blocks.find_ranges(zones, a, b).collect()
        assert {(x.run, x.block) for x in got} == {(x.run, x.block) for x in z if a < b and x.min_key < b and x.max_key >= a}


def test_prefixes(spark):
    keys = [LOW, LOW + 5, -1, 0, 7, 1 << 32, (1 << 32) + 9, (5 << 32) | 0xFFFFFFFF, HIGH]
    g = blocks.prefix_groups(spark.createDataFrame([(k,) for k in keys], "key long"))
    back = g.select(blocks.join_prefix(F.col("prefix"), F.col("min_suffix")).alias("a"), blocks.join_prefix(F.col("prefix"), F.col("max_suffix")).alias("b")).collect()
    assert sorted(tuple(r) for r in back) == [(LOW, LOW + 5), (-1, -1), (0, 7), (1 << 32, (1 << 32) + 9), ((5 << 32) | 0xFFFFFFFF, (5 << 32) | 0xFFFFFFFF), (HIGH, HIGH)]


def test_filters(spark):
    keys = spark.range(-3000, 3000).select((F.col("id") * 7919).alias("key"))
    members = keys.where("key % 2 = 0")
    for bits in (4096, 65_536, 1 << 19):
        probed = membership.probe(keys, membership.build(members, bits), bits)
        r = membership.rates(probed, members).first()
        assert r.false_negatives == 0 and r.positives == 3000 + r.false_positives
    assert r.observed_fp < 0.05
    none = membership.probe(keys, membership.build(members.limit(0), 4096), 4096)
    assert membership.rates(none, members.limit(0)).first().observed_fp == 0


def test_sizing(spark):
    levels = spark.range(5).select(F.col("id").alias("level"))
    bits = bloom.level_bits(F.col("level"))
    got = levels.select(bits.alias("b"), bloom.hashes_for(bits).alias("k"), (bloom.block_bits(F.lit(10_000), bits) / 8).cast("long").alias("bytes")).collect()
    assert [r.b for r in got] == [32, 16, 8, 4, 2] and [r.k for r in got] == [10, 10, 6, 3, 1]
    assert [r.bytes for r in got] == [65536, 32768, 16384, 8192, 4096]


INTS = st.integers(LOW, HIGH)
SHAPES = {
    "sequential": [(i, 2 * i) for i in range(300)], "constant": [(42, 42)] * 9, "timestamps": [(1_600_000_000 + 60 * i, i) for i in range(100)],
    "extreme": [(LOW, HIGH), (-1, LOW), (0, 0), (HIGH, -1)], "one": [(5, -5)], "repeated": [(i % 5, i % 5) for i in range(60)],
}


@pytest.mark.parametrize("codec", ["none", "bit_pack", "delta", "dictionary", "lz4", "snappy"])
def test_block_codecs(codec):
    for pairs in SHAPES.values():
        key, value = (np.array(x, np.int64) for x in zip(*pairs))
        k, v = encode.decode_block(codec, encode.encode_block(codec, key, value), len(key))
        assert k.tolist() == key.tolist() and v.tolist() == value.tolist()
    with pytest.raises(InvalidInput):
        encode.encode_block("zip", key, value)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(INTS, INTS), min_size=1, max_size=40), st.sampled_from(["bit_pack", "delta", "dictionary"]))
def test_block_codecs_any_integers(pairs, codec):
    key, value = (np.array(x, np.int64) for x in zip(*pairs))
    k, v = encode.decode_block(codec, encode.encode_block(codec, key, value), len(key))
    assert k.tolist() == key.tolist() and v.tolist() == value.tolist()


def test_sizes_match_bytes(spark):
    data = [(0, 10 * i + i % 3, 1000 - i) for i in range(100)]
    b = blocks.blocks(spark.createDataFrame(data, PAIRS), 64).persist()
    for codec, model in (("bit_pack", encode.bit_pack_sizes(b)), ("delta", encode.delta_sizes(b))):
        real = {r.block: len(r.payload) for r in encode.encode(b, codec).collect()}
        for r in model.collect():
            assert abs(r["bytes"] - real[r.block]) <= 2
    assert encode.decode(encode.encode(b, "delta")).count() == 100


def test_checksum(spark):
    b = blocks.blocks(spark.createDataFrame([(0, i, i) for i in range(10)], PAIRS), 64)
    broken = encode.encode(b, "none").withColumn("checksum", F.col("checksum") + 1)
    with pytest.raises(Exception, match="checksum"):
        encode.decode(broken).collect()


def test_width(spark):
    rows = [(0, 0, 1), (0, 1, 1), (0, 255, 8), (-5, 5, 4), (LOW, HIGH, 64), (0, HIGH, 64), (0, HIGH // 2, 62)]
    got = spark.createDataFrame([r[:2] for r in rows], "a long, b long").select(codecs.width(F.col("a"), F.col("b")).alias("w")).collect()
    assert [r.w for r in got] == [r[2] for r in rows]


def test_adaptive(spark):
    rows = [(0, 9999, False, 5, 0.0), (1, 9999, True, 5, 0.0), (2, 9999, True, 5, 0.0), (2, 999, False, 5, 0.9), (3, 999, False, 999, 0.9), (3, 999, False, 5000, 0.6), (3, 999, False, 5000, 0.1), (3, 100, True, 5, 0.0)]
    df = spark.createDataFrame(rows, "level int, raw int, seq boolean, r long, rep double")
    got = [r[0] for r in df.select(codecs.adaptive(F.col("level"), F.col("raw"), F.col("seq"), F.col("r"), F.col("rep"))).collect()]
    assert got == ["none", "snappy", "delta", "snappy", "bit_pack", "dictionary", "lz4", "none"]


def test_caches(spark):
    lru = cache.make_cache("lru", 2)
    assert [lru.access(k, i) for i, k in enumerate((1, 2, 1, 3, 2, 1))] == [False, False, True, False, False, False]
    tiny = cache.make_cache("tinylfu", 2)
    for k in (1, 1, 1, 2, 2, 9):
        tiny.access(k, 0)
    assert tiny.access(1, 0) and not tiny.access(9, 0) and tiny.access(2, 0)
    ttl = cache.make_cache("tinylfu_ttl", 2, ttl=20)
    assert [ttl.access(1, t) for t in (0, 15, 25, 26)] == [False, True, False, True] and ttl.expired == 1
    top = cache.make_cache("priority_lfu", 1, priority=lambda k: "critical" if k == 1 else "low")
    assert [top.access(k, 0) for k in (1, 2, 2, 2, 2, 1)][-1]
    with pytest.raises(InvalidInput):
        cache.make_cache("none", 1)
    trace = spark.range(2000).select(F.col("id").alias("seq"), (F.col("id") % 37).alias("key"))
    sim = cache.simulate(trace, "lru", 64, shards=4).agg(F.sum("accesses"), F.sum("hits"), F.sum("misses")).first()
    assert sim[0] == 2000 and sim[1] + sim[2] == 2000


def test_stream_into_store(spark, tmp_path):
    rows = random_log(random.Random(6), 120)
    for i in range(3):
        log_of(spark, rows).where(f"seq div 40 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log_of(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    ingest.into_store(stream, store, str(tmp_path / "check")).awaitTermination()
    assert {r.key: r.value for r in store.image().collect()} == Dict(rows).live
    live = ingest.run_available(ingest.live_image(stream), "t_live", str(tmp_path / "check2"))
    assert {r.key: r.value for r in live.where("not dead").collect()} == Dict(rows).live


def test_live_map(spark, tmp_path):
    rows = [("p", 1, 10), ("p", 2, 20), ("d", 1, None), ("p", 2, 30)]
    log_of(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log_of(spark, rows).schema).parquet(str(tmp_path / "in"))
    got = ingest.run_available(ingest.live_map(stream), "t_map", str(tmp_path / "check"), "update").collect()
    assert sorted((r.key, r.seq, r.value) for r in got) == [(1, 0, 10), (1, 2, None), (2, 1, 20), (2, 3, 30)]


def test_plans_push_filters(spark):
    image = resolve.image(resolve.entries(logs.events_log(spark, "/root/testdata/sf0.001"))).where("key = 7")
    plan = image._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in plan and "max_by" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, sf)
    if name not in oracle.oracle_sql():
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(oracle.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    norm = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert norm(map(tuple, got.select(*cols).collect())) == norm(con.sql(f"SELECT {', '.join(cols)} FROM ({oracle.oracle_sql()[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sketch_misses_are_counted_over_all_keys(spark):
    from kvspark.operators import membership
    from kvspark.queries import bloom_sketch

    keys = spark.range(0, 4000, 2).withColumnRenamed("id", "key")
    assert membership.missed(keys, membership.sketch(keys, "key", 2000, 0.01), "key") == 0
    # the first hundred keys alone would pass
    assert membership.missed(keys, membership.sketch(keys.where("key < 200"), "key", 2000, 0.01), "key") > 1800
    assert bloom_sketch(spark, "/root/testdata/sf0.001").first()["missed"] == 0


def test_range_join_of_all_lengths(spark):
    """Random 64-bit ranges, the extremes among them, against brute force."""
    rng = random.Random(17)
    low, high = -(1 << 63), (1 << 63) - 1
    near = [low, low + 1, -1, 0, 1, (1 << 60) - 1, 1 << 60, high - 1, high]
    keys = sorted({*near, *(rng.randint(low, high) for _ in range(60)), *(rng.randint(-100, 100) for _ in range(30))})
    spans = [(low, high), (high, low), (low, low + 1), (high - 1, high), ((1 << 60) - 1, (1 << 61) + 100 - 1), (5, 5)]
    spans += [(rng.choice(keys), rng.choice(keys)) for _ in range(120)]
    ranges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "id long, start long, end long")
    points = spark.createDataFrame([(k,) for k in keys], "key long")
    for closed in (False, True):
        got = {(r.id, r.key) for r in lookup.range_join(ranges, points, closed=closed).collect()}
        assert got == {(i, k) for i, (a, b) in enumerate(spans) for k in keys if a <= k < b or closed and a <= k == b}


def test_blocks_and_sizes_of_extreme_keys(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(0, k, v) for k, v in ((low, high), (-5, low), (0, 7), (9, high), (high, low))]
    pairs = spark.createDataFrame(rows, "run long, key long, value long")
    b = blocks.blocks(pairs, 2)
    assert sorted((r.block, r.key) for r in b.collect()) == [(0, low), (0, -5), (1, 0), (1, 9), (2, high)]
    found = blocks.find_points(blocks.zone_map(b), spark.createDataFrame([(high,), (low,)], "key long")).collect()
    assert sorted((r.key, r.block) for r in found) == [(low, 0), (high, 2)]
    whole = blocks.blocks(pairs, 100)
    size = encode.delta_sizes(whole).first()["bytes"]
    ordered = sorted(rows, key=lambda r: r[1])
    raw = encode.encode_block("delta", np.array([r[1] for r in ordered]), np.array([r[2] for r in ordered]))
    assert size == len(raw)
    assert encode.shapes(whole).count() == 1
    spread = spark.range(3000).selectExpr("0L run", "id * 3074457345618000 key", "id value")
    numbered = blocks.number(spread).orderBy("key").select("row").collect()
    assert [r.row for r in numbered] == list(range(3000))


def test_filters_deny_no_key(spark):
    runs = spark.range(4000).selectExpr("cast(id % 2 as int) level", "0L run", "id * 3 key")
    keys = spark.range(-50, 6000).withColumnRenamed("id", "key")
    for variant in bloom.VARIANTS:
        out = membership.run_statistics(runs, keys, variant).collect()
        assert len(out) == 2 and all(r.false_negatives == 0 and r.checks == 6050 and r.false_positives < 0.05 * r.checks for r in out)


def test_expiry_and_priority():
    c = cache.make_cache("tinylfu_ttl", 2, ttl=20)
    assert [c.access(1, t) for t in (0, 5, 19, 20, 25)] == [False, True, True, False, True] and c.expired == 1
    p = cache.make_cache("priority_lfu", 1, priority=lambda k: "critical" if k == 7 else "low")
    p.access(1, 0), p.access(1, 1)
    assert not p.access(7, 2) and p.access(7, 3) and not p.access(1, 4) and p.access(7, 5)
