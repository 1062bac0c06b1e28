"""What must not grow with the square of a group or stay on disk."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from kvspark.llm import line_dedup, near_dup, tables, topk


def test_lines_that_share_a_key_but_are_unlike_make_no_group():
    """A run whose nodes SimHash and MinHash connect in a chain gives the chain's pairs, not all nodes."""
    n = 600
    node = np.arange(n) * 3

    def near(i, j):
        return j - i == 1

    out = [b for b in tables.Candidates(16, shatter=True).emit(node, np.array([0]), np.array([n]), near)]
    assert sum(b.column("members").null_count for b in out) == sum(b.num_rows for b in out)
    assert {(a, b) for x in out for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())} == {(3 * k, 3 * k + 3) for k in range(n - 1)}


def test_short_mins_never_drop_what_agrees():
    rng = np.random.default_rng(5)
    packed = []
    for k in range(400):
        x = rng.integers(0, 1 << 16, 23, dtype=np.uint16)
        if k % 2:
            x = np.where(rng.random(23) < rng.choice((0.3, 0.5, 0.7)), np.frombuffer(packed[-1].ljust(46, b"\0"), np.uint16), x).astype(np.uint16)
        packed.append(x.tobytes()[: 46 if k % 4 < 2 else 32])
    packed = pa.array(packed, pa.binary())
    mins, short = line_dedup._mins(packed), line_dedup.short_mins(packed)
    words = np.ascontiguousarray(short[:, :2]).view(np.uint64).ravel()
    i, j = np.triu_indices(400, 1)
    real, may = line_dedup.agree(mins, i, mins, j), line_dedup.may_agree(words, np.ascontiguousarray(short[:, 2]), i, j)
    assert real.any() and not (real & ~may).any() and may.mean() < 0.05


def test_save_leaves_no_shuffle_files(spark):
    def shuffled():
        status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
        return status.size()

    spark._jvm.System.gc()
    before = shuffled()
    kept = tables.save(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "kept")
    assert shuffled() <= before and kept.count() == 10
    tables.drop(kept)
    assert not Path(kept._saved[0].removeprefix("file://")).exists()


def test_topk_sends_the_index_once_and_broadcasts_nothing(spark):
    """However small Spark thinks the packed queries are, before they are copied for each slice."""
    vectors = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    found = topk.top_k(vectors, F.col("vec_id") % 20 == 0, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert found.count() == 300


def test_topk_slices_of_several_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 2)
    rng = np.random.default_rng(2)
    data = [(i, rng.integers(-90, 90, 3 + (i > 100)).astype(float).tolist()) for i in range(220)]
    data[7] = (7, [1e6, 0.5, 2.0])
    found = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 4)
    got = {tuple(r) for r in found.collect()}
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in data}
    want = set()
    for q in range(0, 220, 20):
        s = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4]
        want |= {(q, r, i, -d) for r, (d, i) in enumerate(s, 1)}
    assert got == want


def _saved(monkeypatch, *modules):
    """The number of rows of each table that is saved from now on, by name."""
    rows, save = {}, tables.save

    def counted(df, name, small=False):
        out = save(df, name, small)
        rows.setdefault(name, []).append(out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "save", counted)
    return rows


def test_texts_are_written_only_for_pairs_that_pass_the_screen(spark, monkeypatch):
    """Documents that share a block key with others but are too far apart by their sketches send no text."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 120)]
    docs = [base[:90] + [f"x{d}y{k}" for k in range(30)] for d in range(12)]  # 86 of 146 shingles in common: none links
    docs.append(docs[0][:-2] + ["end", "here"])
    rows = _saved(monkeypatch, near_dup, tables)
    found = near_dup.jaccard_components(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i % 12 for i in range(13)}
    assert rows["wanted"][0] == 13 and sum(rows["texts"]) == 2


def test_line_texts_are_fetched_in_passes(spark, monkeypatch):
    """The shuffle of whole texts never holds all documents whose lines are compared."""
    line = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar"
    docs = [(i, f"{line} papa{i}") for i in range(64)]
    rows = _saved(monkeypatch, line_dedup, tables)
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sum(r["n_removed"] for r in found.collect()) == 63
    assert sum(rows["norms"][: line_dedup.TEXT_PASSES]) == 64 and max(rows["norms"]) < 48


@pytest.mark.parametrize("step", [50, 1])
def test_pairs_inside_a_component_are_not_verified_again(spark, step):
    """If all pairs of some nodes link, those with each node's smallest partner are enough; if few do, all are verified."""
    nodes = 30
    pairs = [(a, b, None) for b in range(nodes) for a in range(b)]
    found = tables.save(spark.createDataFrame(pairs, tables.CANDIDATES), "candidates")
    asked = spark.sparkContext.accumulator(0)

    def verify(pairs, texts):
        def count(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b.filter(pc.less_equal(pc.subtract(b.column("b"), b.column("a")), step))

        return pairs.select("a", "b").mapInArrow(count, "a long, b long")

    comps = tables.link(found, lambda p: p, lambda ids: tables.save(ids, "texts"), verify, None, None, None, 3)
    assert {(r["node"], r["comp"]) for r in comps.collect()} == {(k, 0) for k in range(nodes)}
    assert asked.value == (nodes - 1 if step == 50 else nodes * (nodes - 1) // 2)
