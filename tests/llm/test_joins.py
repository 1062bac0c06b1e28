"""Jaccard join, substring dedup and decontamination against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kvspark.llm import decontaminate, near_dup, queries, substring_dedup, tables
from kvspark.llm.tables import components

from .cases import DOCS, SYLLABLES, Groups, alnum, edit, rows, sentence, sha, shingles, split


def jaccard_brute(data):
    sets = [shingles(r[1]) for r in data]
    g = Groups(len(data))
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                g.join(i, j)
    out = []
    for i, r in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if g.find(j) == g.find(i) and data[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]))
    return Counter(out)


def test_jaccard_cases(spark):
    data = rows()
    found = near_dup.jaccard_components(spark.createDataFrame(data, DOCS))
    assert Counter(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == jaccard_brute(data)


@pytest.mark.parametrize("tile", [256, 7])
def test_jaccard_large_runs(spark, monkeypatch, tile):
    """A large family of near copies around the threshold, and many texts that share a passage, in one
    tile and in many."""
    monkeypatch.setattr(tables, "TILE", tile)
    rng = random.Random(3)
    base = sentence(rng, 90)
    passage = sentence(rng, 40)
    data = [(i, edit(rng, base, rng.choice((0.01, 0.02, 0.03))), *[None] * 9) for i in range(90)]
    data += [(100 + i, passage + " " + sentence(rng, 25), *[None] * 9) for i in range(60)]
    data += [(200 + i, edit(rng, base, 0.0), *[None] * 9) for i in range(10)]
    found = near_dup.jaccard_components(spark.createDataFrame(data, DOCS), small=4)
    assert Counter(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == jaccard_brute(data)


def test_sketches_bound_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 3, 10, 100, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
        band = near_dup.band_of(max(len(a), len(b)))
        x, y = (np.frombuffer(near_dup.sketch(s, band), np.uint64) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
        if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
            none = np.zeros(0, np.uint64)
            assert set(near_dup.block_keys(a, band, 0.75, none).tolist()) & set(near_dup.block_keys(b, band, 0.75, none).tolist())


def test_one_of_each(spark):
    data = rows()
    kept = near_dup.one_of_each(spark.createDataFrame(data, DOCS)).collect()
    assert kept[0].__fields__ == DOCS.names
    brute = jaccard_brute(data)
    some = Counter(c for _, n, c in brute if n)
    worded = [r for r in kept if shingles(r.text)]
    assert len(worded) == len(some) and len(kept) - len(worded) == sum(1 for r in data if not shingles(r[1]))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 100)]
    g = Groups(2200)
    for a, b in links:
        g.join(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {x: g.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_brute(data, window=13):
    words = [split(r[1]) for r in data]
    first = {}
    for r, w in zip(data, words):
        if r[0] is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r, w in zip(data, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[i : i + window])] < r[0]:
                gone.update(range(i, i + window))
        out.append((r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return Counter(out)


@pytest.mark.parametrize("seed", [5, 6])
def test_substring_cases(spark, seed):
    data = rows(seed)
    found = substring_dedup.remove_repeats(spark.createDataFrame(data, DOCS))
    assert Counter(map(tuple, found.collect())) == repeats_brute(data)


def test_substring_keeps_text(spark):
    data = rows()
    for r in substring_dedup.remove_repeats(spark.createDataFrame(data, DOCS), keep_text=True).collect():
        assert sha(r.kept) == r.kept_sha256


ITEMS = "item_id long, text string, n_hit string"


def leaks_brute(data, items, window=13):
    out = []
    wins = {}
    for item, text, _ in items:
        w = alnum(text)
        if item is not None and w:
            n = min(len(w), window)
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in wins}
    for r in data:
        w = alnum(r[1])
        hit, who = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    who |= wins[k]
        out.append((r[0], len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def _leaks(df):
    hit = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return Counter(map(tuple, df.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256), hit).collect()))


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_decontamination_cases(spark, block_words):
    data = rows()
    rng = random.Random(9)
    passage = " ".join(data[40][1].split(" ")[30:60])
    items = [(1, passage, None), (10, passage.upper() + "!", None), (2, "two words", None), (3, None, None), (4, "", None), (5, "?!", None), (None, "word", None)]
    items += [(6, sentence(rng, 30), "x"), (7, data[15][1], None), (7, "word", None), (8, "日本語", None), (9, " ".join(SYLLABLES[:14]), None)]
    bench = spark.createDataFrame(items, ITEMS)
    found = decontaminate.contamination(spark.createDataFrame(data, DOCS), bench, block_words=block_words)
    assert _leaks(found) == leaks_brute(data, items)
    assert found.select("row.*").columns == DOCS.names


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert near_dup.jaccard_components(none).count() == 0
    assert near_dup.one_of_each(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert decontaminate.contamination(none, spark.createDataFrame([], ITEMS)).count() == 0
    some = decontaminate.contamination(spark.createDataFrame(rows(), DOCS), spark.createDataFrame([], ITEMS))
    assert some.agg(F.sum("n_hit")).first()[0] == 0


def test_sql_covers_what_it_can():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_many_sets_at_once():
    import numpy as np

    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 3, 4, 5, 7, 9, 20, 64, 300, 2000)]
    frequent = np.sort(np.concatenate([s[::3] for s in sets]))
    own, key = near_dup.slice_keys(sets, 0.75, frequent)
    for i, s in enumerate(sets):
        band = near_dup.band_of(len(s))
        want = np.concatenate([near_dup.block_keys(s, b, 0.75, frequent) for b in (band, band + 1)])
        assert sorted(key[own == i].tolist()) == sorted(want.tolist())
