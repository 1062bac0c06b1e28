"""Quality, toxicity and language on held-out rows and awkward rows."""

import random
from math import log2

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvspark.llm import language, quality, queries, toxicity

from .cases import DOCS, rows, sentence

LABELS = "doc_id long, quality int, toxic int, score string"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        rank[s == v] = (np.flatnonzero(s[order] == v) + 1).mean()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("name,label,least", [("op1_quality", "quality", 0.99), ("op2_toxicity", "toxic", 0.95)])
def test_held_out(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    found = queries.queries()[name](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", label).toPandas()
    assert held["score"].between(0, 1).all()
    assert auc(held[label].to_numpy(), held["score"].to_numpy()) > least


def test_held_out_labels_are_not_used(spark):
    """Changing held-out labels changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for op, col, where in ((quality, "quality", queries.fold(3) != 1), (toxicity, "toxic", queries.fold(5) != 0)):
        turned = labels.withColumn(col, F.when(where, F.col(col)).otherwise(1 - F.col(col)))
        a, b = (dict(op.score(docs, x, where).select("doc_id", "score").collect()) for x in (labels, turned))
        assert a == pytest.approx(b, abs=1e-6)


def test_held_out_languages_are_not_used(spark):
    """Changing lang of held-out documents changes no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    where = queries.fold(4) != 2
    turned = docs.withColumn("lang", F.when(where, F.col("lang")).otherwise("another"))
    a, b = (sorted(language.identify(x, where).select("row.doc_id", "lang_pred", "score").collect()) for x in (docs, turned))
    assert a == b and len(a) == docs.count()


def test_awkward_rows(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    labels = spark.createDataFrame([(r[0], i % 2, int(i % 3 == 0), None) for i, r in enumerate(rows())] + [(None, 1, 1, None), (5, None, None, None), (6, 7, 7, None), (9999, 1, 0, None)], LABELS)
    for op in (quality, toxicity):
        for known in (labels, labels.limit(0)):
            found = op.score(docs, known).select("score").collect()
            assert len(found) == len(rows()) and all(0 <= r[0] <= 1 for r in found)
        assert op.score(spark.createDataFrame([], DOCS), labels).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), np.array([0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()


def segments_brute(s):
    """Maximal segments: the best one of each range, then those left and right of it."""
    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            t = 0
            for j in range(i, hi):
                t += s[j]
                if t > 0 and (top is None or t > top[2] + 1e-12):
                    top = (i, j + 1, t)
        if top is None:
            return []
        return best(lo, top[0]) + [top] + best(top[1], hi)
    return best(0, len(s))


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(300):
        s = np.array([rng.choice((-3, -2, -1, -1, 1, 2, 4)) + rng.random() * 0.01 for _ in range(rng.randint(0, 25))])
        got, want = toxicity.maximal_segments(s), segments_brute(s.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def ppm_brute(trees, text):
    """Code length by dictionaries, symbol by symbol."""
    out = []
    for col in range(len(trees.langs)):
        seen = [dict(zip(n.tolist(), c[:, col].tolist())) for n, c in trees.symbols]
        bits = 0
        for i in range(len(text)):
            padded = b"   " + text[:i]
            total = 8.0
            parts = 0.0
            for k in range(language.ORDER, -1, -1):
                ctx = int.from_bytes(padded[len(padded) - k :], "big") if k else 0
                after = {s: n for s in range(256) if (n := seen[k].get(ctx << 8 | s, 0))}
                if text[i] in after:
                    parts += log2((sum(after.values()) + len(after)) / after[text[i]])
                    total = 0.0
                    break
                if after:
                    parts += log2((sum(after.values()) + len(after)) / len(after))
            bits += round((parts + total) * language.UNITS)
        out.append(bits)
    return out


def test_code_lengths():
    texts = {"en": "the thing is there and then", "fr": "été à la plage où est-il allé"}
    langs = sorted(texts)
    lang, code = [], []
    for i, x in enumerate(langs):
        c, _ = language.grams(pa.array([texts[x]]))
        code += c.tolist()
        lang += [i] * len(c)
    pairs, n = np.unique(np.array([lang, code]), axis=1, return_counts=True)
    trees = language.Trees.fit(langs, pairs[0], pairs[1], n)
    coder = language.Coder(trees)
    for t in ("the plage", "élan", "zzz", ""):
        units, _ = coder.lengths(pa.array([t, "other", t]))
        data = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in t.encode())
        assert units[0].tolist() == units[2].tolist() == ppm_brute(trees, data)


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op6_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.98


def test_language_cases(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    found = language.identify(docs)
    assert found.select("row.*").columns == DOCS.names
    for r in found.collect():
        letters = r.row.text is not None and any(c.isalpha() for c in r.row.text)
        assert (r.lang_pred == "und") == (not letters)
        assert (0 < r.score <= 1) if letters else r.score == 0
    assert {r[0] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").collect()} == {"und"}
    assert language.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_passage_is_found(spark):
    rng = random.Random(7)
    data = [(i, sentence(rng, 40) + (" you zorgol filk zorgol " if i % 4 == 0 else " ") + sentence(rng, 40), *[None] * 9) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), None) for i in range(150)], LABELS)
    found = toxicity.score(spark.createDataFrame(data, DOCS), labels).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in found)
    for r in found:
        if r.doc_id % 4 == 0:
            assert any(s["first"] <= 41 and s["last"] >= 43 for s in r.segments)


def test_more_than_256_languages(spark):
    docs = spark.createDataFrame([(i, f"text{i:03d} " * 3, f"l{i:03d}") for i in range(300)], "doc_id long, text string, lang string")
    assert language.fit(docs, F.lit(True)).langs == [f"l{i:03d}" for i in range(300)]


def test_toxicity_fits_on_forty_thousand_rows():
    assert toxicity.FIT_ROWS == 40_000
