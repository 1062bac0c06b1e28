"""The pipeline against the brute-force versions of its stages, one after the other."""

import random
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry

from .cases import DOCS, alnum, edit, rows, sentence, shingles, split
from .test_joins import ITEMS, Groups, leaks_brute
from .test_lines import lines_brute


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    base = sentence(rng, 80)
    passage = sentence(rng, 30)
    data = rows()[:-1]  # the last row shares its doc_id with another text: see the line tests
    data += [(300 + i, edit(rng, base, 0.02), "en", None, None, *[None] * 6) for i in range(8)]
    data += [(400 + i, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 30), "en", None, None, *[None] * 6) for i in range(2)]
    items = [(1, passage, None), (2, sentence(rng, 20), None)]
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in data if r[1] is not None and any(c.isalpha() for c in r[1])]
    lines = list(lines_brute(kept).elements())
    kept = [(i, t) for i, t, _, gone in lines if not (gone and not split(t))]
    sets = [shingles(t) for _, t in kept]
    g = Groups(len(kept))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                g.join(i, j)
    first = {}
    for i, (doc, _) in enumerate(kept):
        c = g.find(i)
        rank = (doc is None, doc or 0)
        if c not in first or rank < first[c][0]:
            first[c] = (rank, i)
    kept = [kept[i] for _, i in first.values()]
    out = Counter()
    for doc, text in kept:
        _, n, hit, *_, bad = next(iter(leaks_brute([(doc, text)], items)))
        if not bad:
            words = len(split(text)) + 1
            out[(doc, 0, 0, words)] += words <= 4096
            if words > 4096:
                for p in range(-(-words // 4096)):
                    out[(doc, p, p * 4096, min(4096, words - p * 4096))] += 1
    assert Counter((r.doc_id, r.piece, r.first, r.length) for r in got) == +out
    # the second copy of the passage goes as a repeated line, the first with its document
    assert 400 not in {r.doc_id for r in got}


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == DOCS.names, name
        assert stage(spark, spark.createDataFrame([], DOCS), sf).count() == 0, name


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert alnum("A-b") == ["a", "b"]


def test_documents_stay_without_languages(spark):
    data = [(1, "some words", None, *[None] * 8), (2, "123 ...", None, *[None] * 8), (3, None, None, *[None] * 8)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(data, DOCS), "/root/testdata/sf0.001")
    assert [r.doc_id for r in kept.collect()] == [1]


def test_predicted_language_is_written(spark):
    rng = random.Random(3)
    alphabets = {"aa": "abcdefgh", "nn": "nopqrstu"}

    def text(lang):
        return " ".join("".join(rng.choices(alphabets[lang], k=5)) for _ in range(30))

    truth = [["aa", "nn"][i % 2] for i in range(60)]
    data = [(i, text(x), None if i % 5 == 0 else x, *[None] * 8) for i, x in enumerate(truth)]
    data.append((60, "123 ...", "aa", *[None] * 8))
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(data, DOCS), "/root/testdata/sf0.001")
    assert {r.doc_id: r.lang for r in kept.collect()} == dict(enumerate(truth))
