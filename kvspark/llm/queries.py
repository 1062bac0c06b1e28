"""Thin queries over the operators of this subpackage, and SQL for those it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, decontaminate, language, line_dedup, near_dup, packing, quality, substring_dedup, topk, toxicity
from .tables import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def _held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(fold(modulus) == remainder, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3) != 1)
    return found.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) != 0)
    return found.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, fold(4) != 2)
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), hit.alias("contaminated"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    dac.write_ids(table(spark, sf_dir, "documents"), out, public_tokenizers.path(TOKENIZER))
    return dac.document_digests(spark, out)


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5_SQL = r"""
WITH w AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
    SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, len(w) - 11)]) AS g FROM w
), m AS (
    SELECT g, min(doc_id) AS first FROM g GROUP BY g
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (g) WHERE doc_id > first
), x AS (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w
), k AS (
    SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

OP8_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), bw AS (
    SELECT DISTINCT item, n, g FROM (
        SELECT item, least(len(w), 13) AS n, unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ') FOR i IN range(1, greatest(len(w) - 13, 0) + 2)]) AS g FROM b WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM bw
), dw AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS g FROM d, sizes WHERE len(w) >= n
), m AS (
    SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), h AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), t AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP9_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
    FROM w
), n AS (
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), x AS (
    SELECT doc_id, unnest(s) AS g FROM s
), pairs AS (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT n.doc_id, n.n AS n_shingles, component_id FROM n JOIN least_of ON n.doc_id = least_of.a
"""

#: Scores, predictions, SimHash groups, packing by dynamic programming and tokenization have no SQL:
#: tests hold them against brute force, round trips and held-out labels.
SQL = {"op4_exact_topk": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op8_decontamination": OP8_SQL, "op9_jaccard_join": OP9_SQL}


def queries() -> dict[str, Query]:
    own = [op1_quality, op2_toxicity, op3_line_dedup, op4_exact_topk, op5_substring_dedup, op6_language_id, op7_packing, op8_decontamination, op9_jaccard_join, op10_token_ids]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
