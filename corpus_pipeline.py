"""A corpus pipeline over ``documents``: each stage is one operator of ``kvspark.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of documents; the last returns the pieces that training batches hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.llm import decontaminate, language, line_dedup, near_dup, packing
from kvspark.llm.tables import save, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that have no language: no text, or text without a letter. lang of the others
    becomes the language whose model codes the text shortest, whatever it was; the models have seen the
    labelled rows they were fitted on, so that such a row mostly keeps even a wrong lang."""
    told = F.col("lang_pred") != language.UNKNOWN
    # without a language to learn from, texts with letters can't be told but stay
    found = language.identify(docs).where(told | F.col("row.text").cast("string").rlike(r"\p{L}"))
    lang = F.when(told, F.col("lang_pred").cast(docs.schema["lang"].dataType)).otherwise(F.col("row.lang")).alias("lang")
    return found.select(*(lang if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated and nearly repeated lines out of the texts; n_chars follows. A document
    that loses its last word this way goes."""
    found = line_dedup.dedup_lines(docs)
    lost = (F.col("n_removed") > 0) & ~F.col("kept").rlike(r"[^ \t-\r]")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.where(~F.coalesce(lost, F.lit(False))).select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that Jaccard links connect."""
    return near_dup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of whose words a twentieth or more belong to benchmark passages."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents' pieces into length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: PPM code lengths, SimHash groups and bucket boundaries have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
