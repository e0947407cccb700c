"""Corpus preparation: quality rules, near-duplicates, decontamination, personal data and packing, each over all its predecessor kept.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the next one's docs. All but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontaminate, neardup, packing, pii, quality
from linkloom.llm.common import materialize, small_batches, table


#: Workers serve all stages one after another, so what one stage keeps adds to the memory of the next.
CACHED_WORDS = 50_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    small_batches(spark)
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id of each class of near-duplicates."""
    small_batches(spark, 256)
    return neardup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every text stands in the packed sequences."""
    small_batches(spark)
    pieces = packing.pieces(docs, cached_words=CACHED_WORDS).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: Tokenisers, signatures and the packing plan aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
