"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.tables import drop_table, materialize, shared_dir

#: Words of a shingle, where an operator's contract names no other number.
SHINGLE_WORDS = 5


def give_back(spark: SparkSession) -> None:
    """Delete the shuffle files of steps that are done. Spark does so when the driver's JVM collects what refers to them, which a driver that isn't
    short of memory puts off until the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: str, k: int = SHINGLE_WORDS) -> str:
    """SQL for the 64-bit hashes of every ``k`` consecutive words of an array column; fewer words make one short shingle, none make none."""
    items = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return (
        f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> xxhash64({items})) "
        f"WHEN size({words}) > 0 THEN array(xxhash64(concat_ws(' ', {words}))) ELSE cast(array() AS array<bigint>) END"
    )


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts can be very long: bound the rows of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: The models that this worker keeps, by the operator that made them.
_HELD: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What a worker keeps for one operator between tasks. Workers outlive stages, so what they kept for other operators is given back first."""
    for other in [x for x in _HELD if x != operator]:
        del _HELD[other]
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library, which returns memory by itself
            pass
    return _HELD.setdefault(operator, {})


__all__ = ["SHINGLE_WORDS", "drop_table", "give_back", "held", "materialize", "shared_dir", "shingle_hashes", "small_batches", "table", "words_of"]
