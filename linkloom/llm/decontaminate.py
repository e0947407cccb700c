"""Benchmark decontamination: passages of benchmark items inside documents, exact or edited.

Windows of a document as long as an item get a 64-bit SimHash of their weighted word shingles (a shingle weighs as often as it
occurs). Fingerprints within ``RADIUS`` bits agree in one of five blocks up to ``RADIUS // 5`` bits, so probing each block with
all values that near finds every fingerprint within the radius. Candidates are verified by the exact weighted
Jaccard similarity of the shingles.

Screening and its lossless bounds are in ``screen``. Defined results: null, empty or wordless texts and items match nothing; items
and texts of fewer than five words count as one shingle; equal similarities report the first start; repeated rows of a
document, and items with equal texts, are reported like a single one each; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import materialize
from linkloom.llm.screen import item_shingles, screened, windows

THRESHOLD = 0.8
#: Five blocks of 13, 13, 13, 13 and 12 bits.
RADIUS = 19
BLOCK_BITS = (13, 13, 13, 13, 12)
NEAR = RADIUS // len(BLOCK_BITS)


def simhash(shingles: str) -> str:
    """SQL: bit b is set if it is set in more than half of the weight of the shingles."""
    vote = f"2 * size(filter({shingles}, x -> (shiftrightunsigned(x, b) & 1L) = 1L)) > size({shingles})"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> CASE WHEN {vote} THEN f | shiftleft(1L, b) ELSE f END)"


def block(fingerprint: str, b: int) -> str:
    return f"cast(shiftrightunsigned({fingerprint}, {sum(BLOCK_BITS[:b])}) & {(1 << BLOCK_BITS[b]) - 1} AS int)"


def probes(items: DataFrame) -> DataFrame:
    """Of each item's fingerprint: block number and every value within NEAR bits of the block's."""
    parts = [
        items.select("*", F.lit(b).alias("b"), F.expr(block("fi", b)).alias("at"), F.explode(F.expr(f"filter(sequence(0, {(1 << n) - 1}), x -> bit_count(x) <= {NEAR})")).alias("x")).selectExpr("item", "words", "fi", "ish", "b", "at ^ x AS v")
        for b, n in enumerate(BLOCK_BITS)
    ]
    return reduce(DataFrame.unionAll, parts)


def weighted_jaccard(a: str, b: str) -> str:
    """SQL: of two non-empty shingle arrays as multisets."""
    shared = (
        f"CASE WHEN size(array_distinct({a})) = size({a}) AND size(array_distinct({b})) = size({b}) THEN size(array_intersect({a}, {b})) "
        f"ELSE aggregate(array_intersect({a}, {b}), 0, (s, q) -> s + least(size(filter({a}, x -> x = q)), size(filter({b}, x -> x = q)))) END"
    )
    return f"{shared} / (size({a}) + size({b}) - {shared})"


def _matches(win: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    win = materialize(win.withColumn("fw", F.expr(simhash("ws"))))
    items = materialize(items.withColumn("fi", F.expr(simhash("ish"))))
    keys = F.explode(F.expr("array(" + ", ".join(f"named_struct('b', {b}, 'v', {block('fw', b)})" for b in range(len(BLOCK_BITS))) + ")")).alias("k")
    own = win.select("*", keys).select("*", "k.b", "k.v").drop("k")
    pairs = own.join(probes(items), ["words", "b", "v"])
    # A pair may meet in several blocks: it counts in the first only.
    first = " AND ".join(f"(b <= {b} OR bit_count({block('fw', b)} ^ {block('fi', b)}) > {NEAR})" for b in range(len(BLOCK_BITS) - 1))
    near = pairs.where(f"bit_count(fw ^ fi) <= {RADIUS} AND {first}")
    return near.select("key", "item", "start", "words", F.expr(weighted_jaccard("ws", "ish")).alias("similarity")).where(F.col("similarity") >= threshold)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row per document and item it holds: similarity, the best window's first word and its number of words."""
    items = item_shingles(benchmark, item_key)
    found = _matches(windows(screened(docs, doc_key, items), items, threshold), items, threshold)
    best = found.groupBy("key", "item").agg(F.max_by(F.struct("start", "words"), F.struct("similarity", -F.col("start"))).alias("w"), F.max("similarity").alias("similarity"))
    return best.select(F.col("key").alias(doc_key), F.col("item").alias(item_key), "similarity", F.col("w.start").alias("start_word"), F.col("w.words").alias("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_key: str = "doc_id") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; a null key can't be matched and stays."""
    # Written first, so that the planner knows its size and broadcasts it if it is small instead of shuffling all texts.
    bad = materialize(contamination(docs, benchmark, threshold, doc_key).select(doc_key).distinct())
    return docs.join(bad, doc_key, "left_anti")
