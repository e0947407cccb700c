"""Item-sized windows of texts that can match one of a set of reference items.

A window can only reach a similarity (or containment) of ``threshold`` with an item if enough of its word shingles are known
from items of its own size. Documents are screened for known shingles in one pass, without a shuffle; of those with any,
the windows that hold enough of them are listed. Such a window can be moved right to its first known shingle without losing
one, so only windows that start at a known shingle, or end with the text, are listed. No match is lost by that.

One scan serves any number of items. Up to ``INLINE`` known shingles are compiled into it; more are a table that the documents'
shingles are joined with, broadcast only up to ``FEW_KNOWN``. Both ways list the same hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import SHINGLE_WORDS, materialize, shingle_hashes, words_of

INLINE = 20_000
FEW_KNOWN = 1_000_000


def item_shingles(items: DataFrame, key: str) -> DataFrame:
    """item, words (their number) and ish (shingle hashes in order) of items with any word."""
    w = items.select(F.col(key).alias("item"), words_of(F.col("text")).alias("_w"))
    return materialize(w.select("item", F.size("_w").alias("words"), F.expr(shingle_hashes("_w")).alias("ish")).where("words > 0").dropDuplicates(["item", "ish"]))


def screened(docs: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """_row, key, sh (all shingles) and hits (places of those that items hold, in order) of the documents with any."""
    known = materialize(items.select(F.explode("ish").alias("s")).distinct())
    words = docs.select(F.col(key).alias("key"), words_of(F.col("text")).alias("_w"))
    sh = words.select("key", F.expr(shingle_hashes("_w")).alias("sh"))
    n = known.count()
    if n <= INLINE:
        listed = ", ".join(f"{r[0]}L" for r in known.collect()) or "NULL"
        hits = f"CASE WHEN size(sh) > 0 THEN filter(sequence(0, size(sh) - 1), i -> sh[i] IN ({listed})) END"
        # The row number isn't deterministic, so the filter stays above and the arrays are made once.
        marked = sh.select("key", "sh", F.expr(hits).alias("hits"), F.monotonically_increasing_id().alias("_row"))
        return materialize(marked.where("size(hits) > 0"))
    own = materialize(sh.select("key", "sh", F.monotonically_increasing_id().alias("_row")).where("size(sh) > 0"))
    at = own.select("_row", F.posexplode("sh").alias("pos", "s")).join(F.broadcast(known) if n <= FEW_KNOWN else known, "s", "left_semi")
    hits = at.groupBy("_row").agg(F.sort_array(F.collect_list("pos")).alias("hits"))
    return materialize(own.join(hits, "_row").select("key", "sh", "hits", "_row"))


def windows(hit: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """_row, key, words (the window's size), start (its first word) and ws (its shingles) of all windows worth comparing."""
    k = SHINGLE_WORDS
    sizes = items.select("words", F.explode("ish").alias("s")).distinct()
    at = hit.select("_row", "key", "sh", F.explode("hits").alias("pos")).select("_row", F.size("sh").alias("n"), "pos", F.expr("sh[pos]").alias("s"))
    by = at.join(F.broadcast(sizes) if sizes.limit(FEW_KNOWN + 1).count() <= FEW_KNOWN else sizes, "s").groupBy("_row", "words").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("pos")).alias("h"))
    by = by.withColumn("m", F.greatest(F.lit(1), F.col("words") - (k - 1))).withColumn("need", F.ceil(F.lit(threshold - 1e-9) * F.col("m")).cast("int"))
    start = "greatest(0, least(h[a], n - m))"
    starts = f"array_distinct(transform(filter(sequence(0, size(h) - need), a -> h[a + need - 1] - {start} < m), a -> {start}))"
    by = by.where("size(h) >= need").select("_row", "words", "m", F.explode(F.expr(starts)).alias("start"))
    # Windows and whole texts both grow with the documents: neither is to be broadcast.
    return by.join(hit.select("_row", "key", "sh").hint("merge"), "_row").select("_row", "key", "words", "start", F.expr("slice(sh, start + 1, m)").alias("ws"))
