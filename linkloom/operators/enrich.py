"""Enrichment: which records need it, what a model is asked, and what of its reply is taken. The model itself is an input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import utf16_length
from linkloom.functions.urls import host_of
from linkloom.schema import REPLY, Taxonomy

BATCH = 20


def needs_work(t: Taxonomy | None = None):
    t = t or Taxonomy()
    bare = (F.coalesce("description", F.lit("")) == "") | (F.coalesce(F.size("groups"), F.lit(0)) <= 0) | (utf16_length(F.col("description")) > t.max_description)
    return bare & ~F.coalesce(F.col("enriched.by") == "human", F.lit(False))


def targets(store: DataFrame, everything: bool = False, only_id: str | None = None, force: bool = False, limit: int = 0, t: Taxonomy | None = None) -> DataFrame:
    """Records to enrich: one id before all else; force takes the whole store unless everything (all but human-edited) is asked for."""
    if only_id:
        out = store.where(F.col("id") == only_id)
    elif everything:
        out = store.where(~F.coalesce(F.col("enriched.by") == "human", F.lit(False)))
    else:
        out = store if force else store.where(needs_work(t))
    return out.orderBy("id").limit(limit) if limit > 0 else out


def retitled(records: DataFrame, scraped: DataFrame) -> DataFrame:
    """Placeholder titles give way to the page's own, cut to 120, except for repositories. scraped: id, scraped (struct)."""
    host = host_of(F.col("url"))
    placeholder = (host != "") & ((F.col("title") == host) | F.col("title").startswith(F.concat(host, F.lit("/"))) | (F.col("title") == F.concat(host, F.lit(" video"))))
    own = F.coalesce("scraped.title", F.lit(""))
    title = F.when(placeholder & (F.col("kind") != "repo") & (own != ""), F.substring(own, 1, 120)).otherwise(F.col("title"))
    return records.join(scraped, "id", "left").withColumn("title", title)


def prompts(records: DataFrame) -> DataFrame:
    """id, batch (of BATCH records by id) and input (JSON) of retitled records with their scraped struct."""
    get = lambda c, other: F.coalesce(F.nullif(F.col(f"scraped.{c}"), F.lit("")), other, F.lit(""))
    none = F.lit("")
    page = F.struct(
        get("title", F.col("title")).alias("title"), get("description", F.col("description")).alias("ogDescription"), get("siteName", F.col("meta.siteName")).alias("siteName"), get("author", none).alias("author"),
        none.alias("metaDescription"), F.col("tags").alias("topics"), F.coalesce("meta.language", none).alias("language"), get("error", none).alias("fetchError"),
    )
    context = F.array_join(F.transform("sources", lambda s: F.concat(s["type"], F.lit(" "), F.coalesce(s["ref"], none))), ", ")
    body = F.to_json(F.struct("id", "url", "kind", page.alias("scraped"), context.alias("context")))
    return numbered(records.select("id", body.alias("input")), "id").select("id", F.floor(F.col("_n") / BATCH).alias("batch"), "input")


def numbered(df: DataFrame, by: str) -> DataFrame:
    """Adds _n, each row's place from 0 in the order of a column, from counts per range instead of one global window."""
    parts = df.repartitionByRange(by).sortWithinPartitions(by).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    w = Window.partitionBy("_p").orderBy("_i")
    parts = parts.withColumn("_k", F.row_number().over(w))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return parts.join(F.broadcast(before), "_p").select(*df.columns, (F.col("_b") + F.col("_k") - 1).alias("_n"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """Items of replies(batch, reply): the bracketed array is taken out of noisy text; a reply without one fails alone (null item)."""
    items = F.from_json(F.nullif(F.regexp_extract("reply", r"(?s)\[.*\]", 0), F.lit("")), REPLY)
    return replies.select("batch", F.explode_outer(items).alias("item"))


def validated(items: DataFrame, store: DataFrame, t: Taxonomy | None = None) -> DataFrame:
    """id, ok, why, rejected (unknown groups) and the patch's description, groups and tags of every item."""
    t = t or Taxonomy()
    none = F.expr("cast(array() AS array<string>)")
    allowed = F.array(*map(F.lit, t.groups))
    r = store.select(F.col("id").alias("_id"), F.col("description").alias("_d"), F.col("groups").alias("_g"), F.col("tags").alias("_t"))
    j = items.select("item.*").join(r, F.col("id") == F.col("_id"), "left")
    given = F.coalesce("groups", none)
    kept = F.slice(F.filter(given, lambda g: F.array_contains(allowed, g)), 1, t.max_groups)
    desc = F.regexp_replace(F.coalesce("description", F.lit("")), r"(?U)^\s+|\s+$", "")
    size = utf16_length(desc)
    why = F.when(F.col("_id").isNull(), "unknown id").when(size > t.max_description, F.format_string(f"description %d chars > {t.max_description}", size))
    ok = why.isNull()
    return j.select(
        "id",
        ok.alias("ok"),
        why.alias("why"),
        F.when(ok, F.filter(given, lambda g: ~F.array_contains(allowed, g))).alias("rejected"),
        F.when(ok, F.when(desc != "", desc).otherwise(F.col("_d"))).alias("description"),
        F.when(ok, F.when(F.size(kept) > 0, kept).otherwise(F.col("_g"))).alias("groups"),
        F.when(ok, F.slice(F.array_distinct(F.concat(F.coalesce("_t", none), F.coalesce("tags", none))), 1, t.max_tags)).alias("tags"),
    )


def counters(checked: DataFrame) -> DataFrame:
    """ok and failed items, and how many named groups that don't exist."""
    return checked.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.size("rejected") > 0).alias("invented"))
