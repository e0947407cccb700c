"""Imports: message links and starred repositories to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import clean_text, tags_from_topics, ts_to_iso, urls_from_text, utf16_length
from linkloom.functions.urls import canonical_url, host_of, kind_for, reject_reason, title_for
from linkloom.operators.classify import classify
from linkloom.operators.upsert import new_records
from linkloom.schema import RECORD, Taxonomy


def message_links(messages: DataFrame) -> DataFrame:
    """url, channel, ts and place of every address in messages(text, ts, channel, attachments, _ord)."""
    parts = F.concat(F.array("text"), F.flatten(F.transform(F.coalesce("attachments", F.expr("cast(array() AS array<struct<title_link:string,from_url:string,text:string>>)")), lambda a: F.array(a["title_link"], a["from_url"], a["text"]))))
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")
    links = messages.select("_ord", "ts", F.concat(F.lit("#"), "channel").alias("channel"), F.posexplode(urls_from_text(text)).alias("_k", "url"))
    return links.select("url", F.lit("").alias("context"), "channel", "ts", "_ord", "_k")


def screened(rows: DataFrame, internal_domains: tuple[str, ...] = ()) -> DataFrame:
    """Adds why (null if publishable) to rows with an address; judged on the raw address."""
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"(?U)^\s+|\s+$", "")
    own = rows.withColumn("url", url).where("url != ''")
    return own.withColumn("why", reject_reason(F.col("url"), internal_domains))


def refusals(rows: DataFrame) -> DataFrame:
    return rows.where("why IS NOT NULL").groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def spelled(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """url, seed (first sighting, with its order) and early (that of least numeric time) of every spelling of an address, taken apart by none."""
    n = F.trim("ts").try_cast("double")
    own = rows.withColumn("_n", F.when(F.coalesce("ts", F.lit("")) != "", n))
    row = F.struct(*[c for c in own.columns if c != "url"])
    held = F.struct(F.col(order).alias("o"), row.alias("r"))
    return own.groupBy("url").agg(F.min_by(held, order).alias("seed"), F.min_by(held, F.when(F.col("_n").isNotNull(), F.struct("_n", order))).alias("early"))


def earliest_spelled(spellings: DataFrame) -> DataFrame:
    """One row per canonical address of ``spelled`` rows."""
    own = spellings.select(canonical_url(F.col("url")).alias("url"), "seed", "early")
    agg = own.groupBy("url").agg(F.min_by("seed", "seed.o").alias("seed"), F.min_by("early", F.when(F.col("early").isNotNull(), F.struct("early.r._n", "early.o"))).alias("early"))
    pick = F.when(F.col("seed.r._n").isNotNull() & F.col("early").isNotNull(), F.col("early.r")).otherwise(F.col("seed.r"))
    return agg.select("url", pick.alias("r")).select("url", "r.*").drop("_n", "why")


def earliest_sightings(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """One row per canonical address: the first, replaced only by earlier numeric times if its own time is one."""
    return earliest_spelled(spelled(rows, order))


def link_records(rows: DataFrame, rules: DataFrame, now: str, taxonomy: Taxonomy | None = None, source_type: str = "slack") -> DataFrame:
    """Records of sightings(url, channel, ts): kind, title and groups from the address alone; message text isn't kept."""
    t = taxonomy or Taxonomy()
    named = rows.withColumn("kind", kind_for(F.col("url"))).withColumn("title", title_for(F.col("url"), F.col("kind")))
    words = named.select("url", "title", F.lit("").alias("description"), F.lit(None).cast("array<string>").alias("topics"), F.lit("").alias("language"))
    groups = classify(words, rules, "url", t.max_groups).select("url", "groups")
    at = F.coalesce(ts_to_iso(F.col("ts")), F.lit(now))
    source = F.struct(F.lit(source_type).alias("type"), F.coalesce("channel", F.lit("self-DM")).alias("ref"), at.alias("at"))
    meta = F.struct(host_of(F.col("url")).alias("siteName"), *(F.lit(None).cast("string").alias(c) for c in ("author", "published")), F.lit(None).cast("long").alias("durationSec"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("long").alias("stars"))
    full = named.join(groups, "url").withColumns({"tags": F.array(F.lit(f"src:{source_type}")), "source": source, "meta": meta, "description": F.lit("")})
    out = new_records(full.withColumn("_ord", F.col("_ord") if "_ord" in rows.columns else F.monotonically_increasing_id()), now)
    return out.withColumn("addedAt", F.coalesce(F.try_element_at("sources", F.lit(1))["at"], "addedAt"))


def repo_records(repos: DataFrame, rules: DataFrame, now: str, account: str, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Records of starred repositories; described and grouped ones need no model and say so."""
    t = taxonomy or Taxonomy()
    own = repos.withColumns({"_ord": F.monotonically_increasing_id(), "description": clean_text(F.col("description"))})
    own = own.withColumn("_key", F.col("_ord"))
    groups = classify(own.select("_key", F.col("full_name").alias("title"), "description", "topics", "language"), rules, "_key", t.max_groups).select("_key", "groups")
    owner = F.coalesce(F.nullif(F.col("owner"), F.lit("")), F.substring_index("full_name", "/", 1))
    meta = F.struct(F.lit("GitHub").alias("siteName"), owner.alias("author"), F.coalesce("pushed_at", F.lit("")).alias("published"), F.lit(None).cast("long").alias("durationSec"), F.coalesce("language", F.lit("")).alias("language"), F.col("stargazers_count").alias("stars"))
    source = F.struct(F.lit("github-stars").alias("type"), F.lit(account).alias("ref"), F.lit(now).alias("at"))
    full = own.join(groups, "_key").select("_ord", F.col("html_url").alias("url"), F.lit("repo").alias("kind"), F.col("full_name").alias("title"), "description", "groups", tags_from_topics(F.col("topics"), F.col("language"), t.max_tags).alias("tags"), meta.alias("meta"), source.alias("source"))
    out = new_records(full, now)
    usable = (F.col("description") != "") & (utf16_length(F.col("description")) <= t.max_description) & (F.size("groups") > 0)
    return out.withColumn("enriched", F.when(usable, F.struct(F.lit(now).alias("at"), F.lit("scrape").alias("by"))).otherwise(F.col("enriched")))


def columns() -> list[str]:
    return RECORD.fieldNames()
