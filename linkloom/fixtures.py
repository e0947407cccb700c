"""Views over the driver's tables that the registered queries run on, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import decode_entities, utf16_length
from linkloom.functions.urls import canonical_url, host_of, link_id
from linkloom.operators.upsert import new_records
from linkloom.schema import GROUPS, KINDS, META
from linkloom.tables import materialize

NOW = "2026-01-01T00:00:00.000Z"
INTERNAL = ("corp.example",)

#: Addresses of the shapes that ``part`` gives and of those it can't reach, the same text in both engines.
_SHAPES = """
  CASE CAST(p_partkey % 16 AS INT)
    WHEN 0 THEN concat('https://github.com/Org', CAST(p_partkey % 7 AS VARCHAR(10)), '/', replace(p_name, ' ', '-'))
    WHEN 1 THEN concat('http://www.github.com/org', CAST(p_partkey % 7 AS VARCHAR(10)), '/', replace(p_name, ' ', '_'), '.git')
    WHEN 2 THEN concat('https://github.com/org', CAST(p_partkey % 7 AS VARCHAR(10)), '/', replace(p_name, ' ', '-'), '/tree/main')
    WHEN 3 THEN concat('https://github.com/org', CAST(p_partkey % 7 AS VARCHAR(10)), '/', replace(p_name, ' ', '-'), '/blob/main/README.md')
    WHEN 4 THEN concat('https://github.com/org', CAST(p_partkey % 7 AS VARCHAR(10)), '/', replace(p_name, ' ', '-'), '/pull/', CAST(p_size AS VARCHAR(10)))
    WHEN 5 THEN concat('https://gitlab.com/team', CAST(p_partkey % 5 AS VARCHAR(10)), '/', replace(p_name, ' ', '.'))
    WHEN 6 THEN concat('https://arxiv.org/abs/1706.', CAST(10000 + p_size AS VARCHAR(10)))
    WHEN 7 THEN concat('https://arxiv.org/pdf/1706.', CAST(10000 + p_size AS VARCHAR(10)), 'v2.pdf')
    WHEN 8 THEN concat('https://youtu.be/vid', CAST(p_size AS VARCHAR(10)), '?si=x')
    WHEN 9 THEN concat('https://m.youtube.com/watch?v=vid', CAST(p_size AS VARCHAR(10)), '&list=PL1')
    WHEN 10 THEN concat('https://twitter.com/u', CAST(p_partkey % 3 AS VARCHAR(10)), '/status/', CAST(p_size AS VARCHAR(10)), '?s=20')
    WHEN 11 THEN concat('https://docs.google.com/document/d/D', CAST(p_size AS VARCHAR(10)), '/edit')
    WHEN 12 THEN concat('http://192.168.', CAST(p_size AS VARCHAR(10)), '.1:8080/x')
    WHEN 13 THEN concat('https://example.com/a?b=', CAST(p_size AS VARCHAR(10)), '&a=1&utm_source=s#frag')
    WHEN 14 THEN concat('https://example.com/a/?api_key=', CAST(p_size AS VARCHAR(10)))
    ELSE concat('https://export.arxiv.org/abs/1706.', CAST(10000 + p_size AS VARCHAR(10)))
  END
"""
_MORE = [
    "https://build.corp.example/job/1", "https://corp.example/", "https://notcorp.example/x", "http://ec2-1-2-3-4.compute.amazonaws.com/x", "https://my.elb.amazonaws.com/",
    "https://claude.ai/code/session-1", "https://chatgpt.com/share/abc", "mailto:someone@example.com", "not an address", "ftp://example.com/a", "http://localhost:3000/",
    "http://172.16.0.1/a", "http://172.32.0.1/a", "http://100.64.1.1/a", "http://100.128.1.1/a", "https://www.youtube.com/playlist?list=PL9", "https://example.com/app#/route/1",
    "https://EXAMPLE.com/Path/index.html", "https://example.com/", "https://example.com/z?b=2&a=1&b=1&fbclid=9", "https://x.com/u/status/77/photo/1", "https://gist.github.com/u/1",
    "https://github.com/A/B/tree/main/src", "https://github.com/only", "https://docs.rs/serde", "https://lib.readthedocs.io/en/latest/", "https://example.com/talk.mp4",
    "https://example.com/pod.mp3", "https://example.com/nb.ipynb", "https://example.com/paper.pdf", "https://sheets.example.com/?passwd=1", "https://drive.google.com/file/d/F1/view",
]
_VALUES = ", ".join(f"({-i - 1}, '{u}')" for i, u in enumerate(_MORE))
LINKS = f"SELECT CAST(p_partkey AS BIGINT) AS k, {_SHAPES} AS url FROM part UNION ALL SELECT CAST(k AS BIGINT), url FROM (VALUES {_VALUES}) AS v(k, url)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and url; the view is named anew for each call, as sessions may read several folders."""
    import uuid

    name = f"part_{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView(name)
    return spark.sql(LINKS.replace("FROM part UNION", f"FROM {name} UNION"))


def _pick(items: list[str], k):
    return F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of crawled pages, one per canonical address: the least page_id's."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    p = F.col("page_id")
    url = canonical_url(F.col("url"))
    title = decode_entities(F.regexp_extract("html", r"(?i)<title[^>]*>([\s\S]*?)</title>", 1))
    # Aggregated by the address's id, so that only short columns move.
    own = pages.select(p, url.alias("url"), title.alias("title"))
    own = own.groupBy("url").agg(F.min_by(F.struct("page_id", "title"), "page_id").alias("x")).select("url", "x.*")
    two = F.array_distinct(F.array(_pick(GROUPS, p), _pick(GROUPS, p * 7 + 3)))
    lang = F.regexp_extract("url", r"^https://[^/]+/([^/]+)", 1)
    stars = F.when(p % 4 != 0, (p * 37) % 1000)
    meta = F.struct(host_of(F.col("url")).alias("siteName"), F.lit("").alias("author"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (p % 300).cast("int")), "yyyy-MM-dd").alias("published"), F.lit(None).cast("long").alias("durationSec"), lang.alias("language"), stars.alias("stars"))
    rows = own.select(
        p.alias("_page"), "url", _pick(KINDS, p).alias("kind"), "title", F.when(p % 9 == 0, "").otherwise(F.col("title")).alias("description"),
        F.when(p % 7 == 0, F.expr("cast(array() AS array<string>)")).when(p % 2 == 0, F.slice(two, 1, 1)).otherwise(two).alias("groups"), F.array(lang, host_of(F.col("url"))).alias("tags"), meta.cast(META).alias("meta"),
    )
    full = new_records(rows, NOW)
    day = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("_page") % 200).cast("int")), "yyyy-MM-dd'T'00:00:00.000'Z'")
    return full.withColumns({"starred": F.col("_page") % 5 == 0, "addedAt": day}).drop("_page")


def docrec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (zero-padded doc_id), title (first line, up to 80 characters), description (all the rest of the text) and tags of documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    return d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "doc_id", first.alias("title"), F.expr("substring(text, length(substring(substring_index(text, '\\n', 1), 1, 80)) + 1)").alias("description"), F.array("lang", "source").alias("tags"))


def link_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare records (id, url, k) of the canonical addresses of links: the least k's. Written once, as queries read it several times."""
    return materialize(first_links(links(spark, sf_dir)).select(link_id(F.col("url")).alias("id"), "url", "k"))


def first_links(rows: DataFrame) -> DataFrame:
    """url (canonical) and its least k, of rows (k, url). Each spelling of an address is taken apart once."""
    spelled = rows.groupBy("url").agg(F.min("k").alias("k"))
    return spelled.select("k", canonical_url(F.col("url")).alias("url")).groupBy("url").agg(F.min("k").alias("k"))


__all__ = ["INTERNAL", "LINKS", "NOW", "docrec", "first_links", "link_id", "link_store", "links", "rec", "utf16_length"]
