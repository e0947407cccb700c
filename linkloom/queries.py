"""The registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import oracles as O
from linkloom.fixtures import INTERNAL, NOW, docrec, first_links, link_store, links, rec
from linkloom.functions import text as T
from linkloom.functions import urls as U
from linkloom.operators import classify as C
from linkloom.operators import enrich as E
from linkloom.operators import imports as I
from linkloom.operators import patches as P
from linkloom.operators import resolve as R
from linkloom.operators import upsert as M
from linkloom.operators import violations as V
from linkloom.plans import browse as B
from linkloom.plans.browse import UNFILED, BrowseQuery
from linkloom.schema import GROUPS, META, RECORD, Taxonomy
from linkloom.tables import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _joined(c, sep: str = "|"):
    return F.array_join(F.array_sort(c), sep)


# URL identity


@query(f"SELECT page_id, canon AS canonical, cid AS id FROM ({O.canonical('SELECT page_id, url FROM pages')}) AS x")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    c = U.canonical_url(F.col("url"))
    return _table(spark, d, "pages").select("page_id", c.alias("canonical")).withColumn("id", U.link_id(F.col("canonical")))


@query(f"SELECT cid AS id, canon AS canonical, host, count(*) AS pages, min(page_id) AS first_page FROM ({O.canonical('SELECT page_id, url FROM pages')}) AS x GROUP BY ALL")
def url_identities(spark: SparkSession, d: str) -> DataFrame:
    own = canonical_urls(spark, d).withColumn("host", U.host_of(F.col("canonical")))
    return own.groupBy("id", "canonical", "host").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query(f"SELECT * FROM ({ORACLES['url_identities']}) AS y WHERE pages > 1")
def url_identity_dups(spark: SparkSession, d: str) -> DataFrame:
    return url_identities(spark, d).where("pages > 1")


@query(f"SELECT k, canon AS canonical, cid AS id FROM ({O.canonical(O.LINKS)}) AS x")
def host_rules_canonical(spark: SparkSession, d: str) -> DataFrame:
    c = U.canonical_url(F.col("url"))
    return links(spark, d).select("k", c.alias("canonical")).withColumn("id", U.link_id(F.col("canonical")))


@query(f"SELECT coalesce(why, 'published') AS why, count(*) AS n FROM (SELECT {O.REJECT} AS why FROM ({O.taken_apart(O.LINKS)}) AS x) AS y GROUP BY ALL")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    why = I.screened(links(spark, d), INTERNAL)
    return why.select(F.coalesce("why", F.lit("published")).alias("why")).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT {O.KIND} AS kind FROM ({O.taken_apart(O.LINKS)}) AS x) AS y GROUP BY ALL")
def kinds_histogram(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select(U.kind_for(F.col("url")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT k, {O.TITLE} AS title FROM ({O.taken_apart(O.LINKS)}) AS x")
def titles_from_urls(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select("k", U.title_for(F.col("url"), U.kind_for(F.col("url"))).alias("title"))


@query(
    f"SELECT k, {O.NAME} AS project, {O.OWNER} AS owner, coalesce({O.GITHUB}, '') AS repo, regexp_extract(url, 'arxiv\\.org/abs/(.+)$', 1) AS paper, coalesce(parts[len(parts)], '') AS base, host FROM ({O.taken_apart(O.LINKS)}) AS x"
)
def names_and_owners(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    none = F.lit("")
    return links(spark, d).select(
        "k", U.project_name(u).alias("project"), U.owner_of(u).alias("owner"), F.coalesce(U.github_repo(u), none).alias("repo"), F.coalesce(U.arxiv_id(u), none).alias("paper"), U.basename(u).alias("base"), U.host_of(u).alias("host")
    )


# Text and HTML

_META = """SELECT page_id, concat('<meta property="og:title" content="', page_id, ' &amp;lt; x">', html, '<meta content=''A &quot;b&quot;'' name=''author''><meta name="citation_date" content="2024/', page_id % 12, '">') AS html FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, html FROM pages WHERE page_id % 2 = 1"""


def _meta_sql(name: str, key: str) -> str:
    q = "[\"'']"
    a, b = f"(?i)<meta[^>]+{key}={q}{name}{q}[^>]+content={q}([^\"'']*){q}", f"(?i)<meta[^>]+content={q}([^\"'']*){q}[^>]+{key}={q}{name}{q}"
    return ", ".join(f"nullif({O.decoded(f"regexp_extract(html, '{p}', 1)")}, '')" for p in (a, b))


@query(
    f"""SELECT page_id, coalesce({_meta_sql('og:title', 'property')}, {_meta_sql('twitter:title', 'name')}, {O._TITLE}) AS title,
  coalesce({_meta_sql('og:description', 'property')}, {_meta_sql('description', 'name')}, {_meta_sql('twitter:description', 'name')}, {_meta_sql('citation_abstract', 'name')}, '') AS description,
  coalesce({_meta_sql('og:site_name', 'property')}, '') AS site_name, coalesce({_meta_sql('author', 'name')}, {_meta_sql('citation_author', 'name')}, '') AS author,
  coalesce({_meta_sql('article:published_time', 'property')}, {_meta_sql('citation_date', 'name')}, '') AS published FROM ({_META}) AS x"""
)
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "pages")
    extra = F.concat(F.lit('<meta property="og:title" content="'), "page_id", F.lit(' &amp;lt; x">'), "html", F.lit("<meta content='A &quot;b&quot;' name='author'><meta name=\"citation_date\" content=\"2024/"), F.col("page_id") % 12, F.lit('">'))
    own = p.select("page_id", F.when(F.col("page_id") % 2 == 0, extra).otherwise(F.col("html")).alias("html")).select("page_id", T.page_metadata(F.col("html")).alias("m"))
    return own.select("page_id", "m.title", "m.description", F.col("m.siteName").alias("site_name"), "m.author", "m.published")


@query(f"SELECT page_id, {O._TITLE} AS title FROM pages")
def html_titles(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", T.decode_entities(F.regexp_extract("html", r"(?i)<title[^>]*>([\s\S]*?)</title>", 1)).alias("title"))


@query(
    """SELECT doc_id, length(c) AS chars, md5(c) AS hash FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(concat('— :tada: ', text, ' :x:'), ':[a-z0-9][a-z0-9_+-]{1,30}:', ' ', 'g'), '\\s+', ' ', 'g'), '^[\\s–—-]+', '')) AS c FROM documents) AS x"""
)
def clean_text_stats(spark: SparkSession, d: str) -> DataFrame:
    c = T.clean_text(F.concat(F.lit("— :tada: "), "text", F.lit(" :x:")))
    return _table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", F.length("c").cast("long").alias("chars"), F.md5("c").alias("hash"))


@query(f"SELECT doc_id, len(t) AS n, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT doc_id, {O.tokens("concat(title, ' ', description)")} AS t FROM ({O.DOCREC}) AS x) AS y")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    own = docrec(spark, d).select("doc_id", T.tokens(F.concat_ws(" ", "title", "description")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n"), _joined("t", " ").alias("tokens"))


_MESSAGES = f"SELECT a.k, concat('see <', a.url, '|here> and ', b.url, ' or (', a.url, '), <', b.url, '> x', a.url) AS text FROM ({O.LINKS}) AS a JOIN ({O.LINKS}) AS b ON b.k = a.k + 1 WHERE a.k > 0"


@query(
    f"""SELECT k, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '<(https?://[^|>\\s]+)(?:\\|[^>]*)?>', 1), regexp_extract_all(concat(' ', text), '[^<|0-9A-Za-z_](https?://[^\\s<>|)"'']+)', 1)))), '|') AS urls FROM ({_MESSAGES}) AS x"""
)
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    own = links(spark, d)
    after = own.select((F.col("k") - 1).alias("k"), F.col("url").alias("b"))
    text = F.concat(F.lit("see <"), "url", F.lit("|here> and "), "b", F.lit(" or ("), "url", F.lit("), <"), "b", F.lit("> x"), "url")
    return own.where("k > 0").join(after, "k").select("k", _joined(T.urls_from_text(text)).alias("urls"))


_SIGHTINGS = f"SELECT x.k, x.url, CASE WHEN x.k % 5 = 0 THEN '' WHEN x.k % 7 = 0 THEN strftime(e.ts, '%Y-%m-%d') ELSE CAST(epoch(date_trunc('second', e.ts))::BIGINT AS VARCHAR) END AS ts FROM ({O.LINKS}) AS x JOIN events AS e ON e.event_id = x.k"


@query(
    f"""SELECT canon AS url, CASE WHEN seed.n IS NOT NULL AND early IS NOT NULL THEN early.k ELSE seed.k END AS k,
  CASE WHEN seed.n IS NOT NULL AND early IS NOT NULL THEN early.ts ELSE seed.ts END AS ts FROM (
  SELECT canon, arg_min({{'k': k, 'ts': ts, 'n': n}}, k) AS seed, arg_min({{'k': k, 'ts': ts}}, {{'n': n, 'k': k}}) FILTER (n IS NOT NULL) AS early
  FROM (SELECT *, TRY_CAST(nullif(ts, '') AS DOUBLE) AS n FROM ({O.canonical(_SIGHTINGS)}) AS x) AS y GROUP BY canon) AS z"""
)
def earliest_sighting(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("ts").alias("at"))
    ts = F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 7 == 0, F.date_format("at", "yyyy-MM-dd")).otherwise(F.unix_seconds(F.date_trunc("second", F.col("at")).cast("timestamp")).cast("string"))
    rows = links(spark, d).join(e, "k").select("k", "url", ts.alias("ts")).withColumn("_ord", F.col("k"))
    return I.earliest_sightings(rows).select("url", "k", "ts")


# Classification

_SIGNALS = [s for signals in O.RULES.values() for s in signals]
_N = len(_SIGNALS)
_LANGS = ["Rust", "Zig", "Python", "Haskell"]
_CLASSIFIED = f"""SELECT doc_id, concat(title, ' ', [{O.strings(_SIGNALS)}][doc_id % {_N} + 1], ' x ', [{O.strings(_SIGNALS)}][(doc_id * 5) % {_N} + 1]) AS title, description,
  CASE WHEN doc_id % 3 = 0 THEN [] ELSE [upper([{O.strings(_SIGNALS)}][(doc_id * 3) % {_N} + 1]), [{O.strings(_SIGNALS)}][doc_id % {_N} + 1], 'awesome', 'rust'] END AS topics, [{O.strings(_LANGS)}][doc_id % 4 + 1] AS language FROM ({O.DOCREC}) AS d"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    i = F.col("doc_id")
    topics = F.when(i % 3 == 0, F.expr("cast(array() AS array<string>)")).otherwise(F.array(F.upper(pick(_SIGNALS, i * 3)), pick(_SIGNALS, i), F.lit("awesome"), F.lit("rust")))
    return docrec(spark, d).select("doc_id", F.concat("title", F.lit(" "), pick(_SIGNALS, i), F.lit(" x "), pick(_SIGNALS, i * 5)).alias("title"), "description", topics.alias("topics"), pick(_LANGS, i).alias("language"))


_HINTED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.LANGUAGE_HINT.items())


@query(
    f"""WITH r(signal, grp) AS (VALUES {O.RULE_VALUES}), x AS ({_CLASSIFIED}), s AS (
  SELECT doc_id, language, lower(unnest(topics)) AS signal, 3 AS n FROM x UNION ALL
  SELECT doc_id, language, unnest(list_distinct(list_filter(string_split_regex(lower(concat(title, ' ', description)), '[^a-z0-9+#-]+'), lambda w: w <> ''))) AS signal, 1 AS n FROM x),
h AS (SELECT doc_id, language, grp, sum(n) AS n FROM s JOIN r USING (signal) GROUP BY ALL),
b AS (SELECT doc_id, grp, n FROM h UNION ALL SELECT DISTINCT doc_id, CASE language {_HINTED} END AS grp, 1 AS n FROM h WHERE CASE language {_HINTED} END IS NOT NULL),
t AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id ORDER BY sum(n) DESC, lower(grp), grp) AS i FROM b GROUP BY doc_id, grp HAVING sum(n) >= 2)
SELECT x.doc_id, coalesce(string_agg(grp, '|' ORDER BY i) FILTER (i <= 3), '') AS groups, count(grp) > 0 AS confident FROM x LEFT JOIN t ON t.doc_id = x.doc_id GROUP BY x.doc_id"""
)
def classify_groups(spark: SparkSession, d: str) -> DataFrame:
    own = C.classify(_classified(spark, d), C.rule_table(spark), "doc_id")
    return own.select("doc_id", F.array_join("groups", "|").alias("groups"), "confident")


@query(
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(topics, lambda t: lower(t)), lambda t: t <> '' AND t NOT IN ({O.strings(O.TAG_NOISE)}) AND t <> lower(language))[:8], '|') AS tags FROM ({_CLASSIFIED}) AS x"""
)
def tags_from_topics(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("doc_id", F.array_join(T.tags_from_topics(F.col("topics"), F.col("language")), "|").alias("tags"))


# Faceted search

_VIEW = f"SELECT *, lower(concat(title, ' ', description, ' ', ' ', url, ' ', array_to_string(tags, ' '), ' ', array_to_string(groups, ' '))) AS hay FROM ({O.REC}) AS rec"


def _view(spark: SparkSession, d: str) -> DataFrame:
    return B.prepared(rec(spark, d))


def _found(view: DataFrame, q: BrowseQuery) -> DataFrame:
    return view.where(q.matches()).select("id", "title")


@query(f"SELECT id, title FROM ({_VIEW}) AS v WHERE list_has_any(groups, ['Science', 'Security']) AND kind IN ('web', 'doc', 'video', 'repo', 'pdf')")
def browse_any(spark: SparkSession, d: str) -> DataFrame:
    return _found(_view(spark, d), BrowseQuery(groups=("Science", "Security"), kinds=("web", "doc", "video", "repo", "pdf")))


@query(f"SELECT id, title FROM ({_VIEW}) AS v WHERE list_has_all(groups, ['AI/ML', 'Programming Languages'])")
def browse_all(spark: SparkSession, d: str) -> DataFrame:
    return _found(_view(spark, d), BrowseQuery(groups=("AI/ML", "Programming Languages"), mode="all"))


@query(f"SELECT id, title FROM ({_VIEW}) AS v WHERE (list_contains(groups, 'Science') OR len(groups) = 0) AND list_contains(tags, 'en')")
def browse_unfiled(spark: SparkSession, d: str) -> DataFrame:
    return _found(_view(spark, d), BrowseQuery(groups=("Science", UNFILED), tags=("en",)))


@query(f"SELECT id, title FROM ({_VIEW}) AS v WHERE contains(hay, 'the') AND contains(hay, 'example.net') AND contains(hay, 'in')")
def browse_text(spark: SparkSession, d: str) -> DataFrame:
    return _found(_view(spark, d), BrowseQuery(q="The EXAMPLE.net  in"))


@query(f"SELECT id, title FROM ({_VIEW}) AS v WHERE description = '' AND list_contains(tags, 'fr')")
def browse_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _found(_view(spark, d), BrowseQuery(bucket="undescribed", tags=("fr",)))


_Q = BrowseQuery(q="the", groups=("Science", "Security", UNFILED), kinds=("web", "doc", "pdf", "repo"), tags=("en",))
_G, _K, _T = "(list_has_any(groups, ['Science', 'Security']) OR len(groups) = 0)", "kind IN ('web', 'doc', 'pdf', 'repo')", "list_contains(tags, 'en')"


def _facet(dim: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _Q.facets(_view(spark, d)).where(F.col("dim") == dim).select(F.col("place").cast("long").alias("place"), "value", F.col("n").cast("long").alias("n"))

    run.__name__ = f"facet_{dim}"
    return run


query(
    f"""WITH v AS ({_VIEW}), c AS (SELECT value, count(*) AS n FROM (SELECT unnest(CASE WHEN len(groups) = 0 THEN ['{UNFILED}'] ELSE groups END) AS value FROM v WHERE contains(hay, 'the') AND {_K} AND {_T}) AS a GROUP BY value),
g AS (SELECT unnest([{O.strings(O.GROUPS)}]) AS value, 0 AS last UNION ALL SELECT '{UNFILED}', 1)
SELECT row_number() OVER (ORDER BY last, coalesce(n, 0) DESC, lower(g.value)) AS place, g.value, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.value = g.value"""
)(_facet("groups"))
query(
    f"""WITH v AS ({_VIEW}) SELECT row_number() OVER (ORDER BY n DESC, first) AS place, value, n FROM (SELECT kind AS value, count(*) AS n, min(id) AS first FROM v WHERE contains(hay, 'the') AND {_G} AND {_T} GROUP BY kind) AS a"""
)(_facet("kinds"))
query(
    f"""WITH v AS ({_VIEW}), c AS (SELECT value, count(*) AS n FROM (SELECT unnest(tags) AS value FROM v WHERE contains(hay, 'the') AND {_G} AND {_K}) AS a GROUP BY value),
t AS (SELECT row_number() OVER (ORDER BY n DESC, value) AS place, value, n FROM c QUALIFY place <= 26)
SELECT place, value, n FROM t UNION ALL SELECT 0, 'en', coalesce((SELECT n FROM c WHERE value = 'en'), 0) WHERE NOT EXISTS (SELECT 1 FROM t WHERE value = 'en')"""
)(_facet("tags"))


@query(f"SELECT count(*) FILTER (len(groups) = 0) AS unfiled, count(*) FILTER (description = '') AS undescribed, 0::BIGINT AS linkable FROM ({O.REC}) AS rec")
def bucket_tallies(spark: SparkSession, d: str) -> DataFrame:
    return B.bucket_tallies(_view(spark, d))


@query(f"SELECT count(*) AS total, count(*) FILTER (len(groups) = 0 OR description = '') AS open, count(*) FILTER (starred) AS starred FROM ({O.REC}) AS rec")
def header_tally(spark: SparkSession, d: str) -> DataFrame:
    return B.header_tally(_view(spark, d))


def _sorted(sort: str, order: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return BrowseQuery(sort=sort).rows(_view(spark, d)).select("id", "title")

    run.__name__ = f"sort_page_{sort}"
    query(f"SELECT id, title FROM ({O.REC}) AS rec ORDER BY {order} LIMIT 60")(run)


_sorted("stars", "coalesce(stars, -1) DESC, id")
_sorted("updated", "published DESC, id")
#: Ties and letters are in ICU order, which DuckDB has only as an extension: no twin; tests hold them against a plain sort.
for _sort in ("recent", "title"):
    _sorted(_sort, "")
    del ORACLES[f"sort_page_{_sort}"]


@query(
    f"""SELECT id, concat_ws(' / ', kind, nullif(lang, ''), CASE WHEN stars >= 1000 THEN 'k' ELSE CAST(stars AS VARCHAR) END, nullif(host, '')) AS label, CASE WHEN len(groups) = 0 OR description = '' THEN 'open' ELSE 'settled' END AS state FROM ({O.REC}) AS rec"""
)
def row_labels(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d).select("id", B.row_label().alias("label"), B.row_state().alias("state"))


# Entity resolution

_LS = f"SELECT * FROM ({O.taken_apart(O.LINK_STORE)}) AS ls"


@query(
    f"""WITH s AS ({_LS}), p AS (SELECT id, regexp_extract(url, 'arxiv\\.org/abs/(.+)$', 1) AS paper FROM s), r AS (SELECT id, url, {O.GITHUB} AS repo FROM s),
roots AS (SELECT repo, max(id) AS root FROM r WHERE url = concat('https://github.com/', repo) GROUP BY repo)
SELECT a.id AS keep, b.id AS drop, concat('same arXiv id ', a.paper) AS why FROM p AS a JOIN p AS b ON a.paper = b.paper AND a.id < b.id WHERE a.paper <> ''
UNION ALL SELECT root, id, concat(r.repo, ' front page, and the repo is already saved') FROM r JOIN roots ON r.repo = roots.repo
WHERE url <> concat('https://github.com/', r.repo) AND regexp_matches(substr(url, length(r.repo) + 21), '(?i)^(?:blob/[^/]+/readme(?:\\.[a-z]+)?|tree/[^/]+)$')"""
)
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_candidates(link_store(spark, d))


@query(
    f"""WITH s AS ({_LS}), r AS (SELECT id, url, {O.GITHUB} AS repo FROM s), roots AS (SELECT repo, max(id) AS root FROM r WHERE url = concat('https://github.com/', repo) GROUP BY repo)
SELECT r.repo, root, id AS deep, substr(url, length(r.repo) + 21) AS rest FROM r JOIN roots ON r.repo = roots.repo
WHERE url <> concat('https://github.com/', r.repo) AND NOT regexp_matches(substr(url, length(r.repo) + 21), '(?i)^(?:blob/[^/]+/readme(?:\\.[a-z]+)?|tree/[^/]+)$')"""
)
def deep_links(spark: SparkSession, d: str) -> DataFrame:
    return R.deep_links(link_store(spark, d))


_TITLED = f"SELECT id, url, fullhost, parts, title, list_distinct([split_part(url, '/', 3), CAST(k % 3 AS VARCHAR)]) AS gt, {O.tokens('title')} AS tt, [] AS dt FROM (SELECT *, {O.TITLE} AS title FROM ({_LS}) AS a) AS b"


def _titled(spark: SparkSession, d: str) -> DataFrame:
    s = link_store(spark, d)
    return s.withColumns({"title": U.title_for(F.col("url"), U.kind_for(F.col("url"))), "description": F.lit(""), "tags": F.array(F.coalesce(F.get(F.split("url", "/"), F.lit(2)), F.lit("")), (F.col("k") % 3).cast("string")), "related": F.expr("cast(array() AS array<string>)")})


@query(
    f"""WITH s AS (SELECT *, {O.NAME} AS name, coalesce(split_part({O.GITHUB}, '/', 1), '') AS owner FROM ({_TITLED}) AS t),
g AS (SELECT name, count(*) AS size, count(DISTINCT owner) AS owners FROM s WHERE name <> '' GROUP BY name HAVING size >= 2 AND owners >= 2)
SELECT g.name, size, owners, round(max({O.score()}), 6) AS score, max({O.score()}) >= 0.28 AS corroborated FROM g JOIN s AS a ON a.name = g.name JOIN s AS b ON b.name = g.name AND a.id < b.id GROUP BY g.name, size, owners"""
)
def name_clusters_cli(spark: SparkSession, d: str) -> DataFrame:
    return R.verdicts(R.name_clusters(_titled(spark, d))).withColumn("score", F.round("score", 6))


@query(f"WITH s AS (SELECT id, {O.NAME} AS name, {O.OWNER} AS owner FROM ({_LS}) AS t) SELECT id FROM s WHERE name <> '' AND name IN (SELECT name FROM s WHERE name <> '' GROUP BY name HAVING count(DISTINCT owner) >= 2)")
def linkable_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.linkable(_titled(spark, d))


_PAGESIM = f"SELECT id, {O.tokens('title')} AS tt, {O.tokens('description')} AS dt, list_distinct(tags) AS gt FROM ({O.REC}) AS x"


@query(f"WITH s AS ({_PAGESIM}) SELECT a.id AS a, b.id AS b, round({O.score()}, 6) AS score FROM s AS a JOIN s AS b ON a.id < b.id WHERE {O.score()} >= 0.30")
def similar_pairs_weighted(spark: SparkSession, d: str) -> DataFrame:
    return R.similar_pairs(rec(spark, d)).withColumn("score", F.round("score", 6))


# Upserts, merges and patches

_OLD = f"SELECT cid AS id, canon AS url, min(k) AS k FROM ({O.canonical(O.LINKS)}) AS a WHERE k % 3 = 0 GROUP BY cid, canon"
_NEW = f"SELECT cid AS id, canon AS url, k FROM ({O.canonical(O.LINKS)}) AS a WHERE k % 2 = 0"


def _cast(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD.fields), *[c for c in df.columns if c.startswith("_")])


def _synthetic(rows: DataFrame, side: str) -> DataFrame:
    """Records of (url, k) with fields by the key, and _ord = k."""
    k = F.col("k")
    text = lambda *m: F.concat(F.lit(f"{side} "), k.cast("string"))
    source = F.struct(F.lit(side).alias("type"), (k % 4).cast("string").alias("ref"), F.lit(NOW).alias("at"))
    meta = F.struct(F.when(k % 2 == 0, text()).alias("siteName"), *(F.lit(None).cast("string").alias(c) for c in ("author", "published")), F.lit(None).cast("long").alias("durationSec"), F.lit(None).cast("string").alias("language"), F.when(k % 5 != 0, k).alias("stars"))
    own = rows.select(
        k.alias("_ord"), "url", F.lit("web").alias("kind"), F.when(k % 4 == 0, "").otherwise(text()).alias("title"), F.when(k % 6 == 0, "").otherwise(text()).alias("description"),
        F.array(F.concat(F.lit("g"), (k % 5).cast("string"))).alias("groups"), F.array(F.concat(F.lit(f"{side}-"), (k % 11).cast("string")), F.lit("shared")).alias("tags"), meta.cast(META).alias("meta"), source.alias("source"),
    )
    return M.new_records(own, NOW)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = links(spark, d)
    all_ = own.select("k", U.canonical_url(F.col("url")).alias("url"))
    store = _synthetic(first_links(own.where("k % 3 = 0")), "old")
    by = F.when(F.col("_ord") % 9 == 0, F.struct(F.lit(NOW).alias("at"), F.lit("human").alias("by"))).otherwise(F.col("enriched"))
    return _cast(store.withColumn("enriched", by)).drop("_ord"), _cast(_synthetic(all_.where("k % 2 = 0"), "new"))


def _synthetic_sql(source: str, side: str) -> str:
    return f"""SELECT id, url, k, '{side}' AS side, CASE WHEN k % 4 = 0 THEN '' ELSE concat('{side} ', k) END AS title, CASE WHEN k % 6 = 0 THEN '' ELSE concat('{side} ', k) END AS description,
  concat('g', k % 5) AS g, concat('{side}-', k % 11) AS t, concat('{side} ', k % 4) AS s, CASE WHEN k % 2 = 0 THEN concat('{side} ', k) END AS site, CASE WHEN k % 5 <> 0 THEN k END AS stars FROM ({source}) AS z"""


@query(
    f"""WITH o AS (SELECT *, 0 AS p FROM ({_synthetic_sql(_OLD, 'old')}) AS a), n AS (SELECT *, 1 AS p FROM ({_synthetic_sql(_NEW, 'new')}) AS a), b AS (SELECT * FROM o UNION ALL SELECT * FROM n),
x AS (SELECT id, url, list({{'p': p, 'k': k, 'title': title, 'description': description, 'g': g, 't': t, 's': s, 'site': site, 'stars': stars}} ORDER BY p, k) AS r FROM b GROUP BY id, url),
d AS (SELECT id, url, r, r[1].p = 0 AND r[1].k % 9 = 0 AS human,
  list_transform(r, lambda y: y.g) AS gs, flatten(list_transform(r, lambda y: [y.t, 'shared'])) AS ts, list_transform(r, lambda y: y.s) AS ss FROM x)
SELECT id, url, coalesce(list_filter(r, lambda y: y.title <> '')[1].title, '') AS title,
  CASE WHEN human THEN r[1].description ELSE coalesce(list_filter(r, lambda y: y.description <> '')[1].description, '') END AS description,
  array_to_string(list_filter(gs, lambda y, i: list_position(gs, y) = i)[:3], '|') AS groups, array_to_string(list_filter(ts, lambda y, i: list_position(ts, y) = i)[:8], '|') AS tags,
  array_to_string(list_filter(ss, lambda y, i: list_position(ss, y) = i), '|') AS sources, coalesce(list_filter(r, lambda y: y.site IS NOT NULL)[1].site, '') AS site, list_filter(r, lambda y: y.stars IS NOT NULL)[1].stars AS stars FROM d"""
)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    store, incoming = _sides(spark, d)
    out = M.upsert(store, incoming, NOW)
    sources = F.array_join(F.transform("sources", lambda s: F.concat(s["type"], F.lit(" "), s["ref"])), "|")
    return out.select("id", "url", "title", "description", F.array_join("groups", "|").alias("groups"), F.array_join("tags", "|").alias("tags"), sources.alias("sources"), F.coalesce("meta.siteName", F.lit("")).alias("site"), "meta.stars")


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT count(DISTINCT id) FILTER (id NOT IN (SELECT id FROM o)) AS added, count(*) - count(DISTINCT id) FILTER (id NOT IN (SELECT id FROM o)) AS merged FROM n")
def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    store, incoming = _sides(spark, d)
    return M.upsert_counts(store, incoming)


def _merge_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A store of odd and even keys of one family each, and the pairs to merge: the record of key k with that of key k + 16."""
    own = link_store(spark, d)
    store = _cast(_synthetic(own.select("url", "k"), "s")).drop("_ord")
    a, b = own.where("k > 0 AND k % 32 IN (0, 1, 2, 3, 5)"), own.where("k > 0")
    pairs = a.select(F.col("id").alias("keep"), (F.col("k") + 16).alias("j")).join(b.select(F.col("id").alias("drop"), F.col("k").alias("j")), "j").select("keep", "drop")
    near = own.select((F.col("k") + 1).alias("k"), F.col("id").alias("r")).join(own.select("k", "id"), "k").select("id", "r")
    return store.drop("related").join(near.groupBy("id").agg(F.array(F.min("r")).alias("related")), "id", "left").withColumn("related", F.coalesce("related", F.expr("cast(array() AS array<string>)"))).select(*RECORD.fieldNames()), pairs


_MERGE = f"""o AS (SELECT * FROM ({O.LINK_STORE}) AS a), st AS (SELECT x.*, coalesce(r.id, '') AS rel FROM ({_synthetic_sql(O.LINK_STORE, 's')}) AS x LEFT JOIN o AS r ON r.k = x.k - 1),
pr AS (SELECT a.id AS keep, b.id AS drop FROM o AS a JOIN o AS b ON b.k = a.k + 16 WHERE a.k > 0 AND a.k % 32 IN (0, 1, 2, 3, 5))"""


@query(
    f"""WITH {_MERGE} SELECT k.id, k.url, coalesce(nullif(k.title, ''), d.title) AS title, coalesce(nullif(k.description, ''), d.description) AS description,
  array_to_string(CASE WHEN k.g = d.g THEN [k.g] ELSE [k.g, d.g] END, '|') AS groups, array_to_string(CASE WHEN k.t = d.t THEN [k.t, 'shared'] ELSE [k.t, 'shared', d.t] END, '|') AS tags,
  array_to_string(list_filter(CASE WHEN k.rel = d.rel THEN [k.rel] ELSE [k.rel, d.rel] END, lambda y: y <> '' AND y <> k.id AND y <> d.id), '|') AS related, d.url AS merged_from, coalesce(k.site, d.site, '') AS site, coalesce(k.stars, d.stars) AS stars
FROM pr JOIN st AS k ON k.id = keep JOIN st AS d ON d.id = drop"""
)
def merge_pair(spark: SparkSession, d: str) -> DataFrame:
    store, pairs = _merge_input(spark, d)
    out = M.merge_pairs(store, pairs, NOW)
    join = lambda c: F.array_join(c, "|").alias(c)
    return out.select("id", "url", "title", "description", join("groups"), join("tags"), join("related"), F.array_join("mergedFrom", "|").alias("merged_from"), F.coalesce("meta.siteName", F.lit("")).alias("site"), "meta.stars")


@query(
    f"""WITH {_MERGE} SELECT st.id, CASE WHEN f.keep IS NOT NULL THEN array_to_string(list_filter([f.keep], lambda y: y <> st.id), '|') ELSE rel END AS related FROM st LEFT JOIN pr AS f ON f.drop = st.rel
WHERE st.id NOT IN (SELECT keep FROM pr UNION ALL SELECT drop FROM pr)"""
)
def pointer_repair(spark: SparkSession, d: str) -> DataFrame:
    store, pairs = _merge_input(spark, d)
    gone = pairs.select(F.explode(F.array("keep", "drop")).alias("g"))
    return M.apply_merges(store, pairs, NOW).join(gone, F.col("id") == F.col("g"), "left_anti").select("id", F.array_join("related", "|").alias("related"))


@query(
    f"""WITH {_MERGE}, e AS (SELECT keep AS id, drop AS o FROM pr UNION ALL SELECT drop, keep FROM pr), a AS (SELECT id, list_sort(list_distinct(list(o))) AS o FROM e GROUP BY id)
SELECT st.id, array_to_string(list_sort(list_distinct(list_concat(list_filter([rel], lambda y: y <> ''), a.o))), '|') AS related FROM st JOIN a ON a.id = st.id"""
)
def relate(spark: SparkSession, d: str) -> DataFrame:
    store, pairs = _merge_input(spark, d)
    out = M.relate(store, pairs.select(F.col("keep").alias("a"), F.col("drop").alias("b")), "later")
    return out.where("updatedAt = 'later'").select("id", _joined("related").alias("related"))


_PATCHES = f"""p AS (SELECT l.id, e.event_id AS seq, CASE WHEN e.event_type = 'purchase' OR e.event_id % 3 = 0 THEN e.event_id % 2 = 0 END AS starred, CASE WHEN e.event_id % 4 = 1 THEN concat('note ', e.event_id) END AS notes,
  CASE WHEN e.event_id % 7 = 2 THEN ['Science'] END AS groups FROM events AS e JOIN ({O.LINK_STORE}) AS l ON l.k = e.user_id UNION ALL SELECT 'b_00000000', 1, true, 'x', NULL)"""


def _patches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = link_store(spark, d)
    e = _table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), "event_type")
    i = F.col("seq")
    p = own.join(e, "k").select(
        "id", "seq", F.when((F.col("event_type") == "purchase") | (i % 3 == 0), i % 2 == 0).alias("starred"), F.when(i % 4 == 1, F.concat(F.lit("note "), i)).alias("notes"), F.when(i % 7 == 2, F.array(F.lit("Science"))).alias("groups")
    )
    unknown = spark.createDataFrame([("b_00000000", 1, True, "x", None)], "id string, seq long, starred boolean, notes string, groups array<string>")
    return _cast(_synthetic(own.select("url", "k"), "s")).drop("_ord"), p.unionByName(unknown)


@query(
    f"WITH {_PATCHES} SELECT id, max(seq) AS seq, arg_max(starred, seq) AS starred, coalesce(arg_max(notes, seq), '') AS notes, coalesce(array_to_string(arg_max(groups, seq), '|'), '') AS groups FROM p GROUP BY id"
)
def patch_coalesce(spark: SparkSession, d: str) -> DataFrame:
    out = P.coalesce_patches(_patches(spark, d)[1])
    return out.select("id", "seq", "starred", F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce(F.array_join("groups", "|"), F.lit("")).alias("groups"))


@query(
    f"""WITH {_PATCHES}, c AS (SELECT id, arg_max(starred, seq) AS starred, arg_max(notes, seq) AS notes, arg_max(groups, seq) AS groups FROM p GROUP BY id)
SELECT s.id, coalesce(c.starred, false) AS starred, coalesce(c.notes, '') AS notes, coalesce(array_to_string(c.groups, '|'), s.g) AS groups, CASE WHEN c.notes IS NOT NULL OR c.groups IS NOT NULL THEN 'human' ELSE 'none' END AS by, CASE WHEN c.id IS NULL THEN '{NOW}' ELSE 'later' END AS updated
FROM ({_synthetic_sql(O.LINK_STORE, 's')}) AS s LEFT JOIN c ON c.id = s.id"""
)
def patch_apply(spark: SparkSession, d: str) -> DataFrame:
    store, p = _patches(spark, d)
    out = P.apply_patches(store, P.coalesce_patches(p), "later")
    return out.select("id", "starred", "notes", F.array_join("groups", "|").alias("groups"), F.col("enriched.by").alias("by"), F.col("updatedAt").alias("updated"))


# Enrichment and validation


@query(
    f"""SELECT id, CASE WHEN k % 11 = 0 THEN false WHEN k % 13 = 0 THEN false ELSE true END AS ok, CASE WHEN k % 11 = 0 THEN 'unknown id' WHEN k % 13 = 0 THEN 'description 161 chars > 160' ELSE '' END AS why,
  CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN '' WHEN k % 5 = 0 THEN sd ELSE concat('About ', k) END AS description,
  CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN '' WHEN k % 3 = 0 THEN g ELSE 'Science' END AS groups, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN '' ELSE concat(t, '|shared|new') END AS tags, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN '' ELSE 'Invented' END AS rejected
FROM (SELECT CASE WHEN k % 11 = 0 THEN 'b_nope' ELSE id END AS id, k, description AS sd, g, t FROM ({_synthetic_sql(O.LINK_STORE, 's')}) AS a WHERE k > 0) AS x"""
)
def llm_reply_validation(spark: SparkSession, d: str) -> DataFrame:
    every = link_store(spark, d)
    own = every.where("k > 0")
    k = F.col("k")
    item = F.struct(
        F.when(k % 11 == 0, "b_nope").otherwise(F.col("id")).alias("id"),
        F.when(k % 13 == 0, F.repeat(F.lit("y"), F.lit(161))).when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" About "), k, F.lit(" "))).alias("description"),
        F.when(k % 3 == 0, F.array(F.lit("Invented"))).otherwise(F.array(F.lit("Invented"), F.lit("Science"))).alias("groups"),
        F.array(F.lit("shared"), F.lit("new")).alias("tags"),
    )
    replies = own.select(F.floor(k / 20).alias("batch"), item.alias("i")).groupBy("batch").agg(F.concat(F.lit("Here you are:\n"), F.to_json(F.collect_list("i")), F.lit("\ndone")).alias("reply"))
    store = _cast(_synthetic(every.select("url", "k"), "s"))
    out = E.validated(E.parse_replies(replies), store)
    none = F.lit("")
    return out.select("id", "ok", F.coalesce("why", none).alias("why"), F.coalesce("description", none).alias("description"), *(F.coalesce(F.array_join(c, "|"), none).alias(c) for c in ("groups", "tags", "rejected")))


@query(f"SELECT id, 'needs work' AS why FROM ({O.REC}) AS rec WHERE description = '' OR len(groups) = 0 OR length(description) > 160")
def enrich_targets(spark: SparkSession, d: str) -> DataFrame:
    return E.targets(rec(spark, d)).select("id", F.lit("needs work").alias("why"))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    """A clean store with defects by the key's remainder, in an order of its own."""
    own = _cast(_synthetic(link_store(spark, d).select("url", "k"), "s"))
    m = F.col("_ord") % 23
    long = F.repeat(F.lit("z"), F.lit(170))
    out = own.withColumns(
        {
            "id": F.when(m == 1, "b_XYZ").otherwise(F.col("id")),
            "url": F.when(m == 2, "").when(m == 3, F.regexp_replace("url", "^https:", "http:")).otherwise(F.col("url")),
            "kind": F.when(m == 4, "blob").otherwise(F.col("kind")),
            "groups": F.when(m == 5, F.array(F.lit("Nope"))).when(m == 6, F.array(*map(F.lit, ("Science", "Security", "Science", "AI/ML")))).when(m != 20, F.array(F.lit("Science"))),
            "tags": F.when(m == 7, F.array(F.lit("UP"))).when(m == 8, F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("t"), i % 8))).when(m != 21, F.col("tags")),
            "description": F.when(m == 9, long).when(m == 10, F.lit(None).cast("string")).otherwise(F.col("description")),
            "starred": F.when(m == 11, F.lit(None).cast("boolean")).otherwise(F.col("starred")),
            "notes": F.when(m == 12, F.lit(None).cast("string")).otherwise(F.col("notes")),
            "sources": F.when(m != 13, F.col("sources")),
            "enriched": F.when(m == 14, F.struct(F.lit(None).cast("string").alias("at"), F.lit("robot").alias("by"))).otherwise(F.col("enriched")),
            "mergedFrom": F.when(m == 15, F.array(F.col("url"), F.lit("https://a.example"), F.lit("https://a.example"), F.lit(""))),
            "related": F.when(m == 16, F.array(F.col("id"))).when(m == 17, F.array(F.lit("b_ffffffff"))).when(m == 18, F.lit(None).cast("array<string>")).otherwise(F.col("related")),
        }
    )
    twins = out.where("_ord % 23 = 19").withColumns({"_ord": F.col("_ord") + 1_000_000, "title": F.lit("again")})
    return out.unionByName(twins)


_CLEAN = f"SELECT id, url, k, k % 23 AS m, coalesce(nullif(CASE WHEN k % 4 = 0 THEN '' ELSE concat('s ', k) END, ''), url) AS named FROM ({O.LINK_STORE}) AS a"


@query(
    f"""WITH c AS ({_CLEAN}), v AS (
  SELECT CASE WHEN m = 1 THEN 'b_XYZ' ELSE id END AS id, unnest(CASE m WHEN 1 THEN ['malformed id', 'id does not match its url'] WHEN 2 THEN ['missing url'] WHEN 3 THEN CASE WHEN starts_with(url, 'https:') THEN [concat('url is not canonical (should be ', url, ')')] ELSE [] END
    WHEN 4 THEN ['unknown kind "blob"'] WHEN 5 THEN ['group "Nope" not in taxonomy'] WHEN 6 THEN ['4 groups > 3', 'duplicate groups'] WHEN 7 THEN ['tag "UP" is not lowercase'] WHEN 8 THEN ['9 tags > 8', 'duplicate tags']
    WHEN 9 THEN ['description 170 chars > 160'] WHEN 10 THEN ['description is not a string'] WHEN 11 THEN ['starred is not a boolean'] WHEN 12 THEN ['notes is not a string'] WHEN 13 THEN ['sources is not an array'] WHEN 14 THEN ['unknown enriched.by "robot"']
    WHEN 15 THEN ['mergedFrom holds a non-string', 'mergedFrom lists this record''s own url', 'duplicate mergedFrom urls'] WHEN 16 THEN ['related to itself'] WHEN 17 THEN ['related id b_ffffffff does not resolve'] WHEN 18 THEN ['related is not an array']
    WHEN 19 THEN [concat('duplicate id (also ', named, ')'), concat('duplicate canonical url (also ', id, ')')] WHEN 20 THEN ['groups is not an array'] WHEN 21 THEN ['tags is not an array'] ELSE [] END) AS msg FROM c
  UNION ALL SELECT 'b_XYZ', concat('duplicate id (also ', prev, ')') FROM (SELECT lag(named) OVER (ORDER BY k) AS prev FROM c WHERE m = 1) AS y WHERE prev IS NOT NULL
  UNION ALL SELECT '', 'store is not sorted by id' UNION ALL SELECT 'taxonomy', 'contains "Unsorted"; ungrouped is an empty list')
SELECT id, msg FROM v"""
)
def violations(spark: SparkSession, d: str) -> DataFrame:
    return V.violations(_defects(spark, d), Taxonomy(groups=[*GROUPS, "Unsorted"]))


@query(
    f"SELECT count(*) AS records, count(*) FILTER (len(groups) = 0) AS ungrouped, round(100.0 * count(*) FILTER (len(groups) = 0) / count(*), 1) AS ungrouped_pct, count(*) FILTER (description = '') AS undescribed, 0::BIGINT AS related, 0::BIGINT AS merged FROM ({O.REC}) AS rec"
)
def validator_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.summary(rec(spark, d))


# Whole imports


@query()
def import_links(spark: SparkSession, d: str) -> DataFrame:
    """Sightings to an upserted store: screened, canonical, earliest, projected, classified, folded into the records there."""
    e = _table(spark, d, "events").select(F.col("event_id").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("ts"))
    rows = links(spark, d).join(e, "k").withColumns({"_ord": F.col("k"), "channel": F.lit("#links")})
    ok = I.screened(I.spelled(rows), INTERNAL).where("why IS NULL")
    incoming = _cast(I.link_records(materialize(I.earliest_spelled(ok)), C.rule_table(spark), NOW))
    out = M.upsert(_sides(spark, d)[0], incoming, NOW)
    return out.select("id", "url", "kind", "title", F.array_join("groups", "|").alias("groups"), F.array_join("tags", "|").alias("tags"), F.size("sources").alias("n_sources"), "addedAt")
