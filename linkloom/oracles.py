"""DuckDB text of the queries. Fragments are common table expressions; ``canonical`` adds an address's identity to one."""

from __future__ import annotations

from linkloom.fixtures import INTERNAL, LINKS, NOW
from linkloom.functions.text import STOP
from linkloom.functions.urls import FORGES, PRIVATE_IP, TRACKING
from linkloom.schema import GROUPS, KINDS, LANGUAGE_HINT, RULES, TAG_NOISE


def strings(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def taken_apart(source: str) -> str:
    """Columns of a source with url: raw, web, scheme, fullhost, host, path, q, frag, parts."""
    return f"""
SELECT *, regexp_replace(host0, '^www\\.', '') AS host, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, host0 AS fullhost,
  CASE WHEN sch0 = '' OR (sch0 IN ('http', 'https') AND host0 = '') THEN NULL ELSE sch0 END AS scheme,
  sch0 IN ('http', 'https') AND host0 <> '' AS web
FROM (
  SELECT *, lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch0,
    CASE WHEN regexp_matches(h1, '[\\x00-\\x20<>^|%]') THEN '' ELSE h1 END AS host0,
    CASE WHEN p1 = '' THEN '/' ELSE p1 END AS path,
    regexp_extract(raw, '^[^?#]*\\?([^#]*)', 1) AS q, regexp_extract(raw, '^[^#]*(#.*)$', 1) AS frag
  FROM (
    SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(raw, '^(?i:https?):[/\\\\]*([^/?#\\\\]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS h1,
      replace(regexp_extract(raw, '^(?i:https?):[/\\\\]*[^/?#\\\\]*([^?#]*)', 1), ' ', '%20') AS p1
    FROM (SELECT *, trim(coalesce(url, '')) AS raw FROM ({source}) AS s0) AS s1
  ) AS s2
) AS s3"""


def param(name: str) -> str:
    return f"coalesce(list_extract(list_transform(list_filter(string_split(q, '&'), lambda x: split_part(x, '=', 1) = '{name}'), lambda x: split_part(x, '=', 2)), 1), '')"


def canonical(source: str) -> str:
    """A source with url, as taken apart, with canon (its canonical form) and cid (its id)."""
    return f"""
SELECT *, concat('b_', substr(sha1(canon), 1, 8)) AS cid FROM (
SELECT *, CASE WHEN raw = '' THEN NULL WHEN NOT web THEN raw
  WHEN host IN ('youtube.com', 'm.youtube.com', 'music.youtube.com', 'youtu.be') AND video <> '' THEN concat('https://www.youtube.com/watch?v=', video)
  WHEN host IN ('youtube.com', 'm.youtube.com', 'music.youtube.com', 'youtu.be') AND {param('list')} <> '' THEN concat('https://www.youtube.com/playlist?list=', {param('list')})
  WHEN host = 'github.com' AND len(repo) >= 2 THEN concat('https://github.com/', lower(repo[1]), '/', lower(repo[2]),
    CASE WHEN len(repo) = 2 OR (len(repo) = 4 AND repo[3] = 'tree') THEN '' ELSE concat('/', array_to_string(repo[3:], '/')) END)
  WHEN host IN ('x.com', 'twitter.com', 'mobile.twitter.com') AND regexp_matches(path, '^/([^/]+)/status/([0-9]+)')
    THEN concat('https://x.com/', regexp_extract(path, '^/([^/]+)/status/([0-9]+)', 1), '/status/', regexp_extract(path, '^/([^/]+)/status/([0-9]+)', 2))
  WHEN host = 'arxiv.org' AND paper <> '' THEN concat('https://arxiv.org/abs/', paper)
  WHEN host IN ('docs.google.com', 'drive.google.com') AND regexp_matches(path, '/(document|spreadsheets|presentation|file)/d/([^/]+)')
    THEN concat('https://docs.google.com/', regexp_extract(path, '/(document|spreadsheets|presentation|file)/d/([^/]+)', 1), '/d/', regexp_extract(path, '/(document|spreadsheets|presentation|file)/d/([^/]+)', 2))
  ELSE concat('https://', host, CASE WHEN clean = '' AND NOT (search = '' AND route = '') THEN '/' ELSE clean END, CASE WHEN search = '' THEN '' ELSE concat('?', search) END, route) END AS canon
FROM (
  SELECT *, list_filter(string_split(regexp_replace(path, '\\.git$', ''), '/'), lambda x: x <> '') AS repo,
    CASE WHEN host = 'youtu.be' THEN regexp_extract(path, '^/([^/]*)', 1) WHEN {param('v')} <> '' THEN {param('v')} ELSE regexp_extract(path, '^/(?:embed|shorts|live|v)/([^/]+)', 1) END AS video,
    regexp_extract(path, '/(?:abs|pdf)/(.+?)(?:v[0-9]+)?(?:\\.pdf)?$', 1) AS paper,
    regexp_replace(regexp_replace(path, '/index\\.html?$', '/'), '/+$', '') AS clean,
    CASE WHEN starts_with(frag, '#/') THEN frag ELSE '' END AS route,
    array_to_string(list_transform(list_sort(list_transform(
      list_filter(string_split(q, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({strings(TRACKING)}) AND NOT starts_with(x, 'utm_')),
      lambda x, i: {{'k': split_part(x, '=', 1), 'i': i, 'x': CASE WHEN contains(x, '=') THEN x ELSE concat(x, '=') END}})), lambda s: s.x), '&') AS search
  FROM ({taken_apart(source)}) AS c0
) AS c1
) AS c2"""


def decoded(expr: str) -> str:
    for old, new in (("&quot;", '"'), ("&#39;", "''"), ("&#039;", "''"), ("&apos;", "''"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        expr = f"replace({expr}, '{old}', '{new}')"
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


_TITLE = decoded("regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1)")
_GROUPS = f"[{strings(GROUPS)}]"
_KINDS = f"[{strings(KINDS)}]"

REC = f"""
SELECT cid AS id, canon AS url, {_KINDS}[p % {len(KINDS)} + 1] AS kind, title, CASE WHEN p % 9 = 0 THEN '' ELSE title END AS description,
  CASE WHEN p % 7 = 0 THEN [] WHEN p % 2 = 0 OR g1 = g2 THEN [g1] ELSE [g1, g2] END AS groups, [lang, h] AS tags, p % 5 = 0 AS starred,
  CASE WHEN p % 4 <> 0 THEN (p * 37) % 1000 END AS stars, strftime(DATE '2024-01-01' + CAST(p % 300 AS INT), '%Y-%m-%d') AS published,
  strftime(DATE '2025-01-01' + CAST(p % 200 AS INT), '%Y-%m-%dT00:00:00.000Z') AS addedAt, h AS host, lang
FROM (
  SELECT cid, canon, min(page_id) AS p, arg_min(title, page_id) AS title, {_GROUPS}[min(page_id) % {len(GROUPS)} + 1] AS g1, {_GROUPS}[(min(page_id) * 7 + 3) % {len(GROUPS)} + 1] AS g2,
    regexp_extract(canon, '^https://[^/]+/([^/]+)', 1) AS lang, regexp_replace(regexp_extract(canon, '^https://([^/?#]+)', 1), '^www\\.', '') AS h
  FROM (SELECT page_id, cid, canon, {_TITLE} AS title FROM ({canonical('SELECT page_id, url, html FROM pages')}) AS r0) AS r1
  GROUP BY cid, canon
) AS r2"""

DOCREC = """
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, doc_id, title, substr(text, length(title) + 1) AS description, [lang, source] AS tags, lang, source
FROM (SELECT *, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents) AS d0"""

LINK_STORE = f"SELECT cid AS id, canon AS url, min(k) AS k FROM ({canonical(LINKS)}) AS l0 GROUP BY cid, canon"


def tokens(expr: str) -> str:
    words = f"list_filter(string_split_regex(lower(coalesce({expr}, '')), '[^a-z0-9+#]+'), lambda w: length(w) > 2 AND w NOT IN ({strings(STOP)}))"
    stem = "CASE WHEN length(w) <= 4 THEN w WHEN ends_with(w, 'ies') THEN concat(left(w, length(w) - 3), 'y') ELSE regexp_replace(w, '(?:ing|ers|er|es|s)$', '') END"
    return f"list_distinct(list_transform({words}, lambda w: {stem}))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def score(a: str = "a", b: str = "b") -> str:
    return f"(CAST(0.45 AS DOUBLE) * ({jaccard(a + '.tt', b + '.tt')}) + CAST(0.3 AS DOUBLE) * ({jaccard(a + '.dt', b + '.dt')}) + CAST(0.25 AS DOUBLE) * ({jaccard(a + '.gt', b + '.gt')}))"


FORGE = strings(FORGES)
NAME = f"CASE WHEN fullhost IN ({FORGE}) AND len(parts) >= 2 THEN regexp_replace(lower(parts[2]), '[^a-z0-9]+', '', 'g') ELSE '' END"
OWNER = f"CASE WHEN fullhost IN ({FORGE}) THEN coalesce(parts[1], '') ELSE fullhost END"
GITHUB = "CASE WHEN fullhost = 'github.com' AND len(parts) >= 2 THEN concat(parts[1], '/', parts[2]) END"

REJECT = f"""CASE WHEN scheme IS NULL THEN 'not a URL' WHEN NOT web THEN concat('unsupported scheme ', scheme, ':')
  WHEN fullhost = 'localhost' OR regexp_matches(fullhost, '{PRIVATE_IP}') THEN 'private or loopback address'
  WHEN {' OR '.join(f"fullhost = '{d}' OR ends_with(fullhost, '.{d}')" for d in INTERNAL)} THEN 'internal company host'
  WHEN regexp_matches(fullhost, '\\.(?:compute|elb)\\.amazonaws\\.com$') THEN 'internal cloud hostname'
  WHEN (fullhost = 'claude.ai' AND starts_with(path, '/code/session')) OR (fullhost = 'chatgpt.com' AND starts_with(path, '/share/')) THEN 'private assistant session'
  WHEN fullhost IN ('docs.google.com', 'drive.google.com') THEN 'private document'
  WHEN regexp_matches(q, '(?i)(?:api[-_]?key|access[-_]?token|secret|password|passwd|auth)=') THEN 'credential in the URL' END"""
KIND = """CASE WHEN NOT web THEN 'web' WHEN host = 'gist.github.com' THEN 'doc' WHEN host = 'github.com' THEN 'repo' WHEN host = 'arxiv.org' THEN 'pdf'
  WHEN ends_with(lower(path), '.pdf') THEN 'pdf' WHEN ends_with(lower(path), '.ipynb') THEN 'doc'
  WHEN host IN ('youtube.com', 'youtu.be', 'm.youtube.com') THEN CASE WHEN path = '/playlist' THEN 'playlist' ELSE 'video' END
  WHEN ends_with(lower(path), '.m3u8') OR ends_with(lower(path), '.mp4') THEN 'video' WHEN ends_with(lower(path), '.mp3') OR ends_with(lower(path), '.wav') THEN 'audio'
  WHEN regexp_matches(host, 'readthedocs\\.io$') OR regexp_matches(host, '^docs\\.') THEN 'doc' ELSE 'web' END"""
TITLE = f"""CASE WHEN NOT web THEN url
  WHEN host = 'github.com' AND len(parts) > 2 THEN concat(parts[1], '/', parts[2], ': ', array_to_string(CASE WHEN parts[3] IN ('blob', 'tree') AND len(parts) > 4 THEN parts[5:] ELSE parts[3:] END, '/'))
  WHEN host = 'github.com' AND len(parts) = 2 THEN concat(parts[1], '/', parts[2]) WHEN host = 'arxiv.org' THEN concat('arXiv ', parts[len(parts)])
  WHEN ({KIND}) IN ('video', 'playlist') THEN concat(host, ' video') WHEN len(parts) = 0 THEN host ELSE substr(concat(host, '/', array_to_string(parts, '/')), 1, 120) END"""

RULE_VALUES = ", ".join(f"('{s}', '{g}')" for g, signals in RULES.items() for s in signals)

__all__ = ["LANGUAGE_HINT", "NOW", "TAG_NOISE"]
