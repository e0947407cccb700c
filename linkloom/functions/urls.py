"""URL identity, refusal rules, kinds and names as native column expressions.

Addresses are taken apart by one family of regular expressions rather than java.net.URI, which refuses many that browsers
accept. Known differences to a browser's parser: no percent-encoding of other characters than spaces, no IDNA, no numeric IPv4
forms, no dot-segment removal. IPv6 hosts have no refusal rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.binding import let

# Parameters that identify nothing, hosts of videos, and code forges.
TRACKING = ["fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "referrer", "source", "si", "feature", "app", "ab_channel"]
VIDEO_HOSTS = ["youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be"]
FORGES = ["github.com", "gitlab.com", "codeberg.org", "bitbucket.org", "sr.ht"]

_AUTHORITY = r"^(?i:https?):[/\\]*([^/?#\\]*)"


def _none() -> Column:
    return F.lit(None).cast("string")


def _trim(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?U:\s)+|(?U:\s)+$", "")


def scheme(url: Column) -> Column:
    """Lower-case scheme, or null if the text is no URL."""
    s = _trim(url)
    found = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    bad = found.isin("http", "https") & (hostname(url) == "")
    return F.when((found != "") & ~bad, found)


def hostname(url: Column) -> Column:
    """Host of an http(s) URL: lower case, without credentials and port; '' for others."""
    authority = F.regexp_extract(_trim(url), _AUTHORITY, 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    return F.when(host.rlike(r"[\x00-\x20<>^|%]"), "").otherwise(host)


def host_of(url: Column) -> Column:
    """Host without a leading ``www.``; '' if there is none."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def pathname(url: Column) -> Column:
    path = F.regexp_extract(_trim(url), r"^(?i:https?):[/\\]*[^/?#\\]*([^?#]*)", 1)
    path = F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(" "), F.lit("%20"))
    return F.when(path == "", "/").otherwise(path)


def query(url: Column) -> Column:
    """What follows the question mark, without it."""
    return F.regexp_extract(_trim(url), r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    """The fragment with its hash mark, or ''."""
    return F.regexp_extract(_trim(url), r"^[^#]*(#.*)$", 1)


def path_parts(url: Column) -> Column:
    return F.array_remove(F.split(pathname(url), "/"), "")


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def params(q: Column) -> Column:
    """Decoded (key, place, value) of a query string, in order."""
    pairs = F.filter(F.split(q, "&"), lambda x: x != "")
    return F.transform(
        pairs,
        lambda x, i: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("key"), i.alias("place"), F.when(x.contains("="), _decoded(F.regexp_replace(x, r"^[^=]*=", ""))).otherwise("").alias("value")),
    )


def parsed(url: Column) -> Column:
    """Struct of url, raw (trimmed), scheme, hostname, host (without www.), path, parts, query and fragment."""
    place = lambda x: F.struct(
        x["url"].alias("url"), x["raw"].alias("raw"), scheme(x["raw"]).alias("scheme"), hostname(x["raw"]).alias("hostname"), host_of(x["raw"]).alias("host"), pathname(x["raw"]).alias("path"),
        path_parts(x["raw"]).alias("parts"), query(x["raw"]).alias("query"), fragment(x["raw"]).alias("fragment"),
    )
    return let(F.struct(url.alias("url"), _trim(url).alias("raw")), place)


def _web(p: Column) -> Column:
    return F.coalesce(p["scheme"].isin("http", "https"), F.lit(False))


def param(q: Column, name: str) -> Column:
    """First value of a parameter, '' if absent."""
    return F.coalesce(F.try_element_at(F.filter(params(q), lambda p: p["key"] == name), F.lit(1))["value"], F.lit(""))


def is_tracking(key: Column) -> Column:
    return key.isin(TRACKING) | key.startswith("utm_")


def clean_query(q: Column) -> Column:
    """Form-encoded parameters without tracking ones, sorted by key, equal keys in their order."""
    kept = F.array_sort(F.filter(params(q), lambda p: ~is_tracking(p["key"])))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")


def canonical_url(url: Column) -> Column:
    """One spelling per resource. Text that isn't an http(s) URL is trimmed only; empty text gives null (an error at the source)."""
    return let(parsed(url), lambda p: let(_shapes(p), lambda s: _canonical(p, s)))


_TWEET, _DOCUMENT = r"^/([^/]+)/status/([0-9]+)", r"/(document|spreadsheets|presentation|file)/d/([^/]+)"


def _shapes(p: Column) -> Column:
    """What the rules per host look for, and the parts of an address that no rule names."""
    path, q = p["path"], p["query"]
    watched = F.coalesce(F.nullif(param(q, "v"), F.lit("")), F.regexp_extract(path, r"^/(?:embed|shorts|live|v)/([^/]+)", 1))
    clean = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    return F.struct(
        F.when(p["host"] == "youtu.be", F.regexp_extract(path, r"^/([^/]*)", 1)).otherwise(watched).alias("video"),
        param(q, "list").alias("playlist"),
        F.array_remove(F.split(F.regexp_replace(path, r"\.git$", ""), "/"), "").alias("repo"),
        F.regexp_extract(path, r"/(?:abs|pdf)/(.+?)(?:v[0-9]+)?(?:\.pdf)?$", 1).alias("paper"),
        clean_query(q).alias("search"),
        F.when(p["fragment"].startswith("#/"), p["fragment"]).otherwise("").alias("route"),
        clean.alias("clean"),
    )


def _canonical(p: Column, s: Column) -> Column:
    host, path, repo = p["host"], p["path"], s["repo"]
    root = F.concat(F.lit("https://github.com/"), F.lower(F.get(repo, F.lit(0))), F.lit("/"), F.lower(F.get(repo, F.lit(1))))
    rest = F.slice(repo, F.lit(3), F.greatest(F.lit(0), F.size(repo) - 2))
    is_root = (F.size(repo) == 2) | ((F.size(repo) == 4) & (F.get(repo, F.lit(2)) == "tree"))
    bare = (s["search"] == "") & (s["route"] == "")
    end = F.when((s["clean"] == "") & ~bare, "/").otherwise(s["clean"])
    generic = F.concat(F.lit("https://"), host, end, F.when(s["search"] == "", "").otherwise(F.concat(F.lit("?"), s["search"])), s["route"])
    out = (
        F.when(~_web(p), p["raw"])
        .when(host.isin(VIDEO_HOSTS) & (s["video"] != ""), F.concat(F.lit("https://www.youtube.com/watch?v="), s["video"]))
        .when(host.isin(VIDEO_HOSTS) & (s["playlist"] != ""), F.concat(F.lit("https://www.youtube.com/playlist?list="), s["playlist"]))
        .when((host == "github.com") & (F.size(repo) >= 2), F.when(is_root, root).otherwise(F.concat(root, F.lit("/"), F.array_join(rest, "/"))))
        .when(host.isin("x.com", "twitter.com", "mobile.twitter.com") & path.rlike(_TWEET), F.concat(F.lit("https://x.com/"), F.regexp_extract(path, _TWEET, 1), F.lit("/status/"), F.regexp_extract(path, _TWEET, 2)))
        .when((host == "arxiv.org") & (s["paper"] != ""), F.concat(F.lit("https://arxiv.org/abs/"), s["paper"]))
        .when(host.isin("docs.google.com", "drive.google.com") & path.rlike(_DOCUMENT), F.concat(F.lit("https://docs.google.com/"), F.regexp_extract(path, _DOCUMENT, 1), F.lit("/d/"), F.regexp_extract(path, _DOCUMENT, 2)))
        .otherwise(generic)
    )
    return F.when(p["raw"] != "", out)


def link_id(canonical: Column) -> Column:
    """Id of a canonical URL."""
    return F.concat(F.lit("b_"), F.substring(F.sha1(canonical), 1, 8))


# Fixed value: private, loopback, link-local and carrier-grade ranges, as text.
PRIVATE_IP = r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)"
CREDENTIAL = r"(?i)(?:api[-_]?key|access[-_]?token|secret|password|passwd|auth)="


def reject_reason(url: Column, internal_domains: tuple[str, ...] = ()) -> Column:
    """Null if an address may be published, else the first rule that refuses it. Internal company domains are a parameter."""
    return let(parsed(url), lambda p: _reason(p, internal_domains))


def _reason(p: Column, internal_domains: tuple[str, ...]) -> Column:
    host, path, s = p["hostname"], p["path"], p["scheme"]
    inside = F.lit(False)
    for d in internal_domains:
        inside = inside | (host == d) | host.endswith("." + d)
    session = ((host == "claude.ai") & path.startswith("/code/session")) | ((host == "chatgpt.com") & path.startswith("/share/"))
    return (
        F.when(s.isNull(), "not a URL")
        .when(~s.isin("http", "https"), F.concat(F.lit("unsupported scheme "), s, F.lit(":")))
        .when((host == "localhost") | host.rlike(PRIVATE_IP), "private or loopback address")
        .when(inside, "internal company host")
        .when(host.rlike(r"\.(?:compute|elb)\.amazonaws\.com$"), "internal cloud hostname")
        .when(session, "private assistant session")
        .when(host.isin("docs.google.com", "drive.google.com"), "private document")
        .when(p["query"].rlike(CREDENTIAL), "credential in the URL")
    )


def kind_for(url: Column) -> Column:
    """What an address points at; the first rule wins."""
    return let(parsed(url), _kind)


def _kind(p: Column) -> Column:
    host, path = p["host"], F.lower(p["path"])
    return (
        F.when(~_web(p), "web")
        .when(host == "gist.github.com", "doc")
        .when(host == "github.com", "repo")
        .when(host == "arxiv.org", "pdf")
        .when(path.endswith(".pdf"), "pdf")
        .when(path.endswith(".ipynb"), "doc")
        .when(host.isin("youtube.com", "youtu.be", "m.youtube.com"), F.when(p["path"] == "/playlist", "playlist").otherwise("video"))
        .when(path.endswith(".m3u8") | path.endswith(".mp4"), "video")
        .when(path.endswith(".mp3") | path.endswith(".wav"), "audio")
        .when(host.rlike(r"readthedocs\.io$") | host.rlike(r"^docs\."), "doc")
        .otherwise("web")
    )


def repo_sub_path(parts: Column) -> Column:
    """The telling part of a path below a repository, percent-decoded where that works."""
    rest = F.when(F.get(parts, F.lit(0)).isin("blob", "tree"), F.slice(parts, 3, F.greatest(F.lit(0), F.size(parts) - 2))).otherwise(parts)
    joined = F.array_join(F.when(F.size(rest) > 0, rest).otherwise(parts), "/")
    return F.coalesce(F.try_url_decode(F.replace(joined, F.lit("+"), F.lit("%2B"))), joined)


def title_for(url: Column, kind: Column) -> Column:
    """A readable title from the address alone."""
    return let(F.struct(parsed(url).alias("p"), kind.alias("kind")), lambda x: _title(x["p"], x["kind"]))


def _title(p: Column, kind: Column) -> Column:
    host, parts = p["host"], p["parts"]
    repo = F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)))
    return (
        F.when(~_web(p), p["url"])
        .when((host == "github.com") & (F.size(parts) > 2), F.concat(repo, F.lit(": "), repo_sub_path(F.slice(parts, 3, F.greatest(F.lit(0), F.size(parts) - 2)))))
        .when((host == "github.com") & (F.size(parts) == 2), repo)
        .when(host == "arxiv.org", F.concat(F.lit("arXiv "), F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("undefined"))))
        .when(kind.isin("video", "playlist"), F.concat(host, F.lit(" video")))
        .when(F.size(parts) == 0, host)
        .otherwise(F.substring(F.concat(host, F.lit("/"), F.array_join(parts, "/")), 1, 120))
    )


def basename(url: Column) -> Column:
    parts = path_parts(url)
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))


def project_name(url: Column) -> Column:
    """Normalized second path part on code forges, '' elsewhere."""
    from linkloom.functions.text import normalize_name

    parts = path_parts(url)
    return F.when(hostname(url).isin(FORGES) & (F.size(parts) >= 2), normalize_name(F.get(parts, F.lit(1)))).otherwise("")


def owner_of(url: Column) -> Column:
    """First path part on any forge, the host elsewhere: the owner rule of the browsing side."""
    return F.when(hostname(url).isin(FORGES), F.coalesce(F.get(path_parts(url), F.lit(0)), F.lit(""))).otherwise(hostname(url))


def github_repo(url: Column) -> Column:
    """owner/repo on one forge only, else null: the owner rule of the merging side."""
    parts = path_parts(url)
    return F.when((hostname(url) == "github.com") & (F.size(parts) >= 2), F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1))))


def arxiv_id(url: Column) -> Column:
    """What follows ``arxiv.org/abs/`` anywhere, mirrors included; null without it."""
    return F.nullif(F.regexp_extract(url, r"arxiv\.org/abs/(.+)$", 1), F.lit(""))
