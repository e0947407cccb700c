"""URL identity, refusals, kinds and names: one Spark job per function over a table of cases."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import urls as U


def run(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", fn(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


CANONICAL = {
    "https://youtu.be/abc?si=1": "https://www.youtube.com/watch?v=abc",
    "http://www.youtube.com/watch?v=abc&list=PL1&feature=share": "https://www.youtube.com/watch?v=abc",
    "https://m.youtube.com/shorts/abc": "https://www.youtube.com/watch?v=abc",
    "https://youtube.com/embed/abc?x=1": "https://www.youtube.com/watch?v=abc",
    "https://www.youtube.com/playlist?list=PL1": "https://www.youtube.com/playlist?list=PL1",
    "https://www.youtube.com/@name": "https://youtube.com/@name",
    "https://github.com/Owner/Repo": "https://github.com/owner/repo",
    "https://github.com/Owner/Repo.git": "https://github.com/owner/repo",
    "https://github.com/Owner/Repo/tree/dev": "https://github.com/owner/repo",
    "https://github.com/Owner/Repo/tree/dev/src?x=1#L2": "https://github.com/owner/repo/tree/dev/src",
    "https://github.com/Owner": "https://github.com/Owner",
    "https://twitter.com/Me/status/12?s=20": "https://x.com/Me/status/12",
    "https://mobile.twitter.com/Me/status/12/photo/1": "https://x.com/Me/status/12",
    "https://arxiv.org/pdf/1706.03762v5.pdf": "https://arxiv.org/abs/1706.03762",
    "https://arxiv.org/abs/1706.03762v2": "https://arxiv.org/abs/1706.03762",
    "https://docs.google.com/document/d/X1/edit#h": "https://docs.google.com/document/d/X1",
    "https://drive.google.com/file/d/X1/view": "https://docs.google.com/file/d/X1",
    "https://user:pw@EXAMPLE.com:8443/A/index.html?b=2&a=1&utm_x=1&gclid=2": "https://example.com/A?a=1&b=2",
    "https://example.com/a?z=1&b&a=%20x": "https://example.com/a?a=+x&b=&z=1",
    "https://example.com/a?b=2&b=1": "https://example.com/a?b=2&b=1",
    "https://example.com/app#/route": "https://example.com/app#/route",
    "https://example.com/#/route": "https://example.com/#/route",
    "https://example.com/page#section": "https://example.com/page",
    "http://www.example.com/": "https://example.com",
    "https://example.com/?q=1": "https://example.com/?q=1",
    " /home/me/file.txt ": "/home/me/file.txt",
    "mailto:a@b.c": "mailto:a@b.c",
    "": None,
}


def test_canonical(spark):
    assert dict(zip(CANONICAL, run(spark, U.canonical_url, CANONICAL))) == CANONICAL


def test_canonical_is_idempotent(spark):
    once = [x for x in run(spark, U.canonical_url, CANONICAL) if x]
    assert run(spark, U.canonical_url, once) == once


REASONS = {
    "http://10.1.2.3/x": "private or loopback address", "http://172.16.0.1": "private or loopback address", "http://172.15.0.1": None, "http://172.32.0.1": None,
    "http://192.168.1.1:80/": "private or loopback address", "http://100.64.0.1/": "private or loopback address", "http://100.63.0.1/": None, "http://100.128.0.1/": None,
    "http://169.254.1.1/": "private or loopback address", "http://localhost:1/": "private or loopback address", "http://11.0.0.1/": None,
    "https://ci.corp.example/": "internal company host", "https://corp.example/": "internal company host", "https://mycorp.example/": None, "https://github.com/corp-example/x": None,
    "https://x.compute.amazonaws.com/": "internal cloud hostname", "https://x.elb.amazonaws.com/": "internal cloud hostname", "https://aws.amazon.com/": None,
    "https://chatgpt.com/share/1": "private assistant session", "https://docs.google.com/x": "private document", "https://example.com/?API_KEY=1": "credential in the URL",
    "https://example.com/?author=me": None, "https://example.com/?auth=me": "credential in the URL", "nope": "not a URL", "ftp://example.com": "unsupported scheme ftp:", "https://": "not a URL",
}


def test_reasons(spark):
    assert dict(zip(REASONS, run(spark, lambda c: U.reject_reason(c, ("corp.example",)), REASONS))) == REASONS


KINDS = {
    "https://gist.github.com/a/1": "doc", "https://github.com/a/b/blob/main/n.ipynb": "repo", "https://arxiv.org/abs/1": "pdf", "https://e.com/A.PDF": "pdf", "https://e.com/n.ipynb": "doc",
    "https://youtube.com/playlist?list=1": "playlist", "https://youtu.be/1": "video", "https://e.com/a.mp4": "video", "https://e.com/a.wav": "audio", "https://docs.e.com/": "doc",
    "https://x.readthedocs.io/": "doc", "https://e.com/": "web", "nope": "web",
}


def test_kinds(spark):
    assert dict(zip(KINDS, run(spark, U.kind_for, KINDS))) == KINDS


def test_titles(spark):
    cases = {
        "https://github.com/a/b": "a/b", "https://github.com/a/b/pull/5": "a/b: pull/5", "https://github.com/a/b/blob/main/x%20y+z.md": "a/b: x y+z.md", "https://github.com/a/b/tree/main": "a/b: tree/main",
        "https://arxiv.org/abs/1706.1": "arXiv 1706.1", "https://youtu.be/1": "youtu.be video", "https://www.e.com/": "e.com", "https://e.com/" + "x" * 200: ("e.com/" + "x" * 200)[:120],
    }
    assert dict(zip(cases, run(spark, lambda c: U.title_for(c, U.kind_for(c)), cases))) == cases


def test_names(spark):
    urls = ["https://github.com/O/My-Repo.js", "https://gitlab.com/O/r", "https://x.readthedocs.io/en/latest/", "https://github.com/O", "nope"]
    assert run(spark, U.project_name, urls) == ["myrepojs", "r", "", "", ""]
    assert run(spark, U.owner_of, urls) == ["O", "O", "x.readthedocs.io", "O", ""]
    assert run(spark, U.github_repo, urls) == ["O/My-Repo.js", None, None, None, None]
    assert run(spark, U.arxiv_id, ["https://export.arxiv.org/abs/1.2", "https://e.com"]) == ["1.2", None]


def test_message_links(spark):
    cases = {
        "see <https://a.example/x|label> and https://b.example/y.": ["https://a.example/x", "https://b.example/y."],
        "<https://a.example> https://a.example": ["https://a.example"],
        "(https://c.example/p) xhttps://d.example": ["https://c.example/p"],
        "none": [],
    }
    assert dict(zip(cases, run(spark, T.urls_from_text, cases))) == cases


def test_text(spark):
    assert run(spark, T.clean_text, [":fireworks:A  b c", "— – lead", None]) == ["A b c", "lead", ""]
    assert run(spark, T.decode_entities, ["&amp;lt; &#39;x&#39; &#233;&nbsp; y ", "a&#65;b&#66;", ""]) == ["< 'x' é y", "aAbB", ""]
    assert sorted(run(spark, T.tokens, ["The Libraries of animations, animation and C++ boxes"])[0]) == sorted(["library", "animation", "c++", "box"])
    assert run(spark, T.ts_to_iso, ["1609459200.5", "2021", "2021-01-02", "x", ""]) == ["2021-01-01T00:00:00.500Z", "1970-01-01T00:33:41.000Z", "2021-01-02T00:00:00.000Z", None, None]


def test_stems(spark):
    assert run(spark, T.stem, ["libraries", "running", "users", "boxes", "cats", "math", "gas"]) == ["library", "runn", "us", "box", "cats", "math", "gas"]


@pytest.mark.parametrize("n,out", [(5, "5"), (1000, "1k"), (1234, "1.2k"), (12345, "12k")])
def test_compact(spark, n, out):
    assert spark.range(1).select(T.compact_count(F.lit(n))).first()[0] == out
