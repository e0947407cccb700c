"""Whole inputs: results that a cut or a bound of the work would change."""

import itertools
import random

from pyspark.sql import functions as F

from linkloom.fixtures import first_links
from linkloom.functions import text as T
from linkloom.operators import imports as I
from linkloom.operators import resolve as R


def test_metadata_of_long_pages(spark):
    html = "<html>" + "<p>word</p>" * 20_000 + "<meta content='A &quot;b&quot;' name='author'><title>Late</title>"
    m = spark.createDataFrame([(html,)], "html string").select(T.page_metadata(F.col("html")).alias("m")).first()["m"]
    assert (m["author"], m["title"]) == ('A "b"', "Late")


def test_similarity_join_in_blocks(spark, monkeypatch):
    """Tags of any number, equal rows, keys of many rows and rows without words: each pair once, whatever the minimum."""
    monkeypatch.setattr(R, "BLOCK", 7)
    rng = random.Random(5)
    words = [f"word{k}" for k in range(12)]
    rows = [(f"r{k:03d}", " ".join(rng.sample(words, rng.randint(0, 5))), " ".join(rng.sample(words, rng.choice([0, 0, 3, 8]))), rng.sample([*"abcdefgh", None], rng.choice([0, 1, 2, 2, 5]))) for k in range(120)]
    rows += [(f"s{k:03d}", *rows[0][1:]) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, title string, description string, tags array<string>")
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    full = {(a[0], b[0]): 0.45 * j(a[1].split(), b[1].split()) + 0.3 * j(a[2].split(), b[2].split()) + 0.25 * j(a[3], b[3]) for a, b in itertools.combinations(rows, 2)}
    for least in (0.3, 0.25, 0.1, 0.8):
        got = [(r["a"], r["b"]) for r in R.similar_pairs(df, least).collect()]
        assert len(got) == len(set(got)) and set(got) >= {k for k, v in full.items() if v >= least + 1e-9} and set(got) <= {k for k, v in full.items() if v >= least - 1e-9}


def test_no_token_is_held_against_itself_whole(spark):
    """Rows of one common word that have nothing else in common are dropped before they are scored or made distinct."""
    rows = [(f"r{k:04d}", f"common word{k} other{k} more{k}", "", [f"t{k}"]) for k in range(3000)]
    plan = R.similar_pairs(spark.createDataFrame(rows, "id string, title string, description string, tags array<string>"))
    assert plan.count() == 0
    text = plan._jdf.queryExecution().toString()
    assert "Deduplicate" not in text and "Distinct" not in text


def test_clusters_score_wordings_once(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 2)
    rows = [(f"{k}", f"https://github.com/o{k % 3}/lib", "lib of some kind", "", [f"t{k % 4}"]) for k in range(12)] + [("x", "https://github.com/a/one", "alpha", "", []), ("y", "https://github.com/b/one", "beta", "", [])]
    df = spark.createDataFrame(rows, "id string, url string, title string, description string, tags array<string>")
    out = {r["name"]: (r["size"], r["owners"], round(r["score"], 6)) for r in R.name_clusters(df).collect()}
    assert out == {"lib": (12, 3, 0.7), "one": (2, 2, 0.0)}


def test_link_store_takes_a_spelling_apart_once(spark):
    """The addresses of many rows are few, and the least key of all spellings is kept."""
    rows = [(k, f"https://GitHub.com/A/b{k % 2}" + ("/tree/main" if k % 3 else "")) for k in range(5, 300)]
    out = first_links(spark.createDataFrame(rows, "k long, url string"))
    assert {(r["url"], r["k"]) for r in out.collect()} == {("https://github.com/a/b0", 6), ("https://github.com/a/b1", 5)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_sightings_meet_across_spellings(spark):
    rows = [("https://e.example/a", "100", 3), ("https://e.example/a?utm_source=x", "50", 4), ("http://www.e.example/a", "", 9), ("https://e.example/b", "2024-01-01", 1), ("https://e.example/b#x", "5", 2)]
    df = spark.createDataFrame(rows, "url string, ts string, _ord long")
    ok = I.screened(I.spelled(df)).where("why IS NULL")
    for out in (I.earliest_spelled(ok), I.earliest_sightings(df)):
        assert {(r["url"], r["ts"], r["_ord"]) for r in out.collect()} == {("https://e.example/a", "50", 4), ("https://e.example/b", "2024-01-01", 1)}
