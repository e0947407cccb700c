"""Upsert, merge, relate, patches, classification, violations and browsing of small stores."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom.operators import classify as C
from linkloom.operators import enrich as E
from linkloom.operators import imports as I
from linkloom.operators import patches as P
from linkloom.operators import resolve as R
from linkloom.operators import upsert as M
from linkloom.operators import violations as V
from linkloom.plans import browse as B
from linkloom.schema import RECORD
from linkloom.sources import store as S


def record(i, **more):
    base = dict(
        id=f"b_{i:08x}", url=f"https://e.example/{i}", kind="web", title=f"t{i}", description="d", groups=["Science"], tags=["x"], starred=False, notes="", sources=[("a", str(i), "2020")],
        meta=("s", None, None, None, None, None), related=[], mergedFrom=None, enriched=(None, "none"), addedAt="2020-01-01", updatedAt="2020-01-01",
    )
    return tuple({**base, **more}[c] for c in RECORD.fieldNames())


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_upsert_keeps_what_people_wrote(spark):
    old = frame(spark, [record(1, starred=True, notes="mine", title="", description="", groups=["A", "B"], enriched=("2020", "human"), tags=[f"t{k}" for k in range(8)])])
    new = frame(spark, [record(1, notes="theirs", title="new", description="new", groups=["C", "D"], tags=["late"], sources=[("b", "1", "2021"), ("a", "1", "2022")], meta=("z", "w", None, None, None, 5)), record(2, groups=["A", "B", "C", "D"])]).withColumn("_ord", F.monotonically_increasing_id())
    out = by_id(M.upsert(old, new, "now"))
    r = out["b_00000001"]
    assert (r["starred"], r["notes"], r["title"], r["description"]) == (True, "mine", "new", "")  # a person's empty description stays
    assert r["groups"] == ["A", "B", "C"] and r["tags"] == [f"t{k}" for k in range(8)]
    assert [(s["type"], s["ref"]) for s in r["sources"]] == [("a", "1"), ("b", "1")]
    assert (r["meta"]["siteName"], r["meta"]["author"], r["meta"]["stars"]) == ("s", "w", 5)
    assert out["b_00000002"]["groups"] == ["A", "B", "C", "D"]  # nothing merged: nothing capped
    again = by_id(M.upsert(M.upsert(old, new, "now"), new, "now"))
    assert {k: v["tags"] for k, v in again.items()} == {k: v["tags"] for k, v in out.items()}
    assert M.upsert_counts(old, new.unionAll(new)).first().asDict() == {"added": 1, "merged": 3}


def test_upsert_folds_repeats_across_chunks(spark):
    rows = frame(spark, [record(1, tags=[f"t{k}"], title="" if k < 2 else f"t{k}") for k in range(6)])
    own = rows.withColumn("_ord", F.substring(F.col("tags")[0], 2, 9).cast("long") * 3000)
    r = by_id(M.upsert(frame(spark, []), own, "now"))["b_00000001"]
    assert r["tags"] == [f"t{k}" for k in range(6)] and r["title"] == "t2"


def test_merge_and_pointers(spark):
    store = frame(spark, [record(1, notes=" k ", related=["b_00000002", "b_00000003"], addedAt="2021"), record(2, notes="d", starred=True, addedAt="", groups=["AI/ML"]), record(3, related=["b_00000002", "b_00000001"]), record(4, related=["b_00000002"])])
    pairs = spark.createDataFrame([("b_00000001", "b_00000002"), ("b_00000003", "b_00000003"), ("b_00000004", "b_nope")], "keep string, drop string")
    out = by_id(M.apply_merges(store, pairs, "now"))
    k = out["b_00000001"]
    assert sorted(out) == ["b_00000001", "b_00000003", "b_00000004"]
    assert k["notes"] == "k\n\n## from https://e.example/2\n\nd" and k["starred"] and k["related"] == ["b_00000003"] and k["addedAt"] == "" and k["mergedFrom"] == ["https://e.example/2"]
    assert k["groups"] == ["Science", "AI/ML"]
    assert out["b_00000003"]["related"] == ["b_00000001"] and out["b_00000004"]["related"] == ["b_00000001"]


def test_relate_is_symmetric_and_idempotent(spark):
    store = frame(spark, [record(1), record(2), record(3)])
    pairs = spark.createDataFrame([("b_00000001", "b_00000002"), ("b_00000003", "b_00000003")], "a string, b string")
    once = M.relate(store, pairs, "now")
    twice = by_id(M.relate(once, pairs, "now"))
    assert {k: v["related"] for k, v in twice.items()} == {"b_00000001": ["b_00000002"], "b_00000002": ["b_00000001"], "b_00000003": []}


def test_classification(spark):
    rows = spark.createDataFrame(
        [("a", "a sql thing", "", ["SQL", "sql"], ""), ("b", "x", "sql", [], "Rust"), ("c", "cli sql", "shell duckdb", [], "Rust"), ("d", "", "", [], "Rust"), ("e", None, None, None, None)], "id string, title string, description string, topics array<string>, language string"
    )
    out = {r["id"]: (r["groups"], r["confident"]) for r in C.classify(rows, C.rule_table(spark, {"Data & Databases": ["sql", "duckdb"], "Tools & Utilities": ["cli", "shell"]})).collect()}
    assert out == {"a": (["Data & Databases"], True), "b": ([], False), "c": (["Data & Databases", "Tools & Utilities"], True), "d": ([], False), "e": ([], False)}


def test_violations_none_on_a_clean_store(spark):
    url = "https://e.example/1"
    import hashlib

    ident = "b_" + hashlib.sha1(url.encode()).hexdigest()[:8]
    clean = frame(spark, [record(1, id=ident)]).withColumn("_ord", F.lit(0))
    assert V.violations(clean).count() == 0
    assert V.summary(clean.limit(0)).first()["ungrouped_pct"] == 0.0


def test_similarity_join_is_lossless(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = [f"word{k}" for k in range(40)]
    rows = [(f"r{k:03d}", " ".join(rng.sample(words, 3)), " ".join(rng.sample(words, 8)), rng.sample(["a", "b", "c", "d"], 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, title string, description string, tags array<string>")
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    full = {(a[0], b[0]): 0.45 * j(a[1].split(), b[1].split()) + 0.3 * j(a[2].split(), b[2].split()) + 0.25 * j(a[3], b[3]) for a, b in itertools.combinations(rows, 2)}
    for least in (0.3, 0.2, 0.6, 0.0):
        got = {(r["a"], r["b"]): r["score"] for r in R.similar_pairs(df, least).collect()}
        assert got == {k: pytest.approx(v) for k, v in full.items() if v >= least - 1e-12 and (v >= least)}
    assert R.similar_pairs(df, float("nan")).count() == 0


def test_browse(spark):
    store = frame(spark, [record(k, title=f"Title {k}", groups=[] if k % 3 == 0 else ["Science"] if k % 3 == 1 else ["Science", "Security"], kind="web" if k % 2 else "pdf", description="" if k == 5 else "d", tags=["en"] if k < 4 else ["fr", "en"]) for k in range(8)])
    view = B.prepared(store)
    ids = lambda q: {int(r["id"][2:], 16) for r in view.where(q.matches()).collect()}
    q = B.BrowseQuery
    assert ids(q(groups=("Science", "Security"))) == {1, 2, 4, 5, 7} and ids(q(groups=("Science", "Security"), mode="all")) == {2, 5}
    assert ids(q(groups=(B.UNFILED,))) == {0, 3, 6} and ids(q(groups=(B.UNFILED, "Security"))) == {0, 2, 3, 5, 6}
    assert ids(q(tags=("en", "fr"))) == {4, 5, 6, 7} and ids(q(q="TITLE 3")) == {3} and ids(q(bucket="undescribed")) == {5} and ids(q(kinds=("pdf",))) == {0, 2, 4, 6}
    facets = {(r["dim"], r["value"]): r["n"] for r in q(kinds=("pdf",)).facets(view).collect()}
    assert facets["groups", "Science"] == 2 and facets["groups", B.UNFILED] == 2 and facets["kinds", "web"] == 4 and facets["groups", "Personal"] == 0
    assert q.from_params(q(q="a b", groups=("AI/ML",), tags=("x",), bucket="linkable", mode="all", sort="title").to_params()) == q(q="a b", groups=("AI/ML",), tags=("x",), bucket="linkable", mode="all", sort="title")
    assert q.from_params("?todo=zz&sort=zz&mode=zz") == q()
    found, place = q(sort="title", kinds=("web",)).position(view, "b_00000002")
    assert place == 2 and found.kinds == ()


def test_store_round_trip_and_versions(spark, tmp_path):
    store = frame(spark, [record(2), record(1)])
    path = str(tmp_path / "s")
    S.save_store(store, path)
    again = S.save_store(spark.read.schema(RECORD).parquet(path), path)  # the path being read
    assert [r["id"] for r in again.collect()] == ["b_00000001", "b_00000002"]
    v = S.VersionedStore(spark, str(tmp_path / "v"))
    assert v.write(store, 0) == 1
    with pytest.raises(S.Conflict):
        v.write(store, 0)
    patches = spark.createDataFrame([("b_00000001", 1, True, None), ("b_00000001", 2, None, "n"), ("b_x", 3, True, None)], "id string, seq long, starred boolean, notes string").withColumn("groups", F.lit(None).cast("array<string>"))
    assert P.commit(v, patches, lambda: "now") == 2
    r = by_id(v.read()[1])
    assert (r["b_00000001"]["starred"], r["b_00000001"]["notes"], r["b_00000001"]["enriched"]["by"]) == (True, "n", "human") and r["b_00000002"]["updatedAt"] == "2020-01-01"
    assert P.toggle_group(["a", "b", "c"], "d") == ["a", "b", "c"] and P.toggle_group(["a"], "a") == []


def test_streams(spark, tmp_path):
    from linkloom.streaming.edits import patch_stream, upsert_stream

    src = str(tmp_path / "in")
    frame(spark, [record(1), record(2)]).write.parquet(src)
    v = S.VersionedStore(spark, str(tmp_path / "v"))
    for _ in range(2):  # a second start finds nothing new
        upsert_stream(spark.readStream.schema(RECORD).parquet(src), v, str(tmp_path / "c"), lambda: "now").awaitTermination()
    assert v.version() == 1 and v.read()[1].count() == 2
    edits = str(tmp_path / "e")
    schema = "id string, seq long, starred boolean, notes string, groups array<string>"
    spark.createDataFrame([("b_00000001", 1, True, None, None)], schema).write.parquet(edits)
    patch_stream(spark.readStream.schema(schema).parquet(edits), v, str(tmp_path / "d"), lambda: "now").awaitTermination()
    assert by_id(v.read()[1])["b_00000001"]["starred"] is True


def test_sources_and_imports(spark, tmp_path):
    d = tmp_path / "export" / "general"
    d.mkdir(parents=True)
    (d / "1.json").write_text(json.dumps([{"text": "<https://github.com/A/b|x> and http://10.0.0.1/", "ts": "100.5", "attachments": [{"title_link": "https://e.example/a?utm_source=1", "text": None}]}, {"text": "https://github.com/a/B/tree/main", "ts": "50"}]))
    (d / "2.json").write_text("{broken")
    (d / "users.json").write_text('{"a": 1}')
    rows = I.message_links(S.read_export(spark, str(tmp_path / "export")))
    ok = I.screened(rows.withColumn("_ord", F.monotonically_increasing_id()))
    assert {r["why"]: r["n"] for r in I.refusals(ok).collect()} == {"private or loopback address": 1}
    seen = I.earliest_sightings(ok.where("why IS NULL"))
    out = {r["url"]: r for r in I.link_records(seen, C.rule_table(spark), "now").collect()}
    assert out["https://github.com/a/b"]["addedAt"] == "1970-01-01T00:00:50.000Z" and out["https://github.com/a/b"]["sources"][0]["ref"] == "#general"
    assert sorted(out) == ["https://e.example/a", "https://github.com/a/b"]
    (tmp_path / "stars.json").write_text('{"full_name": "O/R", "html_url": "https://github.com/O/R", "description": ":x1: A sql duckdb tool", "topics": ["SQL"], "language": null, "stargazers_count": 7, "pushed_at": "2024", "owner": null}\n\n')
    r = I.repo_records(S.read_starred(spark, str(tmp_path / "stars.json")), C.rule_table(spark), "now", "me").first()
    assert (r["id"], r["description"], r["groups"], r["tags"], r["meta"]["author"], r["enriched"]["by"]) == (r["id"], "A sql duckdb tool", ["Data & Databases"], ["sql"], "O", "scrape")
    (tmp_path / "inbox.json").write_text('[{"url": "https://e.example", "ts": "1"}]')
    assert S.read_inbox(spark, str(tmp_path / "inbox.json")).count() == 1
    (tmp_path / "tax.json").write_text('{"groups": ["A"], "limits": {"maxTags": 2}}')
    assert S.load_taxonomy(spark, str(tmp_path / "tax.json")).max_tags == 2


def test_prompts(spark):
    store = frame(spark, [record(k, url=f"https://e.example/{k}", title="e.example/x") for k in range(45)])
    scraped = spark.createDataFrame([(f"b_{k:08x}", ("Page", "desc", "", "", "", None)) for k in range(45)], "id string, scraped struct<title:string,description:string,siteName:string,author:string,published:string,error:string>")
    out = E.prompts(E.retitled(store, scraped)).collect()
    assert sorted({r["batch"] for r in out}) == [0, 1, 2] and json.loads(out[0]["input"])["scraped"]["title"] == "Page"
