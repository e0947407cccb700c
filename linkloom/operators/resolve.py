"""Entity resolution: same resource, same name, similar wording."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import WEIGHTS, content_similarity, jaccard, tokens
from linkloom.functions.urls import arxiv_id, github_repo, owner_of, project_name
from linkloom.tables import materialize

RELATED_MIN, DEEP_MIN = 0.28, 0.30
_ROOT = "https://github.com/"


def _repo(store: DataFrame) -> DataFrame:
    return store.select("id", "url", github_repo(F.col("url")).alias("repo")).where("repo IS NOT NULL")


def same_paper(store: DataFrame) -> DataFrame:
    """keep, drop (ids in their order) and why, of records of one paper."""
    p = store.select("id", arxiv_id(F.col("url")).alias("paper")).where("paper IS NOT NULL")
    a, b = p.select(F.col("id").alias("keep"), "paper"), p.select(F.col("id").alias("drop"), "paper")
    return a.join(b, "paper").where("keep < drop").select("keep", "drop", F.concat(F.lit("same arXiv id "), "paper").alias("why"))


def _below_roots(store: DataFrame) -> DataFrame:
    r = _repo(store).withColumn("is_root", F.col("url") == F.concat(F.lit(_ROOT), "repo"))
    roots = r.where("is_root").groupBy("repo").agg(F.max("id").alias("root"))
    rest = F.expr(f"substring(url, length(repo) + {len(_ROOT) + 2})")
    return r.where("NOT is_root").join(roots, "repo").select("repo", "root", "id", rest.alias("rest"))


FRONT_PAGE = r"(?i)^(?:blob/[^/]+/readme(?:\.[a-z]+)?|tree/[^/]+)$"


def front_pages(store: DataFrame) -> DataFrame:
    """keep (a repository's root), drop (a record of its front page) and why."""
    b = _below_roots(store).where(F.col("rest").rlike(FRONT_PAGE))
    return b.select(F.col("root").alias("keep"), F.col("id").alias("drop"), F.concat("repo", F.lit(" front page, and the repo is already saved")).alias("why"))


def merge_candidates(store: DataFrame) -> DataFrame:
    """Pairs that are one resource, each pair once."""
    both = same_paper(store).withColumn("o", F.lit(0)).unionByName(front_pages(store).withColumn("o", F.lit(1)))
    pair = [F.least("keep", "drop").alias("p"), F.greatest("keep", "drop").alias("q")]
    first = both.select(*pair, F.struct("o", "keep", "drop", "why").alias("c")).groupBy("p", "q").agg(F.min("c").alias("c"))
    return first.select("c.keep", "c.drop", "c.why")


def deep_links(store: DataFrame) -> DataFrame:
    """Links below a saved repository that aren't its front page: repo, root, deep and rest."""
    b = _below_roots(store).where(~F.col("rest").rlike(FRONT_PAGE))
    return b.select("repo", "root", F.col("id").alias("deep"), "rest")


def _with_tokens(store: DataFrame) -> DataFrame:
    tags = F.array_distinct(F.coalesce("tags", F.expr("cast(array() AS array<string>)")))
    return store.select("id", tokens(F.col("title")).alias("tt"), tokens(F.col("description")).alias("dt"), tags.alias("gt"))


def _score(a: str = "a", b: str = "b"):
    pair = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    return content_similarity(pair("tt"), pair("dt"), pair("gt"))


def name_clusters(store: DataFrame) -> DataFrame:
    """name, size, owners and best score of records of one project name under two owners or more, by the merging side's owner rule.

    That rule knows owners on one forge only, so all records of other forges have the same, missing one.
    """
    named = store.select("id", project_name(F.col("url")).alias("name"), F.coalesce(F.substring_index(github_repo(F.col("url")), "/", 1), F.lit("")).alias("owner")).where("name != ''")
    groups = named.groupBy("name").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("owner").alias("owners")).where("size >= 2 AND owners >= 2")
    members = named.join(groups, "name").join(_with_tokens(store), "id")
    # Members of one wording are one, and score against each other what one scores against itself.
    words = ["tt", "dt", "gt"]
    kinds = materialize(members.groupBy("name", *(F.array_sort(c).alias(c) for c in words)).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).withColumn("_r", F.monotonically_increasing_id()))
    x, y = _dealt(kinds, ["name"])
    met = x.alias("a").join(y.alias("b"), ["name", "_x", "_y"]).where("(_x != _y OR a._r < b._r) AND least(a.lo, b.lo) < greatest(a.hi, b.hi)").select("name", _score().alias("score"))
    alone = kinds.where("lo < hi").alias("a").select("name", _score("a", "a").alias("score"))
    best = met.unionAll(alone).groupBy("name").agg(F.max("score").alias("score"))
    return groups.join(best, "name", "left").select("name", "size", "owners", F.coalesce("score", F.lit(0.0)).alias("score"))


def verdicts(clusters: DataFrame, minimum: float = RELATED_MIN) -> DataFrame:
    """Adds corroborated: does wording back the shared name?"""
    return clusters.withColumn("corroborated", F.col("score") >= minimum)


def linkable(store: DataFrame) -> DataFrame:
    """Ids of records that share a name with another owner's, by the browsing side's owner rule, and relate to nothing yet."""
    named = store.select("id", "related", project_name(F.col("url")).alias("name"), owner_of(F.col("url")).alias("owner")).where("name != ''")
    groups = named.groupBy("name").agg(F.countDistinct("owner").alias("owners")).where("owners >= 2").select("name")
    return named.join(groups, "name").where(F.size(F.coalesce("related", F.expr("cast(array() AS array<string>)"))) == 0).select("id")


#: Rows of one key that a task holds against as many.
BLOCK = 2000


def _dealt(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two sides of rows with a number _r, to join by keys, _x and _y: each two rows of a key meet once where _x and _y differ, and twice, as each
    row does itself, where they are equal. Keys of one row meet nothing."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    own = rows.join(sizes, keys).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK)).withColumn("_b", F.pmod(F.xxhash64("_r"), "_blocks"))
    x = own.withColumn("_y", F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1))).withColumnRenamed("_b", "_x")
    y = own.withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b")))).withColumnRenamed("_b", "_y")
    return x.drop("_n", "_blocks"), y.drop("_n", "_blocks")


def _by_rarity(t: DataFrame, column: str) -> DataFrame:
    """_r and a column's tokens, those of the fewest rows first: the same order in all rows."""
    rows = t.select("_r", F.explode(column).alias("tok"))
    df = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    return rows.join(df, "tok").groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o")).select("_r", F.transform("o", lambda x: x["tok"]).alias(f"_{column}"))


#: Up to this many numbers of tags are told apart when rows meet.
FEW_SIZES = 64


def similar_pairs(store: DataFrame, minimum: float = DEEP_MIN, proposed: DataFrame | None = None) -> DataFrame:
    """a, b (ids in order) and score of all pairs of at least ``minimum``, without pairs proposed for merging.

    Pairs are of two kinds, by the Jaccard of their tags. Above 1 / q tags bring the score close, so these meet by their rarest common tag
    together with a word. Of all others the title's or the description's Jaccard must reach ``low``, so these meet by one of the rarest
    words, as many as sets of that Jaccard must share one of, and only if enough words can follow. A pair is scored where it meets by its rarest common
    token, with both rows at hand, so it comes out once. Minima of 0 or less compare all pairs.
    """
    tag = F.transform("gt", lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("")))
    t = materialize(_with_tokens(store).withColumns({"gt": tag, "_r": F.monotonically_increasing_id()}))
    if not minimum > 0:
        if not minimum <= 0:  # not a number: nothing compares
            return t.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score"))
        out = t.alias("a").join(t.alias("b"), F.expr("a.id < b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), _score().alias("score"))
    else:
        out = _similar(t, minimum)
    if proposed is not None:
        out = out.join(proposed.select(F.least("keep", "drop").alias("a"), F.greatest("keep", "drop").alias("b")), ["a", "b"], "left_anti")
    return out


def _similar(t: DataFrame, minimum: float) -> DataFrame:
    own = t.select("_r", "id", "tt", "dt", "gt")
    for c in ("tt", "dt", "gt"):
        own = own.join(_by_rarity(t, c), "_r", "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    # Rows with one set of words in both places have no pair by the description that they lack by the title.
    t = materialize(own.withColumn("_same", F.array_sort("tt") == F.array_sort("dt")))
    other = ~(F.col("a._same") & F.col("b._same"))
    words, tags = WEIGHTS["title"] + WEIGHTS["description"], WEIGHTS["tags"]
    q = max(3, math.ceil(2 * tags / minimum))
    low = (minimum - tags / q) / words - 1e-9
    share = low / (1 + low)
    common = lambda c: F.array_intersect(f"a.{c}", f"b.{c}")
    both = lambda c: F.size(f"a.{c}") + F.size(f"b.{c}")
    reached = lambda c: jaccard(F.col(f"a.{c}"), F.col(f"b.{c}")) >= low
    tagged = F.size(common("gt")) * F.lit(q + 1).cast("long") > both("gt")

    def scored(rows: DataFrame, keys: list[str], *conditions) -> DataFrame:
        x, y = _dealt(rows, keys)
        met = x.alias("a").join(y.alias("b"), [*keys, "_x", "_y"]).where("(_x = _y AND a.id < b.id) OR (_x != _y AND a.id != b.id)")
        for condition in conditions:
            met = met.where(condition)
        return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), _score().alias("score")).where(F.col("score") >= minimum)

    # By a tag: rows of n tags and the place of a tag among them, for each number of tags that a partner may have.
    n = F.size("gt")
    sizes = [r["n"] for r in t.select(n.alias("n")).distinct().limit(FEW_SIZES + 1).collect()]
    tagged_rows = t.select("*", F.posexplode("gt").alias("_p", "_tag"))
    by, of = ["_tag"], F.lit(True)
    if len(sizes) <= FEW_SIZES:
        tagged_rows = tagged_rows.withColumn("_m", F.explode(F.array(*(F.lit(m) for m in sizes))))
        tagged_rows = tagged_rows.where(n - F.col("_p") > F.floor((n + F.col("_m")) / (q + 1))).withColumns({"_lo": F.least(n, "_m"), "_hi": F.greatest(n, "_m")}).drop("_m")
        by, of = [*by, "_lo", "_hi"], both("gt") == F.col("_lo") + F.col("_hi")
    tagged_rows = tagged_rows.drop("_p")
    first = lambda c, tok: F.try_element_at(common(c), F.lit(1)) == F.col(tok)
    none = lambda c: ~F.arrays_overlap(f"a.{c}", f"b.{c}")
    out = [scored(tagged_rows.select("*", F.explode(c).alias("_tok")), [*by, "_tok"], of, *skip, first(c, "_tok"), first("gt", "_tag"), tagged) for c, skip in (("tt", ()), ("dt", (other, none("tt"))))]
    if minimum <= tags + 1e-9:
        out.append(scored(tagged_rows, by, of, none("tt"), none("dt"), first("gt", "_tag"), tagged))
    # By a word.
    for c, skip in (("tt", ()), ("dt", (other, ~reached("tt")))):
        rare = F.slice(F.col(c), F.lit(1), F.greatest(F.lit(0), F.size(c) - F.ceil(low * F.size(c) - 1e-9).cast("int") + 1))
        rows = t.select("*", F.posexplode(rare).alias("_p", "_tok"))
        enough = F.least(F.size(f"a.{c}") - F.col("a._p"), F.size(f"b.{c}") - F.col("b._p")) >= share * both(c) - 1e-6
        out.append(scored(rows, ["_tok"], enough, *skip, first(c, "_tok"), reached(c), ~tagged))
    return functools.reduce(DataFrame.unionAll, out)
