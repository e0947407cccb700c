"""Faceted search: a query state that turns a record table into rows, facet counts and tallies."""

from __future__ import annotations

from dataclasses import dataclass, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.resolve import linkable
from linkloom.schema import Taxonomy

UNFILED = " unfiled"
BUCKETS = ("unfiled", "undescribed", "linkable")
SORTS = ("stars", "recent", "updated", "title")
PAGE, TOP_TAGS = 60, 26


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("cast(array() AS array<string>)"))


def prepared(store: DataFrame) -> DataFrame:
    """The store with hay (what text search looks in) and is_linkable, for many queries."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "notes", "url")]
    hay = F.lower(F.concat_ws(" ", *text, F.array_join(_list("tags"), " "), F.array_join(_list("groups"), " ")))
    ids = linkable(store).withColumn("_l", F.lit(True))
    return store.join(ids, "id", "left").withColumn("is_linkable", F.coalesce("_l", F.lit(False))).drop("_l").withColumn("hay", hay)


def bucket_test(name: str) -> Column:
    return {"unfiled": F.size(_list("groups")) == 0, "undescribed": F.coalesce("description", F.lit("")) == "", "linkable": F.col("is_linkable")}[name]


def row_state() -> Column:
    return F.when(bucket_test("unfiled") | bucket_test("undescribed"), "open").when(F.col("is_linkable"), "dup").otherwise("settled")


@dataclass(frozen=True)
class BrowseQuery:
    q: str = ""
    groups: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    bucket: str = ""
    mode: str = "any"
    sort: str = "stars"
    shown: int = PAGE

    @classmethod
    def from_params(cls, search: str) -> BrowseQuery:
        """From a query string; unknown buckets, modes and sorts fall back to their defaults."""
        pairs = parse_qsl(search.removeprefix("?"), keep_blank_values=True)
        first = lambda k: next((v for n, v in pairs if n == k), "")
        every = lambda k: tuple(dict.fromkeys(v for n, v in pairs if n == k))
        return cls(
            first("q"), every("g"), every("kind"), every("tag"), first("todo") if first("todo") in BUCKETS else "", "all" if first("mode") == "all" else "any", first("sort") if first("sort") in SORTS else "stars"
        )

    def to_params(self) -> str:
        pairs = [("q", self.q)] * bool(self.q) + [("g", g) for g in self.groups] + [("tag", t) for t in self.tags] + [("kind", k) for k in self.kinds]
        pairs += [("todo", self.bucket)] * bool(self.bucket) + [("mode", "all")] * (self.mode == "all") + [("sort", self.sort)] * (self.sort != "stars")
        return urlencode(pairs)

    # Filters, one per dimension.

    def _bucket(self) -> Column:
        return bucket_test(self.bucket) if self.bucket else F.lit(True)

    def _groups(self) -> Column:
        if not self.groups:
            return F.lit(True)
        mine, named = _list("groups"), [g for g in self.groups if g != UNFILED]
        empty = F.size(mine) == 0
        if not named:
            return empty
        want = F.array(*map(F.lit, named))
        hit = F.size(F.array_except(want, mine)) == 0 if self.mode == "all" else F.arrays_overlap(want, mine)
        return hit | empty if UNFILED in self.groups else hit

    def _kinds(self) -> Column:
        return F.coalesce(F.col("kind").isin(list(self.kinds)), F.lit(False)) if self.kinds else F.lit(True)

    def _tags(self) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, self.tags)), _list("tags"))) == 0 if self.tags else F.lit(True)

    def _text(self) -> Column:
        out = F.lit(True)
        for term in self.q.lower().split():
            out = out & F.col("hay").contains(term)
        return out

    def matches(self) -> Column:
        return self._bucket() & self._groups() & self._kinds() & self._tags() & self._text()

    def order(self) -> list[Column]:
        title, ident = F.collate(F.coalesce("title", F.lit("")), "UNICODE"), F.col("id")
        return {
            "stars": [F.coalesce("meta.stars", F.lit(-1)).desc(), ident],
            "recent": [F.coalesce("addedAt", F.lit("")).desc(), title, ident],
            "updated": [F.coalesce("meta.published", F.lit("")).desc(), ident],
            "title": [title, ident],
        }[self.sort]

    def rows(self, view: DataFrame) -> DataFrame:
        """The shown rows in order; filters reach the scan, and the limit makes it a top-k."""
        return view.where(self.matches()).orderBy(*self.order()).limit(self.shown)

    def counted(self, view: DataFrame) -> DataFrame:
        """dim, value and n of all facets in one scan: each within what all other dimensions' filters leave."""
        own = {"groups": self._kinds() & self._tags(), "kinds": self._groups() & self._tags(), "tags": self._groups() & self._kinds()}
        values = {"groups": F.when(F.size(_list("groups")) == 0, F.array(F.lit(UNFILED))).otherwise(_list("groups")), "kinds": F.array("kind"), "tags": _list("tags")}
        none = F.expr("cast(array() AS array<struct<dim:string,value:string>>)")
        cells = [F.when(own[d], _cells(d, values[d])).otherwise(none) for d in own]
        return view.where(self._bucket() & self._text()).select("id", F.explode(F.concat(*cells)).alias("c")).groupBy("c.dim", "c.value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))

    def facets(self, view: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
        """dim, place, value and n, in the order of display: all groups, unfiled last; kinds; the top tags, before them selected ones outside."""
        t = taxonomy or Taxonomy()
        spark = view.sparkSession
        counts = self.counted(view).persist()
        names = spark.createDataFrame([(g, 0) for g in t.groups] + [(UNFILED, 1)], "value string, last int")
        groups = names.join(counts.where("dim = 'groups'").select("value", "n"), "value", "left").select(F.lit("groups").alias("dim"), "value", F.coalesce("n", F.lit(0)).alias("n"), "last")
        w = lambda *o: F.row_number().over(Window.partitionBy("dim").orderBy(*o))
        groups = groups.withColumn("place", w("last", F.desc("n"), F.collate("value", "UNICODE"))).select("dim", "place", "value", "n")
        kinds = counts.where("dim = 'kinds'").withColumn("place", w(F.desc("n"), "first")).select("dim", "place", "value", "n")
        tags = counts.where("dim = 'tags'").orderBy(F.desc("n"), F.collate("value", "UNICODE")).limit(TOP_TAGS).withColumn("place", w(F.desc("n"), F.collate("value", "UNICODE"))).select("dim", "place", "value", "n")
        out = groups.unionAll(kinds).unionAll(tags)
        if self.tags:
            chosen = spark.createDataFrame([(v, -i) for i, v in enumerate(self.tags)], "value string, place int")
            extra = chosen.join(tags.select("value"), "value", "left_anti").join(counts.where("dim = 'tags'").select("value", "n"), "value", "left")
            out = out.unionAll(extra.select(F.lit("tags").alias("dim"), "place", "value", F.coalesce("n", F.lit(0)).alias("n")))
        return out

    def position(self, view: DataFrame, ident: str) -> tuple[BrowseQuery, int]:
        """A query that shows a record: filters are cleared if they hide it, and paging reaches its place (from 0; -1 if it doesn't exist)."""
        query = self if not view.where((F.col("id") == ident) & self.matches()).isEmpty() else BrowseQuery(sort=self.sort)
        own = view.where(F.col("id") == ident).select(F.struct(*_keys(query)).alias("k")).limit(1)
        ahead = view.where(query.matches()).select(F.struct(*_keys(query)).alias("o")).crossJoin(F.broadcast(own))  # one row
        if own.isEmpty():
            return query, -1
        place = ahead.where("o < k").count()
        return replace(query, shown=max(query.shown, (place // PAGE + 1) * PAGE)), place


def _keys(query: BrowseQuery) -> list[Column]:
    """The order as ascending keys: numbers negated, texts that sort downwards by the complement of their code points."""
    title = F.collate(F.coalesce("title", F.lit("")), "UNICODE").alias("t")
    down = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), "0123456789", "9876543210").alias("d")  # noqa: E731  ISO dates
    return {
        "stars": [(-F.coalesce("meta.stars", F.lit(-1))).alias("s"), F.col("id")],
        "recent": [(F.coalesce("addedAt", F.lit("")) == "").alias("e"), down("addedAt"), title, F.col("id")],
        "updated": [(F.coalesce("meta.published", F.lit("")) == "").alias("e"), down("meta.published"), F.col("id")],
        "title": [title, F.col("id")],
    }[query.sort]


def _cells(dim: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(dim).alias("dim"), v.alias("value")))


def bucket_tallies(view: DataFrame) -> DataFrame:
    return view.agg(*(F.count_if(bucket_test(b)).alias(b) for b in BUCKETS))


def header_tally(view: DataFrame) -> DataFrame:
    return view.agg(F.count(F.lit(1)).alias("total"), F.count_if(row_state() == "open").alias("open"), F.count_if(F.coalesce("starred", F.lit(False))).alias("starred"))


def paired(page: DataFrame) -> DataFrame:
    """The shown page grouped by project name, or id where there is none."""
    from linkloom.functions.urls import project_name

    name = F.coalesce(F.nullif(project_name(F.col("url")), F.lit("")), F.col("id"))
    return page.select(name.alias("name"), "id").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def related_rows(store: DataFrame, ident: str) -> DataFrame:
    """Records that one relates to, in its order; unresolved ids are dropped."""
    want = store.where(F.col("id") == ident).select(F.posexplode("related").alias("place", "id"))
    return store.join(F.broadcast(want), "id").orderBy("place").drop("place")  # one record's list


def row_label() -> Column:
    """kind / language / stars / host."""
    from linkloom.functions.text import compact_count
    from linkloom.functions.urls import host_of

    stars = F.when(F.col("meta.stars").isNotNull(), compact_count(F.col("meta.stars")))
    return F.concat_ws(" / ", F.col("kind"), F.nullif(F.col("meta.language"), F.lit("")), stars, F.nullif(host_of(F.col("url")), F.lit("")))
