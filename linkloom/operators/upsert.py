"""Idempotent upsert, pair merge and relation of records.

Existing records win on every field a person may have touched. Folding incoming records one after another equals one pass over them
in order: unions capped after each step keep the same prefix as one capped union, and scalar fields take the first that
isn't empty. Only where nothing was merged the seed's arrays stay uncapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical_url, link_id
from linkloom.schema import ENRICHED, META, RECORD, SOURCE, Taxonomy


def _array(kind: str = "string") -> Column:
    return F.expr(f"cast(array() AS array<{kind}>)")


def uniq(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def dedupe_sources(c: Column) -> Column:
    """The first source of each type and ref."""
    key = lambda s: F.concat(F.coalesce(s["type"], F.lit("undefined")), F.lit(" "), F.coalesce(s["ref"], F.lit("")))
    keys = F.transform(c, key)
    return F.filter(c, lambda s, i: F.array_position(keys, key(s)) == i + 1)


def new_records(rows: DataFrame, now: str) -> DataFrame:
    """Full records of rows(url, kind, title, description, groups, tags, meta, source); absent columns take defaults."""
    have = set(rows.columns)
    get = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    canonical = canonical_url(F.col("url"))
    source = F.col("source") if "source" in have else F.lit(None).cast(SOURCE)
    stamped = F.struct(source["type"].alias("type"), source["ref"].alias("ref"), F.coalesce(source["at"], F.lit(now)).alias("at"))
    meta = F.col("meta") if "meta" in have else F.lit(None).cast(META)
    carried = [c for c in rows.columns if c.startswith("_")]
    return rows.select(
        *carried,
        link_id(canonical).alias("id"),
        canonical.alias("url"),
        get("kind", F.lit("web")).alias("kind"),
        get("title", F.lit("")).alias("title"),
        get("description", F.lit("")).alias("description"),
        get("groups", _array()).alias("groups"),
        uniq(get("tags", _array())).alias("tags"),
        F.lit(False).alias("starred"),
        F.lit("").alias("notes"),
        F.when(source.isNull(), _array("struct<type:string,ref:string,at:string>")).otherwise(F.array(stamped)).alias("sources"),
        meta.cast(META).alias("meta"),
        _array().alias("related"),
        F.lit(None).cast("array<string>").alias("mergedFrom"),
        F.struct(F.lit(None).cast("string").alias("at"), F.lit("none").alias("by")).cast(ENRICHED).alias("enriched"),
        F.lit(now).alias("addedAt"),
        F.lit(now).alias("updatedAt"),
    )


def _first(c: str, rows: Column) -> Column:
    """First value of a field that isn't empty, else the first value."""
    found = F.filter(rows, lambda r: r[c].isNotNull() & (r[c] != ""))
    return F.coalesce(F.try_element_at(found, F.lit(1))[c], F.element_at(rows, 1)[c])


def _first_given(rows: Column, c: str) -> Column:
    """First value of a field of meta that is there; absent and null are one."""
    return F.try_element_at(F.filter(F.transform(rows, lambda x: x["meta"][c]), lambda v: v.isNotNull()), F.lit(1))


#: Incoming rows whose sightings of one id are condensed together before those of different chunks meet.
CHUNK = 4096


def _folded(both: DataFrame, keys: list[str], now: str, t: Taxonomy | None) -> DataFrame:
    """keys, o (least order), n (rows) and r (record) of rows (keys, o, n, r) folded in order; without a taxonomy nothing is capped."""
    names = RECORD.fieldNames()
    rows = both.groupBy(*keys).agg(F.min("o").alias("o"), F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("o", F.to_json("r").alias("j"), "r"))), lambda x: x["r"]).alias("rows"))
    r = F.col("rows")
    seed, merged = F.element_at(r, 1), F.col("n") > 1
    union = lambda c: uniq(F.flatten(F.transform(r, lambda x: F.coalesce(x[c], _array()))))
    cap = lambda c, n: F.slice(c, 1, n) if t else c
    human = F.coalesce(seed["enriched"]["by"] == "human", F.lit(False))
    sources = F.flatten(F.transform(r, lambda x: F.coalesce(x["sources"], _array("struct<type:string,ref:string,at:string>"))))
    out = {
        "kind": _first("kind", r),
        "title": _first("title", r),
        "description": F.when(human, seed["description"]).otherwise(_first("description", r)),
        "groups": cap(union("groups"), t.max_groups if t else 0),
        "tags": cap(union("tags"), t.max_tags if t else 0),
        "sources": dedupe_sources(sources),
        "meta": F.struct(*(_first_given(r, c).alias(c) for c in META.fieldNames())),
        "related": union("related"),
        "updatedAt": F.lit(now),
    }
    return rows.select(*keys, "o", "n", F.struct(*(F.when(merged, out[c]).otherwise(seed[c]).alias(c) if c in out else seed[c].alias(c) for c in names)).alias("r"))


def upsert(store: DataFrame, incoming: DataFrame, now: str, taxonomy: Taxonomy | None = None, order: str = "_ord") -> DataFrame:
    """The store with incoming records (columns of RECORD and their order) folded in by id.

    Sightings are condensed by id and chunk of the order first, so one address in a third of all rows doesn't meet in one task uncondensed.
    """
    rec = F.struct(*RECORD.fieldNames())
    chunks = incoming.select("id", F.floor(F.col(order) / CHUNK).alias("c"), F.col(order).cast("long").alias("o"), F.lit(1).cast("long").alias("n"), rec.alias("r"))
    condensed = _folded(chunks, ["id", "c"], now, None).select("id", "o", "n", "r")
    both = store.select("id", F.lit(-(2**62)).cast("long").alias("o"), F.lit(1).cast("long").alias("n"), rec.alias("r")).unionAll(condensed)
    return _folded(both, ["id"], now, taxonomy or Taxonomy()).select("r.*")


def upsert_counts(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """added (new ids) and merged (all other incoming rows)."""
    n = incoming.agg(F.count(F.lit(1)).alias("n"))
    new = incoming.select("id").distinct().join(store.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("added"))
    return n.crossJoin(new).select("added", (F.col("n") - F.col("added")).alias("merged"))  # one row each


def older(a: Column, b: Column) -> Column:
    """The lesser text; a missing one counts as the oldest."""
    return F.when(F.coalesce(a, F.lit("")) <= F.coalesce(b, F.lit("")), a).otherwise(b)


def merge_pairs(store: DataFrame, pairs: DataFrame, now: str, taxonomy: Taxonomy | None = None) -> DataFrame:
    """The survivors of pairs (keep, drop) of ids: drop folded into keep. Unknown ids and pairs of one id give nothing."""
    t = taxonomy or Taxonomy()
    names = RECORD.fieldNames()
    rec = F.struct(*names)
    j = pairs.where("keep != drop").join(store.select(F.col("id").alias("keep"), rec.alias("k")), "keep").join(store.select(F.col("id").alias("drop"), rec.alias("d")), "drop")
    k, d = F.col("k"), F.col("d")
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    fill = lambda c: F.coalesce(F.nullif(k[c], F.lit("")), d[c])
    both = lambda c, kind="string": F.concat(F.coalesce(k[c], _array(kind)), F.coalesce(d[c], _array(kind)))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    notes = F.concat_ws("\n\n", F.when(has(k["notes"]), trim(k["notes"])), F.when(has(d["notes"]), F.concat(F.lit("## from "), d["url"], F.lit("\n\n"), trim(d["notes"]))))
    out = {
        "title": fill("title"),
        "description": fill("description"),
        "groups": F.slice(uniq(both("groups")), 1, t.max_groups),
        "tags": F.slice(uniq(both("tags")), 1, t.max_tags),
        "starred": F.coalesce(k["starred"], F.lit(False)) | F.coalesce(d["starred"], F.lit(False)),
        "notes": notes,
        "sources": dedupe_sources(both("sources", "struct<type:string,ref:string,at:string>")),
        "related": F.filter(uniq(both("related")), lambda x: (x != k["id"]) & (x != d["id"])),
        "mergedFrom": uniq(F.concat(both("mergedFrom"), F.array(d["url"]))),
        "meta": F.struct(*(F.coalesce(k["meta"][c], d["meta"][c]).alias(c) for c in META.fieldNames())),
        "addedAt": older(k["addedAt"], d["addedAt"]),
        "updatedAt": F.lit(now),
    }
    return j.select(*(out.get(c, k[c]).alias(c) for c in names))


def repair_pointers(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records whose related list names a dropped id name the survivor instead, once, and never themselves."""
    links = store.select("id", F.posexplode("related").alias("pos", "rel")).join(pairs.select(F.col("drop").alias("rel"), F.col("keep").alias("to")), "rel", "left")
    fixed = links.groupBy("id").agg(F.count("to").alias("n"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("to", "rel").alias("rel")))).alias("rel"))
    fixed = fixed.where("n > 0").select("id", F.array_distinct(F.filter(F.transform("rel", lambda x: x["rel"]), lambda x: x != F.col("id"))).alias("_fixed"))
    return store.join(fixed, "id", "left").select(*(F.coalesce("_fixed", "related").alias("related") if c == "related" else F.col(c) for c in RECORD.fieldNames()))


def apply_merges(store: DataFrame, pairs: DataFrame, now: str, taxonomy: Taxonomy | None = None) -> DataFrame:
    """The store after merging disjoint pairs (keep, drop): survivors folded, dropped records gone, pointers repaired."""
    ids = store.select("id")
    valid = pairs.where("keep != drop").join(ids.withColumnRenamed("id", "keep"), "keep", "left_semi").join(ids.withColumnRenamed("id", "drop"), "drop", "left_semi")
    gone = valid.select(F.explode(F.array("keep", "drop")).alias("id"))
    rest = repair_pointers(store.join(gone, "id", "left_anti"), valid)
    return rest.unionByName(merge_pairs(store, valid, now, taxonomy))


def relate(store: DataFrame, pairs: DataFrame, now: str) -> DataFrame:
    """The store with symmetric links between pairs (a, b) of known ids; a record never relates to itself."""
    ids = store.select("id")
    valid = pairs.where("a != b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    ends = valid.select(F.col("a").alias("id"), F.col("b").alias("o")).unionAll(valid.select(F.col("b").alias("id"), F.col("a").alias("o")))
    add = ends.groupBy("id").agg(F.array_sort(F.collect_set("o")).alias("_add"))
    j = store.join(add, "id", "left")
    related = F.filter(uniq(F.concat(F.coalesce("related", _array()), F.coalesce("_add", _array()))), lambda x: x != F.col("id"))
    own = {"related": F.when(F.col("_add").isNull(), F.col("related")).otherwise(related), "updatedAt": F.when(F.col("_add").isNull(), F.col("updatedAt")).otherwise(F.lit(now))}
    return j.select(*(own.get(c, F.col(c)).alias(c) for c in RECORD.fieldNames()))
