"""Constraints on a collection: one row (id, msg) per violation, in no particular order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import utf16_length
from linkloom.functions.urls import canonical_url, link_id
from linkloom.schema import ENRICHED_BY, KINDS, Taxonomy


def violations(store: DataFrame, taxonomy: Taxonomy | None = None, order: str = "_ord") -> DataFrame:
    """store: record columns and the place of each record in its file.

    Wrong types read as null under the schema, so a null in a required column is reported as a wrong type.
    """
    t = taxonomy or Taxonomy()
    r = store.withColumns({"_canon": canonical_url(F.col("url")), "_who": F.coalesce("id", F.lit("(missing id)"))})
    row = lambda cond, msg: F.when(cond, msg)
    n = F.format_string
    distinct = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    listed = lambda c: F.coalesce(F.col(c).isNotNull(), F.lit(False))
    allowed = F.array(*map(F.lit, t.groups)) if t.groups else F.expr("cast(array() AS array<string>)")
    checks: list[Column] = [
        row(~F.coalesce(F.col("id").rlike("^b_[0-9a-f]{8}$"), F.lit(False)), F.lit("malformed id")),
        row(F.coalesce("url", F.lit("")) == "", F.lit("missing url")),
        row(F.col("_canon") != F.col("url"), F.concat(F.lit("url is not canonical (should be "), "_canon", F.lit(")"))),
        row((F.col("url") != "") & ~link_id(F.col("_canon")).eqNullSafe(F.col("id")), F.lit("id does not match its url")),
        row(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), F.concat(F.lit('unknown kind "'), F.coalesce("kind", F.lit("undefined")), F.lit('"'))),
        row(~listed("groups"), F.lit("groups is not an array")),
        row(F.size("groups") > t.max_groups, n(f"%d groups > {t.max_groups}", F.size("groups"))),
        row(distinct(F.col("groups")), F.lit("duplicate groups")),
        row(~listed("tags"), F.lit("tags is not an array")),
        row(F.size("tags") > t.max_tags, n(f"%d tags > {t.max_tags}", F.size("tags"))),
        row(distinct(F.col("tags")), F.lit("duplicate tags")),
        row(F.col("description").isNull(), F.lit("description is not a string")),
        row(utf16_length(F.col("description")) > t.max_description, n(f"description %d chars > {t.max_description}", utf16_length(F.col("description")))),
        row(F.col("starred").isNull(), F.lit("starred is not a boolean")),
        row(F.col("notes").isNull(), F.lit("notes is not a string")),
        row(F.col("sources").isNull(), F.lit("sources is not an array")),
        row(~F.coalesce(F.col("enriched.by").isin(ENRICHED_BY), F.lit(False)), F.concat(F.lit('unknown enriched.by "'), F.coalesce("enriched.by", F.lit("undefined")), F.lit('"'))),
        row(distinct(F.col("mergedFrom")), F.lit("duplicate mergedFrom urls")),
        row(F.col("related").isNull(), F.lit("related is not an array")),
    ]
    many: list[Column] = [
        F.transform(F.filter("groups", lambda g: ~F.array_contains(allowed, g)), lambda g: F.concat(F.lit('group "'), g, F.lit('" not in taxonomy'))),
        F.transform(F.filter("tags", lambda x: x != F.lower(x)), lambda x: F.concat(F.lit('tag "'), x, F.lit('" is not lowercase'))),
        F.transform(F.filter("mergedFrom", lambda u: u.isNull() | (u == "")), lambda _: F.lit("mergedFrom holds a non-string")),
        F.transform(F.filter("mergedFrom", lambda u: u == F.col("url")), lambda _: F.lit("mergedFrom lists this record's own url")),
        F.transform(F.filter("related", lambda x: x == F.col("id")), lambda _: F.lit("related to itself")),
    ]
    none = F.expr("cast(array() AS array<string>)")
    found = F.concat(F.array_compact(F.array(*checks)), *(F.coalesce(m, none) for m in many))
    per_row = r.select("_who", found.alias("_found")).select(F.col("_who").alias("id"), F.explode("_found").alias("msg"))

    # Second and later records of one id or canonical address, both from one pass over the store.
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"), F.lit("undefined"))
    fact = lambda label, key, other: F.struct(F.lit(label).alias("label"), F.coalesce(key, F.lit("")).alias("key"), other.alias("other"))
    facts = F.array(fact("id", F.col("id"), title), fact("canonical url", F.col("_canon"), F.coalesce("id", F.lit("undefined"))))
    same = Window.partitionBy("label", "key").orderBy(order)
    seen = r.select("_who", order, F.inline(facts)).where("key != ''").withColumns({"prev": F.lag("other").over(same), "k": F.row_number().over(same)})
    repeated = seen.where("k > 1").select(F.col("_who").alias("id"), F.concat(F.lit("duplicate "), "label", F.lit(" (also "), "prev", F.lit(")")).alias("msg"))

    rel = r.select(F.col("_who").alias("id"), F.explode("related").alias("rel"))
    dangling = rel.join(r.select(F.col("id").alias("rel")).distinct(), "rel", "left_anti").select("id", F.concat(F.lit("related id "), "rel", F.lit(" does not resolve")).alias("msg"))
    # Sorted by id: the place of each record among its neighbours, not a sort of the whole store.
    bounds = r.select(F.col(order).alias("o"), F.coalesce("id", F.lit("undefined")).alias("i")).repartitionByRange("o").sortWithinPartitions("o")
    bounds = bounds.withColumn("p", F.spark_partition_id())
    w = Window.partitionBy("p").orderBy("o")
    inside = bounds.withColumn("prev", F.lag("i").over(w)).agg(F.max(F.coalesce(F.col("i") < F.col("prev"), F.lit(False))).alias("bad"))
    ends = bounds.groupBy("p").agg(F.min_by("i", "o").alias("first"), F.max_by("i", "o").alias("last"))  # a row per partition
    across = ends.withColumn("prev", F.lag("last").over(Window.orderBy("p"))).agg(F.max(F.coalesce(F.col("first") < F.col("prev"), F.lit(False))).alias("bad"))
    unsorted = inside.unionAll(across).agg(F.max("bad").alias("bad")).where("bad").select(F.lit("").alias("id"), F.lit("store is not sorted by id").alias("msg"))
    rows = [per_row, repeated, dangling, unsorted]
    if "Unsorted" in t.groups:
        rows.append(store.sparkSession.createDataFrame([("taxonomy", 'contains "Unsorted"; ungrouped is an empty list')], "id string, msg string"))
    return reduce(DataFrame.unionByName, rows)


def summary(store: DataFrame) -> DataFrame:
    """One row: records, ungrouped (number and percent to one place), undescribed, related, merged."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.expr("cast(array() AS array<string>)")))
    total, bare = F.count(F.lit(1)), F.count_if(size("groups") == 0)
    return store.agg(
        total.alias("records"),
        bare.alias("ungrouped"),
        F.when(total > 0, F.round(100.0 * bare / F.greatest(total, F.lit(1)), 1)).otherwise(0.0).alias("ungrouped_pct"),
        F.count_if(F.coalesce("description", F.lit("")) == "").alias("undescribed"),
        F.count_if(size("related") > 0).alias("related"),
        F.count_if(size("mergedFrom") > 0).alias("merged"),
    )
