"""Rule-table classification: explode signals, join the rules, sum, keep the best groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import classifier_words
from linkloom.schema import LANGUAGE_HINT, RULES

#: Rule tables up to this number of rows are broadcast.
FEW_RULES = 100_000


def rule_table(spark: SparkSession, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """signal and grp, a row per signal of each group."""
    rows = [(s, g) for g, signals in (rules or RULES).items() for s in signals]
    return spark.createDataFrame(rows, "signal string, grp string")


def classify(records: DataFrame, rules: DataFrame, key: str = "id", max_groups: int = 3, min_score: int = 2) -> DataFrame:
    """key, groups (best first) and confident of every row of records(key, title, description, topics, language).

    A topic counts 3 for each group it implies, repetitions too, a distinct word of title or description 1, and the
    language 1 where something else matched. Groups of less than min_score are no groups.
    """
    low = F.transform(F.coalesce("topics", F.expr("cast(array() AS array<string>)")), lambda t: F.lower(F.coalesce(t, F.lit(""))))
    signals = F.concat(
        F.transform(low, lambda t: F.struct(t.alias("signal"), F.lit(3).alias("n"))), F.transform(classifier_words(F.col("title"), F.col("description")), lambda w: F.struct(w.alias("signal"), F.lit(1).alias("n")))
    )
    hint: Column = F.lit(None).cast("string")
    for language, group in LANGUAGE_HINT.items():
        hint = F.when(F.col("language") == language, group).otherwise(hint)
    hits = records.select(key, hint.alias("hint"), F.explode(signals).alias("s")).select(key, "hint", "s.signal", "s.n")
    side = F.broadcast(rules) if rules.limit(FEW_RULES + 1).count() <= FEW_RULES else rules
    score = hits.join(side, "signal").groupBy(key, "hint", "grp").agg(F.sum("n").alias("n"))
    per = score.groupBy(key, "hint").agg(F.collect_list(F.struct("grp", "n")).alias("s"))
    bumped = F.when(F.col("hint").isNull(), F.col("s")).otherwise(
        F.concat(
            F.transform("s", lambda x: F.struct(x["grp"].alias("grp"), (x["n"] + (x["grp"] == F.col("hint")).cast("long")).alias("n"))),
            F.when(F.exists("s", lambda x: x["grp"] == F.col("hint")), F.expr("cast(array() AS array<struct<grp:string,n:bigint>>)")).otherwise(F.array(F.struct(F.col("hint").alias("grp"), F.lit(1).cast("long").alias("n")))),
        )
    )
    ranked = F.array_sort(F.transform(F.filter(bumped, lambda x: x["n"] >= min_score), lambda x: F.struct((-x["n"]).alias("n"), F.lower(x["grp"]).alias("o"), x["grp"].alias("grp"))))
    best = per.select(key, F.transform(F.slice(ranked, 1, max_groups), lambda x: x["grp"]).alias("groups"))
    none = F.expr("cast(array() AS array<string>)")
    out = records.select(key).join(best, key, "left").select(key, F.coalesce("groups", none).alias("groups"))
    return out.withColumn("confident", F.size("groups") > 0)
