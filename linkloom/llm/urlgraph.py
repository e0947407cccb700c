"""URL filters: host and path rules, and trust that spreads over links between hosts.

Rules decide the pages they fit. Hosts with allowed pages seed a personalised PageRank along the links, hosts with blocked pages a
second one against them (who links to bad hosts is distrusted). Both are scaled by the seeds' share, and a host is blocked
where its distrust outweighs its trust by more than the threshold; other pages take their host's verdict. A host that neither
reaches is allowed.

Links are those of ``href`` and ``src`` to other hosts; many links from one host to another are one weighted edge, counted before
the shuffle, so a host with a third of all pages is one row among the edges' sources. Every few rounds are written to the shared folder.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; null html has no
links; repeated rows repeat their verdict and count as pages of their host; rules of equal length go by name; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import drop_table, materialize

#: (verdict, rule): a host and the start of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Spread:
    damping: float = 0.85
    #: Sum of changes at which the rounds end; damping shrinks the changes by that factor a round, so some 90 rounds settle any graph.
    #: Rounds beyond the bound are an error, not a result.
    settled: float = 1e-6
    most_rounds: int = 500
    #: Rounds from one written table to the next.
    rounds_a_table: int = 5
    #: A host is blocked if distrust / (distrust + trust) exceeds this.
    threshold: float = 0.75
    #: Rules up to this number are broadcast.
    few_rules: int = 100_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_verdict string, rule string")


def with_rules(pages: DataFrame, rules: DataFrame, few: int) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits, from one look-up per host suffix. Distinct addresses are looked up."""
    rules = rules.select("rule", "rule_verdict", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("start"))
    if rules.limit(few + 1).count() <= few:
        rules = F.broadcast(rules)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = pages.select("host", "path").distinct().where("host != ''").select("host", "path", F.explode(suffixes).alias("suffix")).join(rules, "suffix").where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "rule")).alias("r")).select("host", "path", "r.rule", "r.rule_verdict")
    return pages.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and n (links) between different hosts."""
    link = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(link), F.lit(1))
    to = F.translate(F.regexp_replace("d", r"^[^@]*@|:[0-9]*$", ""), UPPER, LOWER)
    edges = pages.select(F.col("host").alias("src"), F.explode(found).alias("d")).select("src", to.alias("dst"))
    return edges.where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def personalised_pagerank(hosts: DataFrame, edges: DataFrame, seed: str, s: Spread) -> DataFrame:
    """host and rank. ``seed``: a column of hosts, how strongly each draws the walk back; edges: src, dst, n."""
    total = hosts.agg(F.sum(seed)).first()[0]
    base = hosts.select("host", (F.col(seed) / total if total else F.lit(0.0)).alias("seed"))
    rank = base.withColumn("rank", F.col("seed"))
    if not total:
        return rank.select("host", "rank")
    base = materialize(base)
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    share = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("w")))
    if share.isEmpty():
        return rank.select("host", "rank")
    # Walks that end at hosts without links go home. Leaving them out scales all ranks alike, so their share is put back at the end.
    rank = materialize(rank)
    for turn in range(0, s.most_rounds, s.rounds_a_table):
        new = rank
        for _ in range(s.rounds_a_table):
            given = share.join(new.select(F.col("host").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("w")).alias("in"))
            new = base.join(given, "host", "left").select("host", "seed", ((1 - s.damping) * F.col("seed") + s.damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        new = materialize(new.join(rank.select("host", F.col("rank").alias("old")), "host"))
        change, total = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.sum("rank")).first()
        drop_table(rank)
        rank = new.select("host", "seed", "rank")
        if change < s.settled:
            return rank.select("host", (F.col("rank") / total).alias("rank"))
    raise RuntimeError(f"ranks not settled after {s.most_rounds} rounds")


def host_scores(ruled: DataFrame, edges: DataFrame, s: Spread) -> DataFrame:
    """host, trust and distrust of every host that has pages or is linked; if nothing spreads, its shares of allowed and blocked pages."""
    own = ruled.where("host != ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"), F.count(F.lit(1)).alias("n"))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = own.join(linked, "host", "full_outer").select("host", *(F.coalesce(F.col(c) / F.col("n"), F.lit(0.0)).alias(c) for c in ("good", "bad")))
    hosts = materialize(hosts)
    n_good, n_bad = hosts.agg(F.sum("good"), F.sum("bad")).first()
    trust = personalised_pagerank(hosts, edges, "good", s).select("host", (F.col("rank") * F.lit(float(n_good or 0.0))).alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_pagerank(hosts, back, "bad", s).select("host", (F.col("rank") * F.lit(float(n_bad or 0.0))).alias("distrust"))
    return materialize(trust.join(distrust, "host"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame | None = None, s: Spread | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    s = s or Spread()
    rules = RULES if rules is None else rules
    rules = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    place = [host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")]
    ruled = materialize(with_rules(pages.select("page_id", *place), rules, s.few_rules))
    scores = host_scores(ruled, materialize(host_edges(pages.select(place[0], "html"))), s)
    bad = F.col("distrust") > s.threshold * (F.col("distrust") + F.col("trust"))
    out = ruled.join(scores, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
