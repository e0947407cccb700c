"""Record schema, taxonomy and rule tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "ref", "at")])
META = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("siteName", "author", "published")]
    + [T.StructField("durationSec", T.LongType()), T.StructField("language", T.StringType()), T.StructField("stars", T.LongType())]
)
ENRICHED = T.StructType([T.StructField("at", T.StringType()), T.StructField("by", T.StringType())])
RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "url", "kind", "title", "description")]
    + [T.StructField("groups", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType()))]
    + [T.StructField("starred", T.BooleanType()), T.StructField("notes", T.StringType())]
    + [T.StructField("sources", T.ArrayType(SOURCE)), T.StructField("meta", META)]
    + [T.StructField("related", T.ArrayType(T.StringType())), T.StructField("mergedFrom", T.ArrayType(T.StringType()))]
    + [T.StructField("enriched", ENRICHED), T.StructField("addedAt", T.StringType()), T.StructField("updatedAt", T.StringType())]
)
INBOX = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "context", "channel", "ts")])
STARRED_REPO = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("full_name", "html_url", "description")]
    + [T.StructField("topics", T.ArrayType(T.StringType())), T.StructField("language", T.StringType())]
    + [T.StructField("stargazers_count", T.LongType()), T.StructField("pushed_at", T.StringType()), T.StructField("owner", T.StringType())]
)
REPLY = T.ArrayType(
    T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("description", T.StringType())]
        + [T.StructField("groups", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType()))]
    )
)

# Kinds, authors of an enrichment, and the closed vocabulary of groups with its limits.
KINDS = ["web", "pdf", "doc", "video", "playlist", "audio", "repo", "local"]
ENRICHED_BY = ["claude", "scrape", "human", "none"]
GROUPS = [
    "AI/ML", "Agents & Tooling", "Systems & Infrastructure", "Programming Languages", "Web & Frontend", "Data & Databases", "Security", "DevOps & Cloud",
    "Product & Design", "Business & Strategy", "Career & Learning", "Science", "Media & Talks", "Tools & Utilities", "Personal",
]


@dataclass(frozen=True)
class Taxonomy:
    groups: list[str] = field(default_factory=lambda: list(GROUPS))
    max_groups: int = 3
    max_tags: int = 8
    max_description: int = 160


# A language that hints at a group, and topics that are no tags.
LANGUAGE_HINT = {"Rust": "Programming Languages", "Zig": "Programming Languages", "Haskell": "Programming Languages", "OCaml": "Programming Languages", "Elixir": "Programming Languages"}
TAG_NOISE = ["awesome", "awesome-list", "awesome-lists", "hacktoberfest", "open-source", "opensource", "github", "list", "lists", "collection", "resources", "free", "community", "library", "framework"]

def own_words(group: str) -> list[str]:
    """Signals that a group's name gives by itself: its words, in the singular too, and all of them joined by hyphens."""
    words = re.findall("[a-z]+", group.lower())
    short = [w[:-3] + "y" if w.endswith("ies") else w if w.endswith(("ss", "ops")) else w.removesuffix("s") for w in words if len(w) > 3]
    return list(dict.fromkeys([*words, *short, "-".join(words)]))


#: Signals by group that classification starts from. Rule tables are a parameter, read from a file of any size by
#: ``sources.store.load_rules``: a collection brings its own.
RULES = {g: own_words(g) for g in GROUPS}
