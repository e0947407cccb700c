"""Edits: coalesced per record and field, applied to the freshest copy, committed if its version still holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.schema import RECORD
from linkloom.sources.store import Conflict, VersionedStore

FIELDS = {"starred": "boolean", "notes": "string", "groups": "array<string>"}
ATTEMPTS = 3


def coalesce_patches(patches: DataFrame) -> DataFrame:
    """One row per id from patches(id, seq, starred, notes, groups): of each field the last that was given (not null)."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in FIELDS]
    return patches.groupBy("id").agg(*last, F.max("seq").alias("seq"))


def apply_patches(store: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """The store with coalesced patches on it. Unknown ids are skipped; notes or groups make a record human-edited, a star doesn't."""
    p = patches.select("id", *(F.col(c).alias(f"_{c}") for c in FIELDS), F.lit(True).alias("_hit"))
    j = store.join(p, "id", "left")
    human = F.col("_notes").isNotNull() | F.col("_groups").isNotNull()
    own = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in FIELDS}
    own |= {
        "enriched": F.when(human, F.struct(F.col("enriched.at").alias("at"), F.lit("human").alias("by"))).otherwise(F.col("enriched")),
        "updatedAt": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updatedAt")),
    }
    return j.select(*(own.get(c, F.col(c)).alias(c) for c in RECORD.fieldNames()))


def commit(store: VersionedStore, patches: DataFrame, now: Callable[[], str]) -> int:
    """Writes patches onto the freshest version, up to three attempts where others commit meanwhile; returns the new version."""
    for attempt in range(ATTEMPTS):
        version, current = store.read()
        try:
            return store.write(apply_patches(current, coalesce_patches(patches), now()), version)
        except Conflict:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError


def toggle_group(groups: list[str], name: str, max_groups: int = 3) -> list[str]:
    """A record's groups after one is switched; at the cap no more are taken."""
    if name in groups:
        return [g for g in groups if g != name]
    return [*groups, name] if len(groups) < max_groups else list(groups)
