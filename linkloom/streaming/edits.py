"""Continuous imports and edits: micro-batches upserted into, or patched onto, a versioned store.

Both sinks are idempotent: an upsert of the same rows changes nothing but timestamps, and patches set fields to values. A batch
that is replayed after a failure therefore has the effect of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.patches import ATTEMPTS, commit
from linkloom.operators.upsert import upsert
from linkloom.sources.store import Conflict, VersionedStore


def upsert_stream(incoming: DataFrame, store: VersionedStore, checkpoint: str, now: Callable[[], str], **trigger) -> StreamingQuery:
    """Starts a query that folds a stream of records into the store, a version per batch."""

    def sink(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("_ord", F.monotonically_increasing_id()).persist()
        try:
            for attempt in range(ATTEMPTS):
                version, current = store.read()
                try:
                    store.write(upsert(current, rows, now()), version)
                    return
                except Conflict:
                    if attempt == ATTEMPTS - 1:
                        raise
        finally:
            rows.unpersist()

    return incoming.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def patch_stream(patches: DataFrame, store: VersionedStore, checkpoint: str, now: Callable[[], str], **trigger) -> StreamingQuery:
    """Starts a query that commits a stream of patches(id, seq, starred, notes, groups), coalesced per batch: the trigger's interval is the debounce."""
    return patches.writeStream.foreachBatch(lambda batch, _: commit(store, batch, now)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
