"""Session logs followed as they grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.state import Snapshots
from tessera.operators.sync import file_state, sync
from tessera.schema import MANIFEST, MEMORIES
from tessera.settings import Segments
from tessera.sources.changes import changes
from tessera.sources.sessions import read_sessions
from tessera.streaming.trees import empty


def sync_store(spark: SparkSession, agent: str, root: str, store: Snapshots, now: str, s: Segments = Segments(), **how) -> DataFrame:
    """One run of ``sync`` over an agent's folder against the tables of ``store``; the report."""
    records, manifest = store.read("records"), store.read("manifest")
    records = empty(spark, MEMORIES) if records is None else records
    manifest = empty(spark, MANIFEST) if manifest is None else manifest
    read = read_sessions(spark, agent, root)
    files = file_state(spark, read.sessions.select(F.col("source_path").alias("path")))
    after, seen, report = sync(read, records, manifest, files, now, s, **how)
    store.commit({"records": after, "manifest": seen})
    return report


def watch_sessions(spark: SparkSession, agent: str, root: str, store: Snapshots, clock: Callable[[], str], checkpoint: str, s: Segments = Segments(), once: bool = True, **how) -> StreamingQuery:
    """A stream that syncs whenever session files arrive, are rewritten or go. A
    rewritten file's segments are replaced by their ids and those past its end
    archived, so late and repeated input end in the same tables."""
    arrived = changes(spark, root, f"{checkpoint}-listings")

    def run(batch: DataFrame, _: int) -> None:
        if batch.head(1):
            sync_store(spark, agent, root, store, clock(), s, **how)

    w = arrived.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
