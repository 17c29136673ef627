"""The consolidation job by the clock."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.answers import Answers
from tessera.operators.consolidate import run_full
from tessera.operators.state import Snapshots
from tessera.plans.shared import materialize

log = logging.getLogger(__name__)


def consolidate_store(store: Snapshots, now: str, summarizer: Callable[[str, list[str]], str], **hooks) -> dict[str, DataFrame]:
    """One full run over the tables of ``store`` (records, links, summaries),
    written back in one version. What the summarizer said is kept beside them."""
    from pyspark.sql import functions as F

    records, links, summaries = (store.read(n) for n in ("records", "links", "summaries"))
    if records is None or links is None or summaries is None:
        raise ValueError("the store needs records, links and summaries")
    contradicts = records.select("id", F.posexplode("contradicts_ids").alias("pos", "other"))
    out = run_full(records, links, summaries, contradicts, now, summarizer, answers=Answers("summarizer", store=store), **hooks)
    new = out["links"].select(*[c for c in links.columns if c in out["links"].columns])
    tables = {"links": links.unionByName(new, allowMissingColumns=True), "summaries": out["summaries"].select(*summaries.columns), "records": out["records"].select(*records.columns)}
    store.commit({name: materialize(df, name) for name, df in tables.items()})  # evaluated once, as ids are drawn in them
    return out


def every(spark: SparkSession, seconds: float, job: Callable[[int], object], checkpoint: str) -> StreamingQuery:
    """Runs ``job(number of the run)`` at once and then by the clock. A run that
    fails is logged and the next one comes all the same."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(_: DataFrame, batch: int) -> None:
        try:
            job(batch)
        except Exception:
            log.exception("run %s failed", batch)

    return ticks.writeStream.foreachBatch(run).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()
