"""A folder kept indexed: files new, changed and gone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import chunks, suffix
from tessera.operators.records import new_records
from tessera.operators.state import Snapshots, archive, upsert
from tessera.plans.shared import materialize
from tessera.schema import MANIFEST, MEMORIES
from tessera.sources.changes import changes
from tessera.sources.files import classify, listing, prune, read_text, render


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def file_rows(files: DataFrame, collection: str, root_label: str, texts: DataFrame | None = None, chunk: int = 4000) -> DataFrame:
    """Rows for ``records.insert``: one about each file, and with ``texts``
    (path, text) one for each piece of its body. Ids follow from path, state and place."""
    own = lambda *xs: F.concat(F.lit("file-"), F.substring(F.sha2(F.concat_ws("|", F.lit(collection), "path", F.col("size").cast("string"), F.col("mtime").cast("string"), *xs), 256), 1, 24))
    at = F.timestamp_seconds("mtime").cast("timestamp_ntz")
    online = F.col("online_only") if "online_only" in files.columns else F.lit(False)

    def envelope(**more: Column) -> Column:
        cells = {"path": F.col("path"), "rel": F.col("rel"), "ext": suffix(F.col("name")), "size": F.col("size"), "collection": F.lit(collection), "online_only": online} | more
        return F.to_json(F.struct(*[v.alias(k) for k, v in cells.items()]))

    about = files.join(render(files, root_label), "path").select("path", own(F.lit("file")).alias("id"), F.col("text").alias("content"), envelope(record_role=F.lit("file")).alias("metadata"), at.alias("valid_from"))
    if texts is not None:
        pieces = files.join(texts.where("text is not null and text <> ''"), "path").select("*", F.posexplode(chunks(F.col("text"), chunk)).alias("n", "piece"))
        body = pieces.select("path", own(F.col("n").cast("string")).alias("id"), F.col("piece").alias("content"), envelope(record_role=F.lit("chunk"), chunk=F.col("n")).alias("metadata"), at.alias("valid_from"))
        about = about.unionByName(body)
    return about.withColumns({"category": F.lit("context"), "source": F.lit("document")})


def index_files(files: DataFrame, records: DataFrame, manifest: DataFrame, now: str, collection: str, root_label: str, texts: DataFrame | None = None, mode: str = "metadata", whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, manifest, report) after ``files`` were seen: new and changed
    ones get records, those of a changed file's old state are archived, and
    with ``whole``, where ``files`` is all there is, so are those of files that
    are gone. Files that are unchanged cost a comparison; running twice changes nothing."""
    own = manifest.where(F.col("collection") == collection)
    state = materialize(classify(files, own, mode), "state")
    todo = state.where("state <> 'unchanged'").drop("state")
    made = materialize(file_rows(todo, collection, root_label, texts), "made")
    gone = prune(files, own) if whole else own.where("false")
    old = own.join(todo.select("path"), "path", "left_semi").unionByName(gone).select(F.explode("memory_ids").alias("id"))
    new = new_records(made.drop("path"), now).select(*records.columns)
    old = old.join(made.select("id"), "id", "left_anti")
    after = upsert(archive(records, old), new, "id")
    ids = made.groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("memory_ids"))
    cells = {"collection": F.lit(collection), "content_hash": F.lit(None).cast("string"), "index_mode": F.lit(mode), "online_only": F.col("online_only") if "online_only" in todo.columns else F.lit(False), "last_seen": F.lit(now).cast("timestamp_ntz")}
    seen = todo.join(ids, "path").withColumns(cells).select(*manifest.columns)
    manifest = upsert(manifest.join(gone.select("path"), "path", "left_anti").select(*manifest.columns), seen, "path")
    counts = state.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "unchanged")]).join(gone.agg(F.count("*").alias("gone")))  # one row each
    return after, manifest, materialize(counts, "report")


def index_tree(spark: SparkSession, root: str, store: Snapshots, now: str, collection: str, mode: str = "metadata", include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """One run over a folder against the tables of ``store``; the report."""
    records, manifest = store.read("records"), store.read("manifest")
    records = empty(spark, MEMORIES) if records is None else records
    manifest = empty(spark, MANIFEST) if manifest is None else manifest
    texts = read_text(spark, root).select("path", "text") if mode == "content" else None
    after, seen, report = index_files(listing(spark, root, include, exclude), records, manifest, now, collection, root.rstrip("/").rsplit("/", 1)[-1], texts, mode)
    store.commit({"records": after, "manifest": seen})
    return report


def watch_tree(spark: SparkSession, root: str, store: Snapshots, clock: Callable[[], str], collection: str, checkpoint: str, mode: str = "metadata", once: bool = True) -> StreamingQuery:
    """A stream that runs ``index_tree`` whenever files arrive, are rewritten or
    go. A batch that is repeated after a failure finds nothing left to do."""
    arrived = changes(spark, root, f"{checkpoint}-listings")

    def run(batch: DataFrame, _: int) -> None:
        if batch.head(1):
            index_tree(spark, root, store, clock(), collection, mode)

    w = arrived.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
