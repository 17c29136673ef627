"""Record tables: lookups, inserts, partial updates, notes, and what annotates what."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import entities
from tessera.operators.state import insert_or_ignore, latest, upsert
from tessera.schema import CATEGORIES, MEMORIES, MEMORY_CHECKS, MEMORY_SOURCES, valid

Embed = Callable[[Column], Column]

# A new record's cells where none are given.
DEFAULTS: dict[str, str] = {
    "confidence": "1.0D", "verified": "false", "usefulness_score": "0.0D", "staleness_score": "0.0D", "reinforcement_count": "0", "retrieval_count": "0",
    "is_stale": "false", "is_active": "true", "is_archived": "false", "flagged_for_review": "false", "contradicts_ids": "cast(array() as array<string>)",
    "is_note": "false", "metadata": "'{}'",
}


def active(records: DataFrame) -> DataFrame:
    return records.where("is_active and not is_archived")


def point(records: DataFrame, id_: object) -> DataFrame:
    """The record of an id, or none."""
    return records.where(F.col("id") == F.lit(id_))


def among(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` (id), each once."""
    return records.join(ids.select("id"), "id", "left_semi")


def meta(path: str, column: str = "metadata") -> Column:
    return F.get_json_object(column, f"$.{path}")


def from_rows(rows: DataFrame) -> DataFrame:
    """Records from rows of text cells: JSON lists, 0 and 1, ISO times; a cell that does not parse is null."""
    out = []
    for field in spark_schema(rows.sparkSession, MEMORIES):
        c = F.col(field.name) if field.name in rows.columns else F.lit(None)
        kind = field.dataType.simpleString()
        if field.name in rows.columns and rows.schema[field.name].dataType.simpleString() == "string":
            if kind.startswith("array"):
                c = F.from_json(c, kind)
            elif kind == "timestamp_ntz":
                c = c.try_cast("timestamp_ntz")
            elif kind == "boolean":
                c = F.when(c.isin("1", "true"), True).when(c.isin("0", "false"), False)
            else:
                c = c.try_cast(kind)
        out.append(c.cast(kind).alias(field.name))
    return rows.select(*out)


def spark_schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def new_records(rows: DataFrame, now: str, embed: Embed | None = None) -> DataFrame:
    """``rows`` as full records: defaults filled in, entities taken from the
    content where none are given, embedded if there is an embedder. Rows that
    break a check (content length, category, source, ranges) go; see
    ``schema.violations`` for how many."""
    at = F.lit(now).cast("timestamp_ntz")
    out = rows
    if "id" not in rows.columns:
        out = out.withColumn("id", F.expr("uuid()"))
    cells = {}
    for field in spark_schema(rows.sparkSession, MEMORIES):
        c, kind = field.name, field.dataType.simpleString()
        if c == "id":
            continue
        have = F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
        if c in DEFAULTS:
            have = F.coalesce(have, F.expr(DEFAULTS[c]).cast(kind))
        elif c in ("created_at", "updated_at"):
            have = F.coalesce(have, at)
        elif c == "entity_ids":
            have = F.when(F.coalesce(F.size(have), F.lit(0)) > 0, have).otherwise(entities(F.col("content")))
        elif c == "embedding" and embed is not None:
            have = embed(F.col("content")).cast(kind)
        cells[c] = have
    return out.select(F.col("id"), *[v.alias(k) for k, v in cells.items()]).where(valid(MEMORY_CHECKS))


def insert(records: DataFrame, rows: DataFrame, now: str, embed: Embed | None = None) -> DataFrame:
    """``records`` with ``rows`` added. An id that is there already is an error to the caller: see ``state.insert_or_ignore``."""
    return records.unionByName(new_records(rows, now, embed).select(*records.columns))


def partial_update(records: DataFrame, changes: DataFrame, now: str, embed: Embed | None = None) -> DataFrame:
    """Records after ``changes`` (id, then any columns): a change's cells replace
    the record's, null ones too. ``updated_at`` is set anew. Where the content
    changes, entities are taken from it unless the change has some, and the
    embedding is made again, or is null without an embedder. A change that
    would break a check leaves its record as it was."""
    cells = [c for c in changes.columns if c != "id"]
    ch = changes.select("id", F.struct(*cells).alias("_new"))
    j = records.join(ch, "id", "left")
    hit = F.col("_new").isNotNull()
    new = {c: F.col(f"_new.{c}").cast(records.schema[c].dataType) for c in cells}
    content = F.when(hit, new["content"]).otherwise(F.col("content")) if "content" in cells else F.col("content")
    changed = hit & ~content.eqNullSafe(F.col("content")) if "content" in cells else F.lit(False)
    if "content" in cells:
        if "entity_ids" in records.columns and "entity_ids" not in cells:
            new["entity_ids"] = F.when(changed, entities(content)).otherwise(F.col("entity_ids"))
        if "embedding" in records.columns and "embedding" not in cells:
            made = embed(content).cast("array<float>") if embed is not None else F.lit(None).cast("array<float>")
            new["embedding"] = F.when(changed, made).otherwise(F.col("embedding"))
    if "updated_at" in records.columns:
        new["updated_at"] = F.lit(now).cast("timestamp_ntz")
    checks = {k: v for k, v in MEMORY_CHECKS.items() if all(c in records.columns for c in _columns_of(v))}
    after = j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in records.columns], hit.alias("_hit"), F.struct(*records.columns).alias("_old"))
    good = valid(checks) if checks else F.lit(True)
    return after.select(*[F.when(F.col("_hit") & ~good, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in records.columns])


def _columns_of(check: str) -> list[str]:
    names = [f.split()[0] for f in MEMORIES.split(",")]
    return [n for n in names if n in check.replace("(", " ").replace(")", " ").split()]


def missing(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes of records that are not there, an error to their sender."""
    return changes.join(records.select("id"), "id", "left_anti")


def summaries(table: DataFrame, concept: str | None = None, include_stale: bool = False) -> DataFrame:
    """One concept's summary, or all by name; those no longer current only if asked for."""
    out = table if include_stale or concept is not None else table.where("is_current")
    return out.where(F.col("concept") == concept) if concept is not None else out.orderBy("concept")


def open_session(sessions: DataFrame, query_text: str, now: str, id_: str) -> DataFrame:
    row = sessions.sparkSession.range(1).select(F.lit(id_).alias("id"), F.lit(query_text).alias("query_text"), F.lit(now).cast("timestamp_ntz").alias("created_at"), F.lit(False).alias("concluded"))
    return sessions.unionByName(row, allowMissingColumns=True)


def record_results(results: DataFrame, session_id: str, found: DataFrame) -> DataFrame:
    """``results`` with those of a session, ``found`` (id, score), the last of an id; earlier rows of the same record are replaced."""
    new = found.groupBy(F.col("id").cast("string").alias("memory_id")).agg(F.max("score").alias("relevance_score"))
    new = new.select(F.lit(session_id).alias("session_id"), "memory_id", "relevance_score", F.lit(False).alias("was_accessed"), F.lit(False).alias("was_useful"), F.lit(False).alias("was_stale"))
    return upsert(results, new, "session_id", "memory_id")


def conclude(sessions: DataFrame, session_id: str) -> DataFrame:
    """A session given up without feedback; concluding twice, or one that is not there, changes nothing."""
    return sessions.withColumn("concluded", F.col("concluded") | (F.col("id") == session_id))


def never_accessed_stale(records: DataFrame, least: float = 3.0) -> DataFrame:
    return records.where(F.col("last_accessed_at").isNull() & (F.col("staleness_score") >= least) & ~F.col("is_archived") & ~F.col("is_note"))


def stale_but_useful(records: DataFrame, stale: float = 5.0, useful: float = 3.0) -> DataFrame:
    return records.where((F.col("staleness_score") >= stale) & (F.col("usefulness_score") >= useful) & ~F.col("is_archived") & ~F.col("is_note"))


def manual_link(links: DataFrame, records: DataFrame, source: object, target: object, link_type: str, now: str, strength: float = 1.0, confidence: float = 1.0, entity: str = "") -> DataFrame:
    """``links`` with an edge made by a user and, for symmetric types, its
    mirror. Both ends must be there and differ."""
    from tessera.operators.graph import both_ways

    if source == target:
        raise ValueError("a record cannot link to itself")
    if records.where(F.col("id").isin(source, target)).select("id").distinct().count() < 2:
        raise KeyError("no such record")
    cells = {"source_memory_id": F.lit(source), "target_memory_id": F.lit(target), "link_type": F.lit(link_type), "entity": F.lit(entity), "strength": F.lit(strength), "confidence": F.lit(confidence), "source": F.lit("user"), "verified": F.lit(False), "created_at": F.lit(now).cast("timestamp_ntz"), "updated_at": F.lit(now).cast("timestamp_ntz"), "id": F.expr("uuid()")}
    row = links.sparkSession.range(1).select(*[v.cast(links.schema[k].dataType).alias(k) for k, v in cells.items() if k in links.columns])
    return insert_or_ignore(links, both_ways(row), "source_memory_id", "target_memory_id", "link_type")


def manifest_upsert(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest after ``rows`` were seen, one a path."""
    return upsert(manifest, rows, "path")


def manifest_delete(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    return manifest.join(paths.select("path"), "path", "left_anti")


def manifest_paths(manifest: DataFrame, collection: str | None = None) -> DataFrame:
    m = manifest if collection is None else manifest.where(F.col("collection") == collection)
    return m.select("path").distinct()


def peers(records: DataFrame, asked: DataFrame, most: int = 8) -> DataFrame:
    """(id, peer, place): the first records by id that share an entity with each of ``asked`` (id).

    Of an entity's records only the first ``most`` + 1 by id can be among
    anyone's first, so a common one is cut to them before it is joined. Shared
    entities fold into one row a pair before the rank is cut."""
    e = records.select("id", F.explode(F.array_distinct("entity_ids")).alias("entity"))
    a = e.join(asked.select("id"), "id", "left_semi")
    first = F.row_number().over(Window.partitionBy("entity").orderBy("id"))
    b = e.withColumn("_n", first).where(F.col("_n") <= most + 1).select(F.col("id").alias("peer"), "entity")
    pairs = a.join(b, "entity").where("id <> peer").select("id", "peer").distinct()
    w = Window.partitionBy("id").orderBy("peer")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def annotating(targets: DataFrame, links: DataFrame, records: DataFrame, cap: int, kind: str | None = None) -> DataFrame:
    """(result_id, id, rank): what annotates each of ``targets`` (id): notes by
    strength and age, or with ``kind`` the active records of that kind, newest first."""
    e = links.where("link_type = 'annotates'").select(F.col("target_memory_id").alias("result_id"), F.col("source_memory_id").alias("id"), "strength")
    live = records.where("not is_archived")
    live = live.where("is_note") if kind is None else live.where("not is_note").where(meta("kind") == kind)
    j = targets.select(F.col("id").alias("result_id")).join(e, "result_id").join(live.select("id", "created_at"), "id")
    order = [F.desc("strength"), F.desc("created_at"), "id"] if kind is None else [F.desc("created_at"), "id"]
    w = Window.partitionBy("result_id").orderBy(*order)
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("result_id", "id", "rank")


def list_notes(records: DataFrame, now: str, about: str | None = None, upcoming: bool = False, overdue: bool = False, include_archived: bool = False, limit: int = 50) -> DataFrame:
    """Notes, newest first; or those to come, or overdue, by date. The list is
    cut to ``limit`` first; ``about`` then keeps those with that entity and an
    anchor that contains it."""
    if upcoming and overdue:
        raise ValueError("upcoming and overdue exclude each other")
    at, n = F.lit(now).cast("timestamp_ntz"), records.where("is_note")
    if upcoming:
        n = n.where(F.col("valid_from") > at).orderBy("valid_from", "id")
    elif overdue:
        n = n.where((F.col("valid_from") < at) & ~F.col("is_archived")).orderBy("valid_from", "id")
    else:
        n = (n if include_archived else n.where("not is_archived")).orderBy(F.desc("created_at"), "id")
    n = n.limit(limit)
    if about is not None:
        low = about.lower()
        n = n.where(F.exists("entity_ids", lambda e: F.lower(e) == low) & F.lower(F.coalesce(meta("anchor"), F.lit(""))).contains(low))
    return n


def load_corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(content, category, source, metadata, valid_from, valid_until) of JSON files
    that are a list, or an object with a list ``memories``. Rows of an unknown
    category or without content go; an unknown source becomes document."""
    files = spark.read.text(paths, wholetext=True).select(F.try_parse_json("value").alias("v"))
    rows = F.coalesce(F.try_variant_get("v", "$.memories", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    g = lambda p: F.try_variant_get(F.col("r"), p, "string")
    r = files.select(F.explode(rows).alias("r"))
    source = F.lower(F.coalesce(g("$.source"), F.lit("document")))
    out = r.select(
        F.substring(g("$.content"), 1, 10_000).alias("content"),
        F.lower(g("$.category")).alias("category"),
        F.when(source.isin(*MEMORY_SOURCES), source).otherwise("document").alias("source"),
        F.coalesce(F.to_json(F.try_variant_get(F.col("r"), "$.metadata", "variant")), F.lit("{}")).alias("metadata"),
        g("$.valid_from").try_cast("timestamp_ntz").alias("valid_from"),
        g("$.valid_until").try_cast("timestamp_ntz").alias("valid_until"),
    )
    return out.where(F.col("category").isin(*CATEGORIES) & (F.trim(F.coalesce("content", F.lit(""))) != ""))


def newest(records: DataFrame, key: str) -> DataFrame:
    return latest(records, [key], [F.desc("created_at"), F.desc("id")])
