"""Notes and what they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import entities
from tessera.operators.records import new_records
from tessera.operators.search import candidates, dominant
from tessera.operators.state import insert_or_ignore
from tessera.settings import Notes


def anchor_candidates(records: DataFrame, about: str, limit: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """(id, relevance) of the best records for a phrase; no filter, no session, no counters."""
    return candidates(records, about, limit, vectors).orderBy(F.desc("relevance"), "id").limit(limit)


def resolve_anchor(records: DataFrame, note_id: object, about: str, settings: Notes = Notes(), vectors: DataFrame | None = None) -> DataFrame:
    """(id, share, entity_ids) of the one record the phrase is about, or nothing.

    The note itself, other notes and archived records do not count; the rest
    must leave one that holds the share and is strictly ahead."""
    near = anchor_candidates(records, about, 5, vectors)
    fit = records.where((F.col("id") != F.lit(note_id)) & ~F.col("is_note") & ~F.col("is_archived"))
    near = near.join(fit.select("id", "entity_ids"), "id")
    return dominant(near.select("id", "relevance"), settings.anchor_min_dominance).join(near.select("id", "entity_ids"), "id")


def create_note(records: DataFrame, links: DataFrame, note_id: object, content: str, now: str, about: str | None = None, when: str | None = None, until: str | None = None, category: str | None = None, settings: Notes = Notes()) -> tuple[DataFrame, DataFrame, str]:
    """(records, links, kind of anchor) with a user's note added.

    A phrase that one record dominates becomes an annotates link and lends the
    note that record's entities; any other lends its own."""
    spark = records.sparkSession
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    row = spark.range(1).select(F.lit(note_id).cast(records.schema["id"].dataType).alias("id"), F.lit(content).alias("content"), F.lit(category or ("temporal" if when else "episodic")).alias("category"), F.lit("user").alias("source"), F.lit(True).alias("verified"), F.lit(True).alias("is_note"), t(when).alias("valid_from"), t(until).alias("valid_until"))
    note, kind = new_records(row, now), "none"
    if about is not None:
        hit = resolve_anchor(records, note_id, about, settings).head(1)
        kind = "memory" if hit else "topic"
        lent = F.array(*[F.lit(e) for e in hit[0]["entity_ids"]]).cast("array<string>") if hit else entities(F.lit(about))
        anchor = F.to_json(F.struct(F.lit(about).alias("anchor"), F.lit(str(hit[0]["id"]) if hit else None).alias("anchor_memory_id")))
        note = note.withColumns({"entity_ids": F.array_distinct(F.concat("entity_ids", lent)), "metadata": anchor})
        if hit:
            cells = {"source_memory_id": F.lit(note_id), "target_memory_id": F.lit(hit[0]["id"]), "link_type": F.lit("annotates"), "entity": F.lit(about), "strength": F.lit(1.0), "confidence": F.lit(hit[0]["share"]), "source": F.lit("user")}
            edge = spark.range(1).select(*[cells.get(c, F.lit(None)).cast(links.schema[c].dataType).alias(c) for c in links.columns])
            links = insert_or_ignore(links, edge, "source_memory_id", "target_memory_id", "link_type")
    return records.unionByName(note.select(*records.columns)), links, kind
