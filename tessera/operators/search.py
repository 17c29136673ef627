"""Hybrid search over records: candidates, fusion, filter, score, expansion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import effective_score
from tessera.operators.fusion import fuse, min_max
from tessera.operators.index import Index
from tessera.operators.lexical import both, pool, top
from tessera.plans.shared import materialize
from tessera.settings import Notes


@dataclass(frozen=True)
class Filter:
    include_archived: bool = False
    active_only: bool = True
    exclude_stale: bool = True
    category: str | None = None
    source: str | None = None
    verified_only: bool = False
    entity: str | None = None
    min_usefulness: float | None = None
    max_staleness: float | None = None

    def column(self) -> Column:
        c, out = F.col, [F.lit(True)]
        if not self.include_archived:
            out.append(~c("is_archived"))
        if self.active_only:
            out.append(c("is_active"))
        if self.exclude_stale:
            out.append(~c("is_stale"))
        if self.category:
            out.append(c("category") == self.category)
        if self.source:
            out.append(c("source") == self.source)
        if self.verified_only:
            out.append(c("verified"))
        if self.entity:
            out.append(F.exists("entity_ids", lambda x: F.lower(x) == self.entity.lower()))
        if self.min_usefulness is not None:
            out.append(c("usefulness_score") >= self.min_usefulness)
        if self.max_staleness is not None:
            out.append(c("staleness_score") <= self.max_staleness)
        return reduce(and_, out)


#: The word and the trigram index of a store's records.
Indexes = tuple[Index, Index]


def candidates(records: DataFrame, query: str, limit: int, vectors: DataFrame | None = None, vector_weight: float = 1.0, indexes: Indexes | None = None) -> DataFrame:
    """(id, relevance) of the fused pools; ``vectors`` (id, score) is a ranked
    pool of its own. Words and substrings come from ``indexes``, or from a pass over the texts."""
    n = pool(limit)
    sources = [ix.top(query, n) for ix in indexes] if indexes else [top(ranking, n) for ranking in both(records, query)]
    weights = [1.0, 1.0]
    if vectors is not None:
        sources.append(vectors.orderBy(F.desc("score"), "id").limit(n))
        weights.append(vector_weight)
    return min_max(fuse(sources, weights))


def search(records: DataFrame, query: str, now: str, limit: int = 10, where: Filter = Filter(), vectors: DataFrame | None = None, vector_weight: float = 1.0, prefilter: bool = False, notes: Notes = Notes(), indexes: Indexes | None = None) -> DataFrame:
    """(id, score) of the best records. The pool is cut before the filter, as
    in the model system; ``prefilter`` filters first, which takes a pass over the
    texts, as an index knows of no filter. Changes nothing: see ``feedback.touch`` for the counters."""
    base = records.where(where.column()) if prefilter else records
    found = candidates(base, query, limit, vectors, vector_weight, None if prefilter else indexes)
    rows = found.join(records, "id").where(where.column())
    score = effective_score(F.col("relevance"), F.col("usefulness_score"), F.col("staleness_score"), F.col("last_accessed_at"), F.lit(now).cast("timestamp_ntz"), F.col("is_note"), notes.bonus)
    return rows.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


@dataclass(frozen=True)
class Found:
    results: DataFrame  # (id, score, origin, place): ranked ones first, then neighbours
    notes: DataFrame  # (result_id, note_id, rank)
    sessions: DataFrame
    query_results: DataFrame
    records: DataFrame  # with the counters of what was returned raised


@dataclass(frozen=True)
class Around:
    depth: int = 1
    min_strength: float = 0.0
    types: tuple[str, ...] = ()


def full_search(records: DataFrame, links: DataFrame, sessions: DataFrame, query_results: DataFrame, query: str, now: str, session_id: str, limit: int = 10, where: Filter = Filter(), embed: Callable[[str], list[float]] | None = None, vector_weight: float = 1.0, around: Around | None = None, notes: Notes = Notes(), indexes: Indexes | None = None) -> Found:
    """Search as a user meets it: three ranked sources, filter and score, the
    neighbours of what was found, the notes on it, and the log of the session.

    ``embed`` turns the query into a vector for records with an ``embedding``.
    Neighbours pass no filter and score 0; everything returned is logged and
    counted. The tables come back new; nothing is written for good.
    """
    from tessera.operators.feedback import touch
    from tessera.operators.graph import search_around
    from tessera.operators.records import open_session, record_results
    from tessera.operators.vector import cosine_top_k

    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    vectors = None
    if embed is not None:
        vectors = cosine_top_k(records.select("id", F.col("embedding").alias("vector")).where("vector is not null"), embed(query), pool(limit))
    best = materialize(search(records, query, now, limit, where, vectors, vector_weight, notes=notes, indexes=indexes), "best")
    place = F.row_number().over(Window.orderBy("origin", F.desc("score"), "id"))  # a page of results
    found = best.select("id", "score", F.lit(0).alias("origin"))
    if around is not None:
        near = search_around(links, best.select("id"), around.depth, around.min_strength, list(around.types) or None)
        near = near.join(records.select("id"), "id", "left_semi")
        extra = merge_anchors(best, near).where("origin = 1").select("id", F.lit(0.0).alias("score"), F.lit(1).alias("origin"))
        found = found.unionByName(extra)
    found = materialize(found.withColumn("place", place), "found")
    return Found(found, with_notes(found, links, records, notes.auto_include_cap), open_session(sessions, query, now, session_id), record_results(query_results, session_id, found), touch(records, found, now))


def with_notes(results: DataFrame, links: DataFrame, notes: DataFrame, cap: int = 3) -> DataFrame:
    """(result_id, note_id, rank): for every result its strongest, then newest, active notes, at most ``cap``."""
    e = links.where("link_type = 'annotates'").select(F.col("target_memory_id").alias("result_id"), F.col("source_memory_id").alias("note_id"), "strength")
    j = results.select(F.col("id").alias("result_id")).join(e, "result_id").join(notes.where("is_note and is_active and not is_archived").select(F.col("id").alias("note_id"), "created_at"), "note_id")
    w = Window.partitionBy("result_id").orderBy(F.desc("strength"), F.desc("created_at"), "note_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("result_id", "note_id", "rank")


def merge_anchors(anchors: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Anchors first, then the neighbours that are no anchors: (id, origin)."""
    a = anchors.select("id", F.lit(0).alias("origin"))
    return a.unionByName(neighbours.select("id").distinct().join(a, "id", "left_anti").withColumn("origin", F.lit(1)))


def dominant(candidates: DataFrame, share: float = 0.6) -> DataFrame:
    """(id, share) of the one candidate that holds the share and is strictly ahead, or nothing. ``candidates`` is a bounded pool (id, relevance)."""
    w, every = Window.orderBy(F.desc("relevance"), "id"), Window.partitionBy()
    rows = candidates.select("id", "relevance", F.sum("relevance").over(every).alias("total"), F.lead("relevance").over(w).alias("next"), F.row_number().over(w).alias("rank"))
    part = F.col("relevance") / F.col("total")
    return rows.where((F.col("rank") == 1) & (F.col("total") > 0) & (part >= share) & (F.col("next").isNull() | (F.col("relevance") > F.col("next")))).select("id", F.round(part, 6).alias("share"))
