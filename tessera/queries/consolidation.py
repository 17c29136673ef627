"""Feedback and the consolidation job."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import consolidate as C
from tessera.operators import feedback
from tessera.operators.state import archive, upsert
from tessera.plans.shared import materialize
from tessera.queries import query
from tessera.queries.graphs import LIVE_SQL, records
from tessera.sources.tables import MEMORIES_SQL, NOW, memories, table

_T = f"TIMESTAMP '{NOW}'"
_PLAIN = "NOT is_archived AND NOT is_note"
_ARCHIVE = f"is_stale AND staleness_score >= 9 AND {_PLAIN} AND (last_accessed_at IS NULL OR last_accessed_at < {_T} - INTERVAL 30 DAY)"
_REHAB = f"is_stale AND usefulness_score > staleness_score AND NOT is_archived AND last_accessed_at >= {_T} - INTERVAL 7 DAY"


@query(
    f"""WITH {MEMORIES_SQL} SELECT 'high_stale_high_useful' AS kind, id FROM memories WHERE {_PLAIN} AND staleness_score >= 6 AND usefulness_score >= 5
 UNION ALL SELECT 'never_accessed', id FROM memories WHERE {_PLAIN} AND is_active AND retrieval_count = 0 AND created_at < {_T} - INTERVAL 7 DAY
 UNION ALL SELECT 'flagged', id FROM memories WHERE flagged_for_review"""
)
def anomalies(spark, sf_dir):
    return C.anomalies(memories(spark, sf_dir), NOW)


@query(f"WITH {MEMORIES_SQL} SELECT id, is_archived OR ({_ARCHIVE}) AS is_archived, is_active AND NOT ({_ARCHIVE}) AS is_active FROM memories")
def archive_stale(spark, sf_dir):
    return C.archive_stale(memories(spark, sf_dir), NOW).select("id", "is_archived", "is_active")


@query(f"WITH {MEMORIES_SQL} SELECT id, is_stale AND NOT coalesce({_REHAB}, false) AS is_stale, CASE WHEN {_REHAB} THEN greatest(0, staleness_score - 2) ELSE staleness_score END AS staleness_score FROM memories")
def rehabilitate(spark, sf_dir):
    return C.rehabilitate(memories(spark, sf_dir), NOW).select("id", "is_stale", "staleness_score")


@query(
    f"""WITH {MEMORIES_SQL}, f AS (SELECT doc_id AS id, sum(quality) AS u, sum(toxic) AS s FROM labels GROUP BY doc_id),
 j AS (SELECT m.*, coalesce(u, 0) AS u, coalesce(s, 0) AS s, f.id IS NOT NULL AS hit FROM memories m LEFT JOIN f ON f.id = m.id),
 k AS (SELECT *, CASE WHEN is_note THEN staleness_score ELSE least(10, staleness_score + s) END AS st FROM j)
 SELECT id, least(10, usefulness_score + 0.5 * u) AS usefulness_score, st AS staleness_score, CASE WHEN hit THEN st >= 7 ELSE is_stale END AS is_stale, flagged_for_review OR (is_note AND s > 0) AS flagged_for_review FROM k"""
)
def feedback_apply(spark, sf_dir):
    """Labels as feedback: quality is useful, toxic is stale."""
    f = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("useful"), F.col("toxic").alias("stale"))
    return feedback.apply_feedback(memories(spark, sf_dir), f).select("id", "usefulness_score", "staleness_score", "is_stale", "flagged_for_review")


@query(f"WITH {MEMORIES_SQL} SELECT id, retrieval_count + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS retrieval_count, strftime(CASE WHEN id % 10 = 0 THEN {_T} ELSE last_accessed_at END, '%Y-%m-%d') AS day FROM memories")
def touch_returned(spark, sf_dir):
    m = memories(spark, sf_dir)
    return feedback.touch(m, m.where("id % 10 = 0"), NOW).select("id", "retrieval_count", F.date_format("last_accessed_at", "yyyy-MM-dd").alias("day"))


@query(f"WITH {MEMORIES_SQL} SELECT count(*) AS total, count(*) FILTER (is_active AND NOT is_archived) AS active, count(*) FILTER (is_stale) AS stale, count(*) FILTER (is_archived) AS archived, round(coalesce(avg(usefulness_score) FILTER (is_active AND NOT is_archived), 0), 6) AS avg_usefulness, round(coalesce(avg(staleness_score) FILTER (is_active AND NOT is_archived), 0), 6) AS avg_staleness FROM memories")
def store_stats(spark, sf_dir):
    return C.stats(memories(spark, sf_dir))


_CONCEPTS = f"{LIVE_SQL}, cc AS (SELECT entity AS concept, count(*) AS memory_count FROM kept GROUP BY entity HAVING count(*) >= 3)"


@query(f"WITH {_CONCEPTS} SELECT concept, memory_count FROM cc")
def concept_selection(spark, sf_dir):
    return C.concepts(records(spark, sf_dir))


@query(f"WITH {_CONCEPTS}, old AS (SELECT concept, memory_count - length(concept) % 2 AS memory_count FROM cc WHERE length(concept) % 3 <> 0) SELECT cc.concept, cc.memory_count, true AS needs FROM cc LEFT JOIN old USING (concept) WHERE old.memory_count IS NULL OR old.memory_count <> cc.memory_count")
def summary_jobs(spark, sf_dir):
    chosen = materialize(C.concepts(records(spark, sf_dir)), "concepts")
    old = chosen.where("length(concept) % 3 <> 0").withColumn("memory_count", F.col("memory_count") - F.length("concept") % 2)
    return C.summary_jobs(chosen, old)


@query(
    f"""WITH {LIVE_SQL}, c AS (SELECT entity, count(*) AS n FROM kept GROUP BY entity HAVING count(*) >= 3), r AS (SELECT entity, id, n, row_number() OVER (PARTITION BY entity ORDER BY id) AS place FROM kept JOIN c USING (entity))
 SELECT entity AS concept, entity || ': ' || count(*) || ' records, ' || sum(length(content)) || ' characters' AS summary_text, max(n) AS memory_count FROM r JOIN memories USING (id) WHERE place <= 20 GROUP BY entity"""
)
def summary_generation(spark, sf_dir):
    """Summaries by a stand-in summarizer: the number and total length of the contents it was given."""
    r = materialize(records(spark, sf_dir), "records")
    chosen = C.concepts(r)
    old = spark.createDataFrame([], "concept string, summary_text string, memory_count long")
    return C.generate_summaries(C.concept_contents(r, chosen, pack=True), old, lambda c, xs: f"{c}: {len(xs)} records, {sum(map(len, xs))} characters")


_CONTRA = "c AS (SELECT id, 0 AS pos, id + 1 AS other FROM memories WHERE flagged_for_review UNION ALL SELECT id, 1, id + 6 FROM memories WHERE flagged_for_review)"
_JUDGED = f"""{MEMORIES_SQL}, {_CONTRA}, l AS (SELECT c.id, arg_min(struct_pack(other := c.other, n := m.is_note), pos) AS o FROM c JOIN memories m ON m.id = c.other AND NOT m.is_archived GROUP BY c.id),
 judged AS (SELECT m.id, o.other AS other, CASE WHEN o IS NULL THEN CASE WHEN m.is_note THEN 'note_alone' ELSE 'resolve' END WHEN m.is_note AND o.n THEN 'both_notes' WHEN m.is_note THEN 'supersede_other' WHEN o.n THEN 'supersede_self' ELSE 'resolve' END AS action FROM memories m LEFT JOIN l ON l.id = m.id WHERE m.flagged_for_review)"""


def _judged(spark, sf_dir):
    m = memories(spark, sf_dir)
    flagged = m.where("flagged_for_review")
    c = flagged.select("id", F.posexplode(F.array(F.col("id") + 1, F.col("id") + 6)).alias("pos", "other"))
    return m, C.note_authority(m, c)


@query(f"WITH {_JUDGED} SELECT id, other, action FROM judged")
def note_authority(spark, sf_dir):
    return _judged(spark, sf_dir)[1]


@query(
    f"""WITH {_JUDGED}, lost AS (SELECT id, min(winner) AS winner FROM (SELECT other AS id, id AS winner FROM judged WHERE action = 'supersede_other' UNION ALL SELECT id, other FROM judged WHERE action = 'supersede_self') GROUP BY id)
 SELECT m.id, m.is_archived OR lost.id IS NOT NULL AS is_archived, flagged_for_review AND lost.id IS NULL AND NOT EXISTS (SELECT 1 FROM judged j WHERE j.id = m.id AND j.action IN ('supersede_other','supersede_self','note_alone')) AS flagged, lost.winner AS superseded_by FROM memories m LEFT JOIN lost ON lost.id = m.id"""
)
def contradiction_resolution(spark, sf_dir):
    m, j = _judged(spark, sf_dir)
    return C.apply_actions(m, j).select("id", "is_archived", F.col("flagged_for_review").alias("flagged"), "superseded_by")


@query(f"WITH {MEMORIES_SQL} SELECT id, is_archived OR id % 50 = 1 AS is_archived, is_active AND id % 50 <> 1 AS is_active FROM memories")
def soft_delete(spark, sf_dir):
    m = memories(spark, sf_dir)
    return archive(m, m.where("id % 50 = 1").select("id")).select("id", "is_archived", "is_active")


@query(f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN id % 4 = 1 THEN 'fact' ELSE category END AS category FROM memories")
def upsert_records(spark, sf_dir):
    m = memories(spark, sf_dir).select("id", "category")
    return upsert(m, m.where("id % 4 = 1").withColumn("category", F.lit("fact")), "id")


_NOTE = "is_note AND is_active AND NOT is_archived"


@query(f"WITH {MEMORIES_SQL} SELECT id, strftime(valid_from, '%Y-%m-%d %H:%M') AS due FROM memories WHERE {_NOTE} AND valid_from >= TIMESTAMP '2024-01-15' ORDER BY valid_from, id LIMIT 20")
def notes_upcoming(spark, sf_dir):
    n = memories(spark, sf_dir).where("is_note and is_active and not is_archived and valid_from >= timestamp_ntz'2024-01-15 00:00:00'")
    return n.orderBy("valid_from", "id").limit(20).select("id", F.date_format("valid_from", "yyyy-MM-dd HH:mm").alias("due"))


@query(f"WITH {MEMORIES_SQL} SELECT id, strftime(valid_from, '%Y-%m-%d %H:%M') AS due FROM memories WHERE {_NOTE} AND valid_from < TIMESTAMP '2024-01-15' ORDER BY valid_from DESC, id LIMIT 20")
def notes_overdue(spark, sf_dir):
    n = memories(spark, sf_dir).where("is_note and is_active and not is_archived and valid_from < timestamp_ntz'2024-01-15 00:00:00'")
    return n.orderBy(F.desc("valid_from"), "id").limit(20).select("id", F.date_format("valid_from", "yyyy-MM-dd HH:mm").alias("due"))
