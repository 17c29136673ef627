"""Table schemas, their enumerations, and the checks Spark does not enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
CATEGORIES = ("identity", "preference", "skill", "context", "fact", "episodic", "temporal", "relationship")
LINK_TYPES = ("relates_to", "contradicts", "refines", "supersedes", "enables", "depends_on", "similar_to", "part_of", "uses", "before", "valid_until", "annotates")
SYMMETRIC = ("relates_to", "contradicts", "similar_to")
LINK_SOURCES = ("extraction", "inference", "dreaming", "user")
MEMORY_SOURCES = ("user", "agent", "document", "inference")

MEMORIES = """id string, content string, category string, entity_ids array<string>, embedding array<float>,
 confidence double, source string, verified boolean, valid_from timestamp_ntz, valid_until timestamp_ntz,
 usefulness_score double, staleness_score double, reinforcement_count int, retrieval_count int,
 is_stale boolean, is_active boolean, is_archived boolean, superseded_by string, flagged_for_review boolean,
 contradicts_ids array<string>, is_note boolean, created_at timestamp_ntz, updated_at timestamp_ntz,
 last_accessed_at timestamp_ntz, metadata string"""
CONCEPT_LINKS = """id string, source_memory_id string, target_memory_id string, link_type string, entity string,
 strength double, confidence double, source string, verified boolean, created_at timestamp_ntz, updated_at timestamp_ntz"""
SUMMARIES = "id string, concept string, summary_text string, memory_count int, is_current boolean, generated_at timestamp_ntz"
MANIFEST = """path string, collection string, size long, mtime double, content_hash string, index_mode string,
 memory_ids array<string>, online_only boolean, last_seen timestamp_ntz"""
QUERY_SESSIONS = """id string, query_text string, created_at timestamp_ntz, confidence_rating int, reasoning string,
 useful_ids array<string>, stale_ids array<string>, concluded boolean"""
QUERY_RESULTS = "session_id string, memory_id string, relevance_score double, was_accessed boolean, was_useful boolean, was_stale boolean"
TURNS = "session_id string, agent string, seq int, ts timestamp_ntz, role string, text string, tool_name string"

#: Column checks of a memory row: name, whether a row breaks it.
MEMORY_CHECKS: dict[str, str] = {
    "content_length": "content is null or length(content) < 1 or length(content) > 10000",
    "category": "category is null or category not in ({})".format(", ".join(f"'{c}'" for c in CATEGORIES)),
    "source": "source is null or source not in ({})".format(", ".join(f"'{c}'" for c in MEMORY_SOURCES)),
    "confidence": "confidence is null or confidence < 0 or confidence > 1",
    "usefulness": "usefulness_score is null or usefulness_score < 0 or usefulness_score > 10",
    "staleness": "staleness_score is null or staleness_score < 0 or staleness_score > 10",
}
LINK_CHECKS: dict[str, str] = {
    "link_type": "link_type is null or link_type not in ({})".format(", ".join(f"'{c}'" for c in LINK_TYPES)),
    "self_link": "source_memory_id = target_memory_id",
    "strength": "strength is null or strength < 0 or strength > 1",
    "confidence": "confidence is null or confidence < 0 or confidence > 1",
}


def violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows per broken check, in one pass; a check no row breaks has 0."""
    counts = df.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in checks.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("rows")) for n in checks]))
    return counts.select(pairs.alias("p")).select("p.check", "p.rows")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand in more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def valid(checks: dict[str, str]) -> Column:
    return ~F.expr(" or ".join(f"coalesce({e}, true)" for e in checks.values()))
