"""The record model over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import entities
from tessera.schema import CATEGORIES

#: "Now" of every query, so that results do not depend on the clock.
NOW = "2024-02-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, with_entities: bool = False) -> DataFrame:
    """Documents as records; scores, states and times follow from the id.

    Columns nobody asks for are pruned, down to the scan.
    """
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    out = d.select(
        i.alias("id"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (i % 8 + 1).cast("int")).alias("category"),
        F.when(i % 3 == 0, "user").when(i % 3 == 1, "agent").otherwise("document").alias("source"),
        (i % 5 == 0).alias("verified"),
        ((i % 21) / 2.0).alias("usefulness_score"),
        (i * 7 % 21 / 2.0).alias("staleness_score"),
        (i % 4).cast("int").alias("retrieval_count"),
        (i * 7 % 21 / 2.0 >= 7).alias("is_stale"),
        (i % 17 != 0).alias("is_active"),
        (i % 17 == 0).alias("is_archived"),
        (i % 13 == 0).alias("flagged_for_review"),
        (i % 19 == 0).alias("is_note"),
        F.expr("timestampadd(HOUR, cast(doc_id % 1000 as int), timestamp_ntz'2024-01-01 00:00:00')").alias("created_at"),
        F.when(i % 4 == 0, None).otherwise(F.expr("timestampadd(DAY, cast(doc_id % 45 as int), timestamp_ntz'2024-01-01 00:00:00')")).alias("last_accessed_at"),
        F.col("source").alias("folder"),
        F.col("lang"),
    ).withColumn("valid_from", F.coalesce("created_at", start))
    return out.withColumn("entity_ids", entities(F.col("content"))) if with_entities else out


#: The same rows in DuckDB.
MEMORIES_SQL = """memories AS (SELECT doc_id AS id, coalesce(text, '') AS content,
  ['identity','preference','skill','context','fact','episodic','temporal','relationship'][doc_id % 8 + 1] AS category,
  CASE doc_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' ELSE 'document' END AS source, doc_id % 5 = 0 AS verified,
  (doc_id % 21) / 2.0 AS usefulness_score, (doc_id * 7 % 21) / 2.0 AS staleness_score, CAST(doc_id % 4 AS INT) AS retrieval_count,
  (doc_id * 7 % 21) / 2.0 >= 7 AS is_stale, doc_id % 17 <> 0 AS is_active, doc_id % 17 = 0 AS is_archived,
  doc_id % 13 = 0 AS flagged_for_review, doc_id % 19 = 0 AS is_note,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 1000 AS INT)) AS created_at,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 45 AS INT)) END AS last_accessed_at,
  source AS folder, lang, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 1000 AS INT)) AS valid_from FROM documents)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns without times."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("seq"), F.lit(None).cast("timestamp_ntz").alias("ts"), "role", F.coalesce("text", F.lit("")).alias("text"))


def timed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as one session of timed turns: clicks and views by the user, the rest by the assistant."""
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_type").isin("click", "view"), "user").otherwise("assistant")
    seq = F.row_number().over(_by_user()) - 1
    return e.select(F.col("user_id").alias("session_id"), seq.cast("int").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"), role.alias("role"), F.col("event_type").alias("text"), "event_id")


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


TIMED_TURNS_SQL = """turns AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, ts,
  CASE WHEN event_type IN ('click', 'view') THEN 'user' ELSE 'assistant' END AS role, event_type AS text, event_id FROM events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: path and folder from the url, size from the html, a time from the id."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.col("url"), r"^[a-z]+://|[?#].*$", "")
    mtime = F.col("page_id") * 97 % 400000 + 1704067200
    return p.select("page_id", path.alias("path"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"), F.length("html").cast("long").alias("size"), mtime.cast("double").alias("mtime"), "html")


FILES_SQL = r"""files AS (SELECT page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name,
  length(html) AS size, CAST(page_id * 97 % 400000 + 1704067200 AS DOUBLE) AS mtime, html
  FROM (SELECT *, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as typed links between parts and suppliers."""
    line = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(F.lit("relates_to"), F.lit("uses"), F.lit("depends_on")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return line.groupBy(F.col("l_partkey").alias("source_memory_id"), (F.col("l_suppkey") + 1_000_000).alias("target_memory_id"), kind.alias("link_type")).agg(F.round(F.max(F.col("l_discount")) * 10, 6).alias("strength"))


EDGES_SQL = """edges AS (SELECT l_partkey AS source_memory_id, l_suppkey + 1000000 AS target_memory_id,
  ['relates_to','uses','depends_on'][l_linenumber % 3 + 1] AS link_type, round(max(l_discount) * 10, 6) AS strength
  FROM lineitem GROUP BY 1, 2, 3)"""
