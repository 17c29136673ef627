"""Search over written indexes that came about in several steps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import history
from tessera.operators.index import Index
from tessera.operators.search import Around, full_search, search
from tessera.operators.sync import RECORD_TYPE
from tessera.plans.shared import folder, materialize, over_cores
from tessera.queries import query
from tessera.queries.history import _FL, _ascii_turns
from tessera.queries.retrieval import _EFF, _MM, TEXT, K, _hybrid_sql, _two_sql, bm25_sql, trigram_sql
from tessera.settings import Notes
from tessera.sources.tables import MEMORIES_SQL, NOW, memories, table


def stepwise(spark, records, kind: str) -> Index:
    """An index of ``records`` (id, content) that took rows in, replaced some and lost others."""
    ix, id_ = Index(spark, folder(spark, kind), kind), F.col("id")
    rows = over_cores(records.select("id", "content"))
    first = rows.where("id % 3 <> 0").withColumn("content", F.when(id_ % 10 == 0, F.concat(F.col("content"), F.lit(" of of the heading, to be replaced"))).otherwise(F.col("content")))
    extra = rows.where("id % 11 = 0").withColumn("id", -1 - id_)
    ix.put(first.unionByName(extra))
    ix.put(rows.where("id % 3 = 0"))
    ix.put(rows.where("id % 10 = 0 and id % 3 <> 0"))
    ix.delete(extra.select("id"))
    return ix


@query(f"WITH {MEMORIES_SQL}, {bm25_sql(TEXT)} SELECT id, score FROM scores")
def bm25_indexed(spark, sf_dir):
    """All hits by words, from the index."""
    return stepwise(spark, memories(spark, sf_dir), "plain").ranked(TEXT)


@query(f"WITH {MEMORIES_SQL}, {bm25_sql(TEXT)} SELECT id, score FROM scores ORDER BY score DESC, id LIMIT {K}")
def bm25_indexed_top_k(spark, sf_dir):
    """The best hits; spans that cannot hold one are not opened."""
    return stepwise(spark, memories(spark, sf_dir), "plain").top(TEXT, K)


@query()
def bm25_porter(spark, sf_dir):
    """The best hits by folded stems, as full-text search has them; held against SQLite in the tests."""
    return stepwise(spark, memories(spark, sf_dir), "stems").top("running headings of the nations", K)


@query(f"WITH {MEMORIES_SQL}, {trigram_sql(TEXT + ' ther')} SELECT id, score FROM scores")
def trigram_indexed(spark, sf_dir):
    """All hits by substrings, from the places of trigrams; no text is read."""
    return stepwise(spark, memories(spark, sf_dir), "grams").ranked(TEXT + " ther")


def _indexes(spark, records):
    return stepwise(spark, records, "plain"), stepwise(spark, records, "grams")


@query(_hybrid_sql("NOT is_archived AND is_active AND NOT is_stale"))
def hybrid_indexed(spark, sf_dir):
    m = memories(spark, sf_dir)
    return search(m, TEXT, NOW, K, indexes=_indexes(spark, m))


_LINKS = "links AS (SELECT doc_id AS a, doc_id % 97 AS b, 'relates_to' AS link_type, (doc_id % 7) / 10.0 AS strength FROM documents WHERE doc_id >= 97 UNION ALL SELECT doc_id, doc_id % 50, 'annotates', (doc_id % 7) / 10.0 FROM documents WHERE doc_id % 19 = 0)"
_BEST = _hybrid_sql("NOT is_archived AND is_active AND NOT is_stale").removeprefix(f"WITH {MEMORIES_SQL}, ")


@query(
    f"""WITH {MEMORIES_SQL}, {_LINKS}, best AS (WITH {_BEST}),
 e AS (SELECT a, b FROM links WHERE strength >= 0.3 UNION SELECT b, a FROM links WHERE strength >= 0.3 AND link_type = 'relates_to'),
 near AS (SELECT DISTINCT e.b AS id FROM best JOIN e ON e.a = best.id WHERE e.b NOT IN (SELECT id FROM best) AND e.b IN (SELECT id FROM memories)),
 found AS (SELECT id, CAST(score AS DOUBLE) AS score, 0 AS origin FROM best UNION ALL SELECT id, 0.0, 1 FROM near),
 note AS (SELECT l.b AS id, l.a AS note_id, row_number() OVER (PARTITION BY l.b ORDER BY l.strength DESC, m.created_at DESC, l.a) AS rank FROM links l JOIN memories m ON m.id = l.a WHERE l.link_type = 'annotates' AND m.is_note AND m.is_active AND NOT m.is_archived)
 SELECT found.id, score, origin, row_number() OVER (ORDER BY origin, score DESC, found.id) AS place, note_id FROM found LEFT JOIN note ON note.id = found.id AND rank = 1"""
)
def hybrid_full(spark, sf_dir):
    """Search as a user meets it, from the indexes: ranked, filtered, with neighbours and the best note on each."""
    m, d, i = memories(spark, sf_dir), table(spark, sf_dir, "documents"), F.col("doc_id")
    link = lambda rows, target, kind: rows.select(i.alias("source_memory_id"), target.alias("target_memory_id"), F.lit(kind).alias("link_type"), ((i % 7) / 10.0).alias("strength"))
    links = link(d.where("doc_id >= 97"), i % 97, "relates_to").unionByName(link(d.where("doc_id % 19 = 0"), i % 50, "annotates"))
    logs = [spark.createDataFrame([], ddl.replace("memory_id string", "memory_id long")) for ddl in (schema.QUERY_SESSIONS, schema.QUERY_RESULTS)]
    got = full_search(m, links, *logs, TEXT, NOW, "s1", K, around=Around(1, 0.3), notes=Notes(auto_include_cap=1), indexes=_indexes(spark, m))
    notes = got.notes.select(F.col("result_id").alias("id"), "note_id")
    return got.results.join(notes, "id", "left").select("id", "score", "origin", F.col("place").cast("long").alias("place"), "note_id")


_SEGMENTS = f"""{_FL}, memories AS (SELECT session_id AS id, trim(concat_ws(' ', asked, outcome)) AS content, 0.0 AS usefulness_score, 0.0 AS staleness_score, CAST(NULL AS TIMESTAMP) AS last_accessed_at, FALSE AS is_note,
 'r' || (session_id % 3) AS repo, CASE WHEN session_id % 7 = 0 THEN NULL ELSE TIMESTAMP '{NOW}' - to_days(CAST(session_id % 60 AS INT)) END AS valid_from FROM fl)"""


@query(
    f"""WITH {_SEGMENTS}, {_two_sql(1.0).replace("LIMIT 50", "LIMIT 500")}, {_MM}, got AS (SELECT id, round(relevance + {_EFF}, 6) AS score, repo, valid_from FROM mm JOIN memories USING (id) ORDER BY score DESC, id LIMIT 100),
 best AS (SELECT * FROM got WHERE repo = 'r1' AND (valid_from IS NULL OR valid_from >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY))
 SELECT CAST(id AS VARCHAR) AS session_id, row_number() OVER (ORDER BY score DESC, id) AS place FROM best ORDER BY place LIMIT {K}"""
)
def history_search(spark, sf_dir):
    """The best segments of one repository in the last thirty days, from the indexes."""
    t = _ascii_turns(spark, sf_dir)
    own = t.groupBy("session_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("seq"))).alias("asked"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("seq"))).alias("outcome"))
    day = F.expr(f"timestampadd(DAY, -cast(session_id % 60 as int), timestamp_ntz'{NOW}')")
    i, no, zero = F.col("session_id"), F.lit(False), F.lit(0.0)
    cells = {"record_type": F.lit(RECORD_TYPE), "repo": F.concat(F.lit("r"), (i % 3).cast("string")), "session_id": i.cast("string"), "segment_index": F.lit(0)}
    rows = own.select(
        i.alias("id"), F.trim(F.concat_ws(" ", "asked", "outcome")).alias("content"), zero.alias("usefulness_score"), zero.alias("staleness_score"), F.lit(None).cast("timestamp_ntz").alias("last_accessed_at"),
        no.alias("is_note"), no.alias("is_archived"), F.lit(True).alias("is_active"), no.alias("is_stale"), F.when(i % 7 != 0, day).alias("valid_from"), F.to_json(F.struct(*[v.alias(k) for k, v in cells.items()])).alias("metadata"),
    )
    rows = materialize(rows, "segments")
    got = history.search(rows, TEXT, datetime.fromisoformat(NOW), repo="r1", since="30d", limit=K, indexes=_indexes(spark, rows))
    return got.select("session_id", F.col("place").cast("long").alias("place"))
