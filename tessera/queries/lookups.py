"""Lookups, inserts and updates of records; links, notes, images; evaluators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import distinctive_tokens
from tessera.operators import cochange as X
from tessera.operators import evaluate, images, records
from tessera.operators.cochange import path_distance
from tessera.operators.sync import history_stats as segment_stats
from tessera.queries import query
from tessera.queries.ingest import _CL, _members
from tessera.queries.retrieval import _NEAR, vector_neighbours
from tessera.sources.tables import EDGES_SQL, FILES_SQL, MEMORIES_SQL, NOW, edges, files, memories, table


@query(f"WITH {MEMORIES_SQL} SELECT id, category, is_note FROM memories WHERE id = 19")
def point_lookup(spark, sf_dir):
    return records.point(memories(spark, sf_dir), 19).select("id", "category", "is_note")


@query(f"WITH {MEMORIES_SQL} SELECT id, category FROM memories WHERE id IN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)")
def in_list_scan(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return records.among(memories(spark, sf_dir), ids).select("id", "category")


@query(f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE is_active AND NOT is_archived")
def active_scan(spark, sf_dir):
    return records.active(memories(spark, sf_dir)).select("id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 2 = 0 AS verified, len(['a', CAST(doc_id AS VARCHAR)]) AS n, CAST(doc_id AS DOUBLE) AS confidence, '2024-01-02' AS day FROM documents")
def rows_to_records(spark, sf_dir):
    """Text cells, as a row store keeps them, to typed records."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    rows = d.select(i.alias("id"), F.to_json(F.array(F.lit("a"), i)).alias("entity_ids"), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("0").alias("verified"), i.alias("confidence"), F.lit("2024-01-02T03:04:05").alias("created_at"))
    return records.from_rows(rows).select("id", "verified", F.size("entity_ids").cast("long").alias("n"), "confidence", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'fact' AS category, true AS is_active, 0.0 AS usefulness_score, length(text) AS n FROM documents WHERE length(text) BETWEEN 1 AND 10000")
def insert_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.lit("fact").alias("category"), F.lit("document").alias("source"))
    return records.new_records(d, NOW).select("id", "category", "is_active", "usefulness_score", F.length("content").cast("long").alias("n"))


@query(f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN id % 10 = 1 THEN 'fact' ELSE category END AS category, CASE WHEN id % 10 = 1 THEN NULL ELSE retrieval_count END AS retrieval_count FROM memories")
def partial_update(spark, sf_dir):
    """Two cells of every tenth record change, one of them to null."""
    m = memories(spark, sf_dir).select("id", "category", "retrieval_count")
    ch = m.where("id % 10 = 1").select("id", F.lit("fact").alias("category"), F.lit(None).cast("int").alias("retrieval_count"))
    return records.partial_update(m, ch, NOW)


@query(f"WITH {EDGES_SQL} SELECT * FROM edges UNION (SELECT 1, 2, 'similar_to', 1.0) UNION (SELECT 2, 1, 'similar_to', 1.0)")
def manual_link(spark, sf_dir):
    return records.manual_link(edges(spark, sf_dir), spark.range(10).select("id"), 1, 2, "similar_to", NOW)


@query("SELECT n_name AS concept, CAST(n_regionkey AS BIGINT) AS memory_count FROM nation WHERE n_nationkey % 2 = 0")
def summaries_listed(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select(F.col("n_name").alias("concept"), F.col("n_regionkey").cast("long").alias("memory_count"), (F.col("n_nationkey") % 2 == 0).alias("is_current"))
    return records.summaries(t).select("concept", "memory_count")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS memory_id, CASE WHEN o_orderkey % 3 = 0 THEN 2.0 ELSE 1.0 END AS relevance_score FROM orders")
def results_replaced(spark, sf_dir):
    """Results recorded twice for one session: the later scores stand."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    empty = spark.createDataFrame([], "session_id string, memory_id string, relevance_score double, was_accessed boolean, was_useful boolean, was_stale boolean")
    first = records.record_results(empty, "s", o.withColumn("score", F.lit(1.0)))
    return records.record_results(first, "s", o.where("id % 3 = 0").withColumn("score", F.lit(2.0))).select("memory_id", "relevance_score")


@query(f"WITH {MEMORIES_SQL} SELECT 'never_accessed_stale' AS kind, id FROM memories WHERE last_accessed_at IS NULL AND staleness_score >= 3 AND NOT is_archived AND NOT is_note UNION ALL SELECT 'stale_but_useful', id FROM memories WHERE staleness_score >= 5 AND usefulness_score >= 3 AND NOT is_archived AND NOT is_note")
def helper_anomalies(spark, sf_dir):
    m = memories(spark, sf_dir)
    a, b = records.never_accessed_stale(m), records.stale_but_useful(m)
    return a.select(F.lit("never_accessed_stale").alias("kind"), "id").unionByName(b.select(F.lit("stale_but_useful").alias("kind"), "id"))


@query(f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE is_note AND NOT is_archived ORDER BY created_at DESC, id LIMIT 50")
def notes_recent(spark, sf_dir):
    return records.list_notes(memories(spark, sf_dir), NOW).select("id")


@query(f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE is_note AND valid_from > TIMESTAMP '2024-01-15' ORDER BY valid_from, id LIMIT 50")
def notes_to_come(spark, sf_dir):
    return records.list_notes(memories(spark, sf_dir), "2024-01-15 00:00:00", upcoming=True).select("id")


@query(f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE is_note AND NOT is_archived AND valid_from < TIMESTAMP '2024-01-15' ORDER BY valid_from, id LIMIT 50")
def notes_past_due(spark, sf_dir):
    return records.list_notes(memories(spark, sf_dir), "2024-01-15 00:00:00", overdue=True).select("id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k') <> '50'")
def json_null_safe(spark, sf_dir):
    k = records.meta("k", "props")
    return table(spark, sf_dir, "events").where(k.isNull() | (k != "50")).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.nothing') IS NULL AND json_extract_string(props, '$.k') = '7'")
def json_is_null(spark, sf_dir):
    return table(spark, sf_dir, "events").where(records.meta("nothing", "props").isNull() & (records.meta("k", "props") == "7")).select("event_id")


# Documents as image files: every document a file, every eleventh a description of the one before.
_EXTS = (".jpg", ".png", ".svg", ".psd", ".txt")
_PICS = f"""{MEMORIES_SQL}, f AS (SELECT id, is_archived, is_note, ['.jpg','.png','.svg','.psd','.txt'][id % 5 + 1] AS ext, 'd/' || id AS rel FROM memories WHERE id % 11 <> 0),
 told AS (SELECT id - 1 AS file FROM memories WHERE id % 11 = 0 AND NOT is_archived AND NOT is_note)"""


def _pictures(spark, sf_dir):
    m = memories(spark, sf_dir)
    i = F.col("id")
    ext = F.get(F.array(*[F.lit(x) for x in _EXTS]), F.pmod(i, F.lit(5)).cast("int"))
    file = F.to_json(F.struct(ext.alias("ext"), F.concat(F.lit("d/"), i.cast("string")).alias("rel"), F.concat(F.lit("/d/"), i.cast("string")).alias("path"), i.alias("size")))
    rows = m.withColumn("metadata", F.when(i % 11 == 0, F.lit('{"kind":"image_description"}')).otherwise(file))
    links = m.where("id % 11 = 0").select(i.alias("source_memory_id"), (i - 1).alias("target_memory_id"), F.lit("annotates").alias("link_type"), F.lit(1.0).alias("strength"))
    return rows, links


@query(f"WITH {_PICS} SELECT id, rel, CASE ext WHEN '.jpg' THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM f WHERE NOT is_archived AND ext IN ('.jpg', '.png') AND id NOT IN (SELECT file FROM told)")
def image_jobs(spark, sf_dir):
    return images.jobs(*_pictures(spark, sf_dir)).select("id", "rel", "mime")


@query(f"WITH {_PICS} SELECT id FROM f WHERE NOT is_archived AND ext IN ('.jpg', '.png', '.svg') AND rel = 'd/5'")
def image_file(spark, sf_dir):
    return images.find(_pictures(spark, sf_dir)[0], "d/5").select("id")


@query(f"WITH {_PICS} SELECT file AS result_id, file + 1 AS id FROM told WHERE file >= 0 AND file IN (SELECT id FROM memories)")
def annotating_descriptions(spark, sf_dir):
    rows, links = _pictures(spark, sf_dir)
    return records.annotating(rows, links, rows, 1, images.DESCRIPTION).select("result_id", "id")


@query(f"WITH {MEMORIES_SQL}, s AS (SELECT *, ['claude-code','codex'][id % 2 + 1] AS collection, id % 7 AS sid, strftime(valid_from, '%Y-%m-%d') AS day FROM memories WHERE NOT is_archived) SELECT 'all' AS \"by\", '*' AS name, count(*) AS segments, count(DISTINCT sid) AS sessions, min(day) AS earliest, max(day) AS latest FROM s UNION ALL SELECT 'collection', collection, count(*), count(DISTINCT sid), min(day), max(day) FROM s GROUP BY collection UNION ALL SELECT 'kind', category, count(*), count(DISTINCT sid), min(day), max(day) FROM s GROUP BY category")
def history_by_collection(spark, sf_dir):
    m = memories(spark, sf_dir)
    i = F.col("id")
    meta = F.to_json(F.struct(F.lit("session_summary").alias("record_type"), F.when(i % 2 == 0, "claude-code").otherwise("codex").alias("collection"), F.col("category").alias("kind"), (i % 7).cast("string").alias("session_id")))
    return segment_stats(m.withColumn("metadata", meta))


@query(f"WITH {EDGES_SQL}, d AS (SELECT id, count(*) AS degree FROM (SELECT source_memory_id AS id FROM edges UNION ALL SELECT target_memory_id FROM edges) GROUP BY id) SELECT list_sort(list(degree))[CAST(least(count(*) - 1, floor(count(*) * 0.9)) AS BIGINT) + 1] AS degree FROM d")
def degree_percentile(spark, sf_dir):
    from tessera.operators.graph import degrees

    return evaluate.nearest_rank(degrees(edges(spark, sf_dir)), "degree", 0.9)


@query(f"WITH {EDGES_SQL}, n AS (SELECT link_type, count(*) AS n FROM edges GROUP BY link_type ORDER BY n DESC, link_type LIMIT 2) SELECT (SELECT count(*) FROM edges) AS links, round(100.0 * sum(n) / (SELECT count(*) FROM edges), 1) AS pct FROM n")
def link_share(spark, sf_dir):
    return evaluate.top_share(edges(spark, sf_dir).withColumnRenamed("link_type", "entity"), 2)


_REL = "rel AS (SELECT a.vec_id AS query_id, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND b.vec_id % 7 = 0 WHERE a.vec_id % 50 = 0)"


@query(f"WITH {_NEAR}, {_REL}, h AS (SELECT rel.query_id, count(*) AS relevant, count(ranked.id) AS hits FROM rel LEFT JOIN ranked ON ranked.query_id = rel.query_id AND ranked.id = rel.id AND ranked.rank <= 10 GROUP BY rel.query_id) SELECT query_id, relevant, hits, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS recall_any, round(hits / relevant, 6) AS recall FROM h")
def recall_at_k(spark, sf_dir):
    """Rankings of vectors against those of one label whose id is divisible by 7."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    a = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label")
    rel = a.join(v.where("id % 7 = 0"), "label").where("query_id <> id").select("query_id", "id")
    return evaluate.judged(vector_neighbours(spark, sf_dir), rel, 10).withColumn("recall", F.round("recall", 6))


_TOK = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '\\b\\d[\\d.,:/-]*\\b|\\b[A-Z]{{2,}}\\b|\"[^\"]{{2,40}}\"'), lambda x: lower(trim(x, '\"'))))"


@query(f"SELECT event_id, CASE WHEN len(have) > 0 THEN round(len(list_intersect(have, got)) / len(have), 6) END AS coverage FROM (SELECT event_id, {_TOK('props')} AS have, {_TOK('substr(props, 1, 8)')} AS got FROM events)")
def summary_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.substring("props", 1, 8).alias("summary"), F.array("props").alias("sources"))
    return evaluate.coverage(e).select(F.col("key").alias("event_id"), F.round("coverage", 6).alias("coverage"))


@query(f"SELECT event_id, len({_TOK('props')}) AS n FROM events")
def distinctive(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.size(distinctive_tokens(F.col("props"))).cast("long").alias("n"))


@query(f"WITH {FILES_SQL}, p AS (SELECT a.page_id, list_filter(string_split(a.folder, '/'), lambda x: x <> '') AS pa, list_filter(string_split(b.folder, '/'), lambda x: x <> '') AS pb FROM files a JOIN files b ON b.page_id = a.page_id + 1), c AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(pa), len(pb)) + 1), lambda i: pa[i] = pb[i]), false), least(len(pa), len(pb)) + 1) - 1 AS common FROM p) SELECT page_id, round((len(pa) + len(pb) - 2 * common) / greatest(1, len(pa) + len(pb)), 6) AS distance FROM c")
def path_distances(spark, sf_dir):
    f = files(spark, sf_dir)
    b = f.select((F.col("page_id") - 1).alias("page_id"), F.col("folder").alias("other"))
    return f.join(b, "page_id").select("page_id", F.round(path_distance(F.col("folder"), F.col("other")), 6).alias("distance"))


@query(f"WITH {_CL}, s AS (SELECT cluster, doc_id, mtime FROM c WHERE size BETWEEN 2 AND 50) SELECT a.cluster AS changeset_id, a.doc_id AS source, b.doc_id AS target, 1.0 AS strength FROM s a JOIN s b ON a.cluster = b.cluster AND (a.mtime, a.doc_id) < (b.mtime, b.doc_id)")
def change_pair_edges(spark, sf_dir):
    m = _members(spark, sf_dir).select(F.col("cluster").alias("changeset_id"), "doc_id", "mtime", F.lit(1.0).alias("strength"))
    size = m.groupBy("changeset_id").agg(F.count("*").alias("n")).where("n <= 50")
    return X.pair_edges(m.join(size, "changeset_id", "left_semi"))


@query(f"WITH {FILES_SQL} SELECT page_id FROM files WHERE lower(regexp_extract(path, '[^/.](\\.[^./]+)$', 1)) NOT IN ('.html', '.png', '.jar')")
def without_suffixes(spark, sf_dir):
    return X.without_suffixes(files(spark, sf_dir), "path", (".html",)).select("page_id")


@query(f"WITH {MEMORIES_SQL} SELECT id, strftime(valid_from, '%Y-%m-%d') AS date, CASE WHEN id % 4 = 0 THEN 'c' ELSE '' END AS collection FROM memories WHERE source = 'document' AND NOT is_archived AND id % 3 <> 1 AND id % 6 <> 5 AND valid_from BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-02-01' ORDER BY memories.valid_from DESC, id LIMIT 200")
def documents_without_chunks(spark, sf_dir):
    """Every other document is a piece of a body and left out."""
    m = memories(spark, sf_dir)
    i = F.col("id")
    meta = F.to_json(F.struct(F.when(i % 6 == 5, "chunk").alias("record_role"), F.when(i % 4 == 0, "c").alias("collection")))
    got = X.documents_timeline(m.withColumn("metadata", meta), "2024-01-05 00:00:00", "2024-02-01 00:00:00", limit=200)
    return got.select("id", "date", "collection")
