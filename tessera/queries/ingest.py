"""Files, manifests, chunks, co-change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import chunks, clean_markdown, human_size, mime, snippet, suffix, text_route, type_label
from tessera.operators import cochange as X
from tessera.operators.dedup import Contents
from tessera.operators.state import Snapshots, latest
from tessera.plans.shared import folder
from tessera.queries import query
from tessera.settings import Documents
from tessera.sources.files import classify, prune, siblings
from tessera.sources.tables import FILES_SQL, MEMORIES_SQL, files, memories, table


@query("SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY coalesce(text, '')")
def exact_dedup(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").groupBy(F.sha2(t, 256).alias("content_hash")).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))


_TEXT = "coalesce(text, 'null')"


@query(f"SELECT min(doc_id) AS id, sha256({_TEXT}) AS digest FROM documents WHERE doc_id % 3 <> 0 AND {_TEXT} NOT IN (SELECT {_TEXT} FROM documents WHERE doc_id % 3 = 0) GROUP BY {_TEXT}")
def new_contents(spark, sf_dir):
    """A batch's contents that a store, which took the other documents in two runs, does not hold."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("null")).alias("content"))
    known = Contents(Snapshots(spark, folder(spark, "contents")))
    for part in ("id % 6 = 0", "id % 6 = 3"):
        known.add(known.fresh(d.where(part)))
    return known.fresh(d.where("id % 3 <> 0")).select("id", "digest")


_MAN = f"{FILES_SQL}, one AS (SELECT path, max(size) AS size, max(mtime) AS mtime FROM files GROUP BY path), man AS (SELECT path, size + CASE WHEN size % 5 = 0 THEN 1 ELSE 0 END AS size, mtime, CASE WHEN size % 7 = 0 THEN 'metadata' ELSE 'content' END AS index_mode FROM one WHERE size % 3 <> 0 UNION ALL SELECT path || '.gone', size, mtime, 'content' FROM one WHERE size % 11 = 0)"


def _manifest(spark, sf_dir):
    one = files(spark, sf_dir).groupBy("path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    live = one.where("size % 3 <> 0").select("path", (F.col("size") + F.when(F.col("size") % 5 == 0, 1).otherwise(0)).alias("size"), "mtime", F.when(F.col("size") % 7 == 0, "metadata").otherwise("content").alias("index_mode"))
    gone = one.where("size % 11 = 0").select(F.concat("path", F.lit(".gone")).alias("path"), "size", "mtime", F.lit("content").alias("index_mode"))
    return one, live.unionByName(gone)


@query(f"WITH {_MAN} SELECT one.path, CASE WHEN man.path IS NULL THEN 'new' WHEN man.size = one.size AND abs(man.mtime - one.mtime) < 1e-6 AND man.index_mode IN ('content', 'vision') THEN 'unchanged' ELSE 'changed' END AS state FROM one LEFT JOIN man USING (path)")
def manifest_diff(spark, sf_dir):
    return classify(*_manifest(spark, sf_dir), "content").select("path", "state")


@query(f"WITH {_MAN} SELECT path FROM man WHERE path NOT IN (SELECT path FROM one)")
def manifest_prune(spark, sf_dir):
    return prune(*_manifest(spark, sf_dir)).select("path")


@query(f"WITH {FILES_SQL} SELECT path, page_id, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, page_id DESC) AS n FROM files) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    return latest(files(spark, sf_dir), ["path"], [F.desc("mtime"), F.desc("page_id")]).select("path", "page_id", "size")


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(trim(coalesce(text, ''), {_BLANK}), chr(10) || chr(10)), lambda x: length(trim(x, {_BLANK}))), lambda n: n > 0) AS p FROM documents),
 f AS (SELECT doc_id, list_reduce(list_prepend({{'n': 0::BIGINT, 'total': 0::BIGINT, 'buf': 0::BIGINT}}, list_transform(p, lambda x: {{'n': 0::BIGINT, 'total': 0::BIGINT, 'buf': x::BIGINT}})), lambda a, x: CASE
   WHEN x.buf > 1000 THEN {{'n': a.n + CAST(a.buf > 0 AS BIGINT) + (x.buf + 999) // 1000, 'total': a.total + a.buf + x.buf, 'buf': 0::BIGINT}}
   WHEN a.buf > 0 AND a.buf + 2 + x.buf > 1000 THEN {{'n': a.n + 1, 'total': a.total + a.buf, 'buf': x.buf}}
   ELSE {{'n': a.n, 'total': a.total, 'buf': CASE WHEN a.buf > 0 THEN a.buf + 2 + x.buf ELSE x.buf END}} END) AS f FROM p)
 SELECT doc_id, f.n + CAST(f.buf > 0 AS BIGINT) AS n, f.total + f.buf AS total FROM f"""
)
def chunk_hard(spark, sf_dir):
    """Every text in chunks of paragraphs, up to 1000 characters each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    c = chunks(F.col("t"), 1000)
    return d.select("doc_id", F.size(c).cast("long").alias("n"), F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("total"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '(?s)<!--.*?-->', '', 'g'), '[^\S\n]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+\z', '', 'g')"


@query(f"SELECT page_id, {_CLEAN} AS text FROM pages")
def clean_markdown_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean_markdown(F.col("html")).alias("text"))


_SFX = "lower(regexp_extract(path, '[^/.](\\.[^./]+)$', 1))"


@query(f"WITH {FILES_SQL} SELECT page_id, {_SFX} AS suffix, CASE WHEN {_SFX} = '' THEN 'file' WHEN {_SFX} IN ('.html', '.htm') THEN 'HTML page' ELSE upper(substr({_SFX}, 2)) || ' file' END AS label, CASE WHEN {_SFX} IN ('.html', '.htm') THEN 'convert' ELSE 'unknown' END AS route, 'application/octet-stream' AS mime FROM files")
def suffix_dispatch(spark, sf_dir):
    s = suffix(F.col("path"))
    return files(spark, sf_dir).select("page_id", s.alias("suffix"), type_label(s).alias("label"), text_route(s).alias("route"), mime(s).alias("mime"))


@query(f"WITH {FILES_SQL} SELECT page_id, CASE WHEN size < 1024 THEN size || ' B' ELSE format('{{:.1f}} KB', round(size / 1024.0, 1)) END AS size FROM files")
def human_sizes(spark, sf_dir):
    return files(spark, sf_dir).select("page_id", human_size(F.col("size")).alias("size"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN rtrim(substr(text, 1, 200)) || '…' ELSE text END AS snippet FROM documents")
def concise_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


@query(f"WITH {FILES_SQL}, n AS (SELECT DISTINCT folder, path, name FROM files), l AS (SELECT folder, count(*) AS n, list_sort(list(name))[1:13] AS names FROM n GROUP BY folder) SELECT folder, n, list_aggregate(names, 'string_agg', ', ') AS names FROM l")
def folder_siblings(spark, sf_dir):
    return siblings(files(spark, sf_dir)).withColumn("names", F.array_join("names", ", "))


_DOCS = f"{MEMORIES_SQL}, docs AS (SELECT id AS doc_id, folder, CAST(1704067200 + id * 7919 % 60000 AS DOUBLE) AS mtime FROM memories), b AS (SELECT *, CAST(floor(mtime / 86400) AS BIGINT) AS bucket FROM docs)"


def _docs(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.select(F.col("id").alias("doc_id"), "folder", (F.lit(1704067200) + F.col("id") * 7919 % 60000).cast("double").alias("mtime"))


@query(f"WITH {_DOCS} SELECT doc_id, folder, bucket, row_number() OVER (PARTITION BY folder, bucket ORDER BY mtime, doc_id) AS place FROM b")
def blocks(spark, sf_dir):
    return X.blocks(_docs(spark, sf_dir), Documents(block_cap=2**31 - 1)).select("doc_id", "folder", "bucket", F.col("place").cast("long").alias("place"))


ALL = Documents(block_cap=2**31 - 1, eps=0.35, tau=3600.0)


@query(f"WITH {_DOCS}, p AS (SELECT folder, bucket, doc_id AS b, mtime, lag(doc_id) OVER w AS a, lag(mtime) OVER w AS pm FROM b WINDOW w AS (PARTITION BY folder, bucket ORDER BY mtime, doc_id)) SELECT a, b FROM p WHERE a IS NOT NULL AND least(1.0, abs(mtime - pm) / 3600.0) / 1.5 <= 0.35")
def change_neighbours(spark, sf_dir):
    return X.neighbours(X.blocks(_docs(spark, sf_dir), ALL), ALL).select(F.col("b").alias("a"), F.col("a").alias("b"))


_CL = f"{_DOCS}, p AS (SELECT *, CASE WHEN lag(mtime) OVER w IS NULL OR least(1.0, abs(mtime - lag(mtime) OVER w) / 3600.0) / 1.5 > 0.35 THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY folder, bucket ORDER BY mtime, doc_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY folder, bucket ORDER BY mtime, doc_id) AS isle FROM p), c AS (SELECT *, min(doc_id) OVER (PARTITION BY folder, bucket, isle) AS cluster, count(*) OVER (PARTITION BY folder, bucket, isle) AS size FROM i)"


@query(f"WITH {_CL} SELECT doc_id, cluster FROM c WHERE size > 1")
def change_components(spark, sf_dir):
    return X.clusters(X.blocks(_docs(spark, sf_dir), ALL), ALL)


def _members(spark, sf_dir):
    return change_components(spark, sf_dir).join(_docs(spark, sf_dir), "doc_id")


@query(f"WITH {_CL} SELECT substr(sha1(list_aggregate(list_sort(list(CAST(doc_id AS VARCHAR))), 'string_agg', '|') || '@' || CAST(CAST(max(mtime) AS BIGINT) AS VARCHAR)), 1, 16) AS changeset_id, max(mtime) AS observed_at, count(*) AS size FROM c WHERE size > 1 GROUP BY cluster HAVING count(*) <= 50")
def changeset_ids(spark, sf_dir):
    return X.changesets(_members(spark, sf_dir), ALL).select("changeset_id", "observed_at", "size")


@query(f"WITH {_DOCS}, g AS (SELECT doc_id, folder, mtime, CASE WHEN mtime - lag(mtime) OVER w > 7200 THEN 1 ELSE 0 END AS new FROM docs WINDOW w AS (PARTITION BY folder ORDER BY mtime, doc_id)) SELECT doc_id, sum(new) OVER (PARTITION BY folder ORDER BY mtime, doc_id) AS part FROM g")
def gap_split(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumnRenamed("folder", "cluster")
    return X.split_gaps(d, Documents(gap=7200.0)).select("doc_id", "part")


@query(f"WITH {_CL}, m AS (SELECT cluster AS changeset_id, doc_id, lead(doc_id) OVER (PARTITION BY cluster ORDER BY mtime, doc_id) AS nxt FROM c WHERE size > 1) SELECT changeset_id, doc_id AS source, nxt AS target FROM m WHERE nxt IS NOT NULL")
def before_edges(spark, sf_dir):
    return X.before_edges(_members(spark, sf_dir).withColumnRenamed("cluster", "changeset_id"))


@query(f"WITH {_CL}, f AS (SELECT cluster FROM c WHERE size > 1 ORDER BY cluster LIMIT 1) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS strength FROM c, f WHERE c.cluster = f.cluster AND doc_id <> f.cluster")
def changed_with(spark, sf_dir):
    m = _members(spark, sf_dir).select(F.col("cluster").alias("changeset_id"), "doc_id", "mtime")
    row = m.select("changeset_id").orderBy("changeset_id").head(1)
    first = row[0][0] if row else -1
    links = m.where((F.col("changeset_id") == first) & (F.col("doc_id") % 2 == 0)).select(F.lit(first).alias("source"), F.col("doc_id").alias("target"), F.lit(0.5).alias("strength"))
    return X.changed_with(m, links, first)


@query(f"WITH {MEMORIES_SQL} SELECT id, folder, strftime(valid_from, '%Y-%m-%d %H:%M') AS valid_from FROM memories WHERE source = 'document' AND NOT is_archived AND valid_from BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-02-01' ORDER BY memories.valid_from DESC, id LIMIT 200")
def documents_timeline(spark, sf_dir):
    m = memories(spark, sf_dir).where("source = 'document' and not is_archived and valid_from between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-02-01 00:00:00'")
    return m.orderBy(F.desc("valid_from"), "id").limit(200).select("id", "folder", F.date_format("valid_from", "yyyy-MM-dd HH:mm").alias("valid_from"))


@query("SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS VARCHAR) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "n")
