"""Entities, links and traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import CAP_PHRASE, CAP_WORD, QUOTED, STOP_WORDS, ascii_only, entities
from tessera.operators import graph
from tessera.operators.components import connected_components
from tessera.operators.search import with_notes
from tessera.plans.shared import materialize, over_cores
from tessera.queries import query
from tessera.settings import Links
from tessera.sources.tables import EDGES_SQL, MEMORIES_SQL, edges, memories, table

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
ENT_SQL = f"""{MEMORIES_SQL}, raw AS (SELECT id, is_active, is_archived, regexp_replace(content, '[^\\x00-\\x7F]', ' ', 'g') AS t FROM memories),
 keys AS (SELECT id, is_active, is_archived, list_filter(list_transform(regexp_extract_all(t, '{CAP_PHRASE}') || regexp_extract_all(t, '{CAP_WORD}') || regexp_extract_all(t, '{QUOTED}', 1), lambda x: trim(lower(x))), lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x)) AS k FROM raw),
 ents AS (SELECT id, is_active, is_archived, list_filter(k, lambda x, i: list_position(k, x) = i)[1:24] AS e FROM keys)"""
LIVE_SQL = ENT_SQL + ", live AS (SELECT id, unnest(e) AS entity FROM ents WHERE is_active AND NOT is_archived), kept AS (SELECT * FROM live WHERE entity NOT IN ('all','api','backend','ing','space'))"
#: Words that open a sentence in most documents link everything; the cap takes them out.
CAP = Links(df_cap=0.02)
CAPPED_SQL = LIVE_SQL + ", n AS (SELECT count(*) AS n FROM ents WHERE is_active AND NOT is_archived), df AS (SELECT entity, count(*) AS df FROM kept GROUP BY entity), rare AS (SELECT k.id, k.entity, df.df FROM kept k JOIN df USING (entity), n WHERE df.df <= 0.02 * n.n)"
PAIRS_SQL = CAPPED_SQL + """, pr AS (SELECT a.id AS id1, b.id AS id2, count(*) AS shared, min(a.entity) AS entity, sum(ln((n.n + 1) / (a.df + 1)) + 1) AS idf, max(n.n) AS n FROM rare a JOIN rare b ON a.entity = b.entity AND a.id < b.id, n GROUP BY 1, 2),
 sz AS (SELECT id, count(*) AS size FROM rare GROUP BY id)"""


def records(spark, sf_dir):
    m = over_cores(memories(spark, sf_dir).select("id", "content", "is_active", "is_archived"))
    found = m.withColumn("plain", ascii_only(F.col("content"))).withColumn("entity_ids", entities(F.col("plain")))
    return found.select("id", "content", "entity_ids", "is_active", "is_archived")


@query(f"WITH {ENT_SQL} SELECT id, len(e) AS n, list_aggregate(e, 'string_agg', '|') AS entities FROM ents")
def entity_extract(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.size("entity_ids").cast("long").alias("n"), F.nullif(F.array_join("entity_ids", "|"), F.lit("")).alias("entities"))


@query(f"WITH {LIVE_SQL} SELECT entity, count(*) AS n FROM live GROUP BY entity ORDER BY n DESC, entity LIMIT 20")
def top_concepts(spark, sf_dir):
    r = records(spark, sf_dir).where("is_active and not is_archived")
    return r.select(F.explode("entity_ids").alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(20)


@query(f"WITH {ENT_SQL} SELECT id FROM ents WHERE list_contains(e, 'the')")
def entity_filter_absent(spark, sf_dir):
    """A stop word is never an entity."""
    return records(spark, sf_dir).where(F.exists("entity_ids", lambda x: F.lower(x) == "the")).select("id")


def _written(spark, sf_dir):
    """Records and their entities, written without the texts they come from."""
    return materialize(records(spark, sf_dir).drop("content"), "records")


@query(f"WITH {CAPPED_SQL} SELECT entity, count(*) AS df FROM rare GROUP BY entity")
def df_cap(spark, sf_dir):
    return graph.document_frequency(graph.entity_rows(_written(spark, sf_dir), CAP))


@query(f"WITH {PAIRS_SQL} SELECT id1, id2, shared, entity FROM pr")
def co_occurrence_pairs(spark, sf_dir):
    return graph.co_occurrence(graph.entity_rows(_written(spark, sf_dir), CAP))


@query(
    f"""WITH {LIVE_SQL}, n AS (SELECT count(*) AS n FROM ents WHERE is_active AND NOT is_archived), df AS (SELECT entity, count(*) AS df FROM kept GROUP BY entity), small AS (SELECT k.id, k.entity, df.df FROM kept k JOIN df USING (entity), n WHERE df.df <= 0.02 * n.n),
 df2 AS (SELECT entity, count(*) AS d2 FROM small GROUP BY entity), pr AS (SELECT a.id AS id1, b.id AS id2, count(*) AS shared, min(a.entity) AS entity, sum(ln((n.n + 1) / (d2 + 1)) + 1) AS idf, max(n.n) AS n FROM small a JOIN small b ON a.entity = b.entity AND a.id < b.id JOIN df2 ON df2.entity = a.entity, n GROUP BY 1, 2),
 sz AS (SELECT id, count(*) AS size FROM small GROUP BY id)
 SELECT id1, id2, shared, entity, round(shared / (x.size + y.size - shared), 6) AS jaccard, round(greatest(0, least(1, idf / (shared * (ln(n + 1) + 1)))), 6) AS strength FROM pr JOIN sz x ON x.id = id1 JOIN sz y ON y.id = id2 WHERE shared >= 2"""
)
def concept_strength(spark, sf_dir):
    """Pairs with two entities in common: Jaccard similarity and idf strength."""
    return graph.concept_pairs(_written(spark, sf_dir), CAP)


_ALL = LIVE_SQL + """, n AS (SELECT count(*) AS n FROM ents WHERE is_active AND NOT is_archived), df AS (SELECT entity, count(*) AS df FROM kept GROUP BY entity), own AS (SELECT k.id, k.entity, df.df FROM kept k JOIN df USING (entity)),
 pr AS (SELECT a.id AS id1, b.id AS id2, count(*) AS shared, min(a.entity) AS entity, sum(ln((n.n + 1) / (a.df + 1)) + 1) AS idf, max(n.n) AS n FROM own a JOIN own b ON a.entity = b.entity AND a.id < b.id, n GROUP BY 1, 2), sz AS (SELECT id, count(*) AS size FROM own GROUP BY id)"""


@query(f"WITH {_ALL} SELECT id1, id2, shared, entity FROM pr")
def co_occurrence_pairs_all(spark, sf_dir):
    """All entities, however common."""
    return graph.co_occurrence(graph.entity_rows(_written(spark, sf_dir)))


def _strength_sql(where: str) -> str:
    return f"WITH {_ALL} SELECT id1, id2, shared, entity, round(shared / (x.size + y.size - shared), 6) AS jaccard, round(greatest(0, least(1, idf / (shared * (ln(n + 1) + 1)))), 6) AS strength FROM pr JOIN sz x ON x.id = id1 JOIN sz y ON y.id = id2 WHERE shared >= 2{where}"


@query(_strength_sql(""))
def concept_strength_all(spark, sf_dir):
    """All entities, however common."""
    return graph.concept_pairs(_written(spark, sf_dir))


@query(_strength_sql(" AND shared / (x.size + y.size - shared) >= 0.3"))
def concept_strength_similar(spark, sf_dir):
    """Pairs of a Jaccard similarity of 0.3 or more: lengths and prefixes rule most out unseen."""
    return graph.concept_pairs(_written(spark, sf_dir), Links(min_jaccard=0.3))


@query()
def cap_per_node(spark, sf_dir):
    """At most three links a record, the best first."""
    return graph.capped_pairs(_written(spark, sf_dir), Links(max_per_node=3))


def _bfs_sql(depth: int, types: str = "") -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT source_memory_id AS a, target_memory_id AS b FROM edges WHERE strength >= 0.3{types} UNION SELECT target_memory_id, source_memory_id FROM edges WHERE strength >= 0.3 AND link_type IN ('relates_to','contradicts','similar_to'){types}),
 r(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.id WHERE r.depth < {depth}) SELECT id, min(depth) AS depth FROM r WHERE id <> 1 GROUP BY id"""


def _bfs(spark, sf_dir, depth, types=None):
    anchors = spark.range(1, 2).select("id")
    return graph.search_around(edges(spark, sf_dir), anchors, depth, 0.3, types)


@query(_bfs_sql(1))
def bfs_depth1(spark, sf_dir):
    return _bfs(spark, sf_dir, 1)


@query(_bfs_sql(2))
def bfs_depth2(spark, sf_dir):
    return _bfs(spark, sf_dir, 2)


@query(_bfs_sql(3))
def bfs_depth3(spark, sf_dir):
    return _bfs(spark, sf_dir, 3)


@query(_bfs_sql(2, " AND link_type = 'relates_to'"))
def bfs_symmetric(spark, sf_dir):
    return _bfs(spark, sf_dir, 2, ["relates_to"])


@query(f"WITH {EDGES_SQL}, d AS (SELECT id, count(*) AS degree FROM (SELECT source_memory_id AS id FROM edges UNION ALL SELECT target_memory_id FROM edges) GROUP BY id) SELECT count(*) AS nodes, round(avg(degree), 6) AS avg_degree, list_sort(list(degree))[count(*) // 2 + 1] AS median_degree, max(degree) AS max_degree FROM d")
def degree_stats(spark, sf_dir):
    return graph.degree_stats(edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT source_memory_id, target_memory_id, link_type, strength FROM edges WHERE (source_memory_id = 5 OR target_memory_id = 5) AND strength >= 0.2")
def links_of_node(spark, sf_dir):
    return graph.links_of(edges(spark, sf_dir), 5, min_strength=0.2).select("source_memory_id", "target_memory_id", "link_type", "strength")


def _annotations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where("doc_id % 19 = 0").select(F.col("doc_id").alias("source_memory_id"), (F.col("doc_id") % 50).alias("target_memory_id"), F.lit("annotates").alias("link_type"), ((F.col("doc_id") % 7) / 10.0).alias("strength"))


@query(
    f"""WITH {MEMORIES_SQL}, e AS (SELECT doc_id AS note_id, doc_id % 50 AS result_id, (doc_id % 7) / 10.0 AS strength FROM documents WHERE doc_id % 19 = 0),
 j AS (SELECT r.id AS result_id, e.note_id, row_number() OVER (PARTITION BY r.id ORDER BY e.strength DESC, n.created_at DESC, e.note_id) AS rank FROM memories r JOIN e ON e.result_id = r.id JOIN memories n ON n.id = e.note_id WHERE n.is_note AND n.is_active AND NOT n.is_archived)
 SELECT result_id, note_id, rank FROM j WHERE rank <= 3"""
)
def annotate_top_k(spark, sf_dir):
    m = memories(spark, sf_dir)
    return with_notes(m, _annotations(spark, sf_dir), m, 3)


@query("WITH e AS (SELECT DISTINCT o_custkey AS a, -1 - CAST(c_nationkey AS BIGINT) AS b FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT a AS node, b AS component FROM e UNION SELECT b, b FROM e) SELECT node, component FROM n")
def components(spark, sf_dir):
    """Customers with orders, joined by their nation."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    e = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_custkey").alias("src"), (-1 - F.col("c_nationkey").cast("long")).alias("dst"))
    return connected_components(e)
