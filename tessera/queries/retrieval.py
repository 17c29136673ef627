"""Lexical, vector and fused retrieval; filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scoring import effective_score
from tessera.operators.fusion import min_max, rrf
from tessera.operators.lexical import bm25, pool, query_terms, tokens, top, trigram, trigram_terms
from tessera.operators.search import Filter, dominant, search
from tessera.operators.vector import cosine_top_k, hashing_embed, nearest
from tessera.queries import query
from tessera.sources.tables import MEMORIES_SQL, NOW, memories, table

TEXT = "the heading of ation"
K = 10


def _sum(parts: list[str]) -> str:
    return " + ".join(parts) or "0"


def bm25_sql(text: str, docs: str = "memories") -> str:
    """Scores of all hits as a table ``scores(id, score)`` after WITH."""
    terms = query_terms(text)
    cond = lambda t, p: f"starts_with(x, '{t}')" if p else f"x = '{t}'"
    fs = ", ".join(f"len(list_filter(t, lambda x: {cond(t, p)})) AS f{i}" for i, (t, p) in enumerate(terms))
    return _scores_sql(f"toks AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM {docs}), c AS (SELECT id, len(t) AS dl, {fs} FROM toks)", len(terms))


def _scores_sql(head: str, n: int) -> str:
    idf = [f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END" for i in range(n)]
    part = [f"CASE WHEN f{i} > 0 THEN ({idf[i]}) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * dl / av)) ELSE 0 END" for i in range(n)]
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(n))
    return f"{head}, s AS (SELECT count(*) AS n, avg(dl) AS av, {dfs} FROM c), scores AS (SELECT id, round({_sum(part)}, 6) AS score FROM c, s WHERE {' OR '.join(f'f{i} > 0' for i in range(n))})"


def trigram_sql(text: str, docs: str = "memories") -> str:
    terms = trigram_terms(text)
    # the terms used have no border, so no two places overlap and replacing counts them
    count = lambda t: f"((length(content) - length(replace(lower(content), '{t}', ''))) // {len(t)})"
    return _scores_sql(f"c AS (SELECT id, greatest(length(content) - 2, 0) AS dl, {', '.join(f'{count(t)} AS f{i}' for i, t in enumerate(terms))} FROM {docs})", len(terms))


@query(f"WITH {MEMORIES_SQL}, {bm25_sql(TEXT)} SELECT id, score FROM scores ORDER BY score DESC, id LIMIT {K}")
def bm25_top_k(spark, sf_dir):
    return top(bm25(memories(spark, sf_dir), TEXT), K)


@query(f"WITH {MEMORIES_SQL}, {bm25_sql('thi ng er')} SELECT id, score FROM scores")
def bm25_prefix_compound(spark, sf_dir):
    """Short terms, and their joined neighbours as prefixes."""
    return bm25(memories(spark, sf_dir), "thi ng er")


@query(f"WITH {MEMORIES_SQL}, {trigram_sql('ther')} SELECT id, score FROM scores ORDER BY score DESC, id LIMIT {K}")
def trigram_top_k(spark, sf_dir):
    return top(trigram(memories(spark, sf_dir), "ther"), K)


@query(f"WITH {MEMORIES_SQL}, t AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM memories) SELECT term, count(*) AS df FROM t GROUP BY term")
def term_df(spark, sf_dir):
    t = memories(spark, sf_dir).select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {MEMORIES_SQL} SELECT count(*) AS n, round(avg(len(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> ''))), 6) AS avgdl FROM memories")
def doc_length_stats(spark, sf_dir):
    return memories(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(F.size(tokens(F.col("content")))), 6).alias("avgdl"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"
_NEAR = f"near AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS ql, b.label, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near)"


@query(f"WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT b.vec_id AS id, round({_COS}, 6) AS score FROM q a, embeddings b ORDER BY score DESC, id LIMIT {K}")
def cosine_top_k_query(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return cosine_top_k(v, v.orderBy("id").first()["vector"], K)


@query(f"WITH {_NEAR} SELECT query_id, id, score, rank FROM ranked WHERE rank <= {K}")
def vector_neighbours(spark, sf_dir):
    """The vectors with ids divisible by 50 against all."""
    v = _vectors(spark, sf_dir)
    return nearest(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), K)


@query(f"WITH {_NEAR} SELECT round(avg(CASE WHEN ql = label THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS pairs FROM ranked WHERE rank <= {K} AND query_id <> id")
def vector_recall_by_label(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    got = vector_neighbours(spark, sf_dir).where("query_id <> id")
    a, b = v.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), v.select("id", "label")
    return got.join(a, "query_id").join(b, "id").agg(F.round(F.avg((F.col("ql") == F.col("label")).cast("double")), 6).alias("recall"), F.count("*").alias("pairs"))


@query()
def hashing_embed_top_k(spark, sf_dir):
    """Documents by the feature-hashing embedder's cosine with the query text."""
    from tessera.operators.vector import feature_vector

    v = memories(spark, sf_dir).select("id", hashing_embed(F.col("content")).alias("vector"))
    return cosine_top_k(v, feature_vector(TEXT).tolist(), K)


def _two(spark, sf_dir):
    m = memories(spark, sf_dir)
    return top(bm25(m, TEXT), pool(K)), top(trigram(m, TEXT), pool(K))


def _two_sql(w: float) -> str:
    tri = trigram_sql(TEXT)
    for x, y in ((", s AS (", ", s2 AS ("), ("FROM c)", "FROM c2)"), ("FROM c, s WHERE", "FROM c2, s2 WHERE"), ("scores AS (", "scores2 AS (")):
        tri = tri.replace(x, y)
    tri = "c2 AS (" + tri[len("c AS (") :]
    return f"""{bm25_sql(TEXT)}, a AS (SELECT id, score FROM scores ORDER BY score DESC, id LIMIT 50), {tri}, b AS (SELECT id, score FROM scores2 ORDER BY score DESC, id LIMIT 50),
  fused AS (SELECT id, round(sum(p), 9) AS score FROM (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM a UNION ALL SELECT id, {w} / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM b) GROUP BY id)"""


@query(f"WITH {MEMORIES_SQL}, {_two_sql(1.0)} SELECT id, score FROM fused")
def rrf_two_source(spark, sf_dir):
    return rrf(list(_two(spark, sf_dir)))


@query(f"WITH {MEMORIES_SQL}, {_two_sql(3.0)} SELECT id, score FROM fused")
def rrf_weighted(spark, sf_dir):
    return rrf(list(_two(spark, sf_dir)), [1.0, 3.0])


_MM = "mm AS (SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS relevance FROM fused)"


@query(f"WITH {MEMORIES_SQL}, {_two_sql(1.0)}, {_MM} SELECT id, round(relevance, 6) AS relevance FROM mm")
def min_max_relevance(spark, sf_dir):
    return min_max(rrf(list(_two(spark, sf_dir)))).select("id", F.round("relevance", 6).alias("relevance"))


_EFF = f"0.3 * usefulness_score - 0.2 * staleness_score + CASE WHEN last_accessed_at IS NULL THEN 0 ELSE 0.1 * exp(-0.01 * greatest(0, date_diff('second', last_accessed_at, TIMESTAMP '{NOW}') / 86400.0)) END"


@query(f"WITH {MEMORIES_SQL} SELECT id, round(1.0 + {_EFF}, 6) AS score FROM memories ORDER BY score DESC, id LIMIT {K}")
def effective_score_top_k(spark, sf_dir):
    m = memories(spark, sf_dir)
    s = effective_score(F.lit(1.0), F.col("usefulness_score"), F.col("staleness_score"), F.col("last_accessed_at"), F.lit(NOW).cast("timestamp_ntz"))
    return m.select("id", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "id").limit(K)


def _hybrid_sql(where: str) -> str:
    return f"WITH {MEMORIES_SQL}, {_two_sql(1.0)}, {_MM} SELECT id, round(relevance + {_EFF} + CASE WHEN is_note THEN 0.05 ELSE 0 END, 6) AS score FROM mm JOIN memories USING (id) WHERE {where} ORDER BY score DESC, id LIMIT {K}"


@query(_hybrid_sql("NOT is_archived AND is_active AND NOT is_stale"))
def hybrid_search(spark, sf_dir):
    return search(memories(spark, sf_dir), TEXT, NOW, K)


@query(_hybrid_sql("NOT is_archived AND is_active AND category = 'fact' AND usefulness_score >= 2"))
def hybrid_filtered(spark, sf_dir):
    return search(memories(spark, sf_dir), TEXT, NOW, K, Filter(exclude_stale=False, category="fact", min_usefulness=2.0))


@query(f"WITH {MEMORIES_SQL}, {bm25_sql('zu')} SELECT id, score FROM scores ORDER BY score DESC, id LIMIT 50")
def single_source_passthrough(spark, sf_dir):
    """No trigram in two letters: the one live source keeps its raw scores."""
    from tessera.operators.fusion import fuse

    m = memories(spark, sf_dir)
    return fuse([top(bm25(m, "zu"), pool(K)), top(trigram(m, "zu"), pool(K))], [1.0, 1.0])


@query(f"WITH {MEMORIES_SQL}, {_two_sql(1.0)}, {_MM}, r AS (SELECT id, relevance, sum(relevance) OVER () AS total, lead(relevance) OVER (ORDER BY relevance DESC, id) AS nxt, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM mm) SELECT id, round(relevance / total, 6) AS share FROM r WHERE rank = 1 AND total > 0 AND relevance / total >= 0.01 AND (nxt IS NULL OR relevance > nxt)")
def anchor_dominance(spark, sf_dir):
    return dominant(min_max(rrf(list(_two(spark, sf_dir)))), 0.01)


@query(f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE NOT is_archived AND is_active AND NOT is_stale AND category = 'skill' AND source = 'user' AND staleness_score <= 5 AND usefulness_score >= 1 AND NOT (NOT verified)")
def memory_filter_all(spark, sf_dir):
    f = Filter(category="skill", source="user", verified_only=True, min_usefulness=1.0, max_staleness=5.0)
    return memories(spark, sf_dir).where(f.column()).select("id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_predicate(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type")
def time_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(F.col("ts").between(F.lit("2024-01-10 00:00:00").cast(e.schema["ts"].dataType), F.lit("2024-01-20 00:00:00").cast(e.schema["ts"].dataType))).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {MEMORIES_SQL} SELECT category, count(*) AS n FROM memories WHERE valid_from BETWEEN TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND TIMESTAMP '{NOW}' GROUP BY category")
def window_grammar(spark, sf_dir):
    from datetime import datetime

    from tessera.operators.history import window

    lo, hi = window("2w", None, None, datetime.fromisoformat(NOW))
    return memories(spark, sf_dir).where(F.col("valid_from").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {MEMORIES_SQL}, {_two_sql(1.0)}, top AS (SELECT id FROM fused ORDER BY score DESC, id LIMIT {K}), ref AS (SELECT id FROM a ORDER BY score DESC, id LIMIT {K}) SELECT round(count(*) FILTER (ref.id IS NOT NULL AND top.id IS NOT NULL) / greatest(count(*) FILTER (ref.id IS NOT NULL), 1), 6) AS recall, round(count(*) FILTER (ref.id IS NOT NULL AND top.id IS NOT NULL) / greatest(count(*), 1), 6) AS jaccard FROM top FULL JOIN ref ON top.id = ref.id")
def recall_and_agreement(spark, sf_dir):
    """Recall at k and Jaccard agreement of the fused with the lexical ranking."""
    a, b = _two(spark, sf_dir)
    t = rrf([a, b]).orderBy(F.desc("score"), "id").limit(K).select("id", F.lit(1).alias("t"))
    r = a.orderBy(F.desc("score"), "id").limit(K).select("id", F.lit(1).alias("r"))
    j = t.join(r, "id", "full")
    both = F.count_if(F.col("t").isNotNull() & F.col("r").isNotNull())
    return j.agg(F.round(both / F.greatest(F.count("r"), F.lit(1)), 6).alias("recall"), F.round(both / F.greatest(F.count("*"), F.lit(1)), 6).alias("jaccard"))
