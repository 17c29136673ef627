"""Exact vector search and the feature-hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.scoring import cosine
from tessera.plans.shared import materialize


#: Queries up to this number are sent to every task; more meet the vectors cell by cell.
FEW = 1024
#: Cells of the vectors, and rows of a block of one.
CELLS, BLOCK = 64, 4096
_FOUND = "query_id long, id long, score double"


def _unit(rows: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the length ``dim`` at length 1, and which rows they are; zero vectors have no direction."""
    fits = np.flatnonzero([v is not None and len(v) == dim for v in rows])
    m = np.array([rows.iloc[i] for i in fits], np.float64).reshape(len(fits), dim)
    size = np.linalg.norm(m, axis=1)
    return m[size > 0] / size[size > 0][:, None], fits[size > 0]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(-score, id) of the best k of a row, ties by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        ids, scores = ids[keep], scores[keep]
    return sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, few: int = FEW) -> DataFrame:
    """(query_id, id, score, rank): the k most similar vectors (id, vector) of every
    query (query_id, vector), by cosine to six digits, ties by id.

    Up to ``few`` queries are sent to every task, which keeps a running best k
    of each over its vectors in one pass. More of them meet the vectors cell by
    cell; see ``by_cells``. Null and zero vectors, and those of another length
    than the first query's, are in no result.
    """
    asked = queries.select("query_id", "vector").where("vector is not null")
    rows = asked.limit(few + 1).collect()  # a bounded number
    if not rows:
        return vectors.sparkSession.createDataFrame([], _FOUND + ", rank int")
    dim = len(rows[0]["vector"])
    if len(rows) > few:
        return by_cells(vectors, asked, k, dim)[0]
    units, at = _unit(pd.Series([r["vector"] for r in rows]), dim)
    names = np.array([r["query_id"] for r in rows])[at]

    def run(batches):
        best: list[list] = [[] for _ in names]
        for b in batches:
            m, own = _unit(b["vector"], dim)
            if not len(own):
                continue
            ids, scores = b["id"].to_numpy()[own], np.round(units @ m.T, 6)
            for i, row in enumerate(scores):
                best[i] = sorted(best[i] + _best(ids, row, k))[:k]
        for name, found in zip(names.tolist(), best, strict=True):
            yield pd.DataFrame({"query_id": name, "id": [x for _, x in found], "score": [-x for x, _ in found]})

    return _first(vectors.select("id", "vector").mapInPandas(run, _FOUND), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_cells(vectors: DataFrame, queries: DataFrame, k: int, dim: int, cells: int = CELLS, block: int = BLOCK) -> tuple[DataFrame, float]:
    """``nearest`` for any number of queries, and the share of all pairs that was never compared.

    ``cells`` of the vectors are pivots; every vector lies in its nearest one's
    cell. Angles are a metric: a query at the angle t from a pivot whose vectors
    are at most r away has none of them within t - r. Each query first meets the
    nearest cells that hold k vectors; the k-th best of those is a bound, and
    cells whose bound is below it are left out. Vectors and queries of a cell meet
    in blocks, each a matrix product of one task. Pivots decide what is left out,
    never what is found.
    """
    spark = vectors.sparkSession
    sample = vectors.where((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0)).select("vector").orderBy(F.xxhash64("id"), "id").limit(cells)
    pivots, _ = _unit(pd.Series([r["vector"] for r in sample.collect()]), dim)  # ``cells`` rows
    if not len(pivots):
        return spark.createDataFrame([], _FOUND + ", rank int"), 0.0

    def placed(batches):
        for b in batches:
            m, own = _unit(b["vector"], dim)
            dots = m @ pivots.T
            cell = dots.argmax(1)
            yield pd.DataFrame({"id": b["id"].to_numpy()[own], "cell": cell.astype(np.int32), "angle": np.arccos(np.clip(dots.max(1, initial=-1), -1, 1)), "unit": list(m)})

    rows = materialize(vectors.select("id", "vector").mapInPandas(placed, "id long, cell int, angle double, unit array<double>"), "cells")
    known = {r.cell: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()}  # a row a cell
    names = np.array(sorted(known))
    size, lo, hi = (np.array([float(known[c][f]) for c in names]) for f in ("n", "lo", "hi"))

    def visits(batches, again: bool):
        for b in batches:
            m, own = _unit(b["vector"], dim)
            theta = np.arccos(np.clip(m @ pivots[names].T, -1, 1))
            order = np.argsort(theta, 1, kind="stable")
            near = np.cumsum(size[order], 1) - size[order] < k  # until k vectors lie in them
            first = np.zeros(theta.shape, bool)
            np.put_along_axis(first, order, near, 1)
            take = first
            if again:
                bound = np.cos(np.clip(np.maximum(theta - hi, lo - theta), 0, np.pi))
                take = ~first & (bound + 2e-6 >= b["least"].to_numpy()[own][:, None])
            i, j = np.nonzero(take)
            yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[own][i], "cell": names[j].astype(np.int32), "unit": list(m[i])})

    out_schema = "query_id long, cell int, unit array<double>"
    blocks = spark.createDataFrame([(int(c), -(-int(known[c].n) // block)) for c in names], "cell int, nv int")

    def compared(visit: DataFrame) -> DataFrame:
        nq = visit.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(FEW)).cast("int").alias("nq")).join(blocks, "cell")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        a = visit.join(F.broadcast(nq), "cell").withColumn("bq", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).withColumn("bv", every("nv"))  # a row a cell
        b = rows.join(F.broadcast(nq), "cell").withColumn("bv", F.pmod(F.xxhash64("id"), F.col("nv")).cast("int")).withColumn("bq", every("nq"))

        def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            scores, ids = np.round(np.stack(q["unit"].to_numpy()) @ np.stack(v["unit"].to_numpy()).T, 6), v["id"].to_numpy()
            found = [(n, i, -s) for n, row in zip(q["query_id"].tolist(), scores, strict=True) for s, i in _best(ids, row, k)]
            return pd.DataFrame(found, columns=["query_id", "id", "score"])

        key = ["cell", "bq", "bv"]
        return a.select(*key, "query_id", "unit").groupBy(*key).cogroup(b.select(*key, "id", "unit").groupBy(*key)).applyInPandas(meet, _FOUND)

    one = materialize(queries.select("query_id", "vector").mapInPandas(lambda x: visits(x, False), out_schema), "visits")
    start = materialize(_first(compared(one), k).select("query_id", "id", "score", "rank"), "start")
    least = start.groupBy("query_id").agg(F.when(F.max("rank") == k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
    two = materialize(queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))).mapInPandas(lambda x: visits(x, True), out_schema), "visits")
    met = one.unionByName(two).groupBy("cell").agg(F.count("*").alias("q")).collect()  # a row a cell
    pairs = sum(r.q * known[r.cell].n for r in met)
    every = float(size.sum()) * queries.count()
    return _first(start.select("query_id", "id", "score").unionByName(compared(two)), k), 1 - pairs / every if every else 0.0


def cosine_top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """One query without Python: (id, score), rows of other lengths left out."""
    score = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select("id", F.round(score, 6).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def _signed_place(feature: str, dim: int) -> tuple[int, float]:
    h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
    return h % dim, 1.0 if h >> 63 else -1.0


_place = lru_cache(maxsize=1 << 20)(_signed_place)


@lru_cache(maxsize=1 << 17)
def _word(word: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signs of what a word has by itself; a text names it once, however often it says it."""
    edged = f"^{word}$"
    named = [f"w:{word}"] + [f"c:{edged[i : i + n]}" for n in (3, 4, 5) for i in range(len(edged) - n + 1)]
    at, sign = zip(*(_place(f, dim) for f in named), strict=True)
    return np.array(at, np.int64), np.array(sign)


def feature_vector(text: str | None, dim: int = 512) -> np.ndarray:
    """Signed feature hashing of a text, of length 1.

    Fixed by what other stores hold: words of two or more of ``a-z0-9``, alone
    (``w:``) and in pairs, and the 3- to 5-letter pieces (``c:``) of each between
    ``^`` and ``$``; a feature's bucket is its 8-byte blake2b modulo ``dim``, its
    sign that hash's top bit."""
    words = re.findall("[a-z0-9]{2,}", (text or "").lower())
    if not words:
        return np.zeros(dim, np.float32)
    own, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
    at, sign = zip(*(_word(w, dim) for w in own), strict=True)
    times = np.repeat(np.fromiter(own.values(), np.float64, len(own)), [len(x) for x in at])
    sums = np.bincount(np.concatenate(at), weights=np.concatenate(sign) * times, minlength=dim)
    if pairs:
        at, sign = zip(*(_signed_place(f"w:{a} {b}", dim) for a, b in pairs), strict=True)
        sums += np.bincount(at, weights=np.array(sign) * np.fromiter(pairs.values(), np.float64, len(pairs)), minlength=dim)
    v = sums.astype(np.float32)
    norm = np.linalg.norm(v)
    return v / norm if norm > 0 else v


def hashing_embed(text: Column, dim: int = 512) -> Column:
    @pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: feature_vector(t, dim))

    return run(text)
