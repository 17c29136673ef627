"""Fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.shared import materialize

RRF_K = 60


def rrf(sources: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """(id, score) by weighted reciprocal ranks of sources (id, score). Sources
    are candidate pools, bounded by their limit, so ranking one is one task."""
    weights = weights or [1.0] * len(sources)
    if len(weights) != len(sources):
        raise ValueError("as many weights as sources")
    w = Window.orderBy(F.desc("score"), "id")
    parts = [s.select("id", (F.lit(float(x)) / (k + F.row_number().over(w))).alias("part")) for s, x in zip(sources, weights, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"))


def fuse(sources: list[DataFrame], weights: list[float]) -> DataFrame:
    """No live source gives nothing, a single one its raw scores, more their
    reciprocal ranks. Each source, a pool, is written once and looked at there."""
    sources = [materialize(s, "pool") for s in sources]
    live = [(s, w) for s, w in zip(sources, weights, strict=True) if s.head(1)]
    if len(live) == 1:
        return live[0][0].select("id", "score")
    return rrf([s for s, _ in live], [w for _, w in live]) if live else sources[0].select("id", "score").where("false")


def min_max(scored: DataFrame) -> DataFrame:
    """Scores of a pool to 0..1; all 1 where they do not differ."""
    w = Window.partitionBy()
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.select("id", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)).alias("relevance"))
