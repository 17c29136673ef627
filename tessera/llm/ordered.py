"""Rows in the order of their key, in ranges of about equal size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges at most; inputs of more than that many targets get larger ranges, which are sorted with spilling.
MOST_RANGES = 10_000


def ranges(rows: DataFrame, target_bytes: int, most: int = MOST_RANGES) -> int:
    """How many ranges of about ``target_bytes`` of text (k, text) makes."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, min(most, math.ceil(total / target_bytes)))


def sorted_ranges(rows: DataFrame, target_bytes: int) -> DataFrame:
    """``rows`` (k, text) in partitions that ascend with k, sorted by it.

    Rows of one key are told apart by a hash of their text, so a key with many
    rows (null, say) may stretch over several partitions.
    """
    hashed = rows.withColumn("h", F.xxhash64("text"))
    return hashed.repartitionByRange(ranges(rows, target_bytes), "k", "h").sortWithinPartitions("k", "h").select("k", "text")


class Buckets:
    """Key ranges with about as many rows each, cut at quantiles of the keys of
    all rows, so outliers and gaps cost nothing. A key's rows stay together;
    what runs over a bucket streams. Any 64-bit key will do."""

    def __init__(self, rows: DataFrame, target_bytes: int) -> None:
        n = ranges(rows, target_bytes)
        self.bounds = np.zeros(0, np.int64)
        if n > 1:
            at = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n + 10_000)).first()[0] or []
            self.bounds = np.unique(np.array(at, np.int64))
        self.count = len(self.bounds) + 1

    def column(self) -> Column:
        bounds = self.bounds
        if not len(bounds):
            return F.lit(0).cast("long")

        @F.pandas_udf("long")
        def bucket(k: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, k.to_numpy(np.int64), "right"))

        return bucket("k")

    def lookup(self, values: list[int | None]) -> Column:
        """A value of the row's bucket."""
        table = F.transform(F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ","), lambda x: x.try_cast("long"))
        return F.get(table, F.col("bucket").cast("int"))
