"""Contents told apart from those a store already holds.

The store keeps a digest of every content in buckets by its hash, and beside
them a Bloom filter of all digests, a bitmap of a fixed size in pages. A batch
asks the filter first, in the pass that hashes it: most new contents are not in
it and need no join. The rest, stored ones and a few the filter mistakes, meet
the digests of their own buckets only.

A null content is a content like others; of rows of a batch with one content the
one with the least id stands; an empty batch changes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.operators.state import Snapshots
from tessera.plans.shared import materialize

#: Bits of the filter and of a page of it, as powers of two. 2^27 bits, 16 MB, keep mistakes under 2 % up to 16 million contents.
BITS, PAGE = 27, 16
PROBES = 4
NULL = "null"


def digest(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit(NULL))


def _places(d: str, bits: int) -> list[int]:
    h = d if d != NULL else "0" * 64
    return [int(h[8 * i : 8 * i + 8], 16) & ((1 << bits) - 1) for i in range(PROBES)]


class Contents:
    """The digests of a store's contents."""

    def __init__(self, store: Snapshots, bits: int = BITS) -> None:
        if not PAGE <= bits <= 30:
            raise ValueError("bits is 16 to 30")
        self.store, self.bits = store, bits

    def _bitmap(self) -> np.ndarray:
        """The filter, as many bytes as it has bits by eight whatever it holds."""
        out = np.zeros((1 << self.bits) // 8, np.uint8)
        pages = self.store.read("digest_bits")
        for r in pages.toLocalIterator() if pages is not None else ():
            at = r.page << (PAGE - 3)
            out[at : at + (1 << (PAGE - 3))] = np.frombuffer(r.content, np.uint8)
        return out

    def fresh(self, rows: DataFrame, content: str = "content") -> DataFrame:
        """``rows`` (id, ...) with ``digest``, whose content the store does not hold, each content once."""
        bits, sent = self.bits, rows.sparkSession.sparkContext.broadcast(self._bitmap())

        @pandas_udf("boolean")
        def maybe(s: pd.Series) -> pd.Series:
            at = np.array([_places(d, bits) for d in s], np.int64).reshape(-1, PROBES)
            return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1))

        named = rows.withColumn("digest", digest(F.col(content)))
        named = materialize(named.withColumn("_maybe", maybe("digest")), "digested")
        first = named.groupBy("digest").agg(F.min("id").alias("id"))
        once = named.join(first, ["digest", "id"]).dropDuplicates(["digest"])
        new, held = once.where("not _maybe"), once.where("_maybe")
        table = self.store._state()[1].get("digests")
        if table is not None:
            touched = {r[0] for r in held.select(self.store._bucket(["digest"], table["buckets"])).distinct().collect()}  # as many as buckets
            known = self.store.read("digests", parts=touched) if touched else None
            if known is not None:
                held = held.join(known.select("digest"), "digest", "left_anti")
        return new.unionByName(held).drop("_maybe").select(*rows.columns, "digest")

    def add(self, rows: DataFrame) -> None:
        """Remembers the digests of ``rows`` (digest). A run that dies between the
        two tables leaves a filter that knows too much, which costs a join and no content."""
        bits = self.bits
        own = materialize(rows.select("digest").distinct(), "digests")

        def pages(batches):
            for b in batches:
                at = np.array([_places(d, bits) for d in b["digest"]], np.int64).ravel()
                yield pd.DataFrame({"page": (at >> PAGE).astype(np.int32), "bit": (at & ((1 << PAGE) - 1)).astype(np.int32)})

        def page(x: pd.DataFrame) -> pd.DataFrame:
            on = np.zeros(1 << PAGE, np.uint8)
            on[x["bit"].dropna().astype(np.int64)] = 1
            out = np.packbits(on, bitorder="little")
            for c in x["content"].dropna():
                out |= np.frombuffer(c, np.uint8)
            return pd.DataFrame({"page": x["page"].iloc[:1], "content": [out.tobytes()]})

        made = own.mapInPandas(pages, "page int, bit int").distinct().withColumn("content", F.lit(None).cast("binary"))
        old = self.store.read("digest_bits")
        if old is not None:
            made = made.unionByName(old.select("page", F.lit(None).cast("int").alias("bit"), "content"))
        self.store.commit({"digest_bits": made.groupBy("page").applyInPandas(page, "page int, content binary")})
        self.store.upsert("digests", own, "digest")
