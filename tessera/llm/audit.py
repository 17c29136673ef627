"""What each of several filters removes, alone and in every order of applying them.

A document is, for this, no more than the set of filters it fails: five bits.
A table of 32 sets by 120 orders holds the step at which a document goes, so
one look gives its fate in all orders; tasks count (order, step) cells with
np.bincount and Spark sums their arrays.

Defined results: null texts are empty; null languages are the part ``''``; a
null doc_id comes before all others and has no label; rows of one doc_id and
text are not copies of one another, and count as often as they come; a document
whose labels contradict each other is both; an empty table has no parts.
"""

from __future__ import annotations

import hashlib
import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import NULL_KEY, small_batches, tidy
from tessera.plans.shared import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: Partial arrays of so many parts are held at once.
MOST_PARTS = 500
#: Rows of one text are dealt over so many tasks.
SALTS = 64

_CAPITALS = string.ascii_uppercase.encode()
_SYMBOLS = b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))


def first_failures(filters: str = FILTERS, orders: list[str] = ORDERS) -> np.ndarray:
    """By the set of failed filters (bit i: the i-th) and order: the step, from
    0, at which a document goes; the number of filters if it stays."""
    n = len(filters)
    table = np.full((1 << n, len(orders)), n, np.int64)
    for mask in range(1 << n):
        for j, order in enumerate(orders):
            table[mask, j] = next((s for s, f in enumerate(order) if mask >> filters.index(f) & 1), n)
    return table


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # bytes.split() cuts at 0x20 and 0x09 to 0x0D, no more
    few = len(words) < 100
    same = 100 * len(set(words)) < 80 * len(words)
    points = len(text.translate(None, _FOLLOWING))
    loud = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 10 * points
    signs = len(text.translate(None, _SYMBOLS)) < len(text)
    return few | same << 1 | loud << 2 | signs << 3


def measured(docs: DataFrame) -> DataFrame:
    """(k, part, mask, digest): the filters that a text fails by itself, and its SHA-256."""
    small_batches(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary() if pa.types.is_string(b.schema.field("text").type) else pa.large_binary())
            masks, digests = [], []
            for x in texts:
                raw = x.as_py()
                masks.append(failed(raw))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["k", "part", "mask", "digest"])
        tidy()

    return rows.mapInArrow(run, "k long, part string, mask int, digest binary")


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """Sets ``bit`` of rows whose digest a smaller k has too. A text of a third of
    all rows is dealt over ``SALTS`` keys; only one row of each meets its like."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)))
    least = salted.groupBy("digest", "salt").agg(F.min("k").alias("least"))
    first = least.select("digest", "salt", F.min("least").over(Window.partitionBy("digest")).alias("first"))
    later = salted.join(first, ["digest", "salt"])
    return later.select("k", "part", F.col("mask").bitwiseOR(F.when(F.col("k") > F.col("first"), F.lit(1 << bit)).otherwise(F.lit(0))).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n). Rows of one document are counted before they meet its labels."""
    label = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("k"))
    known = label.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = rows.groupBy("k", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    mark = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return counted.join(known, "k", "left").select("part", "mask", mark("good"), mark("toxic"), "n")


def removals(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(part, ord, at, removed, good, toxic): documents that go at a step of an
    order, ``at`` from 0; the last ``at`` holds those that stay. Every cell of every part is there."""
    n_orders, n_steps = table.shape[1], int(table.max()) + 1
    cells = n_orders * n_steps
    base = np.arange(n_orders) * n_steps
    schema = pa.schema([("part", pa.string()), ("ord", pa.int32()), ("at", pa.int32()), ("removed", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])
    ord_, at = (x.astype(np.int32) for x in np.divmod(np.arange(cells), n_steps))

    def told(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part, pa.string()), cells), pa.array(ord_), pa.array(at), *map(pa.array, s)], schema=schema)
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for i in range(0, b.num_rows, 10_000):
                x = b.slice(i, 10_000)
                mask, good, toxic, n = (x.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "good", "toxic", "n"))
                code = x.column("part").dictionary_encode()
                of = code.indices.to_numpy(zero_copy_only=False)
                for j, part in enumerate(code.dictionary.to_pylist()):
                    own = of == j
                    cell = (base + table[mask[own]]).ravel()
                    weigh = lambda w: np.bincount(cell, np.repeat(w, n_orders), cells).astype(np.int64)  # noqa: E731, B023
                    w = n[own].astype(np.float64)  # exact up to 2^53 documents a batch
                    got = np.stack([weigh(w), weigh(w * good[own]), weigh(w * toxic[own])])
                    if part in sums:
                        sums[part] += got
                    else:
                        if len(sums) >= MOST_PARTS:
                            yield from told(sums)
                        sums[part] = got
        yield from told(sums)
        tidy()

    partial = rows.mapInArrow(run, "part string, ord int, at int, removed long, good long, toxic long")
    return partial.groupBy("part", "ord", "at").agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic")))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step (from 1), with what the step's filter
    removes there and what that costs; see the module for odd inputs."""
    rows = with_labels(with_copies(materialize(measured(docs), "measured"), FILTERS.index("E")), labels)
    sums = removals(rows, first_failures())
    last = len(FILTERS) - 1
    names = F.array(*map(F.lit, ORDERS))
    steps = sums.withColumn("filter_order", F.element_at(names, F.col("ord") + 1)).withColumn("filter", F.substring("filter_order", F.col("at") + 1, F.lit(1)))
    run = Window.partitionBy("part", "ord")
    sofar = run.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("kept", F.sum("removed").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum("removed").over(sofar))
    own = Window.partitionBy("part", "filter")

    def where(step: int) -> Column:
        """What the filter removes when it is at ``step``, the same in all such orders."""
        return F.max(F.when(F.col("at") == step, F.col("removed"))).over(own)

    out = steps.where(F.col("at") <= last).select("*", where(0).alias("fails"), where(last).alias("unique_fails"), F.sum("removed").over(own).alias("shapley"))
    return out.select("part", "filter_order", (F.col("at") + 1).alias("step"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")

