"""Context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever its remainder by
the block size is the largest; a chunk's hash gives one letter. So an edit
changes the letters near it and no others. A fingerprint is
``block:letters:letters at twice the block`` with the block size, 3 times a
power of two, fitted to the text's length. Fingerprints of the same or
neighbouring block sizes are compared by edit distance (insertions and
deletions) of the letters for the size they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import keyed, mix, slices, unkeyed
from tessera.llm.ordered import Buckets

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEAST, LONG, SPAN = 3, 64, 7
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 2**64)


class Powers:
    """Powers of an odd number modulo 2**64, made when first needed."""

    def __init__(self, base: int) -> None:
        self.base, self.have = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.have) < n:
            self.have = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, self.base))])
        return self.have[:n]


_up, _down = Powers(_P), Powers(_INVERSE)


def _letters(ends: np.ndarray, sums: np.ndarray, most: int) -> str:
    """One letter a chunk; what follows the last chunk that has a place of its own joins it."""
    n = len(sums) - 1
    cut = ends[: most - 1]
    cut = np.concatenate([[0], cut, [n]]) if not len(cut) or cut[-1] != n else np.concatenate([[0], cut])
    start = cut[:-1]
    h = (sums[cut[1:]] - sums[start]) * _down.upto(int(start[-1]) + 1)[start]
    return LETTERS[(mix(h) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """Of any bytes; empty input gives ``3::``."""
    n = len(data)
    if not n:
        return f"{LEAST}::"
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(b * _up.upto(n), out=sums[1:])
    roll = np.zeros(n, np.uint64)
    for i in range(min(SPAN, n)):
        roll[i:] += b[: n - i] * np.uint64(pow(_P, i + 1, 2**64))
    roll = mix(roll) >> np.uint64(32)
    block = LEAST
    while block * LONG < n:
        block *= 2
    while True:
        ends = np.flatnonzero(roll % np.uint64(block) == np.uint64(block - 1)) + 1
        if len(ends) >= LONG // 2 or block == LEAST:
            break
        block //= 2
    twice = ends[roll[ends - 1] % np.uint64(2 * block) == np.uint64(2 * block - 1)]
    return f"{block}:{_letters(ends, sums, LONG)}:{_letters(twice, sums, LONG // 2)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = max(1, min(SPAN, min(len(a), len(b)) // 2))
    if run > 1:  # no run of letters in common: chance
        have = {a[i : i + run] for i in range(len(a) - run + 1)}
        if not any(b[i : i + run] in have for i in range(len(b) - run + 1)):
            return 0.0
    return 2.0 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 at block sizes that share nothing."""
    if x == y:
        return 1.0
    (p, a, a2), (q, b, b2) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_alike(a, b), _alike(a2, b2) if len(a2) >= SPAN and len(b2) >= SPAN else 0.0)
    if p == 2 * q:
        return _alike(a, b2)
    return _alike(a2, b) if q == 2 * p else 0.0


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; null text counts as empty."""
    from tessera.llm.common import map_rows

    got = map_rows(keyed(docs), "k long, fingerprint string", lambda: lambda ks, ts: [ks, [fingerprint((t or "").encode("utf-8", "replace")) for t in ts]])
    return got.select(unkeyed(), "fingerprint")


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_neighbours(docs: DataFrame, target_bytes: int = 8 << 20) -> DataFrame:
    """Every row beside the next one in descending doc_id (after the last: the first).

    doc_id, text, edited (the last third of the text replaced by the beginning
    of the next), fingerprint, edited_fingerprint, next_fingerprint. Rows go to
    key ranges of about ``target_bytes``; a range's first row is also sent to
    the range before it, and the sorted rows stream by, so no task holds more
    than two texts. Null texts are empty; rows of one doc_id stand in
    descending order of text; a null doc_id comes last.
    """
    rows = keyed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    buckets = Buckets(rows, target_bytes)
    rows = rows.withColumn("bucket", buckets.column())
    heads = [None] * buckets.count
    for r in rows.groupBy("bucket").agg(F.max("k").alias("k")).collect():  # one short row a range
        heads[r["bucket"]] = r["k"]
    used = [b for b in range(buckets.count) if heads[b] is not None]
    to: list[int | None] = [None] * buckets.count
    for i, b in enumerate(used):
        to[b] = used[(i + 1) % len(used)]
    if used:
        own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest"))
        guest = F.struct(buckets.lookup(to).alias("at"), F.lit(True).alias("guest"))
        places = F.when(F.col("k") == buckets.lookup(heads), F.array(own, guest)).otherwise(F.array(own))
        rows = rows.withColumn("p", F.explode(places)).select(F.col("p.at").alias("bucket"), F.col("p.guest").alias("guest"), "k", "text")
    else:
        rows = rows.withColumn("guest", F.lit(False))
    schema = StructType.fromDDL("k long, text string, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (bucket, k, text, fingerprint) of the row that waits for its next
        for batch in batches:
            for part in slices(batch, 500):
                out = []
                for bucket, guest, k, text in zip(*(part[c].to_pylist() for c in ("bucket", "guest", "k", "text")), strict=True):
                    mark = fingerprint(text.encode("utf-8", "replace"))
                    if before and before[0] == bucket:
                        made = edited(before[2], text)
                        out.append((*before[1:3], made, before[3], fingerprint(made.encode("utf-8", "replace")), mark))
                    before = None if guest else (bucket, k, text, mark)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    dealt = rows.repartition(max(1, buckets.count), "bucket").sortWithinPartitions("bucket", "guest", F.desc("k"), F.desc("text")).select("bucket", "guest", "k", "text")
    return dealt.mapInArrow(run, schema).select(unkeyed(), "text", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint")


def compared(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds a likeness column for each pair of fingerprint columns; null if one is null."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(", ".join(f"{c} double" for c in pairs)).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [pa.array([None if x is None or y is None else likeness(x, y) for x, y in zip(b[p].to_pylist(), b[q].to_pylist(), strict=True)], pa.float64()) for p, q in pairs.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], schema=arrow)

    return rows.mapInArrow(run, schema)
