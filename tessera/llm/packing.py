"""Cost-balanced packing of documents into sequences of equal capacity.

A piece of n tokens costs linear*n + quadratic*n*n, the work of a transformer
layer on it. Documents are packed in groups of neighbours; a group cuts whole
capacities off its long documents, takes the remainders in descending order,
and gives each to the sequence with the lowest cost that still has room. The
group opens as many sequences as its remainders fill, so late remainders that
fit nowhere whole are cut over the lowest-cost sequences, and only one
sequence a group needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import keyed, slices, tidy, unkeyed
from tessera.llm.tokens import encoder

PIECES = "k long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; documents without tokens get none."""
    out, rest, seq = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        out.extend((d, i * capacity, capacity, seq + i, 0) for i in range(whole))
        seq += whole
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    bins = -(-sum(r[0] for r in rest) // capacity)
    room, cost = np.full(bins, capacity, np.int64), np.zeros(bins)
    for n, d, start in rest:
        while n:
            open_ = np.where(room >= n, cost, np.inf)
            b = int(np.argmin(open_))
            if open_[b] == np.inf:
                b = int(np.argmin(np.where(room > 0, cost, np.inf)))
            take = min(n, int(room[b]))
            out.append((d, start, take, seq + b, capacity - int(room[b])))
            room[b] -= take
            cost[b] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048, group_bytes: int = 8 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file. Every row of ``docs`` is a
    document: a null or empty text is its end id alone, repeated rows are
    packed as often as they come, a null doc_id comes back null. No rows give
    no pieces. Every partition of ``docs`` is packed where it lies, in groups
    of about ``group_bytes`` of text, and pads one sequence a group; nothing
    is shuffled, so no key or text can crowd a task. Partitions with less text
    are taken together. A sequence's id tells its partition (upper bits) and
    its place there.
    """
    rows = keyed(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = StructType.fromDDL(PIECES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        ks: list[int] = []
        ids: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            lengths = [len(x) // 4 for x in ids]
            got = pack(lengths, capacity, linear, quadratic)
            for i in range(0, len(got), 5000):
                part = got[i : i + 5000]
                cols = [
                    [ks[d] for d, *_ in part],
                    [s for _, s, *_ in part],
                    [n for _, _, n, *_ in part],
                    [ids[d][4 * s : 4 * (s + n)] for d, s, n, *_ in part],
                    [lengths[d] for d, *_ in part],
                    [first + q for *_, q, _ in part],
                    [o for *_, o in part],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            first += 1 + max(q for *_, q, _ in got)

        for b in batches:
            for part in slices(b, 500):
                for k, text, got in zip(part["k"].to_pylist(), part["text"].to_pylist(), enc.encode_batch(part["text"].to_pylist()), strict=True):
                    ks.append(k)
                    ids.append(got + end)
                    size += len(text or "")
                    if size >= group_bytes:
                        yield from flush()
                        ks, ids, size = [], [], 0
        if ks:
            yield from flush()
        tidy()

    return rows.coalesce(max(1, -(-total // group_bytes))).mapInArrow(run, schema).select(unkeyed(), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
