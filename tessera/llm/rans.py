"""Token ids in files coded by a static range asymmetric numeral system.

One file holds whole documents in ascending doc_id order:

    "TRAN" version:u16 scale:u16 lanes:u32 block:u32 docs:u64 ids:u64
    table:u32 index:u32 dir:u32       lengths of the three parts that follow
    table   zlib(symbols:u32[], frequencies:u32[])  shared by all blocks
    index   zlib(doc_ids:i64[], counts:i64[])
    dir     per block (first id:u64, ids:u32, offset:u64, bytes:u32, crc32:u32)
    head    crc32 of all the above
    blocks

A block is ``block`` ids dealt in turn to ``lanes`` interleaved coders, each
with a 63-bit state that moves 32 bits at a time; the vector of states is what
numpy codes at once. Its directory entry is a checkpoint: a block is decoded
with the table and its own bytes alone, in any order, and its checksum is
verified first. Files are rows of a Parquet table, so Spark's committer writes
them to any file system and a lost executor leaves no half file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import keyed, slices, tidy, unkeyed
from tessera.llm.ordered import sorted_ranges
from tessera.llm.tokens import encoder

HEAD = struct.Struct("<4sHHIIQQIII")
ENTRY = np.dtype([("first", "<u8"), ("ids", "<u4"), ("at", "<u8"), ("bytes", "<u4"), ("crc", "<u4")])
SCALE, LANES, BLOCK = 18, 1024, 1 << 18
LOW = np.uint64(1 << 31)


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**scale."""
    size = 1 << scale
    if len(counts) > size:
        raise ValueError("more symbols than slots")
    f = np.maximum(1, counts * size // counts.sum())
    off = size - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if off > 0:
        f[order[0]] += off
    i = 0
    while off < 0:
        take = min(-off, max(0, int(f[order[i]]) - 1), max(1, int(f[order[i]]) // 2))
        f[order[i]] -= take
        off += take
        i = (i + 1) % len(f)
    return f


def encode_block(sym: np.ndarray, freq: np.ndarray, cum: np.ndarray, scale: int = SCALE, lanes: int = LANES) -> bytes:
    n, m = len(sym), np.uint64(scale)
    x = np.full(lanes, LOW, np.uint64)
    limit, words = np.uint64(63 - scale), []
    for i in reversed(range(0, n, lanes)):
        s = sym[i : i + lanes]
        f, c, y = freq[s], cum[s], x[: len(s)]
        full = (y >> limit) >= f
        if full.any():
            words.append(y[full].astype("<u4"))  # the low half
            y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[: len(s)] = (q << m) + (y - q * f) + c
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, symbol: np.ndarray, freq: np.ndarray, cum: np.ndarray, scale: int = SCALE, lanes: int = LANES) -> np.ndarray:
    """``symbol`` maps a slot to its symbol."""
    x = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
    out, at, m, mask = np.empty(n, np.int64), 0, np.uint64(scale), np.uint64((1 << scale) - 1)
    for i in range(0, n, lanes):
        y = x[: min(lanes, n - i)]
        slot = y & mask
        s = symbol[slot]
        y = freq[s] * (y >> m) + slot - cum[s]
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = (y[need] << np.uint64(32)) | words[at : at + len(need)]
            at += len(need)
        x[: len(y)] = y
        out[i : i + len(y)] = s
    if at != len(words) or (x != LOW).any():
        raise ValueError("block does not end in its first state")
    return out


def _tables(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return f.astype(np.uint64), (np.cumsum(f) - f).astype(np.uint64)


def write_file(doc_ids: list[int], ids: list[bytes]) -> bytes:
    every = np.frombuffer(b"".join(ids), "<u4")
    counts = np.bincount(every) if len(every) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    f = scaled(counts[symbols]) if len(symbols) else symbols
    freq, cum = _tables(f)
    to = np.zeros(len(counts), np.int64)
    to[symbols] = np.arange(len(symbols))
    blocks, entries, at = [], [], 0
    for i in range(0, len(every), BLOCK):
        part = every[i : i + BLOCK]
        data = encode_block(to[part], freq, cum)
        blocks.append(data)
        entries.append((i, len(part), at, len(data), zlib.crc32(data)))
        at += len(data)
    table = zlib.compress(symbols.astype("<u4").tobytes() + f.astype("<u4").tobytes())
    index = zlib.compress(np.array(doc_ids, "<i8").tobytes() + np.array([len(x) // 4 for x in ids], "<i8").tobytes())
    directory = np.array(entries, ENTRY).tobytes()
    head = HEAD.pack(b"TRAN", 1, SCALE, LANES, BLOCK, len(doc_ids), len(every), len(table), len(index), len(directory)) + table + index + directory
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


class TokenFile:
    """Reader of one file; blocks are decoded on their own."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.scale, self.lanes, self.block, docs, self.ids, t, i, d = HEAD.unpack_from(data)
        at = HEAD.size
        if magic != b"TRAN" or version != 1 or zlib.crc32(data[: at + t + i + d]) != struct.unpack_from("<I", data, at + t + i + d)[0]:
            raise ValueError("not a token file, or its head is damaged")
        table = np.frombuffer(zlib.decompress(data[at : at + t]), "<u4")
        self.symbols, f = table[: len(table) // 2], table[len(table) // 2 :].astype(np.int64)
        self.freq, self.cum = _tables(f)
        self.slots = np.repeat(np.arange(len(f)), f)
        index = np.frombuffer(zlib.decompress(data[at + t : at + t + i]), "<i8")
        self.doc_ids, self.counts = index[:docs], index[docs:]
        self.entries = np.frombuffer(data[at + t + i : at + t + i + d], ENTRY)
        self.data, self.at = data, at + t + i + d + 4

    def read_block(self, b: int) -> np.ndarray:
        e = self.entries[b]
        raw = self.data[self.at + int(e["at"]) : self.at + int(e["at"]) + int(e["bytes"])]
        if zlib.crc32(raw) != e["crc"]:
            raise ValueError(f"block {b} is damaged")
        return self.symbols[decode_block(raw, int(e["ids"]), self.slots, self.freq, self.cum, self.scale, self.lanes)]

    def documents(self) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, ids of the file before it, its ids) in order; a block at a time."""
        have, b, at = np.zeros(0, "<u4"), 0, 0
        for k, n in zip(self.doc_ids.tolist(), self.counts.tolist(), strict=True):
            parts = [have]
            got = len(have)
            while got < n:
                parts.append(self.read_block(b).astype("<u4"))
                got, b = got + len(parts[-1]), b + 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield k, at, have[:n].tobytes()
            have, at = have[n:], at + n


FILES = "bucket long, file long, docs long, ids long, data binary"


def encode_files(docs: DataFrame, tokenizer: str, end_id: int = 2, target_bytes: int = 16 << 20, file_ids: int = 4 << 20) -> DataFrame:
    """The files of ``docs`` in ascending doc_id order: (bucket, file) orders them.

    A bucket holds about ``target_bytes`` of text, a file about ``file_ids``
    ids (more only where one document has more). Null texts are empty, a null
    doc_id comes first, rows of one doc_id stand in the order of a hash of
    their text, repeated rows come as often as they were there. Any 64-bit
    doc_id will do; an empty table gives no files.
    """
    schema = StructType.fromDDL(FILES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, bucket = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        ks: list[int] = []
        ids: list[bytes] = []
        number, size = 0, 0

        def flush() -> pa.RecordBatch:
            row = [bucket, number, len(ks), size, write_file(ks, ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for b in batches:
            for part in slices(b, 500):
                for k, got in zip(part["k"].to_pylist(), enc.encode_batch(part["text"].to_pylist()), strict=True):
                    if size >= file_ids:
                        yield flush()
                        number, size, ks, ids = number + 1, 0, [], []
                    ks.append(k)
                    ids.append(got + end)
                    size += len(got) // 4 + 1
        if ks:
            yield flush()
        tidy()

    return sorted_ranges(keyed(docs), target_bytes).mapInArrow(run, schema)


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document; start counts the ids of all documents before it.

    Ids are counted within runs of 1024 buckets and over the runs, so the one
    window without partitions has a short row for every 1024 buckets.
    """
    each = files.select("bucket", "file", "ids", F.floor(F.col("bucket") / 1024).alias("run"))
    upto = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = each.withColumn("own", upto(Window.partitionBy("run").orderBy("bucket", "file"))).drop("ids")
    runs = each.groupBy("run").agg(F.sum("ids").alias("ids")).withColumn("before", upto(Window.orderBy("run"))).drop("ids")
    starts = own.join(runs, "run").select("bucket", "file", (F.col("own") + F.col("before")).alias("base"))
    schema = StructType.fromDDL("bucket long, file long, k long, at long, ids binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                bucket, file, data = (part[c][0].as_py() for c in ("bucket", "file", "data"))
                rows: list[tuple] = []
                size = 0
                for row in TokenFile(data).documents():
                    rows.append((bucket, file, *row))
                    size += len(row[2])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    got = files.select("bucket", "file", "data").mapInArrow(run, schema)
    return got.join(starts, ["bucket", "file"]).select(unkeyed(), (F.col("base") + F.col("at")).alias("start"), "ids")
