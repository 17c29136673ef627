"""Removal of repeated passages with families of suffix arrays.

A byte goes if it lies in a ``length``-byte string that also starts in a
document with a smaller doc_id. All suffixes of a corpus fit no single array,
so they are dealt to buckets by content: every ``length``-byte window belongs
to the least hash of its ``gram``-byte grams, its anchor, so that equal
windows meet whatever documents they come from. Consecutive windows with one
anchor travel as a single short string (a run).

1.  Rows go to groups by the hash of their text, compressed; equal texts meet
    there and only the one with the smallest id is looked at further.
2.  Every group sends each bucket the distinct anchors it has, and gets back
    which of them other groups have too (or two of its own documents).
3.  Runs with such an anchor go to their bucket, equal ones of a group once,
    under the smallest id. A bucket takes them in ascending id order, in
    batches. A batch gets a suffix array (its suffixes, as far as ``length``
    bytes, in byte order), is merge-scanned against the levels of the family,
    and becomes a level itself; while the last level is not larger than the
    new one, the two merge, so a family of n suffixes has log(n) levels.
    Each run gets back one bit per window: found under a smaller id or not.
4.  Every group turns the bits into removed spans.

Bytes are compared, never hashes alone. A group holds about ``group_bytes``
of text, a bucket the anchors of about ``bucket_bytes``; their numbers grow
with the input. A passage in a third of all documents comes to its bucket
once a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import NULL_KEY, cell, keyed, mix, slices, tidy, unkeyed

#: Windows of a run at most: their answers fill one unsigned 64-bit number.
RUN = 64
#: Bytes of a suffix that a level keeps beside its place.
HEAD = 16


@dataclass
class Level:
    """A suffix array: ``at`` are places in ``buf`` whose ``length`` bytes are
    distinct and ascend, ``head`` their first HEAD bytes, ``least`` the
    smallest id each is seen under."""

    buf: np.ndarray
    at: np.ndarray
    head: np.ndarray
    least: np.ndarray


def heads(buf: np.ndarray, at: np.ndarray, size: int = HEAD) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, size)[at]).view(f"S{size}").ravel()


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``key`` and each one's rank. Keys that leave room for their
    place in 64 bits are sorted with it, many times faster than by argsort."""
    n = np.uint64(bits)
    if int(key.max(initial=0)).bit_length() + bits <= 64:
        both = np.sort((key << n) | np.arange(len(key), dtype=np.uint64))
        order, ordered = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> n
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])) if len(key) else 0
    return order, rank


def order_of(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the places ``at``, as indices into it, and each one's
    rank by its first ``length`` bytes, by doubling what is ranked. Equals keep their order."""
    data = np.concatenate([buf, np.zeros(length, np.uint8)])
    n, bits = len(buf), max(1, len(buf).bit_length())
    done = min(5, length)
    key = np.zeros(n, np.uint64)
    for i in range(done):
        key = (key << np.uint64(8)) | data[i : i + n]
    while done < length:
        rank = _ranked(key, bits)[1].astype(np.uint64)
        step = min(done, length - done)  # less than done where they overlap, which orders alike
        after = np.zeros(n, np.uint64)
        after[: n - step] = rank[step:]
        width = max(1, int(rank.max(initial=0)).bit_length())
        key = (rank << np.uint64(width)) | after
        done += step
    return _ranked(key[at], bits)


class SuffixFamily:
    """Suffix arrays in levels; levels merge geometrically.

    Batches come in ascending id order; any number may be added at any time.
    """

    def __init__(self, length: int) -> None:
        self.length, self.levels = length, []

    def add(self, buf: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Index the suffixes of ``buf`` at ``at`` (ascending ids); True where one is known under a smaller id."""
        if not len(at):
            return np.zeros(0, bool)
        order, rank = order_of(buf, at, self.length)
        new = np.concatenate([[True], np.diff(rank[order]) > 0])
        first = order[new]  # a stable order: the first of equals has the least id
        low = ids[first].copy()
        batch = Level(buf, at[first], heads(buf, at[first], min(HEAD, self.length)), low)
        hit = np.zeros(len(first), bool)
        for level in self.levels:
            place, same = self.locate(level, batch)
            low[same] = np.minimum(low[same], level.least[place[same]])
            hit |= same
        known = low[rank] < ids
        self._push(Level(buf, batch.at[~hit], batch.head[~hit], low[~hit]))
        return known

    def locate(self, level: Level, batch: Level) -> tuple[np.ndarray, np.ndarray]:
        """Where each suffix of ``batch`` stands in ``level``, and whether it is there. Both are in order, so this scans them side by side."""
        lo, hi = np.searchsorted(level.head, batch.head, "left"), np.searchsorted(level.head, batch.head, "right")
        end, left = hi.copy(), np.flatnonzero(lo < hi)
        if self.length > HEAD and len(left):
            while len(left):
                mid = (lo[left] + hi[left]) >> 1
                less = self._compare(level, mid, batch, left) < 0
                lo[left] = np.where(less, mid + 1, lo[left])
                hi[left] = np.where(less, hi[left], mid)
                left = left[lo[left] < hi[left]]
            there = np.flatnonzero(lo < end)
            same = np.zeros(len(lo), bool)
            same[there] = self._compare(level, lo[there], batch, there) == 0
            return lo, same
        return lo, lo < end

    def _compare(self, x: Level, i: np.ndarray, y: Level, j: np.ndarray) -> np.ndarray:
        """The sign of each suffix of ``x`` against one of ``y``; their heads are equal."""
        a, b, out = x.at[i], y.at[j], np.zeros(len(i), np.int8)
        words = [np.ndarray(len(v.buf) - 7, ">u8", v.buf, strides=(1,)) for v in (x, y)]
        open_, at = np.arange(len(i)), HEAD
        while at < self.length and len(open_):
            off = min(at, self.length - 8)  # the last word overlaps the one before
            u, v = words[0][a[open_] + off].astype(np.uint64), words[1][b[open_] + off].astype(np.uint64)
            out[open_] = (u > v).astype(np.int8) - (u < v).astype(np.int8)
            open_, at = open_[u == v], at + 8
        return out

    def _push(self, new: Level) -> None:
        while self.levels and len(self.levels[-1].at) <= len(new.at):
            old = self.levels.pop()
            place, _ = self.locate(old, new)  # nothing of the new level stands in the old one
            to = place + np.arange(len(place))
            keep = np.ones(len(old.at) + len(to), bool)
            keep[to] = False
            merged = []
            for x, y in ((old.at, new.at + len(old.buf)), (old.head, new.head), (old.least, new.least)):
                z = np.empty(len(keep), x.dtype)
                z[keep], z[to] = x, y
                merged.append(z)
            new = Level(np.concatenate([old.buf, new.buf]), *merged)
        if len(new.at):
            self.levels.append(new)


def anchors(buf: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For every window of ``buf``, the least hash of its grams."""
    h = buf.astype(np.uint64) + np.uint64(1)
    span, mul = 1, 0x9E3779B97F4A7C15
    while span < gram:  # gram is a power of two
        h = h[:-span] * np.uint64(mul) + h[span:]
        mul = mul * mul % 2**64
        span *= 2
    h = mix(h)
    w, have = length - gram + 1, 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def runs(texts: list[bytes], length: int, gram: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run: text, first window (a place in the joined texts), windows, anchor.
    Short texts are taken together and long ones in parts of ``step`` bytes, so few arrays of that size are held."""
    out: list[tuple] = []

    def take(parts: list[tuple[int, int, bytes]]) -> None:
        buf = np.frombuffer(b"".join(p for *_, p in parts), np.uint8)
        if len(buf) < length:
            return
        a = anchors(buf, length, gram)
        sizes = np.array([len(p) for *_, p in parts])
        ends = np.cumsum(sizes)
        part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)[: len(a)]
        at = np.flatnonzero(np.arange(len(a)) + length <= ends[part])
        if not len(at):
            return
        a, part = a[at], part[at]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
        since = np.arange(len(at)) - np.repeat(new, np.diff(new, append=len(at)))
        start = np.flatnonzero(since % RUN == 0)
        shift = np.array([base for _, base, _ in parts]) - (ends - sizes)
        doc = np.array([d for d, *_ in parts])
        own = part[start]
        out.append((doc[own], at[start] + shift[own], np.diff(start, append=len(at)), a[start]))

    held, size, base = [], 0, 0
    for d, text in enumerate(texts):
        for i in range(0, max(1, len(text) - length + 1), step):
            piece = text[i : i + step + length - 1]
            held.append((d, base + i, piece))
            size += len(piece)
            if size >= step:
                take(held)
                held, size = [], 0
        base += len(text)
    take(held)
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate([np.zeros(0, kind), *(x[i] for x in out)]).astype(kind) for i, kind in enumerate(kinds))


def unpacked(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """The distinct texts of a group, in ascending order of their least ids: digests, ids, texts."""
    least: dict[bytes, int] = {}
    blobs: dict[bytes, bytes] = {}
    for sha, k, blob in zip(table["sha"].to_pylist(), table["k"].to_pylist(), table["blob"].to_pylist(), strict=True):
        least[sha] = min(k, least.get(sha, k))
        blobs[sha] = blob
    shas = sorted(least, key=lambda s: (least[s], s))
    unpack = zstandard.ZstdDecompressor()
    return shas, np.array([least[s] for s in shas], np.int64), [unpack.decompress(blobs[s]) for s in shas]


class Group:
    """The runs of a group's distinct texts."""

    def __init__(self, table: pa.Table, length: int, gram: int, buckets: int) -> None:
        self.shas, self.ids, self.texts = unpacked(table)
        self.length = length
        self.doc, self.at, self.windows, anchor = runs(self.texts, length, gram)
        self.values, self.of = np.unique(anchor, return_inverse=True)
        ids = self.ids[self.doc] if len(self.doc) else self.doc
        low, high = np.full(len(self.values), 2**63 - 1), np.full(len(self.values), -(2**63))
        np.minimum.at(low, self.of, ids)
        np.maximum.at(high, self.of, ids)
        self.several = low < high
        self.bucket = (self.values % np.uint64(buckets)).astype(np.int64)

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(self.bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(self.bucket[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(self.bucket[part[0]]), part

    def chosen(self, marks: pa.Table) -> dict[int, list[tuple[bytes, list[int]]]]:
        """Per bucket the distinct strings of the marked runs, with their runs, smallest id first."""
        marked = np.zeros(len(self.values), bool)
        bits = dict(zip(marks["bucket"].to_pylist(), marks["bits"].to_pylist(), strict=True))
        for bucket, part in self.by_bucket():
            if bucket in bits:
                marked[part] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(part)).astype(bool)
        whole, out = b"".join(self.texts), {}
        own = np.flatnonzero(marked[self.of]) if len(self.of) else np.zeros(0, np.int64)
        starts = self.at[own]
        ends = starts + self.windows[own] + self.length - 1
        for r, bucket, a, b in zip(own.tolist(), self.bucket[self.of[own]].tolist() if len(own) else [], starts.tolist(), ends.tolist(), strict=True):
            out.setdefault(bucket, {}).setdefault(whole[a:b], []).append(r)
        return {b: list(x.items()) for b, x in sorted(out.items())}

    def sent(self, own: list[tuple[bytes, list[int]]], press: zstandard.ZstdCompressor) -> tuple[bytes, bytes, bytes, bytes]:
        """What a bucket gets of distinct strings: their least ids, lengths and
        bytes, and, to be given back, where they stand (``places``)."""
        sizes = np.array([len(s) for s, _ in own], np.uint16)
        counts = np.array([len(rs) for _, rs in own], np.int64)
        flat = np.array([r for _, rs in own for r in rs], np.int64)
        ids = self.ids[self.doc[flat]]
        least = np.minimum.reduceat(ids, np.cumsum(counts) - counts)
        later = np.packbits(ids > np.repeat(least, counts)).tobytes()
        places = press.compress(np.concatenate([counts, self.at[flat]]).tobytes() + later)
        return least.tobytes(), sizes.tobytes(), press.compress(b"".join(s for s, _ in own)), places


def short(values: np.ndarray, buckets: int) -> bytes:
    """40 bits of each anchor beside its bucket. A bucket has about a million
    anchors, so another anchor is taken for it once in a million: it costs a run more, never a byte."""
    return (values // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unshort(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def batches_of(names: list[str], schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def shared_anchors(table: pa.Table) -> list[tuple]:
    """(grp, bucket, bits): which of the anchors each group sent are met elsewhere too."""
    sent = [unshort(x) for x in table["anchors"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)).astype(bool) for x, s in zip(table["several"].to_pylist(), sent, strict=True)]
    every = np.concatenate(sent)
    values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = counts > 1
    np.logical_or.at(shared, inverse, np.concatenate(several))
    marked, at, out = shared[inverse], 0, []
    for grp, bucket, s in zip(table["grp"].to_pylist(), table["bucket"].to_pylist(), sent, strict=True):
        own = marked[at : at + len(s)]
        at += len(s)
        if own.any():
            out.append((grp, bucket, np.packbits(own).tobytes()))
    return out


def judge(table: pa.Table, length: int, batch: int) -> list[tuple]:
    """(grp, bucket, found, sizes, places): for every run a group sent, its windows known under a smaller id."""
    strings: dict[bytes, list] = {}  # -> smallest id, bits for it
    sent = []
    unpack = zstandard.ZstdDecompressor()
    for grp, bucket, ids, sizes, blob, places in zip(*(table[c].to_pylist() for c in ("grp", "bucket", "ids", "sizes", "blob", "places")), strict=True):
        data = unpack.decompress(blob)
        ends = np.cumsum(np.frombuffer(sizes, np.uint16).astype(np.int64)).tolist()
        own = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        ids = np.frombuffer(ids, np.int64).tolist()
        sent.append((grp, bucket, ids, own, sizes, places))
        for s, k in zip(own, ids, strict=True):
            x = strings.get(s)
            if x is None:
                strings[s] = [k, 0]
            elif k < x[0]:
                x[0] = k
    family, todo, size = SuffixFamily(length), [], 0
    # places and, for ids, their order: half the width where the bucket allows it
    kind = np.int32 if sum(map(len, strings)) < 2**31 else np.int64
    ranks = np.unique(np.array([k for k, _ in strings.values()], np.int64))

    def flush() -> None:
        nonlocal todo, size
        buf = np.frombuffer(b"".join(s for s, _ in todo), np.uint8)
        lens = np.array([len(s) for s, _ in todo])
        n = lens - length + 1
        first = np.repeat(np.cumsum(lens) - lens, n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids = np.searchsorted(ranks, np.array([k for _, k in todo], np.int64)).astype(kind)
        known = family.add(buf, (first + within).astype(kind), np.repeat(ids, n))
        bits = np.bitwise_or.reduceat(known.astype(np.uint64) << within.astype(np.uint64), np.cumsum(n) - n)
        for (s, _), b in zip(todo, bits.tolist(), strict=True):
            strings[s][1] = b
        todo, size = [], 0

    for s, (k, _) in sorted(strings.items(), key=lambda x: (x[1][0], x[0])):
        todo.append((s, k))
        size += len(s)
        if size >= batch:
            flush()
    if todo:
        flush()
    out = []
    for grp, bucket, ids, own, sizes, places in sent:
        found = np.fromiter(((strings[s][1] if strings[s][0] == k else 2**64 - 1) for s, k in zip(own, ids, strict=True)), np.uint64, len(own))
        out.append((grp, bucket, found.tobytes(), sizes, places))
    return out


def cut_spans(left: pa.Table, right: pa.Table, length: int, step: int = 50_000) -> Iterator[tuple[bytes, int, bytes, list[tuple[int, int]]]]:
    """(sha, id, text, removed spans) of every distinct text of a group, from what its runs were told."""
    shas, ids, texts = unpacked(left)
    change = np.zeros(sum(map(len, texts)) + 1, np.int32)
    unpack, bit = zstandard.ZstdDecompressor(), np.arange(RUN, dtype=np.uint64)
    for found, sizes, places in zip(right["found"].to_pylist(), right["sizes"].to_pylist(), right["places"].to_pylist(), strict=True):
        bits, windows = np.frombuffer(found, np.uint64), np.frombuffer(sizes, np.uint16).astype(np.int64) - length + 1
        data = unpack.decompress(places)
        counts = np.frombuffer(data, np.int64, len(bits))
        at = np.frombuffer(data, np.int64, int(counts.sum()), 8 * len(bits))
        later = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (len(bits) + len(at))), count=len(at)).astype(bool)
        bits, windows = np.repeat(bits, counts), np.repeat(windows, counts)
        np.add.at(change, at[later], 1)  # a copy under a larger id goes whole
        np.subtract.at(change, at[later] + windows[later] + length - 1, 1)
        some = np.flatnonzero(~later & (bits > 0))
        for i in range(0, len(some), step):
            part = some[i : i + step]
            gone = ((bits[part, None] >> bit) & np.uint64(1)).astype(bool) & (bit.astype(np.int64) < windows[part, None])
            r, w = np.nonzero(gone)
            start = at[part[r]] + w
            np.add.at(change, start, 1)
            np.subtract.at(change, start + length, 1)
    covered = np.cumsum(change[:-1], dtype=np.int32) > 0
    end = 0
    for sha, k, text in zip(shas, ids.tolist(), texts, strict=True):
        own = covered[end : end + len(text)]
        end += len(text)
        edge = np.flatnonzero(np.diff(own.view(np.int8), prepend=0, append=0))
        yield sha, k, text, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 16, group_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, batch: int = 2_000_000, held_bytes: int = 16 << 20, as_text: bool = False) -> DataFrame:
    """(sha, k, n_bytes, spans, kept) of every distinct text of ``docs`` (k, text).

    k is the smallest id of the text, spans its removed byte ranges, kept the
    remaining bytes, or with ``as_text`` the characters that are whole in them
    (null where nothing was removed).
    Null texts count as empty.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(1, -(-total // group_bytes)), max(1, -(-total // bucket_bytes))

    def arrow(ddl: str):
        s = StructType.fromDDL(ddl)
        return s, to_arrow_schema(s)

    packed_t, packed_a = arrow("grp long, sha binary, k long, blob binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        least: dict[bytes, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(int.from_bytes(sha[:7], "big") % groups, sha, k, blob) for sha, (k, blob) in least.items()]
            for i in range(0, len(rows), 1000):
                yield from batches_of(packed_t.names, packed_a, rows[i : i + 1000]).to_batches()

        for b in batches:
            for part in slices(b):
                for k, text in zip(part["k"].to_pylist(), part["text"].to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "replace")
                    sha = hashlib.sha256(data).digest()
                    x = least.get(sha)
                    if x is None:
                        x = least[sha] = [k, press.compress(data)]
                        size += len(x[1]) + 100
                    x[0] = min(x[0], k)
            if size >= held_bytes:
                yield from flush()
                least, size = {}, 0
        yield from flush()
        tidy()

    packed = docs.mapInArrow(pack, packed_t)

    sent_t, sent_a = arrow("grp long, bucket long, anchors binary, several binary")

    def send(table: pa.Table) -> pa.Table:
        g = Group(table, length, gram, buckets)
        grp = table["grp"][0].as_py()
        tidy()
        return batches_of(sent_t.names, sent_a, [(grp, b, short(g.values[p], buckets), np.packbits(g.several[p]).tobytes()) for b, p in g.by_bucket()])

    marks_t, marks_a = arrow("grp long, bucket long, bits binary")
    marks = packed.groupBy("grp").applyInArrow(send, sent_t).groupBy("bucket").applyInArrow(lambda t: batches_of(marks_t.names, marks_a, shared_anchors(t)), marks_t)

    runs_t, runs_a = arrow("grp long, bucket long, ids binary, sizes binary, blob binary, places binary")

    def send_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            g, grp, press = Group(left, length, gram, buckets), left["grp"][0].as_py(), zstandard.ZstdCompressor(level=1)
            rows = [(grp, bucket, *g.sent(own, press)) for bucket, own in g.chosen(right).items()]
        tidy()
        return batches_of(runs_t.names, runs_a, rows)

    found_t, found_a = arrow("grp long, bucket long, found binary, sizes binary, places binary")

    def told(table: pa.Table) -> pa.Table:
        rows = judge(table, length, batch)
        tidy()
        return batches_of(found_t.names, found_a, rows)

    found = packed.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(send_runs, runs_t).groupBy("bucket").applyInArrow(told, found_t)
    out_t, out_a = arrow("sha binary, k long, n_bytes long, spans array<struct<start:long,end:long>>, kept " + ("string" if as_text else "binary"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return batches_of(out_t.names, out_a, [])
        rows = []
        for sha, k, text, spans in cut_spans(left, right, length):
            ends = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            rows.append((sha, k, len(text), [{"start": a, "end": b} for a, b in spans], kept.decode("utf-8", "ignore") if as_text and spans else None if as_text else kept))
        tidy()
        return batches_of(out_t.names, out_a, rows)

    return packed.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(cut, out_t)


def remove_repeats(docs: DataFrame, length: int = 50, **how) -> DataFrame:
    """Every row's remaining bytes: doc_id, n_bytes, spans, kept.

    Rows whose text also stands under a smaller doc_id lose all of it (if it
    has ``length`` bytes or more). Repeated rows of a doc_id come back as often
    as they were there. Null texts are empty; a null doc_id counts as the
    smallest. Kept bytes may start or end inside a character.
    """
    rows = keyed(docs)
    cuts = repeated_spans(rows, length, **how).withColumnRenamed("k", "least")
    data = F.coalesce(F.col("text"), F.lit(""))
    own = rows.select("k", F.octet_length(data).cast("long").alias("own_bytes"), F.unhex(F.sha2(data, 256)).alias("sha"))
    whole = (F.col("k") > F.col("least")) & (F.col("own_bytes") >= length)
    none = F.col("k") > F.col("least")  # shorter than a window: nothing goes
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("own_bytes").alias("end")))
    j = own.join(cuts, "sha")
    return j.select(
        unkeyed(),
        F.col("own_bytes").alias("n_bytes"),
        F.when(whole, all_of).when(none, F.slice("spans", 1, 0)).otherwise(F.col("spans")).alias("spans"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def without_repeats(docs: DataFrame, length: int = 50, **how) -> DataFrame:
    """``docs`` with the remaining characters as text and n_chars, if there, counted anew.

    Rows stay as many as they are, whatever ids they share; the rule is
    ``remove_repeats``', but characters that a cut splits go whole. Null texts
    stay null.
    """
    rows = keyed(docs)
    cuts = repeated_spans(rows, length, as_text=True, **how)
    cuts = cuts.select("sha", F.col("k").alias("least"), "kept")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    k = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_KEY))
    own = docs.select(F.struct(*[cell(docs, c) for c in docs.columns]).alias("row"), k.alias("k"), F.octet_length(text).alias("size"), F.unhex(F.sha2(text, 256)).alias("sha"))
    j = own.join(cuts, "sha")
    later = F.col("k") > F.col("least")
    left = F.when(later & (F.col("size") >= length), F.lit("")).when(later, F.col("row.text")).otherwise(F.coalesce("kept", "row.text"))
    left = F.when(F.col("row.text").isNotNull(), left)
    new = {"text": left, "n_chars": F.length(left).cast("long")}
    return j.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
