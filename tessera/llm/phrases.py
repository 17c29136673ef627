"""Collocations by Apriori passes: phrases of k words are counted only where both
of their parts of k - 1 words are frequent, then cut where they hold least.

Every pass reads all texts. What it needs of the pass before, the frequent
shorter phrases, is broadcast as a bitmap over their hashes: 16 bits a phrase,
64 MB at most. A phrase whose parts are frequent always finds their bits, so
nothing is lost; a phrase that finds bits of others is counted exactly like the
rest and goes for its count. So the bitmap bounds what is sent, never what is
found. Within a task, phrases are told apart exactly, by ranks of pairs.

Defined results: a null text has no words; a null language is ``und``, an empty
one is itself; repeated rows count as often as they come; very long texts are
read in portions that end where a piece ends; an empty table, or one without
frequent phrases, has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import mix, small_batches, tidy
from tessera.plans.shared import materialize

#: A chunk is counted and told when it has so many words, or so many distinct ones.
CHUNK_WORDS, CHUNK_DISTINCT = 4_000_000, 400_000
#: A longer text is read in portions of about so many bytes.
PORTION = 4 << 20
#: Bits of a page of the bitmap, and of the whole of it at most, as powers of two.
PAGE, MOST_BITS = 16, 29

_BREAK = b"\xff"  # no byte of UTF-8
_PLAIN = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def portions(text: bytes) -> Iterator[bytes]:
    """A folded text whole, or cut after breaks."""
    while len(text) > PORTION and (cut := text.find(_BREAK, PORTION)) >= 0:
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


class Numbers(dict):
    """Words to small numbers as they come; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Chunk:
    """Words of some texts of one language, as numbers."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.n = Numbers(), [], 0

    def add(self, text: bytes) -> None:
        words = text.replace(_BREAK, b" \xff ").split()  # whitespace left is 0x20 and 0x09
        words.append(_BREAK)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    @property
    def full(self) -> bool:
        return self.n >= CHUNK_WORDS or len(self.numbers) >= CHUNK_DISTINCT

    def words(self) -> pa.Array:
        return pa.array([b"", *list(self.numbers)[1:]], pa.binary())


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one word more."""
    return mix(h * _MULTIPLIER + word)


def phrase_hash(lang: bytes, phrase: bytes) -> int:
    parts = word_hashes(lang, phrase.split(b" "))
    h = parts[:1]
    for i in range(1, len(parts)):
        h = extended(h, parts[i : i + 1])
    return int(h[0])


class Bitmap:
    """Which hashes may be among the frequent: never a wrong no."""

    def __init__(self, bits: int, pages: dict[int, bytes]) -> None:
        self.bits, self.array = bits, np.zeros(max(1, (1 << bits) // 8), np.uint8)
        for page, content in pages.items():
            at = page << (PAGE - 3)
            self.array[at : at + len(content)] = np.frombuffer(content, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.array[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrases_of(chunk: Chunk, lang: bytes, k: int, frequent: Bitmap | None) -> tuple[pa.Array, np.ndarray]:
    """Phrases of k words with their counts, where both parts may be frequent."""
    w, words = np.concatenate(chunk.parts), chunk.words()
    if k == 1:
        n = np.bincount(w, minlength=len(words))
        n[0] = n[1:].sum()  # the empty phrase: all words
        return words, n
    hashes = word_hashes(lang, list(chunk.numbers))
    starts = len(w) - (k - 1) + 1
    if starts < 2:
        return words[:0], np.zeros(0, np.int64)
    short = frequent.has(hashes) if k == 2 else None
    if short is not None:
        short[0] = False
        ok = short[w]
    else:
        at = np.flatnonzero(w[:starts] != 0)
        for i in range(1, k - 1):
            at = at[w[at + i] != 0]
        h = hashes[w[at]]
        for i in range(1, k - 1):
            h = extended(h, hashes[w[at + i]])
        ok = np.zeros(starts, bool)
        ok[at[frequent.has(h)]] = True
    at = np.flatnonzero(ok[:-1] & ok[1:])
    rank = w[at].astype(np.uint64)
    first = n = np.zeros(0, np.int64)
    for i in range(1, k):
        pair = rank << np.uint64(32) | w[at + i].astype(np.uint64)
        if i < k - 1:
            rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        else:
            _, first, n = np.unique(pair, return_index=True, return_counts=True)
    pos = at[first]
    parts = [words.take(pa.array(w[pos + i])) for i in range(k)]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())), n


def counted(docs: DataFrame, k: int, frequent: Broadcast | None) -> DataFrame:
    """(lang, phrase, a): phrases of k words counted over all texts; the empty phrase of k = 1 counts all words."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def told(chunks: dict[bytes, Chunk]) -> Iterator[pa.RecordBatch]:
        for lang, c in ((x, c) for x, c in chunks.items() if c.n):
            phrases, n = phrases_of(c, lang, k, frequent.value if frequent else None)
            phrases = phrases.cast(pa.string())
            for i in range(0, len(n), 100_000):
                part = phrases.slice(i, 100_000)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang.decode(), pa.string()), len(part)), part, pa.array(n[i : i + 100_000], pa.int64())], schema=schema)
        chunks.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[bytes, Chunk] = {}
        held = 0
        for b in batches:
            for lang, text in zip(b.column("lang").cast(pa.binary()), b.column("text").cast(pa.binary()), strict=True):
                chunk = chunks.setdefault(lang.as_py(), Chunk())
                for part in portions(text.as_py().translate(_PLAIN)):
                    before = chunk.n
                    chunk.add(part)
                    held += chunk.n - before
                    if chunk.full or held >= CHUNK_WORDS:
                        yield from told(chunks)
                        chunk, held = chunks.setdefault(lang.as_py(), Chunk()), 0
        yield from told(chunks)
        tidy()

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def bitmap(grams: DataFrame) -> Bitmap:
    """The phrases' bits, gathered by pages: at most 64 MB however many there are."""
    n = grams.count()
    bits = min(MOST_BITS, max(PAGE, (16 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("lang").cast(pa.binary()), b.column("phrase").cast(pa.binary()), strict=True)
            at = np.array([phrase_hash(x.as_py(), p.as_py()) for x, p in pairs], np.uint64) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(PAGE)).astype(np.int32)), pa.array((at & np.uint64((1 << PAGE) - 1)).astype(np.int32))], names=["page", "bit"])

    def page(t: pa.Table) -> pa.Table:
        on = np.zeros(1 << PAGE, np.uint8)
        on[t.column("bit").to_numpy()] = 1
        return pa.table({"page": t.column("page").slice(0, 1), "content": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    pages = grams.select("lang", "phrase").mapInArrow(places, "page int, bit int").distinct().groupBy("page").applyInArrow(page, "page int, content binary")
    return Bitmap(bits, {r.page: bytes(r.content) for r in pages.toLocalIterator()})


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, a, k): all phrases of up to ``longest`` words that stand
    ``least`` times or more in a language; k = 0 is the empty phrase, with all words' count."""
    small_batches(docs)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    spark, levels, sent = docs.sparkSession, [], None
    for k in range(1, longest + 1):
        level = counted(rows, k, sent).where(F.col("a") >= least).withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(k))
        levels.append(materialize(level, f"phrases_{k}"))
        if sent is not None:
            sent.unpersist()
        if k < longest:
            sent = spark.sparkContext.broadcast(bitmap(levels[-1].where("k > 0")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def cut(grams: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of every phrase of two words or more:
    its lowest-scoring cut, of equal ones the first. Products have 38 digits."""
    whole = grams.where("k = 0").select("lang", F.col("a").alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")
    parts = grams.where("k >= 2").select("lang", "phrase", "k", "a", F.split("phrase", " ").alias("w"), at)
    head, tail = F.array_join(F.slice("w", 1, F.col("at")), " "), F.array_join(F.slice("w", F.col("at") + 1, F.col("k")), " ")
    parts = parts.select("lang", "phrase", "k", "a", "at", head.alias("head"), tail.alias("tail"))
    known = grams.where("k >= 1")
    parts = parts.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    parts = parts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    wide = lambda c: f"cast({c} AS decimal(18, 0))"
    score = F.expr(f"(1000BD * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = parts.join(whole, "lang").withColumn("score", score).groupBy("lang", "phrase", "k", "a", "n")
    return best.agg(F.min(F.struct("score", "at", "l", "r")).alias("b")).select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def maximal(grams: DataFrame) -> DataFrame:
    """(lang, phrase) of phrases of two words or more that stand as often in a
    longer one. One word more is enough to look at: counts only fall on the way."""
    w = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(w, 1, F.col("k") - 1), " "), F.array_join(F.slice(w, 2, F.col("k") - 1), " "))).alias("phrase")
    longer = grams.where("k >= 3").select("lang", inner, F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return grams.where("k >= 2").join(longer, ["lang", "phrase"]).where("most >= a").select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``
    phrases by score, count and, ascending, their bytes."""
    grams = frequent_phrases(docs, longest, least)
    scored = cut(grams).join(maximal(grams), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
