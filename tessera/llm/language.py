"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram of letters is bound
into one vector, the product of its letters' vectors, each rotated by its
place. A document is the sum (bundle) of its n-grams' vectors, and so is a
language, over the documents it is learned from. A document gets the language
whose prototype has the largest cosine with it, after the mean of all
prototypes, what they have in common, is taken off both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import keyed, mix, slices, unkeyed

#: Symbols: 0 for what is no letter, 1 to 26 for a to z, the others for other letters by their code.
SYMBOLS = 128


class Profiles:
    def __init__(self, size: int = 1024, n: int = 3, seed: int = 7) -> None:
        self.size, self.n = size, n
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, size))
        self.rolled = [np.roll(letters, i, axis=1) for i in range(n)]
        code = np.arange(0x110000)
        symbol = np.zeros(0x110000, np.int64)
        is_letter = np.fromiter((chr(c).isalpha() for c in code), bool, len(code))
        other = 27 + (mix(code.astype(np.uint64)) % np.uint64(SYMBOLS - 27)).astype(np.int64)
        symbol[is_letter] = other[is_letter]
        symbol[97:123] = np.arange(1, 27)
        self.symbol = symbol
        self.known: dict[int, np.ndarray] = {}

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes and their counts; runs of non-letters are one gap, and gaps stand at both ends."""
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        s = np.concatenate([[0], s, [0]])
        s = s[(s != 0) | np.concatenate([[True], s[:-1] != 0])]
        if not s.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = len(s) - self.n + 1
        code = np.zeros(max(m, 0), np.int64)
        for i in range(self.n):
            code = code * SYMBOLS + s[i : i + m]
        return np.unique(code, return_counts=True)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The bound vector of every n-gram."""
        v = self.rolled[self.n - 1][codes // SYMBOLS ** (self.n - 1)].copy()
        for i in range(1, self.n):
            v *= self.rolled[self.n - 1 - i][codes // SYMBOLS ** (self.n - 1 - i) % SYMBOLS]
        return v

    def bundle(self, codes: np.ndarray, counts: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.zeros(self.size)
        for i in range(0, len(codes), block):
            out += counts[i : i + block].astype(np.float32) @ self.vectors(codes[i : i + block]).astype(np.float32)
        return out


def learn(docs: DataFrame, **how) -> DataFrame:
    """(lang, vector) of every language of ``docs`` (text, lang); null ones are left out.

    Every task adds up its n-grams by language and binds each once.
    """
    schema = StructType.fromDDL("lang string, vector array<double>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total = Profiles(**how), {}
        for b in batches:
            for part in slices(b, 500):
                own: dict[str, list] = {}
                for text, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist(), strict=True):
                    own.setdefault(lang, []).append(p.grams(text or ""))
                for lang, got in own.items():
                    codes, where = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
                    v = p.bundle(codes, np.bincount(where, np.concatenate([n for _, n in got]), len(codes)))
                    total[lang] = total.get(lang, 0) + v
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v], arrow.field("vector").type)], schema=arrow)

    parts = docs.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, schema)
    each = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return each.groupBy("lang").agg(vector.alias("vector"))


def prototypes(learned: DataFrame, most: int = 20_000) -> list[tuple[str, list[float]]]:
    """What ``learn`` found, in order of language. More than ``most`` languages
    (8 KB each) are an error: a column of them would then be no language."""
    n = learned.count()
    if n > most:
        raise ValueError(f"{n} languages to learn; at most {most} fit every task")
    return [(r["lang"], list(r["vector"])) for r in learned.orderBy("lang").collect()]


class Classifier:
    def __init__(self, prototypes: list[tuple[str, list[float]]], **how) -> None:
        self.p, self.langs = Profiles(**how), [lang for lang, _ in prototypes]
        m = np.array([v for _, v in prototypes]).reshape(len(prototypes), self.p.size)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        self.mean = m.mean(axis=0) if len(m) > 1 else np.zeros(self.p.size)
        m = m - self.mean
        self.m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = self.p.grams(text or "")
        if not len(codes) or not self.langs:
            return "und", 0.0
        v = self.p.bundle(codes, counts)
        v = v / max(np.linalg.norm(v), 1e-12) - self.mean
        cos = self.m @ v / max(np.linalg.norm(v), 1e-12)
        i = int(np.argmax(cos))
        return self.langs[i], float(min(1.0, max(0.0, cos[i])))


def identify(docs: DataFrame, prototypes: list[tuple[str, list[float]]], **how) -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    A text that is null or has no letter is ``und`` with score 0; so is every
    text if no language was learned. Ties go to the first language in order.
    The prototypes go to every task: one vector a language.
    """
    schema = StructType.fromDDL("k long, lang_pred string, score double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(prototypes, **how)
        for b in batches:
            for part in slices(b):
                got = [c.predict(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["k"], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], schema=arrow)

    return keyed(docs).mapInArrow(run, schema).select(unkeyed(), "lang_pred", "score")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
