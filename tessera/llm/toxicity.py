"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled documents: one on windows
of ordinary text, and one on what toxic documents say in words that ordinary
ones do not (words with a ``GRAM``-byte string that no ordinary training
document has, four to a sample; on whole windows the trainer picks what is
frequent in any text, and held-out AUC falls from 0.99 to 0.59). Every window
of a text is compressed with the ordinary dictionary alone and with the toxic
one before it; what the toxic one saves is evidence. The largest saving of a
text's windows and the numbers of windows over several savings go into a
logistic model, fitted on labelled documents that gave nothing to its
dictionaries and weighted to the classes' true shares, so that 0.5 is the
calibrated threshold.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, with_measures

WINDOW, STEP, GRAM, LEVEL = 80, 56, 5, 9
EDGE = b".,;:!?#*$%&|<>()[]'-" + b'"'


@dataclass(frozen=True)
class Bounds:
    """What is fitted on: documents per class at most (those with the smallest
    hash of their id), the longest that is taken, so the driver gets 112 million
    characters at most, and dictionary sizes in bytes."""

    toxic: int = 1600
    ordinary: int = 4000
    chars: int = 20_000
    toxic_bytes: int = 1024
    ordinary_bytes: int = 32 << 10


def windows(data: bytes) -> list[bytes]:
    """Overlapping windows that cover all of the text."""
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def words(data: bytes) -> list[bytes]:
    """Words without punctuation at their ends, a space on each side."""
    return [b" " + w.strip(EDGE) + b" " for w in data.split()]


def grams(word: bytes) -> list[bytes]:
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def train(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """A dictionary's bytes; of too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def ordinary_dictionary(texts: list[bytes], size: int) -> bytes:
    parts = [w for d in texts for w in windows(d)]
    order = np.random.default_rng(0).permutation(len(parts))[: (100 * size) // WINDOW]
    return train(size, [parts[i] for i in order], 32, 6)


def toxic_dictionary(toxic: list[bytes], ordinary: list[bytes], size: int) -> bytes:
    """Trained on the words of ``toxic`` that ``ordinary`` has no likes of."""
    known: set[bytes] = set()
    for d in ordinary:
        known.update(g for w in set(words(d)) for g in grams(w))
    samples = []
    for d in toxic:
        new = [w for w in words(d) if any(g not in known for g in grams(w))]
        samples += [b"".join(new[i : i + 4]) for i in range(0, len(new), 4)]
    return train(size, samples, 24, 8)


class Pair:
    """Compressors for both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.same = not toxic
        made = []
        for content in (ordinary, toxic + ordinary):
            how = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if len(content) >= 8:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                how["dict_data"] = d
            made.append(zstandard.ZstdCompressor(**how).compress)
        self.ordinary, self.toxic = made

    def features(self, text: str | None) -> list[float]:
        parts = windows(plain(text))
        if self.same:
            saved = np.zeros(len(parts))
        else:
            a, b = self.ordinary, self.toxic
            saved = np.array([len(a(w)) - len(b(w)) for w in parts])
        over = [math.log1p(int((saved >= s).sum())) for s in (3, 4, 5, 6, 8)]
        return [float(saved.max()), *over, math.log1p(float(np.maximum(saved - 2, 0).sum()))]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / sd, np.ones(len(x))]
    w, weight = np.zeros(a.shape[1]), weight / weight.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ ((p - y) * weight) + l2 * w
        w -= np.linalg.solve((a * (p * (1 - p) * weight)[:, None]).T @ a + l2 * np.eye(len(w)), grad)
    return mean, sd, w


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    sd: np.ndarray
    w: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.w):
            return np.full(len(x), self.prior)
        z = np.c_[(x - self.mean) / self.sd, np.ones(len(x))] @ self.w
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """From ``labels`` (doc_id, toxic) and the texts of ``docs``. The driver
    gets the documents that ``bounds`` names and no others; rows without a
    label or a text are left out. Without both classes the score is constant."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((1, bounds.toxic), (0, bounds.ordinary))]
    chosen = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("k"), "toxic")
    # at most bounds.toxic + bounds.ordinary short rows
    rows = keyed(docs).where(F.length("text") <= bounds.chars).join(F.broadcast(chosen), "k").orderBy("k", "text").collect()
    fold = [zlib.crc32(str(r["k"]).encode()) // 7 % 3 == 0 for r in rows]
    data, y = [plain(r["text"]) for r in rows], np.array([r["toxic"] for r in rows])
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    of = lambda c, held: [d for d, t, f in zip(data, y, fold, strict=True) if t == c and (held is None or f == held)]
    nothing = Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), prior)
    if not (of(1, True) and of(0, True) and of(1, False) and of(0, False)):
        return nothing
    ordinary = ordinary_dictionary(of(0, False), bounds.ordinary_bytes)
    pair = Pair(toxic_dictionary(of(1, False), of(0, False), bounds.toxic_bytes), ordinary)
    held = [(r["text"], t) for r, t, f in zip(rows, y, fold, strict=True) if f]
    x, t = np.array([pair.features(s) for s, _ in held]), np.array([c for _, c in held], float)
    weight = np.where(t == 1, totals[1] / t.sum(), totals[0] / (1 - t).sum())
    return Model(toxic_dictionary(of(1, None), of(0, None), bounds.toxic_bytes), ordinary, *fit_logistic(x, t, weight), prior)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` as one struct column ``row`` beside its score. Null and empty texts get a score too."""

    def make():
        pair = Pair(model.toxic, model.ordinary)
        return lambda texts: [model.score(np.array([pair.features(t) for t in texts]))]

    return with_measures(docs, f"{column} double", make)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns as they were."""
    return scored(docs, model).where(F.col("score") < threshold).select("row.*")


def training_part(doc_id: Column, parts: int = 5, held: int = 0) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) != held
