"""Where a user's own models come in. The engine calls none by itself.

=================  ==============================================================
Embedder           ``operators.records.new_records(embed=...)``: column to column
Summarizer         ``operators.consolidate.generate_summaries``
Conflict resolver  ``operators.consolidate.resolve``
Distiller          ``operators.sync.prepare(distiller=...)``
Captioner          ``operators.images.describe``
Entity finder      ``entity_finder``: column to column
Session dialect    ``register_dialect``
=================  ==============================================================
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.text import STOP_WORDS, entities
from tessera.operators.vector import feature_vector
from tessera.sources import sessions


class Embedder(Protocol):
    dimensions: int
    model_name: str

    def embed_batch(self, texts: Sequence[str]) -> Sequence[np.ndarray]: ...


def embedding(embedder: Embedder) -> Callable[[Column], Column]:
    """An embedder as a function of columns, a batch of texts at a time; it is sent to the workers once a task."""

    def column(text: Column) -> Column:
        @pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            made = embedder.embed_batch(s.fillna("").tolist())
            return pd.Series([np.asarray(v, np.float32) for v in made])

        return run(text)

    return column


class Hashing:
    """The feature-hashing embedder behind the protocol."""

    model_name = "hashing"

    def __init__(self, dimensions: int = 512) -> None:
        self.dimensions = dimensions

    def embed_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [feature_vector(t, self.dimensions) for t in texts]


class TokenBuckets:
    """For tests. Fixed by what other stores hold: a token's sha256 names its bucket
    by the first four bytes and its weight, -1 to 1, by the next four; sums have length 1."""

    model_name = "token-buckets"

    def __init__(self, dimensions: int = 384) -> None:
        self.dimensions = dimensions

    def embed_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for token in text.lower().split():
                at, weight = np.frombuffer(hashlib.sha256(token.encode()).digest()[:8], ">u4").tolist()
                row[at % self.dimensions] += np.float32(2.0 * weight / (2**32 - 1) - 1.0)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return list(out / np.where(norms > 0, norms, 1))


def entity_finder(find: Callable[[str], Sequence[str]], most: int = 24, least_length: int = 2, characters: int = 5000) -> Callable[[Column], Column]:
    """``functions.text.entities`` of a content, then those that ``find`` (a named-entity
    model, say) has in its first ``characters``: in lower case, without stop
    words, each once, ``most`` in all. A text that ``find`` fails on keeps its own."""

    @pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(text: str) -> list[str]:
            try:
                return [str(e) for e in find(text)]
            except Exception:  # the plain way stands
                return []

        return s.fillna("").map(one)

    def column(content: Column) -> Column:
        found = F.transform(run(F.substring(content, 1, characters)), lambda e: F.trim(F.lower(e)))
        found = F.filter(found, lambda e: (F.length(e) >= least_length) & ~e.isin(*STOP_WORDS))
        found = F.slice(F.array_distinct(found), 1, most)
        return F.slice(F.array_distinct(F.concat(entities(content), found)), 1, most)

    return column


def register_dialect(agent: str, read: Callable[..., sessions.Sessions]) -> None:
    """Makes ``read(spark, root)`` the reader of an agent's sessions."""
    sessions.DIALECTS[agent] = read
