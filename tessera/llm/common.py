"""What the operators share: reading tables, keys, word hashing, Arrow maps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another libc keeps its own house
    _libc = None

#: Stands for a null doc_id inside the operators, so that it sorts first.
NULL_KEY = -(2**63)


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the machine: workers
    live on, and what one operator needed must not add to what the next one does."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Sees to it that the session sends Python at most 1000 rows or about 8 MB
    at once: texts are long, and a batch is held several times over."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) in (0, 10000):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def cell(docs: DataFrame, name: str) -> Column:
    """A column by its name, whatever is in it."""
    return docs["`" + name.replace("`", "``") + "`"]


def keyed(docs: DataFrame) -> DataFrame:
    """Only (k, text): extra columns go, whatever their names; null ids get NULL_KEY."""
    small_batches(docs)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"), F.col("text").cast("string").alias("text"))


def unkeyed(k: str = "k") -> Column:
    return F.nullif(F.col(k), F.lit(NULL_KEY)).alias("doc_id")


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept while the worker lives, bounded."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Kept:
    """A bounded map in two generations: what a batch uses moves to the young
    one; when that is full it turns old, and what was not used since goes."""

    def __init__(self, limit: int) -> None:
        self.half, self.young, self.old = limit // 2, {}, {}

    def missing(self, keys: set) -> list:
        """``take`` for a new batch."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        return self.take(keys)

    def take(self, keys: set) -> list:
        """Takes over what is known of a batch's keys; returns the rest, to be put into ``young``."""
        young, old = self.young, self.old
        absent = [k for k in keys if k not in young]
        young.update((k, old[k]) for k in absent if k in old)
        return [k for k in absent if k not in young] if old else absent


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n-word window; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = mix(words[: len(words) - n + 1].copy())
    for i in range(1, n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return h


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., list[list]]], columns: tuple[str, ...] = ("k", "text")) -> DataFrame:
    """mapInArrow over ``columns``. ``make()`` runs once a task and gives a
    function from the columns' lists to the output columns."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            for part in slices(b):
                got = step(*(part.column(c).to_pylist() for c in columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(got, arrow, strict=True)], schema=arrow)
        tidy()

    return df.mapInArrow(run, out)


def with_measures(docs: DataFrame, schema: str, make: Callable[[], Callable[[list[str | None]], list[list]]], row: str = "row") -> DataFrame:
    """``docs`` as one struct column ``row`` beside columns made from its text.
    ``make()`` runs once a task and gives a function from texts to those columns.
    A row goes through Python once, with its text in it; ``text`` need not be a string."""
    small_batches(docs)
    odd = dict(docs.dtypes)["text"] != "string"
    own = [cell(docs, c) for c in docs.columns] + [docs["text"].cast("string")] * odd
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(own)])
    made = StructType.fromDDL(schema)
    out = StructType([StructField(row, docs.schema, False), *made.fields])
    arrow = to_arrow_schema(out)
    at, kind = len(docs.columns) if odd else docs.columns.index("text"), arrow.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            for part in slices(b):
                got = step(part.column(at).to_pylist())
                own = pa.StructArray.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(part.columns, kind, strict=False)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x, type=f.type) for x, f in zip(got, list(arrow)[1:], strict=True))], schema=arrow)
        tidy()

    return rows.mapInArrow(run, out)


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Short pieces, so that few decoded rows are held at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
