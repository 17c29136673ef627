"""Language-model scores of texts: attention over subword ids, beside word counts.

What is learned comes from all training documents. Tasks first turn texts into
chunks: words as numbers of the chunk, subword ids of each word once, and the
chunk's distinct words. Word counts meet their chunks again by a shuffle of
distinct words, so no table of all words is in one place. The attention model
is learned in rounds, each over twice the documents of the one before and all
of them together over every one once: tasks run Adam over their own windows from
the round's parameters, and what they end with is averaged by tokens.

A text is, for both, its words in lower case (A-Z) and an end. Defined results:
a null text is empty and has its end alone; equal texts have equal scores; a
null id stays null; repeated rows are scored, and learned from, as often as they
come; without training documents counts are 0 and the model is as it starts; an
empty table has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import attention
from tessera.llm.common import NULL_KEY, keyed, tidy
from tessera.llm.tokens import encoder
from tessera.plans.shared import materialize, over_cores

#: A chunk ends when it has so many words, or so many distinct ones.
CHUNK_WORDS, CHUNK_DISTINCT = 3_000_000, 300_000
#: Round i learns from documents whose hash falls into its share of 256, with a
#: learning rate and windows a step; small steps come first, low rates last.
ROUNDS = (0, 2, 4, 8, 16, 32, 64, 128, 256)
RATES = (0.02, 0.02, 0.02, 0.02, 0.015, 0.01, 0.006, 0.003)
BATCHES = (16, 16, 16, 16, 32, 32, 64, 128)
#: Sums of parameters are added up by so many a task until no more are left.
FAN = 32

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words with white space of other scripts could share a token with their neighbours: encoded alone.
_ODD = re.compile(r"[^\S \t\n\r\x0b\x0c]")
_ENCODED = "chunk long, place int, k long, train boolean, words binary, ids binary, word binary, number int, n long"


class Numbers(dict):
    """Words to numbers as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def subwords(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each after a space, and where each word's begin (one more at the end)."""
    enc = encoder(path)
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    texts = [w.decode(errors="replace") for w in words]
    odd = {i for i, t in enumerate(texts) if _ODD.search(t)} if _ODD.search(" ".join(texts)) else set()
    plain = [i for i in range(len(texts)) if i not in odd] if odd else list(range(len(texts)))
    lengths = np.zeros(len(words), np.int64)
    flat = np.zeros(0, np.int64)
    if plain:
        flat = np.frombuffer(enc.encode("".join(" " + texts[i] for i in plain)), "<u4").astype(np.int64)
        begins = np.flatnonzero(_spaced(path)[flat])
        lengths[plain] = np.diff(np.append(begins, len(flat)))
    if odd:
        alone = {i: np.frombuffer(enc.encode(" " + texts[i]), "<u4").astype(np.int64) for i in odd}
        parts, at = [], 0
        for i in range(len(words)):
            if i in odd:
                parts.append(alone[i])
                lengths[i] = len(alone[i])
            else:
                parts.append(flat[at : at + lengths[i]])
                at += lengths[i]
        flat = np.concatenate(parts)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


_begins: dict[str, np.ndarray] = {}


def _spaced(path: str) -> np.ndarray:
    """By id: whether its bytes begin with a space."""
    if path not in _begins:
        tok = encoder(path).tok
        size = tok.get_vocab_size() + 1
        _begins[path] = np.array([(tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
    return _begins[path]


def spread(flat: np.ndarray, offsets: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The ids of a row of words, one after another."""
    lengths = (offsets[1:] - offsets[:-1])[numbers]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets[numbers] - (ends - lengths), lengths) + np.arange(total)]


def encoded(docs: DataFrame, train: Column, path: str, end: int) -> DataFrame:
    """Rows of documents (chunk, place, k, train, words, ids) and of the chunks'
    distinct words (chunk, word, number, n), n counting those in training documents."""
    rows = keyed(over_cores(docs.select("doc_id", "text"))).withColumn("train", train)
    names = [x.split()[0] for x in _ENCODED.split(", ")]
    types = dict(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64()), strict=True))
    schema = pa.schema([(n, types[n]) for n in names])

    def batch(rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, n_held, chunk = Numbers(), [], 0, TaskContext.get().partitionId() << 32

        def told() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            flat, offsets = subwords(words, path)
            n = np.zeros(len(words), np.int64)
            for i in range(0, len(held), 500):
                part = held[i : i + 500]
                ids = [np.append(spread(flat, offsets, w), end).astype("<u2").tobytes() for _, _, w in part]
                learned = [w for _, t, w in part if t]
                if learned:
                    n += np.bincount(np.concatenate(learned), minlength=len(n))
                yield batch(len(part), chunk=pa.repeat(pa.scalar(chunk, pa.int64()), len(part)), place=pa.array(range(i, i + len(part)), pa.int32()), k=pa.array([k for k, _, _ in part], pa.int64()), train=pa.array([t for _, t, _ in part], pa.bool_()), words=pa.array([w.astype("<i4").tobytes() for _, _, w in part], pa.binary()), ids=pa.array(ids, pa.binary()))
            for i in range(0, len(words), 50_000):
                own = words[i : i + 50_000]
                yield batch(len(own), chunk=pa.repeat(pa.scalar(chunk, pa.int64()), len(own)), word=pa.array(own, pa.binary()), number=pa.array(range(i, i + len(own)), pa.int32()), n=pa.array(n[i : i + 50_000], pa.int64()))

        for b in batches:
            for k, text, t in zip(b.column("k").to_pylist(), b.column("text").cast(pa.binary()), b.column("train").to_pylist(), strict=True):
                words = (text.as_py() or b"").translate(_LOWER).split()
                held.append((k, t, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                n_held += len(words) + 1
                if n_held >= CHUNK_WORDS or len(numbers) >= CHUNK_DISTINCT:
                    yield from told()
                    numbers, held, n_held, chunk = Numbers(), [], 0, chunk + 1
        if held:
            yield from told()
        tidy()

    return rows.mapInArrow(run, _ENCODED)


def id_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in training texts, summed by Spark; one number an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("ids"):
                n += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["id", "n"])

    out = np.zeros(size)
    for r in texts.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def neighbours(texts: DataFrame, counts: np.ndarray) -> np.ndarray:
    """By id: how often each of the most frequent ids, or another, stands before and after it."""
    size, n = len(counts), attention.NEIGHBOURS
    kind = np.full(size, n, np.int64)
    kind[np.argsort(-counts, kind="stable")[:n]] = np.arange(n)
    width = 2 * (n + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size * width, np.int32)

        def add(ids: np.ndarray) -> None:
            near = kind[ids]
            at = np.concatenate([ids[1:] * width + near[:-1], ids[:-1] * width + (n + 1) + near[1:]])
            where, many = np.unique(at, return_counts=True)
            cells[where] += many.astype(np.int32)

        held, total = [], 0
        for b in batches:
            for x in b.column("ids"):
                held.append(np.frombuffer(x.as_buffer(), "<u2").astype(np.int64))
                total += len(held[-1])
                if total > 1_000_000:
                    add(np.concatenate(held))
                    held, total = [], 0
        if held:
            add(np.concatenate(held))
        some = np.flatnonzero(cells)
        for i in range(0, len(some), 100_000):
            part = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(cells[part], pa.int64())], names=["cell", "n"])
        tidy()

    out = np.zeros(size * width, np.float32)
    for b in texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[b.column("cell").to_numpy()] = b.column("n").to_numpy()
    return out.reshape(size, width)


def averaged(sums: DataFrame) -> tuple[int, np.ndarray | None]:
    """Tokens, and the mean by tokens of the parameters in (tokens, total) rows of float64 vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, None
        for b in batches:
            for n, x in zip(b.column("tokens").to_pylist(), b.column("total"), strict=True):
                own = np.frombuffer(x.as_buffer(), "<f8")
                tokens, total = tokens + n, own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["tokens", "total"])

    n = sums.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        sums = sums.repartition(n).mapInArrow(run, "tokens long, total binary")
    rows = sums.collect()
    tokens = sum(r.tokens for r in rows)
    return tokens, sum(np.frombuffer(r.total, "<f8") for r in rows) / tokens if tokens else None


def learn(texts: DataFrame, size: int, end: int) -> tuple[attention.Units, np.ndarray]:
    """Units and parameters from the ids of training texts (chunk, place, ids)."""
    sc = texts.sparkSession.sparkContext
    counts = id_counts(texts, size)
    units = attention.units_of(counts, neighbours(texts, counts))
    vector = attention.Model.start(counts, units).vector
    share = F.pmod(F.xxhash64("chunk", "place"), F.lit(ROUNDS[-1]))
    for i, (rate, batch) in enumerate(zip(RATES, BATCHES, strict=True)):
        sent = sc.broadcast((units, vector))

        def run(batches: Iterator[pa.RecordBatch], i=i, rate=rate, batch=batch, sent=sent) -> Iterator[pa.RecordBatch]:
            units, vector = sent.value
            trainer = attention.Trainer(vector, units, rate, batch, warm=10 if i else 30, seed=i)
            for b in batches:
                for x in b.column("ids"):
                    trainer.add(np.frombuffer(x.as_buffer(), "<u2").astype(np.int64), end)
            own = trainer.done().astype(np.float64) * trainer.tokens
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens], pa.int64()), pa.array([own.astype("<f8").tobytes()], pa.binary())], names=["tokens", "total"])
            tidy()

        part = texts.where((share >= ROUNDS[i]) & (share < ROUNDS[i + 1])).select("ids")
        _, mean = averaged(part.mapInArrow(run, "tokens long, total binary"))
        vector = vector if mean is None else mean.astype(np.float32)
        sent.unpersist()
    return units, vector


def attention_scores(texts: DataFrame, units: attention.Units, vector: np.ndarray, end: int) -> DataFrame:
    """(chunk, k, train, words, score): log10 probabilities of texts' ids."""
    sent = texts.sparkSession.sparkContext.broadcast((units, vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, vector = sent.value
        model = attention.Model(vector)
        for b in batches:
            own = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in b.column("ids")]
            got = attention.scored(model, units, own, end) / np.log(10) if own else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("chunk", "k", "train", "words")), pa.array(got, pa.float64())], names=["chunk", "k", "train", "words", "score"])
        tidy()

    return texts.select("chunk", "k", "train", "words", "ids").mapInArrow(run, "chunk long, k long, train boolean, words binary, score double")


def scored(docs: DataFrame, train: Column, path: str) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``train`` says, from the column ``k`` (doc_id as a long), what is learned from.
    ``base_score`` is that of add-0.1 word counts, ``score`` the attention model's.
    """
    size = encoder(path).tok.get_vocab_size() + 1
    end = size - 1
    if size > 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    rows = materialize(encoded(docs, train, path, end), "encoded", "zstd")
    texts, words = rows.where("ids IS NOT NULL"), rows.where("word IS NOT NULL").select("chunk", "word", "number", "n")
    own = Window.partitionBy("word")
    known = words.select("chunk", "number", "n", F.sum("n").over(own).alias("c"), (F.row_number().over(own.orderBy("chunk")) == 1).alias("first"))
    known = materialize(known, "word_counts", "zstd")
    tally = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("first") & (F.col("c") > 0), 1)).alias("v")).first()
    ends = texts.where("train").count()
    total, kinds = tally.n + ends, tally.v + (ends > 0)
    units, vector = learn(texts.where("train").select("chunk", "place", "ids"), size, end)
    below = np.log10(total + 0.1 * (kinds + 1))

    def base(rows: pa.Table, counts: pa.Table) -> pa.Table:
        c = np.zeros(counts.num_rows, np.int64)
        c[counts.column("number").to_numpy()] = counts.column("c").to_numpy()
        log, seen = np.log10(c + 0.1) - below, c > 0
        n, n_known, score = [], [], []
        for x in rows.column("words"):
            w = np.frombuffer(x.as_buffer(), "<i4")
            n.append(len(w) + 1)
            n_known.append(int(seen[w].sum()) + (ends > 0))
            score.append(float(log[w].sum() + np.log10(ends + 0.1) - below))
        return pa.table({"k": rows.column("k"), "train": rows.column("train"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(score, pa.float64()), "score": rows.column("score")})

    judged = attention_scores(texts, units, vector, end)
    both = judged.groupBy("chunk").cogroup(known.select("chunk", "number", "c").groupBy("chunk"))
    out = both.applyInArrow(base, "k long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.nullif("k", F.lit(NULL_KEY)).alias("doc_id"), "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
