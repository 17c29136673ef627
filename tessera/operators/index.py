"""An inverted index on disk that takes inserts, updates and deletes as they come.

A batch of records becomes a segment, and segments never change. Within one,
each task sorts its records by length and cuts them into spans of some thousand; a block holds
a term's postings in a span, with their lengths beside them, the largest count
and the least length. So

* a hot term is many blocks, written by the tasks that read its records, and a
  file of blocks is sorted by term, so a scan opens the row groups of its terms;
* a span is looked at whole or not at all: the sum of what its blocks could
  score at most, by their largest counts and least lengths, tells whether any
  of its records can be among the best k, and the rest is not opened;
* document frequencies come from the blocks' sizes, not their contents, where
  one term of the index answers a term of the query.

A delete marks records of a span as gone. An insert makes a segment, then
segments of like size merge, so each posting is written again a logarithmic
number of times; what is gone is dropped on the way. All of it is one version of
the store (``state.Snapshots``): readers see a batch whole or not yet.

Kinds: ``stems`` (words of any script, folded and stemmed as the full-text
search of SQLite does), ``plain`` (words of a-z and 0-9) and ``grams`` (three
characters, with their places, for substrings without reading a text).

Null contents are empty records: they count as records and have no term. Of
rows of one batch with the same id the one with the longest content stands.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from tessera.operators.lexical import K1, B, query_terms, trigram_terms
from tessera.operators.postings import WORDS, folded
from tessera.operators.state import Snapshots
from tessera.plans.shared import materialize

#: A span ends with so many records or characters; of trigrams, whose places are many, with fewer.
SPAN_RECORDS, SPAN_CHARS, GRAM_CHARS = 4096, 4_000_000, 1_000_000
#: A segment is merged with the newer ones if it holds at most so many times their records.
RATIO = 2
#: Spans that are scored first, to learn what the k-th best is worth at least.
FIRST = 4
_PLAIN = re.compile("[a-z0-9]+")


def _word_blocks(texts: list[str], terms: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Terms, where each one's postings begin, their records and counts, and records' lengths."""
    posts: dict[str, tuple[list[int], list[int]]] = {}
    lengths = []
    for i, text in enumerate(texts):
        found = Counter(terms(text))
        lengths.append(found.total())
        for t, n in found.items():
            at, counts = posts.setdefault(t, ([], []))
            at.append(i)
            counts.append(n)
    names = list(posts)
    starts = np.cumsum([0, *(len(posts[t][0]) for t in names)])
    flat = lambda j: np.array([x for t in names for x in posts[t][j]], np.int32)
    return names, starts, flat(0), flat(1), lengths


def _gram_blocks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """As ``_word_blocks``, with the places of every posting one after another."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) for t in texts]
    lengths = [max(0, len(c) - 2) for c in codes]
    keys = np.concatenate([np.zeros(0, np.uint64), *(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:] for c in codes if len(c) > 2)])
    record = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    place = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in lengths)])
    order = np.argsort(keys, kind="stable")  # records and places stay in order within a gram
    keys, record, place = keys[order], record[order], place[order]
    new = np.flatnonzero((np.diff(keys, prepend=keys[:1]) != 0) | (np.diff(record, prepend=record[:1]) != 0))
    post = np.concatenate([[0], new]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(post, len(keys))).astype(np.int32)
    gram = keys[post]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    low = np.uint64((1 << 21) - 1)
    names = ["".join(chr(int(k >> np.uint64(s) & low)) for s in (42, 21, 0)) for k in gram[first]]
    return names, np.append(first, len(gram)), record[post].astype(np.int32), counts, lengths, place


def _stemmed() -> Callable[[str], list[str]]:
    """Terms of a lower-case text; a task folds a distinct word once."""
    known: dict[str, str] = {}

    def terms(text: str) -> list[str]:
        out = []
        for w in WORDS.findall(text):
            t = known.get(w)
            if t is None:
                if len(known) > 300_000:
                    known.clear()
                t = known[w] = folded(w)
            out.append(t)
        return [t for t in out if t]

    return terms


@dataclass(frozen=True)
class Stats:
    n: int
    average: float


class Index:
    """The index of one column of texts, at a root of its own."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "stems", ids: str = "long") -> None:
        if kind not in ("stems", "plain", "grams"):
            raise ValueError(f"no index of kind {kind}")
        self.spark, self.kind, self.ids = spark, kind, ids
        self.store = Snapshots(spark, root, keys={})
        places = ", places array<array<int>>" if kind == "grams" else ""
        self.schema = StructType.fromDDL(f"seg string, term string, span long, n int, most int, least int, ids array<{ids}>, tfs array<int>, dls array<int>{places}")
        self.lists = [f.name for f in self.schema.fields if f.name in ("ids", "tfs", "dls", "places")]

    # state

    def _state(self) -> tuple[int, dict]:
        number, state = self.store._state()
        if not state:
            state = {"blocks": {"schema": json.loads(self.schema.json()), "parts": {}}, "dead": {"schema": json.loads(StructType.fromDDL(f"seg string, span long, id {self.ids}, dl int").json()), "parts": {}}, "segments": {}}
        return number, state

    def blocks(self, state: dict | None = None, segments: list[str] | None = None) -> DataFrame:
        state = state or self._state()[1]
        table = state["blocks"] | {"parts": {s: f for s, f in state["blocks"]["parts"].items() if segments is None or s in segments}}
        return self.store._open(table, "blocks")

    def dead(self, state: dict | None = None) -> DataFrame:
        state = state or self._state()[1]
        return self.store._open(state["dead"], "dead").where(F.col("seg").isin(*state["segments"]))

    def segments(self) -> dict[str, dict]:
        return self._state()[1]["segments"]

    def stats(self, state: dict | None = None) -> Stats:
        own = (state or self._state()[1])["segments"].values()
        n = sum(s["n"] - s["dead"] for s in own)
        return Stats(n, sum(s["length"] - s["dead_length"] for s in own) / n if n else 0.0)

    # changes

    def put(self, records: DataFrame, id_col: str = "id", content: str = "content") -> None:
        """Inserts records; those whose id is there already are replaced."""
        rows = records.select(F.col(id_col).cast(self.ids).alias("id"), F.lower(F.coalesce(F.col(content), F.lit(""))).alias("text"))
        rows = materialize(rows.groupBy("id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")), "batch", "zstd")
        self._change(rows.select("id"), rows)

    def delete(self, ids: DataFrame) -> None:
        """Records of ``ids`` (id) are no longer found; unknown ones do nothing."""
        self._change(ids.select(F.col("id").cast(self.ids).alias("id")).distinct(), None)

    def _change(self, ids: DataFrame, rows: DataFrame | None) -> None:
        number, state = self._state()
        if state["segments"]:
            state = self._mark(state, ids)
        if rows is not None:
            seg = uuid.uuid4().hex
            state = self._add(state, seg, self._built(rows, seg))
            state = self._merged(state)
        self.store._publish(number + 1, json.dumps(state))

    def _mark(self, state: dict, ids: DataFrame) -> dict:
        own = self.blocks(state).where("term = ''").select("seg", "span", F.explode(F.arrays_zip("ids", "dls")).alias("x"))
        gone = own.select("seg", "span", F.col("x.ids").alias("id"), F.col("x.dls").alias("dl")).join(ids, "id", "left_semi")
        gone = gone.join(self.dead(state).select("seg", "span", "id"), ["seg", "span", "id"], "left_anti").select("seg", "span", "id", "dl")
        folder = self._write("dead", gone)
        sums = self.spark.read.parquet(f"{self.store.root}/dead/{folder}").groupBy("seg").agg(F.count("*").alias("n"), F.sum("dl").alias("length")).collect()  # a row a segment
        if not sums:
            return state
        segments = {s: dict(x) for s, x in state["segments"].items()}
        for r in sums:
            segments[r.seg]["dead"] += r.n
            segments[r.seg]["dead_length"] += r.length
        return state | {"segments": segments, "dead": state["dead"] | {"parts": state["dead"]["parts"] | {folder: folder}}}

    def _write(self, table: str, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{self.store.root}/{table}/{folder}")
        return folder

    def _add(self, state: dict, seg: str, blocks: DataFrame) -> dict:
        """``state`` with a segment written from its blocks."""
        folder = self._write("blocks", blocks.sortWithinPartitions("term", "span"))  # blocks stay where they were made: a file has all terms, in order
        own = self.spark.read.schema(self.schema).parquet(f"{self.store.root}/blocks/{folder}").where("term = ''")
        r = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("length")).first()
        entry = {"n": r.n, "length": r.length, "dead": 0, "dead_length": 0}
        return state | {"segments": state["segments"] | {seg: entry}, "blocks": state["blocks"] | {"parts": state["blocks"]["parts"] | {seg: folder}}}

    def _built(self, rows: DataFrame, seg: str) -> DataFrame:
        """Blocks of a batch (id, text). The block of the term ``''`` lists a span's records."""
        kind, arrow, with_places = self.kind, to_arrow_schema(self.schema), self.kind == "grams"
        near = rows.select("id", "text", F.length("text").alias("size")).sortWithinPartitions("size", "id").drop("size")  # a task's own records are enough to tell short spans from long ones
        most_chars = GRAM_CHARS if kind == "grams" else SPAN_CHARS

        def block_rows(ids: pa.Array, texts: list[str], span: int, terms: Callable[[str], list[str]] | None) -> Iterator[pa.RecordBatch]:
            names, starts, record, counts, lengths, *places = _gram_blocks(texts) if kind == "grams" else _word_blocks(texts, terms)
            dl = np.array(lengths, np.int32)
            names, record = ["", *names], np.concatenate([np.arange(len(texts), dtype=np.int32), record])
            counts = np.concatenate([np.zeros(len(texts), np.int32), counts])
            starts = np.concatenate([[0], starts + len(texts)]).astype(np.int64)
            lists = [ids.take(pa.array(record)), pa.array(counts), pa.array(dl[record])]
            if with_places:
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(places[0])))
            most, least = np.maximum.reduceat(counts, starts[:-1]), np.minimum.reduceat(dl[record], starts[:-1])
            columns = [pa.repeat(pa.scalar(seg, pa.string()), len(names)), pa.array(names, pa.string()), pa.repeat(pa.scalar(span, pa.int64()), len(names)), pa.array(np.diff(starts), pa.int32()), pa.array(most), pa.array(least)]
            columns += [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for x in lists]
            made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            for i in range(0, len(names), 2000):
                yield made.slice(i, 2000)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = _stemmed() if kind == "stems" else _PLAIN.findall
            span, ids, texts, chars = TaskContext.get().partitionId() << 32, [], [], 0
            for b in batches:
                for i, text in enumerate(b.column("text").to_pylist()):
                    ids.append(b.column("id").slice(i, 1))
                    texts.append(text)
                    chars += len(text)
                    if len(texts) >= SPAN_RECORDS or chars >= most_chars:
                        yield from block_rows(pa.concat_arrays(ids), texts, span, terms)
                        span, ids, texts, chars = span + 1, [], [], 0
            if texts:
                yield from block_rows(pa.concat_arrays(ids), texts, span, terms)

        return near.mapInArrow(run, self.schema)

    def _merged(self, state: dict) -> dict:
        """``state`` after the newest segments of like size became one."""
        live = {s: x["n"] - x["dead"] for s, x in state["segments"].items()}
        order = list(state["segments"])  # oldest first
        run, size = [order[-1]], live[order[-1]]
        for s in reversed(order[:-1]):
            if live[s] > RATIO * size:
                break
            run.append(s)
            size += live[s]
        if len(run) < 2:
            return state
        seg = uuid.uuid4().hex
        made = self._add(state, seg, self._joined(state, run, seg))
        rest = {s: x for s, x in made["segments"].items() if s not in run}
        state = made | {"segments": rest, "blocks": made["blocks"] | {"parts": {s: f for s, f in made["blocks"]["parts"].items() if s not in run}}}
        left = self.dead(state)  # of the segments that are still there
        parts = {}
        if any(x["dead"] for x in rest.values()):
            folder = self._write("dead", left)
            parts = {folder: folder}
        return state | {"dead": state["dead"] | {"parts": parts}}

    def _joined(self, state: dict, run: list[str], seg: str) -> DataFrame:
        """The blocks of some segments as those of one, without what is gone.
        Neighbouring spans by length become one, up to the records of a span."""
        blocks, dead = self.blocks(state, run), self.dead(state).where(F.col("seg").isin(*run))
        spans = blocks.where("term = ''").select("seg", "span", "n", "least").repartitionByRange("least", "seg", "span").sortWithinPartitions("least", "seg", "span")

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = TaskContext.get().partitionId() << 32, 0
            for b in batches:
                out = []
                for n in b.column("n").to_pylist():
                    if held and held + n > SPAN_RECORDS:
                        at, held = at + 1, 0
                    held += n
                    out.append(at)
                yield pa.RecordBatch.from_arrays([b.column("seg"), b.column("span"), pa.array(out, pa.int64())], names=["seg", "span", "to"])

        to = materialize(spans.mapInArrow(numbered, "seg string, span long, to long"), "spans")
        cells = ["term", "to", *self.lists]
        placed = blocks.join(to, ["seg", "span"])
        dirty = dead.select("seg", "span").distinct()
        clean = placed.join(dirty, ["seg", "span"], "left_anti").select(*cells)
        one = placed.join(dirty, ["seg", "span"], "left_semi").select("seg", "span", "term", "to", F.explode(F.arrays_zip(*self.lists)).alias("x"))
        one = one.select("seg", "span", "term", "to", F.col("x.ids").alias("id"), "x").join(dead.select("seg", "span", "id"), ["seg", "span", "id"], "left_anti")
        kept = clean.unionByName(one.select("term", "to", *[F.array(F.col(f"x.{c}")).alias(c) for c in self.lists]))
        got = kept.groupBy("term", "to").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in self.lists])
        size = F.size("ids")
        return got.select(F.lit(seg).alias("seg"), "term", F.col("to").alias("span"), size.alias("n"), F.array_max("tfs").alias("most"), F.array_min("dls").alias("least"), *self.lists)

    # questions

    def _wanted(self, query: str) -> list[tuple[str, bool]]:
        terms = query_terms(query)
        if self.kind == "stems":
            terms = [(folded(t), pre) for t, pre in terms]
        return [(t, pre) for t, pre in dict.fromkeys(terms) if t]

    @staticmethod
    def _fits(terms: list[tuple[str, bool]]) -> tuple[Column, Column]:
        """Whether a block's term answers any term of the query, and the numbers of those it answers."""
        fits = [F.col("term").startswith(t) if pre else F.col("term") == t for t, pre in terms]
        either = fits[0]
        for f in fits[1:]:
            either = either | f
        return either, F.explode(F.filter(F.array(*[F.when(f, F.lit(i)) for i, f in enumerate(fits)]), lambda x: x.isNotNull()))

    def _postings(self, blocks: DataFrame, dead: DataFrame) -> DataFrame:
        """(i, seg, span, id, tf, dl) of blocks with a number ``i``, without what is gone."""
        x = blocks.select("i", "seg", "span", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("x"))
        x = x.select("i", "seg", "span", F.col("x.ids").alias("id"), F.col("x.tfs").alias("tf"), F.col("x.dls").alias("dl"))
        return x.join(dead.select("seg", "span", "id"), ["seg", "span", "id"], "left_anti")

    def _frequencies(self, blocks: DataFrame, dead: DataFrame, n: int) -> list[int]:
        """Records with a term, by its number. Only spans where records are gone,
        or where several terms of the index answer, are opened."""
        heads = blocks.groupBy("i", "seg", "span").agg(F.count("*").alias("terms"), F.sum("n").alias("n"))
        dirty = dead.select("seg", "span").distinct().withColumn("dirty", F.lit(True))
        heads = heads.join(dirty, ["seg", "span"], "left").withColumn("open", F.coalesce("dirty", F.lit(False)) | (F.col("terms") > 1))
        plain = heads.where("not open").groupBy("i").agg(F.sum("n").alias("df"))
        inside = self._postings(blocks.join(heads.where("open").select("i", "seg", "span"), ["i", "seg", "span"], "left_semi"), dead)
        counted = inside.select("i", "id").distinct().groupBy("i").agg(F.count("*").alias("df"))
        rows = plain.unionByName(counted).groupBy("i").agg(F.sum("df").alias("df")).collect()  # a row a term of the query
        found = {r.i: r.df for r in rows}
        return [found.get(i, 0) for i in range(n)]

    @staticmethod
    def _idf(frequencies: list[int], n: int) -> list[float]:
        idf = [np.log((n - d + 0.5) / (d + 0.5)) for d in frequencies]
        return [float(x) if x > 0 else 1e-6 for x in idf]

    @staticmethod
    def _part(idf: list[float], f: Column, dl: Column, average: float) -> Column:
        weight = F.element_at(F.array(*map(F.lit, idf)), F.col("i") + 1)
        return weight * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / F.lit(average or 1.0)))

    def _scored(self, blocks: DataFrame, dead: DataFrame, idf: list[float], average: float) -> DataFrame:
        hits = self._postings(blocks, dead).groupBy("i", "id").agg(F.sum("tf").cast("double").alias("f"), F.max("dl").alias("dl"))
        return hits.groupBy("id").agg(F.round(F.sum(self._part(idf, F.col("f"), F.col("dl"), average)), 6).alias("score"))

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], f"id {self.ids}, score double")

    def ranked(self, query: str) -> DataFrame:
        """(id, score) of every record with a term of the query, by BM25."""
        if self.kind == "grams":
            return self._substrings(query)
        state, terms = self._state()[1], self._wanted(query)
        s = self.stats(state)
        if not terms or not s.n:
            return self._none()
        either, which = self._fits(terms)
        blocks, dead = self.blocks(state).where(either).withColumn("i", which), self.dead(state)
        return self._scored(blocks, dead, self._idf(self._frequencies(blocks, dead, len(terms)), s.n), s.average)

    def top(self, query: str, k: int) -> DataFrame:
        """(id, score) of the best k, ties by id; spans that cannot hold one of them are not opened."""
        return self._top(query, k)[0]

    def _top(self, query: str, k: int) -> tuple[DataFrame, int, int]:
        """The best k, the spans that were opened, and the spans with a term."""
        order = (F.desc("score"), "id")
        state, terms = self._state()[1], self._wanted(query)
        s = self.stats(state)
        if self.kind == "grams" or not terms or not s.n:
            return self.ranked(query).orderBy(*order).limit(k), 0, 0
        either, which = self._fits(terms)
        blocks, dead = self.blocks(state).where(either).withColumn("i", which), self.dead(state)
        idf = self._idf(self._frequencies(blocks, dead, len(terms)), s.n)
        heads = blocks.groupBy("i", "seg", "span").agg(F.sum("most").cast("double").alias("f"), F.min("least").alias("dl"))
        bound = heads.groupBy("seg", "span").agg(F.sum(self._part(idf, F.col("f"), F.col("dl"), s.average)).alias("bound"))
        bound = materialize(bound, "bounds")
        first = bound.orderBy(F.desc("bound"), "seg", "span").limit(FIRST)
        start = self._scored(blocks.join(F.broadcast(first.select("seg", "span")), ["seg", "span"], "left_semi"), dead, idf, s.average)  # FIRST rows
        best = start.orderBy(*order).limit(k).collect()
        least = best[-1].score if len(best) == k else float("-inf")
        chosen = bound.where(F.col("bound") >= least - 1e-5)
        r = bound.agg(F.count("*").alias("n"), F.count_if(F.col("bound") >= least - 1e-5).alias("opened"), F.min(F.when(F.col("bound") >= least - 1e-5, F.col("span"))).alias("lo"), F.max(F.when(F.col("bound") >= least - 1e-5, F.col("span"))).alias("hi")).first()
        if not r.n:
            return self._none(), 0, 0
        near = blocks.where(F.col("span").between(r.lo, r.hi))  # cut in the scan, by the order of the files
        out = self._scored(near.join(chosen.select("seg", "span"), ["seg", "span"], "left_semi"), dead, idf, s.average)
        return out.orderBy(*order).limit(k), r.opened, r.n

    def _substrings(self, query: str) -> DataFrame:
        """(id, score) of records that hold a term as a substring. A term's grams
        meet where each stands at its own distance; only spans and records with
        the term's rarest gram are looked at, and no text is read."""
        state, terms = self._state()[1], trigram_terms(query)
        s = self.stats(state)
        if not terms or not s.n:
            return self._none()
        asked = [(i, j, t[j : j + 3]) for i, t in enumerate(terms) for j in range(len(t) - 2)]
        grams = sorted({g for *_, g in asked})
        blocks, dead = self.blocks(state).where(F.col("term").isin(*grams)), self.dead(state)
        size = {r.term: r.n for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a gram of the query
        rare = {i: min(((size.get(g, 0), j, g) for h, j, g in asked if h == i)) for i in range(len(terms))}
        places = F.explode(F.filter(F.array(*[F.when(F.col("term") == g, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for i, j, g in asked]), lambda x: x.isNotNull()))
        rows = blocks.withColumn("a", places).select("a.i", "a.j", "seg", "span", "ids", "dls", "places")
        is_rare = F.coalesce(*[F.when((F.col("i") == i) & (F.col("j") == j), F.lit(True)) for i, (_, j, _) in rare.items()], F.lit(False))
        x = lambda df: df.select("i", "j", "seg", "span", F.explode(F.arrays_zip("ids", "dls", "places")).alias("x")).select("i", "seg", "span", F.col("x.ids").alias("id"), F.col("x.dls").alias("dl"), F.transform("x.places", lambda p: p - F.col("j")).alias("at"))
        few = x(rows.where(is_rare)).join(dead.select("seg", "span", "id"), ["seg", "span", "id"], "left_anti")
        key = ["i", "seg", "span"]
        rest = rows.where(~is_rare).join(few.select(*key).distinct(), key, "left_semi")
        rest = x(rest).join(few.select(*key, "id"), [*key, "id"], "left_semi")
        need = F.element_at(F.array(*[F.lit(len(t) - 2) for t in terms]), F.col("i") + 1)
        met = few.unionByName(rest.select(*few.columns)).groupBy("i", "id").agg(F.count("*").alias("n"), F.max("dl").alias("dl"), F.collect_list("at").alias("at")).where(F.col("n") == need)
        f = F.size(F.aggregate(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.element_at("at", 1), F.array_intersect)).cast("double")
        hits = materialize(met.select("i", "id", "dl", f.alias("f")).where("f > 0"), "substrings")
        found = {r.i: r.df for r in hits.groupBy("i").agg(F.count("*").alias("df")).collect()}
        idf = self._idf([found.get(i, 0) for i in range(len(terms))], s.n)
        return hits.groupBy("id").agg(F.round(F.sum(self._part(idf, F.col("f"), F.col("dl"), s.average)), 6).alias("score"))


def id_type(records: DataFrame, id_col: str = "id") -> str:
    kind: DataType = records.schema[id_col].dataType
    return kind.simpleString()
