"""The index against SQLite's full-text search, against scans, and through inserts, updates and deletes."""

import math
import random
import re
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import index as X
from tessera.operators.lexical import K1, B, bm25, query_terms, trigram, trigram_terms
from tessera.operators.postings import WORDS, folded

SF = "/root/testdata/sf0.001"
WORD = ["Running", "runners", "run", "café", "Cafés", "analogy", "analogies", "the", "society", "Überraschung", "straße", "b64encode", "10s", "relational", "漢字", "étude", "x"]


def texts(n, seed=1, words=WORD):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 8, 40]))) + rng.choice(["", ".", "-ab"]) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "id long, content string")


def plain(rows, query, kind):
    """BM25 of every row by hand; ``rows`` is {id: text}."""
    cut = {"plain": lambda t: re.findall("[a-z0-9]+", t.lower()), "stems": lambda t: [folded(w) for w in WORDS.findall(t.lower())]}
    if kind == "grams":
        low = {i: (t or "").lower() for i, t in rows.items()}
        terms = trigram_terms(query)
        f = {i: [len(re.findall(f"(?={t})", x)) for t in terms] for i, x in low.items()}
        dl = {i: max(0, len(x) - 2) for i, x in low.items()}
    else:
        toks = {i: cut[kind](t or "") for i, t in rows.items()}
        terms = list(dict.fromkeys((folded(t) if kind == "stems" else t, p) for t, p in query_terms(query)))
        f = {i: [sum(w.startswith(t) if p else w == t for w in ws) for t, p in terms] for i, ws in toks.items()}
        dl = {i: len(w) for i, w in toks.items()}
    n = len(rows)
    avg = sum(dl.values()) / n
    df = [sum(x[j] > 0 for x in f.values()) for j in range(len(terms))]
    idf = [max(math.log((n - d + 0.5) / (d + 0.5)), 0) or 1e-6 for d in df]
    return {i: sum(w * x * (K1 + 1) / (x + K1 * (1 - B + B * dl[i] / avg)) for w, x in zip(idf, xs, strict=True) if x) for i, xs in f.items() if any(xs)}


def scores(df):
    return {r.id: r.score for r in df.collect()}


def test_folding_and_stems_are_sqlite_s():
    """Every word of the documents, and every letter up to Unicode 6.1's Latin, Greek and Cyrillic."""
    words = [r[0] for r in duckdb.sql(f"select distinct unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) from '{SF}/documents.parquet'").fetchall()]
    words += ["eed", "ies", "sses", "assembly", "analogy", "sensibly", "10s", "große", "µm", "a" * 63 + "ing", "é" * 31 + "ing", "ſs"]
    words += [f"ab{c}cd" for c in map(chr, range(0xC0, 0x528)) if c.isalpha() and c not in "Ϳ"]
    words += [f"ab{chr(m)}cd" for m in range(0x300, 0x332)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(c, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, instance)")
    con.executemany("insert into t(rowid, c) values (?, ?)", list(enumerate(words)))
    got = {}
    for term, doc, offset in con.execute("select term, doc, offset from v"):
        got.setdefault(doc, {})[offset] = term
    wrong = [(w, got.get(i)) for i, w in enumerate(words) if [folded(x) for x in WORDS.findall(w.lower())] != [got[i][k] for k in sorted(got.get(i, {}))]]
    assert wrong == []


def test_bm25_is_sqlite_s(spark, tmp_path):
    """Single words against the bm25() of a full-text table."""
    rows = {i: t for i, t in enumerate(texts(300)) if t}
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(c, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, c) values (?, ?)", rows.items())
    ix = X.Index(spark, f"file://{tmp_path}/i")
    ix.put(frame(spark, rows.items()))
    for q, match in (("running", "running*"), ("cafe", "cafe*"), ("of", '"of"'), ("analogy", "analogy*")):
        want = {i: -s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (match,))}
        assert scores(ix.ranked(q)) == pytest.approx(want, abs=2e-6), q


@pytest.mark.parametrize("kind", ["stems", "plain", "grams"])
def test_inserts_updates_deletes(spark, tmp_path, monkeypatch, kind):
    """After any order of changes the ranking is that of what is there."""
    monkeypatch.setattr(X, "SPAN_RECORDS", 7)
    rng, ix, there = random.Random(kind), X.Index(spark, f"file://{tmp_path}/i", kind), {}
    for step in range(4):
        batch = {rng.randrange(120): t for t in texts(30 if step % 3 else 8, seed=step)}
        batch[1000 + step] = None
        ix.put(frame(spark, batch.items()))
        there |= batch
        gone = rng.sample(sorted(there), 5)
        ix.delete(spark.createDataFrame([(g,) for g in [*gone, 99_999]], "id long"))
        there = {i: t for i, t in there.items() if i not in gone}
        assert ix.stats().n == len(there)
    assert len(ix.segments()) <= 4
    for q in ("running the cafe", "straße unn", "zzz"):
        want = plain(there, q, kind)
        assert scores(ix.ranked(q)) == pytest.approx({i: s for i, s in want.items()}, abs=2e-6), q
        best = sorted(((-round(s, 5), i) for i, s in want.items()))[:5]
        got = [(-round(r.score, 5), r.id) for r in ix.top(q, 5).collect()]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in best], abs=2e-5)
    assert ix.stats().average == pytest.approx(sum(len((t or "").lower()) - 2 if kind == "grams" and len(t or "") > 2 else 0 if kind == "grams" else len((WORDS if kind == "stems" else re.compile("[a-z0-9]+")).findall((t or "").lower())) for t in there.values()) / len(there))


def test_a_change_writes_its_own_segment_only(spark, tmp_path):
    ix = X.Index(spark, f"file://{tmp_path}/i")
    ix.put(frame(spark, enumerate(texts(200))))
    (old,) = ix.segments()
    folders = ix._state()[1]["blocks"]["parts"]
    ix.put(frame(spark, [(1000, "new words here"), (3, "replaced")]))
    assert len(ix.segments()) == 2 and ix._state()[1]["blocks"]["parts"][old] == folders[old] and ix.segments()[old]["dead"] == 1
    ix.delete(spark.createDataFrame([(5,), (3,)], "id long"))
    assert ix._state()[1]["blocks"]["parts"][old] == folders[old] and ix.stats().n == 199
    sizes, n = [], 0
    for i in range(12):
        ix.put(frame(spark, [(2000 + i, "one more")]))
        sizes.append(len(ix.segments()))
    assert max(sizes) <= 5 and old in ix.segments()  # the large one is never written again
    assert ix.store.vacuum(keep=1) > 0 and ix.stats().n == 211 + n


def test_spans_that_cannot_win_stay_shut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SPAN_RECORDS", 20)
    rows = dict(enumerate(texts(2000, seed=9, words=["alpha", *"bcdefghijk"])))
    ix = X.Index(spark, f"file://{tmp_path}/i")
    ix.put(frame(spark, rows.items()))
    best, opened, spans = ix._top("alpha", 3)
    want = sorted((-round(s, 5), i) for i, s in plain(rows, "alpha", "stems").items())
    assert [(-round(r.score, 5), r.id) for r in best.collect()] == want[:3]
    assert spans > 50 and opened < spans / 4


def test_rows_and_ids(spark, tmp_path):
    """Strings as ids, repeated rows, odd columns, empty tables."""
    ix = X.Index(spark, f"file://{tmp_path}/i", ids="string")
    assert ix.ranked("x").count() == 0 and ix.top("x", 3).count() == 0 and ix.stats().n == 0
    df = spark.createDataFrame([("a", "red", 1), ("a", "red deer", 2), ("b", None, 3), (None, "deer", 4)], "id string, content string, span long")
    ix.put(df)
    ix.put(df.where("false"))
    assert ix.stats().n == 3 and set(scores(ix.ranked("deer"))) == {"a", None}
    with pytest.raises(ValueError):
        X.Index(spark, f"file://{tmp_path}/j", "bytes")


def test_large_records(spark, tmp_path):
    ix, words = X.Index(spark, f"file://{tmp_path}/g", "grams"), X.Index(spark, f"file://{tmp_path}/w")
    rows = frame(spark, [(1, "abcabc " * 200_000), (2, "xyzzy abca")])
    ix.put(rows)
    words.put(rows)
    assert scores(ix.ranked("abca")) == pytest.approx(plain({1: "abcabc " * 200_000, 2: "xyzzy abca"}, "abca", "grams"), abs=2e-6)
    assert set(scores(words.ranked("abcabc"))) == {1}


def test_scans_and_index_agree(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    plain_, grams = X.Index(spark, f"file://{tmp_path}/p", "plain"), X.Index(spark, f"file://{tmp_path}/g", "grams")
    for ix, scan in ((plain_, bm25), (grams, trigram)):
        ix.put(docs)
        for q in ("the heading of ation", "ther onin", "zu"):
            assert scores(ix.ranked(q)) == pytest.approx(scores(scan(docs, q)), abs=2e-6), (ix.kind, q)
