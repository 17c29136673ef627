"""Collocations against a plain count of every phrase."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, k int"


def plain(rows, longest=5, least=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if a >= least and " " in p}
        best = []
        for p, a in cands.items():
            w = p.split(" ")
            if any(len(q.split(" ")) > len(w) and 100 * b >= 100 * a and f" {p} " in f" {q} " for q, b in cands.items()):
                continue
            cuts = [(1000 * a * n[lang] // (c[" ".join(w[:j])] * c[" ".join(w[j:])]), j) for j in range(1, len(w))]
            score, j = min(cuts)
            best.append((-score, -a, p.encode(), p, c[" ".join(w[:j])], c[" ".join(w[j:])]))
        for i, (s, a, _, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, i, p, -a, left, right, n[lang], -s))
    return out


def mixed(seed=3, n=60):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "É", "gamma\x1c", "of", "the", "漢字", "\x00x", "DELTA", "z"]
    rows = []
    for i in range(n):
        w = rng.choice(words, size=80, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.04, 0.02, 0.02, 0.02])
        sep = rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \x0b", "\x85"], size=80, p=[0.6, 0.1, 0.1, 0.06, 0.04, 0.04, 0.03, 0.03])
        rows.append(("".join(a + b for a, b in zip(w, sep, strict=True)) + " in the long run of it" * 3, [None, "en", "", "und"][i % 4]))
    return [*rows, (None, "en"), ("", None), ("...", "en"), (" \t", "xx"), ("ab ab ab ab ab ab " * 30, "en"), rows[1], rows[1]]


@pytest.mark.parametrize("small", [False, True])
def test_against_a_plain_count(spark, monkeypatch, small):
    """Also where chunks and portions are tiny, so that every text is cut and told apart."""
    if small:
        monkeypatch.setattr(phrases, "CHUNK_WORDS", 50)
        monkeypatch.setattr(phrases, "PORTION", 100)
    rows = mixed()
    docs = spark.createDataFrame([(i, t, lang, "p", 9) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = phrases.collocations(docs, least=10 if not small else 12)
    want = plain(rows, least=10 if not small else 12)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40
    assert all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))


def test_ranks_stop_at_the_top(spark):
    rows = mixed(5)
    docs = spark.createDataFrame([(i, t, lang, "p", 9) for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert {tuple(r) for r in phrases.collocations(docs, longest=3, least=8, top=4).collect()} == plain(rows, 3, 8, 4)


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """A bitmap too small for its phrases only lets more through to be counted."""
    rows = mixed(7)
    docs = spark.createDataFrame([(i, t, lang, "p", 9) for i, (t, lang) in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(phrases.Bitmap, "has", lambda self, h: np.ones(len(h), bool))
    assert {tuple(r) for r in phrases.collocations(docs, least=10).collect()} == plain(rows, least=10)


def test_products_beyond_64_bits(spark):
    """Scores whose products pass 64 bits, and even 96."""
    big = 3 * 10**15
    grams = spark.createDataFrame([("x", "", 7 * 10**16, 0), ("x", "a", big + 1, 1), ("x", "b", big + 7, 1), ("x", "a b", big, 2)], "lang string, phrase string, a long, k int")
    assert phrases.cut(grams).first().score == 1000 * big * 7 * 10**16 // ((big + 1) * (big + 7))


def test_empty_and_long(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b", "en", None, None)], SCHEMA)).count() == 0
    text = "one two three " * 400_000
    (r,) = phrases.collocations(spark.createDataFrame([(1, text, "en", "", 0)], SCHEMA), longest=2).where("phrase = 'three one'").collect()
    assert (r.a, r.l, r.r, r.n) == (399_999, 400_000, 400_000, 1_200_000)
