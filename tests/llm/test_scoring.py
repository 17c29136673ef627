"""Language-model scores: counts by hand, gradients by differences, windows one by one, held-out quality."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import attention, queries, scoring

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.json")


def words_of(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def held(k):
    return zlib.crc32(str(k).encode()) % 10 == 0


def test_op11(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    c = Counter(w for k, t in docs if not held(k) for w in words_of(t))
    ends = sum(not held(k) for k, _ in docs)
    n, v = sum(c.values()) + ends, len(c) + 1
    below = math.log10(n + 0.1 * (v + 1))
    rows = queries.op11_lm_scoring(spark, SF).collect()
    texts = dict(docs)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        w = words_of(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(sum(math.log10(c[x] + 0.1) for x in w) + math.log10(ends + 0.1) - (len(w) + 1) * below, rel=1e-9)
        assert r.score < 0
    out = [r for r in rows if r.held_out]
    # half a megabyte teaches little, yet unknown words are spelled better than counted
    assert sum(r.score for r in out) / sum(r.n_tokens for r in out) > -7


def some_model(seed=1, n=200):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(0, 1000, n))[::-1].astype(float)
    units = attention.units_of(counts, rng.random((n, 8)).astype(np.float32))
    m = attention.Model.start(counts, units)
    m.vector += rng.normal(0, 0.2, m.vector.shape).astype(np.float32)
    return m, units, n


def test_probabilities_sum_to_one():
    """Over all ids, at every place, also of ids that share a slot."""
    rng = np.random.default_rng(2)
    n = 3000
    counts = rng.integers(0, 50, n).astype(float)
    units = attention.units_of(counts, rng.random((n, 8)).astype(np.float32))
    m = attention.Model.start(counts, units)
    m.vector += rng.normal(0, 0.2, m.vector.shape).astype(np.float32)
    assert len(np.unique(units.unit)) < n
    total = sum(np.exp(attention.scored(m, units, [np.array([5, 7, i])], end=0)[0]) for i in range(n))
    before = np.exp(attention.scored(m, units, [np.array([5, 7])], end=0)[0])
    assert total == pytest.approx(before, rel=1e-3)


def plainly(m, units, ids, end):
    """Every id by itself, from what its window shows before it."""
    out, line = 0.0, [end, *ids]
    for i, y in enumerate(ids):
        window = i // attention.STRIDE
        first = max(0, window * attention.STRIDE - (attention.WINDOW - attention.STRIDE))
        seen = line[first : i + 1]
        at = attention.WINDOW - attention.STRIDE + i - window * attention.STRIDE
        x = np.array([m.E[units.unit[s]] + m.P[at - len(seen) + 1 + j] for j, s in enumerate(seen)], np.float64)
        w = attention.WIDTH
        q, k, v = x[-1] @ m.W[:, :w], x @ m.W[:, w : 2 * w], x @ m.W[:, 2 * w :]
        a = np.exp(k @ q / math.sqrt(w))
        f = x[-1] + (a / a.sum()) @ v @ m.O
        g = np.exp(f @ m.U + m.b)
        s = np.exp(f @ m.V[units.group[y]] + m.c[units.group[y]])
        out += math.log(g[units.group[y]] / g.sum()) + math.log(s[units.slot[y]] / s.sum()) + units.share[y]
    return out


@pytest.mark.parametrize("length", [1, 2, 11, 12, 13, 24, 25, 100])
def test_windows_score_each_id_once(length):
    m, units, n = some_model()
    texts = [np.random.default_rng(length + j).integers(0, n, length) for j in range(3)]
    got = attention.scored(m, units, [texts[0], texts[1][:1], texts[2]], end=3)
    assert got == pytest.approx([plainly(m, units, t, 3) for t in (texts[0], texts[1][:1], texts[2])], rel=1e-4)


def test_gradient():
    """Against differences of the loss along random directions, in 64 bits."""
    m, units, n = some_model()
    m = attention.Model(m.vector.astype(np.float64))
    rng = np.random.default_rng(3)
    x = rng.integers(0, n, (4, attention.WINDOW))
    y = rng.integers(0, n, x.shape)

    def loss(vector):
        q = attention.Model(vector)
        z = (q.E[units.unit[x]] + q.P).reshape(-1, attention.WIDTH)
        w = attention.WIDTH
        h = (z @ q.W).reshape(4, -1, 3 * w)
        s = np.exp(h[..., :w] @ h[..., w : 2 * w].transpose(0, 2, 1) / math.sqrt(w)) * np.tril(np.ones((attention.WINDOW,) * 2))
        f = z + ((s / s.sum(-1, keepdims=True)) @ h[..., 2 * w :]).reshape(-1, w) @ q.O
        i, g, t = np.arange(len(f)), units.group[y.ravel()], units.slot[y.ravel()]
        a, b = np.exp(f @ q.U + q.b), np.exp(np.einsum("nw,nws->ns", f, q.V[g]) + q.c[g])
        return -np.mean(np.log(a[i, g] / a.sum(-1)) + np.log(b[i, t] / b.sum(-1)))

    grad = attention.Model(np.zeros(m.vector.size, np.float32))
    attention.gradient(attention.Model(m.vector.astype(np.float32)), grad, units.unit[x], units.group[y], units.slot[y])
    for name, shape in m.shapes.items():
        way = attention.Model(np.zeros(m.vector.size))
        getattr(way, name)[...] = rng.normal(0, 1, shape)
        slope = (loss(m.vector + 1e-5 * way.vector) - loss(m.vector - 1e-5 * way.vector)) / 2e-5
        assert float(grad.vector.astype(np.float64) @ way.vector) == pytest.approx(slope, rel=2e-3, abs=1e-5), name


def test_subwords_are_the_library_s():
    tok = Tokenizer.from_file(PATH)
    words = [w.encode() for w in ("a", "it's", "über-x", "\xa0x", "y\xa0", "z", "\x85", "\x1c", "漢字", "12ab!?", "…", " q", "é", "<|endoftext|>", "x" * 300)]
    flat, offsets = scoring.subwords(words, PATH)
    for i, w in enumerate(words):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == tok.encode(" " + w.decode(), add_special_tokens=False).ids, w
    numbers = np.array([3, 3, 0, 14])
    assert scoring.spread(flat, offsets, numbers).tolist() == [x for i in numbers for x in flat[offsets[i] : offsets[i + 1]]]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:  # every text a chunk of its own, sums in many levels
        monkeypatch.setattr(scoring, "CHUNK_WORDS", 3)
        monkeypatch.setattr(scoring, "FAN", 2)
    rows = [(1, "The cat sat. the CAT", 1), (2, None, 1), (3, "", 2), (4, "the cat", 2), (4, "the cat", 2), (None, "the dog", 3), (7, "\x85 \xa0the É", None), (8, "ab " * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = scoring.scored(docs, F.col("k") != 7, PATH).collect()
    assert len(got) == 8 and all(r.score < 0 and math.isfinite(r.score) for r in got)
    n = 300_000 + 5 + 2 + 2 + 2 + 7
    assert {r.train_tokens for r in got} == {n}
    by = {(r.doc_id, r.n_tokens): r for r in got}
    assert set(by) == {(1, 6), (2, 1), (3, 1), (4, 3), (None, 3), (7, 4), (8, 300_001)}
    assert by[2, 1].score == by[3, 1].score and by[2, 1].n_known == 1
    assert (by[7, 4].n_known, by[7, 4].train) == (1, False)
    assert by[8, 300_001].score / 300_001 > by[7, 4].score / 4
    below = math.log10(n + 0.1 * (8 + 1))  # the, cat, sat., dog, ab, end: 6 kinds
    kinds = len({"the", "cat", "sat.", "dog", "ab"}) + 1
    below = math.log10(n + 0.1 * (kinds + 1))
    assert by[None, 3].base_score == pytest.approx(math.log10(5.1) + math.log10(1.1) + math.log10(7.1) - 3 * below)


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scoring.scored(none, F.lit(True), PATH).count() == 0
    (r,) = scoring.scored(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False), PATH).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0


def test_biases_are_learned_by_the_products_of_their_weights():
    """A step costs three products a group and no sum beside them; biases get the mean of what is wrong by group and slot."""
    rng = np.random.default_rng(3)
    counts, profiles = rng.integers(1, 90, 1500).astype(float), rng.random((1500, 4)).astype(np.float32)
    units = attention.units_of(counts, profiles)
    m = attention.Model.start(counts, units)
    U, V = attention._with_biases(m)
    F = rng.normal(size=(5, attention.WIDTH)).astype(np.float32)
    assert np.allclose(attention._with_ones(F) @ U, F @ m.U + m.b, atol=1e-5) and np.allclose(attention._with_ones(F) @ V[3], F @ m.V[3] + m.c[3], atol=1e-5)
    ids = rng.integers(0, 1500, 3 * attention.WINDOW + 1)
    x, y = units.unit[ids[:-1]].reshape(3, -1), ids[1:].reshape(3, -1)
    g = attention.Model(np.full_like(m.vector, np.nan))
    attention.gradient(m, g, x, units.group[y], units.slot[y])
    mean = lambda: -(attention._logs(m, features(), y.ravel(), units) - units.share[y.ravel()]).mean()

    def features():
        X = (m.E[x] + m.P).reshape(-1, attention.WIDTH)
        q, k, v = np.split((X @ m.W).reshape(3, attention.WINDOW, -1), 3, -1)
        S = attention._softmax(q @ k.transpose(0, 2, 1) * attention._SCALE + attention._CAUSAL)
        return X + (S @ v).reshape(-1, attention.WIDTH) @ m.O

    for view, slope in ((m.b, g.b), (m.c[units.group[y[0, 0]]], g.c[units.group[y[0, 0]]])):
        for i in (0, 7):
            was = view[i]
            view[i] = was + 0.05
            up = mean()
            view[i] = was - 0.05
            down, view[i] = mean(), was
            assert abs((up - down) / 0.1 - slope[i]) < 2e-4
    empty = np.setdiff1d(np.arange(attention.GROUPS), units.group[y])
    assert not np.isnan(g.vector).any() and not g.V[empty].any() and not g.c[empty].any()
