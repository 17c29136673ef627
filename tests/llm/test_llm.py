"""The training-data operators against brute force, round trips and held-out cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, language, packing, quality, queries, rans, repeats, toxicity, urls
from tessera.llm.fingerprints import fingerprint, likeness
from tessera.llm.minhash import near_duplicates
from tessera.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potent jars of liquid and go home again "
TEXTS = [None, "", " ", "one", "one", BASE * 3, BASE * 3 + "end", BASE + "é漢字  \n\n<|endoftext|> x", BASE * 40, "ß " * 60, BASE * 3]
COLUMNS = "doc_id long, text string, lang string, source string, k long, n_words string, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "x", True) for i, t in enumerate(TEXTS)] + [(None, BASE * 2, None, None, None, None, None), (5, BASE * 3, "en", "s", 1, "x", True)]
    return spark.createDataFrame(rows, COLUMNS)


def corpus(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def shingle_set(text, n):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(sets, percent):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * i >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("dense", [50, 1])
def test_near_duplicates(spark, dense):
    rows = corpus(spark)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    base = [words[i] for i in rng.integers(0, 300, 80)]
    for i in range(30):  # many variants of one text, some linked, some not
        v = list(base)
        for j in rng.integers(0, 80, i % 9):
            v[j] = f"x{i}-{j}"
        rows.append((10_000 + i, " ".join(v)))
    sets = {k: shingle_set(t, 2) for k, t in rows}
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, dense=dense, common=50 if dense > 1 else 3).collect()
    assert {r.doc_id: r.component_id for r in got} == components(sets, 80)
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark, docs):
    got = near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].kept and by[0].n_shingles == 0 and by[10].component_id is None and by[4].component_id == 3  # the null id leads repeated text
    assert near_duplicates(docs.where("false")).count() == 0


def brute_repeats(rows, length=50):
    first, out = {}, {}
    for k, t in sorted(rows):
        b = t.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], k)
    for k, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < k:
                gone[i : i + length] = True
        out[k] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("how", [{}, {"group_bytes": 20_000, "bucket_bytes": 30_000, "batch": 500}])
def test_repeats(spark, how):
    rows = corpus(spark) + [(20_000, "a" * 400), (20_001, "a" * 300 + "b"), (20_002, "ab" * 90), (20_003, "é" * 80)]
    want = brute_repeats(rows)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == want
    texts = dict(rows)
    for r in got:
        assert r.n_bytes - sum(s.end - s.start for s in r.spans) == len(r.kept) and r.n_bytes == len(texts[r.doc_id].encode())


def test_repeats_edges(spark, docs):
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    assert {len(r.kept) for r in got if r.doc_id == 10} == {0}
    assert repeats.remove_repeats(docs.where("false")).count() == 0


@pytest.mark.parametrize(("length", "letters"), [(4, 3), (16, 2), (20, 2), (50, 2)])
def test_suffix_family_takes_batches(length, letters):
    """Later batches find what earlier ones brought; levels grow geometrically."""
    f = repeats.SuffixFamily(length)
    rng, seen = np.random.default_rng(length), {}
    words = [rng.integers(0, letters, length // 2).astype(np.uint8) for _ in range(12)]
    for batch in range(40):
        buf = np.concatenate([words[i] for i in rng.integers(0, 12, 12)])
        at = np.arange(len(buf) - length + 1)
        ids = np.sort(rng.integers(2 * batch, 2 * batch + 2, len(at)))
        got = f.add(buf, at, ids).tolist()
        for i, k in zip(at.tolist(), ids.tolist(), strict=True):
            w = buf[i : i + length].tobytes()
            seen[w] = min(k, seen.get(w, k))
        assert got == [seen[buf[i : i + length].tobytes()] < k for i, k in zip(at.tolist(), ids.tolist(), strict=True)]
    assert len(f.levels) <= 8
    for level in f.levels:
        s = [level.buf[i : i + length].tobytes() for i in level.at.tolist()]
        assert s == sorted(set(s)) and [seen[x] for x in s] == level.least.tolist()


def test_packing(spark, docs):
    path = P.path("byte_bpe_50k.json")
    tok, got = Tokenizer.from_file(path), packing.pack_documents(docs, path, capacity=64).collect()
    seen = defaultdict(list)
    for r in got:
        seen[r.sequence_id].append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS) if i != 5}
    for i, want in ids.items():
        own = sorted((r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got if r.doc_id == i)
        assert [x for _, p in own for x in p] == want
    assert len(seen) - sum(sum(n for _, n in p) for p in seen.values()) / 64 < 1
    assert packing.pack_documents(docs.where("false"), path).count() == 0


def test_packing_balances_cost():
    got = packing.pack([30, 30, 20, 20, 10, 10, 5, 3], 64, 1.0, 0.1)
    load = defaultdict(int)
    for _, _, n, s, _ in got:
        load[s] += n
    assert sum(load.values()) == 128 and max(load.values()) <= 64


@pytest.mark.parametrize("n", [0, 1, 5, 1024, 5000])
def test_rans_block(n):
    rng = np.random.default_rng(n)
    ids = [rng.geometric(0.02, n).astype("<u4").tobytes(), np.array([7], "<u4").tobytes()]
    data = rans.write_file([3, 4], ids)
    assert [(k, b) for k, _, b in rans.TokenFile(data).documents()] == [(3, ids[0]), (4, ids[1])]
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        list(rans.TokenFile(bytes(broken)).documents())


def test_token_files(spark, docs):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = rans.read_documents(rans.encode_files(docs, path, target_bytes=2000, file_ids=100)).orderBy("start").collect()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and len(got) == docs.count()
    at = 0
    for r in got:
        text = BASE * 2 if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2]
        at += len(r.ids) // 4
    assert rans.read_documents(rans.encode_files(docs.where("false"), path)).count() == 0


ODD = ["", " ", "  a  b\n\n c", "it's we'll 'tis", "é ñandú 漢字 🙂 a  b", "x<|endoftext|>y", "á  b\x0bc", "1234 5.6,7", "ſ ﬁ İ ς"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    tok, enc = Tokenizer.from_file(P.path(name)), Encoder(P.path(name))
    assert enc.coder is not None
    rng = np.random.default_rng(5)
    fuzz = ["".join(rng.choice(list("abcdeT'shing séÀ\n.07!"), 60)) for _ in range(500)]
    runs = ["a" * 60_000, " " * 60_000 + "x", "ab " * 30_000, "é" * 40_000]
    vocabulary = [tok.decode([i]) for i in range(0, tok.get_vocab_size(), 17)]
    for x in ODD + fuzz + runs + vocabulary:
        assert np.frombuffer(enc.encode_batch([x])[0], "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids, x[:99]
    assert enc.encode_batch([None]) == [b""]


def test_trie_bpe(spark, docs):
    path = P.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), bpe.TrieEncoder(path)
    rng = np.random.default_rng(3)
    fuzz = ["".join(rng.choice(list("abcdethis ing'sé\n.0"), 40)) for _ in range(300)]
    for x in ODD + fuzz + [t for _, t in corpus(spark)][:60]:
        assert enc.encode_batch([x])[0].tolist() == tok.encode(x, add_special_tokens=False).ids, x
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    for r in rows:
        text = BASE * 2 if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == tok.encode(text, add_special_tokens=False).ids and r.text == text


def test_fingerprints():
    assert fingerprint(b"") == "3::" and likeness(fingerprint(b""), fingerprint(b"")) == 1.0
    a = " ".join(f"word{i * i % 977}" for i in range(900)).encode()
    b = a[:3000] + b"INSERTED" + a[3000:]
    assert likeness(fingerprint(a), fingerprint(b)) > 0.85
    c = " ".join(f"other{i * i % 983}" for i in range(900)).encode()
    assert likeness(fingerprint(a), fingerprint(c)) < 0.2


def test_fingerprint_query(spark):
    rows = sorted(corpus(spark), reverse=True)
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, SF).collect()}
    for i, (k, t) in enumerate(rows):
        n, after = len(t) // 3, rows[(i + 1) % len(rows)][1]
        made = t[: len(t) - n] + after[:n]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(made.encode()).hexdigest())
        assert got[k].fingerprint == fingerprint(t.encode()) and got[k].near_next == likeness(got[k].fingerprint, fingerprint(after.encode()))


def test_quality_measures(spark, docs):
    assert quality.measure("a b c a b c\nx $|\nx $|\n", quality.WordHashes())[:3] == (10, 12, 4)
    assert quality.measure("a b c a b c\nx $|\nx $|\n", quality.WordHashes())[4:] == (1, 6)
    got = quality.judged(docs).collect()
    assert len(got) == docs.count() and all(r.base_failed for r in got if not r.row.text)
    assert quality.filter_quality(docs).columns == docs.columns and quality.filter_quality(docs.where("false")).count() == 0


def test_sketches_merge(spark):
    rows = spark.range(1, 2001).select(F.lit("en").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), *[F.lit(100).alias(c) for c in ("n_words", "n_lines")], *[F.col("id").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    q = quality.quantiles(quality.sketches(rows, 1.01), [], 1.01, (0.1, 0.5, 0.9)).where("name = 'symbols'").first()
    assert q.rows == 2000 and abs(q.q1 - 10) < 0.2 and abs(q.q2 - 18) < 0.3


def test_language(spark, docs):
    got = queries.op5_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)
    c = language.identify(docs, []).collect()
    assert {r.lang_pred for r in c} == {"und"} and len(c) == docs.count()
    assert language.learn(docs.where("false")).count() == 0


def test_toxicity(spark, docs):
    rows = [(i, BASE + (" scumbag moronic" if i % 3 == 0 else " harmless words") + f" n{i}") for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows if i < 120], "doc_id long, toxic int")
    m = toxicity.learn(d, labels)
    got = {r.row.doc_id: r.score for r in toxicity.scored(d, m).collect()}
    assert min(got[i] for i in range(120, 150, 3)) > max(got[i] for i in range(121, 150) if i % 3)
    none = toxicity.learn(d, labels.where("false"))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, m).columns == docs.columns


def test_urls_follow_aliases(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    pages = [
        (1, "https://bad.test/x", "<p>"),
        (2, "http://alias.test/y", link("https://bad.test/x")),
        (3, "http://c.test/z", '<meta http-equiv="refresh" content="0; url=http://alias.test/y">'),
        (4, "http://free.test/", link("http://good.test/ok")),
        (5, "http://odd.test/", "<!-- " + link("https://bad.test/x") + " -->"),
        (6, None, None),
        (7, "no scheme", "<p>"),
        (8, "HTTP://WWW.Bad.Test/x?q#f", "<p>"),
    ]
    rules = [("bad.test", "/x", "block"), ("good.test", "/", "allow"), ("free.test", "/no", "block")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.url_verdicts(df, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
    many = rules + [(f"h{i}.test", "/", "block") for i in range(300)]
    assert {r.page_id: r.verdict for r in urls.url_verdicts(df, many).collect()} == got
    allowed = {r.page_id: r.verdict for r in urls.url_verdicts(df, [*rules, ("c.test", "/", "allow")]).collect()}
    assert allowed[2] == "allow" and allowed[1] == "block"
    assert urls.url_verdicts(df.where("false"), rules).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as C

    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0
        out.count()
    assert zlib.crc32(b"") == 0
    got = C.run(spark, SF)
    assert got.count() > 0


def test_quality_fences_stand_junk(spark):
    """A fifth or more of a source, most of another, do not excuse themselves."""
    prose = [" ".join(f"w{i:04}x{j:02}" for j in range(60)) for i in range(1200)]
    lines = lambda t: "\n".join([*t.split()[:10], *["samesame linelin1 moremor2"] * 15, *t.split()[10:]])
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(prose)]
    for source, share in (("s1", 5), ("s2", 0)):  # 20 % of s1, all but 20 % of s2
        own = [r for r in rows if r[3] == source]
        for n, (i, t, lang, s) in enumerate(own):
            if n % 5 == 0 if share else n % 5:
                rows[i] = (i, t.replace(" ", " $$$$$$$$ ", 40) if n % 10 else lines(t), lang, s)
    plain = {r[0] for r in rows if r[1] == prose[r[0]]}
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in got)
    assert {r.row.doc_id for r in got if r.kept} == plain
    # a language of longer words keeps its own lengths
    long = [(i, t if i % 2 else t.replace("x", "xyzuvwxyz"), "en" if i % 2 else "fi", "s") for i, t in enumerate(prose)]
    assert all(r.kept for r in quality.judged(spark.createDataFrame(long, "doc_id long, text string, lang string, source string")).collect())


def test_near_duplicates_null_and_repeated_ids(spark):
    """Texts that share a null or repeated doc_id are documents of their own."""
    import corpus_pipeline as C

    t = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdef"]
    near = [x + " end" for x in t]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (7, near[0]), (8, near[1]), (None, None), (None, None), (3, t[2]), (3, t[3]), (3, t[3]), (9, near[3]), (1, t[4]), (1, near[4]), (4, near[5]), (5, t[5]), (6, None), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[7].component_id is None and by[8].component_id is None and not by[7].kept and not by[8].kept
    assert by[9].component_id == 3 and not by[9].kept and sum(r.kept for r in got if r.doc_id == 1) == 1
    left = sorted(map(tuple, C.near_duplicate(spark, df, SF).collect()), key=str)
    one = [r for r in left if r[0] == 1]
    assert len(one) == 1 and one[0] in {(1, t[4]), (1, near[4])}
    assert [r for r in left if r[0] != 1] == sorted([(None, t[0]), (None, t[1]), (None, None), (None, None), (3, t[2]), (3, t[3]), (4, near[5]), (6, None)], key=str)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_character_of_the_plane(name):
    """Alone, before and within a word, as it is, upper and lower: the library's ids."""
    own, lib = Encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    for first in range(0, 0x10000, 0x1000):
        chars = [c for c in map(chr, range(first, first + 0x1000)) if not 0xD800 <= ord(c) < 0xE000]
        texts = [t for c in chars for t in {c, c.upper() + "li ve " + c.lower() + "li", "an" + c + "la", "x " + c.upper()}]
        want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert [t for t, a, b in zip(texts, own.encode_batch(texts), want, strict=True) if a != b] == []


def test_a_bucket_keeps_narrow_suffixes(monkeypatch):
    """Ids travel as 64 bits; a bucket's suffix arrays hold places and ids in half of that."""
    import pyarrow as pa
    import zstandard

    held, real = [], repeats.SuffixFamily
    monkeypatch.setattr(repeats, "SuffixFamily", lambda length: held.append(real(length)) or held[-1])
    rng = np.random.default_rng(5)
    strings = [rng.integers(97, 123, 60, dtype=np.uint8).tobytes() for _ in range(50)]
    ids = np.arange(50) + 2**40
    row = {"bucket": 0, "ids": ids.tobytes(), "sizes": np.full(50, 60, np.uint16).tobytes(), "blob": zstandard.compress(b"".join(strings)), "places": b""}
    got = repeats.judge(pa.Table.from_pylist([{"grp": 0} | row, {"grp": 1} | row | {"ids": (ids + 1).tobytes()}]), 50, 1000)
    assert [set(np.frombuffer(r[2], np.uint64).tolist()) for r in got] == [{0}, {2**64 - 1}]
    assert sum(x.at.nbytes + x.least.nbytes for x in held[0].levels) == 8 * 50 * 11


def test_known_words_are_not_coded_again():
    enc = Encoder(P.path("word_bpe_49k.json"))
    seen, real = [], enc.words.coder
    enc.words.coder = type("Coder", (), {"encode_to_numpy": lambda self, text, **k: seen.append(text) or real.encode_to_numpy(text, **k)})()
    texts = ["The cat don't sit, the cat sits!", "Über 12 cats sit " + "long" * 30, "", "the the sit"]
    assert enc.encode_batch(texts) == [enc._whole(t) for t in texts]
    assert "".join(seen).split("\x01").count("the") == 1 and len(seen) == 2
    enc.words.MOST, enc.words.known = 0, {}  # with no room to remember, ids are the same
    assert enc.encode_batch(texts) == [enc._whole(t) for t in texts] and not enc.words.known
