"""The registered queries against their SQL, the libraries and brute force; odd inputs of every stage."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tessera.llm import bpe, language, ordered, packing, quality, queries, rans, repeats, toxicity, urls
from tessera.llm.fingerprints import fingerprint, likeness, with_neighbours
from tessera.llm.minhash import near_duplicates

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels")
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potent jars of liquid and go home again "


def corpus():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == want


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t, *_ in corpus()}
    seen, room = defaultdict(list), defaultdict(list)
    for r in queries.op1_packing(spark, SF).collect():
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        room[r.sequence_id].append((r.offset, r.length))
    for k, x in ids.items():
        at = 0
        for start, n in sorted(seen[k]):
            assert start == at
            at += n
        assert at == len(x)
    full = [sum(n for _, n in parts) for parts in room.values()]
    for parts in room.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1])
    assert max(full) <= 2048 and len(full) <= sum(full) / 2048 + 2


def test_op3(spark):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, at = sorted(queries.op3_rans_output(spark, SF).collect(), key=lambda r: r.doc_id), 0
    assert len(got) == len(corpus())
    for r, (k, t, *_) in zip(got, corpus(), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), crc(ids))
        at += len(ids)


def test_op7(spark):
    tok, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {k: t or "" for k, t, *_ in corpus()}
    for r in queries.op7_bpe(spark, SF).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_counts(text):
    words, lines = (text or "").encode().split(), [x for x in (text or "").split("\n") if x.encode().split()]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_op6(spark):
    texts = {k: t for k, t, *_ in corpus()}
    for r in queries.op6_quality(spark, SF).collect():
        n = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)


def test_fences_are_quantiles(spark):
    """A verdict recomputed from exact quantiles differs only next to a fence."""
    rows = quality.judged(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    ok = [r for r in rows if not r.base_failed]
    top = {"word_length": (lambda r: r.word_chars / r.n_words, 0.5), "symbols": (lambda r: r.n_symbols / r.n_words, 0.02), "dup_lines": (lambda r: r.n_dup_lines / r.n_lines, 0.3), "repeats": (lambda r: r.n_repeat_words / r.n_words, 0.3)}
    assert {n: RATIO[2] for n, RATIO in quality.RATIOS.items()} == {n: s for n, (_, s) in top.items()}

    def fence(xs, slack):
        q = [sorted(xs)[max(0, math.ceil(len(xs) * p) - 1)] for p in (0.25, 0.5, 0.75)]
        down, up = q[1] - q[0], q[2] - q[1]
        return q[1] - max(10 * min(down, 2 * up), slack), q[1] + max(10 * min(up, 2 * down), slack)

    def group(keys):
        out = defaultdict(list)
        for r in ok:
            out[keys(r)].append(r)
        return out

    fine, lang = group(lambda r: (r.row.lang, r.row.source)), group(lambda r: r.row.lang)
    wrong = 0
    for r in ok:
        own = fine[(r.row.lang, r.row.source)]
        base = own if len(own) >= 200 else lang[r.row.lang] if len(lang[r.row.lang]) >= 200 else ok
        good, near = True, False
        for name, (f, slack) in top.items():
            low, high = fence([f(x) for x in base], slack)
            if name != "word_length":
                high = min([high, fence([f(x) for x in ok], slack)[1]] + ([fence([f(x) for x in lang[r.row.lang]], slack)[1]] if len(lang[r.row.lang]) >= 200 else []))
            x = f(r)
            good &= x <= high and (name != "word_length" or x >= low)
            near |= abs(x - high) < 0.3 * slack + 0.02 or abs(x - low) < 0.3 * slack + 0.02
        wrong += good != r.kept and not near
    assert wrong == 0


def test_op5(spark):
    truth = {k: lang for k, _, lang, _ in corpus()}
    got = queries.op5_language(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_by_hand():
    """The bundle of a text is the sum of its n-grams' products of rotated letter vectors."""
    p = language.Profiles(size=64)
    text = "ab a"
    letters = np.roll  # a rotated vector for each place
    base = {c: p.rolled[0][p.symbol[ord(c)]].astype(int) for c in "ab"} | {" ": p.rolled[0][0].astype(int)}
    want = np.zeros(64)
    padded = " ab a "
    for i in range(len(padded) - 2):
        want += letters(base[padded[i]], 2) * letters(base[padded[i + 1]], 1) * base[padded[i + 2]]
    assert np.allclose(p.bundle(*p.grams(text)), want)


def test_many_languages(spark):
    rows = [(i, f"word{i} " * 3, f"lang{i:04}") for i in range(1100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.prototypes(language.learn(df, size=64))
    assert len(got) == 1100
    with pytest.raises(ValueError):
        language.prototypes(language.learn(df, size=64), most=1000)


def test_op8(spark):
    got = queries.op8_toxicity(spark, SF).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxic_dictionary_is_trained():
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(300)]
    text = lambda: " ".join(rng.choice(vocabulary, 120))
    bad = ["zqvillainx", "wretchedyq", "kzscoundrel"]
    ordinary = [text().encode() for _ in range(150)]
    toxic = [(text() + " " + " ".join(rng.choice(bad, 3)) + " " + text()).encode() for _ in range(150)]
    d = toxicity.toxic_dictionary(toxic[:100], ordinary[:100], 512)
    assert any(w.encode() in d for w in bad)
    pair = toxicity.Pair(d, toxicity.ordinary_dictionary(ordinary[:100], 8192))
    score = lambda t: pair.features(t.decode())[0]
    assert np.median([score(t) for t in toxic[100:]]) > max(2, np.median([score(t) for t in ordinary[100:]]))
    whole, windowed = ordinary[0] * 40, ordinary[0]
    assert abs(score(whole) - score(windowed)) <= 3  # a long text is no more toxic than its windows


def test_op10(spark):
    rows = sorted(((k, t or "") for k, t, *_ in corpus()), reverse=True)
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, SF).collect()}
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t) // 3
        made = t[: len(t) - n] + after[:n]
        a, b, c = (fingerprint(x.encode()) for x in (t, made, after))
        assert (got[k].fingerprint, got[k].edited_fingerprint, got[k].near_edited, got[k].near_next) == (a, b, likeness(a, b), likeness(a, c))
    assert got[rows[0][0]].near_edited > 0


EDGE_IDS = [-(2**63) + 1, -(2**62) - 5, -1, *range(20), 2**62, 2**63 - 1]


def test_wide_ids_lose_no_row(spark):
    rows = [(i, f"{BASE} {i}") for i in EDGE_IDS] + [(None, f"null {j} {BASE}") for j in range(30)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = P.path("word_bpe_49k.json")
    for size in (300, 1 << 20):
        got = rans.read_documents(rans.encode_files(df, path, target_bytes=size, file_ids=50)).orderBy("start").collect()
        assert [r.doc_id for r in got] == [None] * 31 + sorted(EDGE_IDS)
        back = with_neighbours(df, target_bytes=size).collect()
        assert Counter(r.doc_id for r in back) == Counter(i for i, _ in rows)
        by = {r.doc_id: r for r in back}
        order = sorted(EDGE_IDS, reverse=True)
        assert all(by[a].next_fingerprint == fingerprint(f"{BASE} {b}".encode()) for a, b in zip(order, order[1:], strict=False))
    b = ordered.Buckets(df.selectExpr("coalesce(doc_id, -9223372036854775808) k", "text"), 300)
    assert b.count > 5


def test_token_blocks_in_any_order():
    rng = np.random.default_rng(4)
    ids = rng.geometric(0.001, 3 * rans.BLOCK // 2).astype("<u4")
    f = rans.TokenFile(rans.write_file([9], [ids.tobytes()]))
    parts = {b: f.read_block(b) for b in reversed(range(len(f.entries)))}
    assert len(parts) == 2 and (np.concatenate([parts[0], parts[1]]) == ids).all()


def test_very_long_text(spark):
    """Ten million characters, one run without a space among them."""
    long = "".join(f"word{i} " for i in range(1_100_000)) + "x" * 300_000 + BASE * 50
    rows = [(1, long), (2, BASE * 60), (3, long[5000:60_000]), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert len(long) > 10_000_000
    pieces = packing.pack_documents(df, P.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    n = {k: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in rows}
    assert {r.doc_id: r.n for r in pieces} == n
    assert {r.doc_id: r.n for r in bpe.encode(df, P.path("byte_bpe_50k.json")).select("doc_id", F.size("ids").alias("n")).collect()} == {k: v - 1 for k, v in n.items()}
    cut = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert len(cut[1].kept) == len(long) - sum(s.end - s.start for s in cut[1].spans) and len(cut[3].kept) == 0
    assert {r.doc_id: r.kept for r in near_duplicates(df).collect()} == {1: True, 2: True, 3: True, 4: True, 5: True}
    assert quality.judged(df.selectExpr("*", "'en' lang", "'s' source")).count() == 5
    assert {r.doc_id: r.lang_pred for r in language.identify(df, [("en", [1.0] * 1024)]).collect()}[4] == "und"


NAMES = "k long, _kept boolean, _k long, _text string, row string, score double, sha string, kept string, text_ string, m long, bucket long, `a.b` int"


def test_stages_take_any_columns(spark):
    """Clashing names, null ids with unlike texts, repeated rows, empty tables; each stage keeps its columns."""
    prose = [" ".join(f"{w}{i:03}x{j:02}" for j in range(60)) for i, w in enumerate("abcdefgh")]
    other = (1, True, 2, "t", "r", 0.5, "s", "k", "x", 3, 4, 5)
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[1]), (3, prose[2]), (3, prose[3]), (3, prose[3]), (4, prose[2] + " " + prose[4]), (5, prose[2]), (6, None), (7, ""), (8, prose[5])]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) + other for k, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType, name
        assert out.where("`a.b` <> 5 or row <> 'r'").count() == 0
        assert stage(spark, df.where("false"), SF).count() == 0
    got = Counter((r.doc_id, r.text) for r in C.suffix_dedup(spark, df, SF).collect())
    assert sum(got.values()) == len(rows)
    assert got[(None, prose[0])] == 1 and got[(None, prose[1])] == 2 and got[(3, prose[2])] == 1 and got[(3, prose[3])] == 2  # ids tie: no smaller one
    assert got[(5, "")] == 1 and got[(4, " " + prose[4])] == 1 and got[(6, None)] == 1 and got[(7, "")] == 1
    assert all(r.n_chars == len(r.text or "") for r in C.suffix_dedup(spark, df, SF).where("text is not null").collect())
    near = Counter((r.doc_id, r.text) for r in C.near_duplicate(spark, df, SF).collect())
    assert near[(None, prose[0])] == near[(None, prose[1])] == near[(3, prose[3])] == 1 and near[(3, prose[2])] == 1 and near[(5, prose[2])] == 0
    assert C.packing(spark, df, SF).count() >= 1


def test_pipeline_rows_follow_from_its_stages(spark):
    """run() against the stages applied by hand, and its pieces against the texts left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert 0 < len(texts) < len(corpus())
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in C.run(spark, SF).collect():
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {k: [i for _, p in sorted(v) for i in p] for k, v in got.items()} == {k: [*tok.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}


def test_links_between_pages(spark):
    """Chains, a cycle, relative links, entities, and addresses within a query."""
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    move = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    pages = [
        (1, "https://bad.test/x", ""),
        (2, "http://a.test/1", move("/2")),
        (3, "http://a.test/2", move("http://a.test/3")),
        (4, "http://a.test/3", move("https://bad.test/x")),
        (5, "http://b.test/dir/page", link("../top?a=1&amp;b=2")),
        (6, "http://b.test/top?a=1&b=2", move("//bad.test/x")),
        (7, "http://c.test/1", move("http://c.test/2")),
        (8, "http://c.test/2", move("http://c.test/1")),
        (9, "http://clean.test/", move("/go?u=https://bad.test/x")),
        (10, "http://clean.test/mail", link("mailto:x@bad.test")),
        (11, "http://d.test/", move("http://a.test/1")),
        (12, "http://good.test/ok", move("https://bad.test/x")),
    ]
    rules = [("bad.test", "/x", "block"), ("c.test", "/2", "block")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.url_verdicts(df, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block", 9: "allow", 10: "allow", 11: "block", 12: "block"}
    allowed = {r.page_id: r.verdict for r in urls.url_verdicts(df, [*rules, ("good.test", "/", "allow")]).collect()}
    assert allowed[12] == "allow" and allowed[1] == "block" and allowed[2] == "allow" and allowed[7] == "block"
    given = spark.createDataFrame([("http://clean.test/", "http://c.test/2"), (None, "x"), ("no", "https://bad.test/x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in urls.url_verdicts(df, rules, given).collect()}[9] == "block"
    twice = df.unionByName(df)
    assert urls.url_verdicts(twice, rules).count() == 24


def test_pack_balances_cost():
    """Descending documents go to the sequence with the least cost that has room."""
    lengths = [30, 30, 20, 20, 10, 10, 5, 3]
    got = packing.pack(lengths, 64, 1.0, 0.1)
    load, cost = defaultdict(int), defaultdict(float)
    for _, _, n, s, _ in got:
        load[s] += n
        cost[s] += n + 0.1 * n * n
    assert sum(load.values()) == 128 and max(load.values()) <= 64
    worst = [30 + 30 + 0.1 * (900 + 900), sum(lengths[2:]) + 0.1 * sum(n * n for n in lengths[2:])]
    assert max(cost.values()) - min(cost.values()) < abs(worst[0] - worst[1])
