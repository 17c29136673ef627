"""Operators against plain forms that share no code with them."""

import random

import duckdb

from tessera.llm import queries, sql
from tessera.llm.fingerprints import fingerprint, likeness

M = 2**64
P = 0x9E3779B97F4A7C15
ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 % M
    h ^= h >> 27
    h = h * 0x94D049BB133111EB % M
    return h ^ h >> 31


def plain_fingerprint(data):
    """Byte by byte: the last seven decide where a chunk ends."""

    def letters(block, most):
        out, h, power, done = "", 0, 1, 0
        for i, c in enumerate(data):
            h, power, done = (h + (c + 1) * power) % M, power * P % M, done + 1
            last = data[max(0, i - 6) : i + 1][::-1]
            roll = mixed(sum((x + 1) * pow(P, j + 1, M) for j, x in enumerate(last)) % M) >> 32
            if roll % block == block - 1 and len(out) < most - 1:
                out, h, power, done = out + ABC[mixed(h) >> 58], 0, 1, 0
        return out + ABC[mixed(h) >> 58] if done else out

    def ends(block):
        return sum((mixed(sum((x + 1) * pow(P, j + 1, M) for j, x in enumerate(data[max(0, i - 6) : i + 1][::-1])) % M) >> 32) % block == block - 1 for i in range(len(data)))

    if not data:
        return "3::"
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and ends(block) < 32:
        block //= 2
    return f"{block}:{letters(block, 64)}:{letters(2 * block, 32)}"


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def plain_likeness(x, y):
    """Twice the letters that one can keep in order, by all letters: what edits by single letters leave."""
    if x == y:
        return 1.0
    (p, a, a2), (q, b, b2) = x.split(":"), y.split(":")

    def alike(s, t):
        if s == t:
            return 1.0
        if not s or not t:
            return 0.0
        run = max(1, min(7, min(len(s), len(t)) // 2))
        if run > 1 and not any(s[i : i + run] in t for i in range(len(s) - run + 1)):
            return 0.0
        return 2.0 * plain_common(s, t) / (len(s) + len(t))

    p, q = int(p), int(q)
    if p == q:
        return max(alike(a, b), alike(a2, b2) if min(len(a2), len(b2)) >= 7 else 0.0)
    return alike(a, b2) if p == 2 * q else alike(a2, b) if q == 2 * p else 0.0


def test_fingerprints_byte_by_byte():
    rng = random.Random(5)
    texts = [b"", b"a", b"ab" * 300, bytes(range(256)) * 3, bytes(5000)]
    texts += [bytes(rng.choices(b"the quick brown fox jumps", k=n)) for n in (1, 6, 7, 8, 63, 191, 192, 193, 700, 3000)]
    texts += [texts[-1][:2000] + b"!" + texts[-1][2000:], texts[-1] + texts[-2][:900]]
    marks = [plain_fingerprint(t) for t in texts]
    assert [fingerprint(t) for t in texts] == marks
    for x in marks:
        for y in marks:
            assert likeness(x, y) == plain_likeness(x, y), (x, y)
    assert plain_likeness(marks[-3], marks[-2]) > 0.8


def test_op10_of_documents(spark):
    """The query's fingerprints of shorter documents, and likenesses of all."""
    sf = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall())
    rows = {r.doc_id: r for r in queries.op10_fingerprints(spark, sf).collect()}
    short = [k for k, t in sorted(texts.items()) if len(t) < 1200][:25]
    assert len(short) > 10
    for k in short:
        assert rows[k].fingerprint == plain_fingerprint(texts[k].encode())
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        after = rows[order[(i + 1) % len(order)]]
        assert (rows[k].near_edited, rows[k].near_next) == (plain_likeness(rows[k].fingerprint, rows[k].edited_fingerprint), plain_likeness(rows[k].fingerprint, after.fingerprint))


def test_op9_through_its_query(spark, tmp_path):
    """Chains, cycles, both verdicts and repeated rows, by the query, by its SQL and by hand."""
    canon = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    moved = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    pages = [(i, f"http://a{i}.test/p", canon(f"http://a{i + 1}.test/p")) for i in range(40)]
    pages += [(40, "http://a40.test/p", moved("https://x.net/es/1")), (41, "https://x.net/es/1", "")]
    pages += [(50 + i, f"http://c{i}.test/", canon(f"http://c{(i + 1) % 5}.test/")) for i in range(5)]
    pages += [(60, "http://d.test/1", moved("http://y.net/fr/1")), (61, "http://d.test/1", canon("http://www.example.com/en/p")), (62, "http://y.net/fr/1", None), (63, "http://www.example.com/en/p", "")]
    pages += [(70, "http://example.com/en/q", canon("http://e.test/")), (71, "http://e.test/", ""), (72, "http://E.test/#f", ""), (73, None, ""), (74, "e.test", moved("http://y.net/fr/1")), (75, "http://f.test/?a=1", canon("http://y.net/fr/1")), (76, "http://f.test/?a=2", "")]
    pages += [(71, "http://e.test/", ""), (None, "http://a7.test/p", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.op9_urls(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    res = con.execute(sql.OP9)
    names = [d[0] for d in res.description]
    want = sorted((tuple(r[names.index(c)] for c in ("page_id", "host", "path", "rule", "verdict")) for r in res.fetchall()), key=str)
    assert got == want and len(got) == len(pages)
    blocked = {*range(42), None, 62, 70, 71, 72}  # the chain, its end, and aliases of blocked urls; 75 has an allowed alias too
    assert {r[0] for r in got if r[4] == "block"} == blocked
    assert {r[0] for r in got if r[4] == "allow"} == {50, 51, 52, 53, 54, 60, 61, 63, 73, 74, 75, 76}
