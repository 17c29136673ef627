"""Record tables, notes, images, files and evaluators on small tables."""

import json
import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import hooks, schema
from tessera.functions import text as T
from tessera.operators import consolidate, evaluate, images, notes, records, state
from tessera.operators.search import Around, Filter, full_search
from tessera.sources import files

NOW = "2024-03-01 00:00:00"


def made(spark, rows, ddl="id string, content string, category string, source string"):
    return records.new_records(spark.createDataFrame(rows, ddl), NOW)


@pytest.fixture(scope="module")
def three(spark):
    return made(spark, [("a", "Azure Server", "fact", "user"), ("b", "the Azure Portal", "skill", "agent"), ("c", "plain words", "fact", "document")]).cache()


def test_insert_fills_in(spark, three):
    got = {r.id: r for r in three.collect()}
    assert got["a"].entity_ids == ["azure server", "azure", "server"] and got["a"].is_active and not got["a"].is_note and got["a"].metadata == "{}" and got["a"].embedding is None
    assert got["a"].created_at == datetime(2024, 3, 1)
    bad = [("x", "", "fact", "user"), ("y", "ok", "nonsense", "user"), ("z", "ok", "fact", "nobody")]
    assert made(spark, bad).count() == 0
    own = spark.createDataFrame([("d", "Has Own", "fact", "user", ["mine"])], "id string, content string, category string, source string, entity_ids array<string>")
    more = records.insert(three, own, NOW, hooks.embedding(hooks.TokenBuckets(8)))
    d = records.point(more, "d").first()
    assert d.entity_ids == ["mine"] and len(d.embedding) == 8 and more.count() == 4
    assert {r.id for r in records.among(three, spark.createDataFrame([("a",), ("a",), ("q",)], "id string")).collect()} == {"a"}


def test_partial_update(spark, three):
    embedded = three.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")).withColumn("valid_until", F.lit("2025-01-01").cast("timestamp_ntz"))
    ch = spark.createDataFrame([("a", "Now Kafka", None), ("zz", "x", None)], "id string, content string, valid_until timestamp_ntz")
    got = {r.id: r for r in records.partial_update(embedded, ch, "2024-04-01 00:00:00").collect()}
    assert got["a"].content == "Now Kafka" and got["a"].entity_ids == ["now kafka", "now", "kafka"] and got["a"].embedding is None and got["a"].valid_until is None
    assert got["a"].updated_at == datetime(2024, 4, 1) and got["b"].updated_at == datetime(2024, 3, 1) and got["b"].embedding == [1.0] and got["b"].valid_until
    same = spark.createDataFrame([("a", "Azure Server")], "id string, content string")
    assert records.partial_update(embedded, same, NOW).where("id = 'a'").first().embedding == [1.0]
    broken = spark.createDataFrame([("a", 99.0)], "id string, usefulness_score double")
    assert records.partial_update(embedded, broken, NOW).where("id = 'a'").first().usefulness_score == 0.0
    assert [r.id for r in records.missing(three, ch).collect()] == ["zz"]


def test_links_by_hand(spark, three):
    none = spark.createDataFrame([], schema.CONCEPT_LINKS)
    one = records.manual_link(none, three, "a", "b", "similar_to", NOW)
    assert {(r.source_memory_id, r.target_memory_id, r.source) for r in one.collect()} == {("a", "b", "user"), ("b", "a", "user")}
    assert records.manual_link(one, three, "a", "b", "similar_to", NOW).count() == 2 and records.manual_link(one, three, "a", "b", "uses", NOW).count() == 3
    with pytest.raises(ValueError):
        records.manual_link(none, three, "a", "a", "uses", NOW)
    with pytest.raises(KeyError):
        records.manual_link(none, three, "a", "nobody", "uses", NOW)


def test_sessions_and_summaries(spark, three):
    sessions = records.open_session(spark.createDataFrame([], schema.QUERY_SESSIONS), "q", NOW, "s1")
    assert sessions.first().query_text == "q" and not sessions.first().concluded
    assert records.conclude(records.conclude(sessions, "s1"), "zz").first().concluded
    res = spark.createDataFrame([], schema.QUERY_RESULTS)
    first = records.record_results(res, "s1", spark.createDataFrame([("a", 0.5), ("b", 0.4)], "id string, score double"))
    again = records.record_results(first, "s1", spark.createDataFrame([("a", 0.9)], "id string, score double"))
    assert {(r.memory_id, r.relevance_score) for r in again.collect()} == {("a", 0.9), ("b", 0.4)}
    from tessera.operators.feedback import feedback_prompt

    assert feedback_prompt(again, three, "<{memories}|{answer}>", "yes").first().prompt == "<a :: Azure Server\nb :: the Azure Portal|yes>"
    table = spark.createDataFrame([], schema.SUMMARIES)
    one = consolidate.apply_summary(three, table, "azure", "about azure", NOW)
    assert (one.first().memory_count, one.first().is_current) == (2, True)
    kept = one.first().id
    two = consolidate.apply_summary(three.where("id = 'a'"), one, "azure", "new", NOW)
    assert (two.first().id, two.first().memory_count, two.first().summary_text, two.count()) == (kept, 1, "new", 1)
    assert consolidate.concept_count(three, "api").first().memory_count == 0
    old = two.withColumn("is_current", F.lit(False))
    assert records.summaries(old).count() == 0 and records.summaries(old, include_stale=True).count() == 1 and records.summaries(old, "azure").count() == 1


def test_manifest(spark):
    rows = [("p", "c", 1, 1.0, None, "metadata", ["x"], False, None), ("q", "d", 1, 1.0, None, "metadata", [], False, None)]
    m = spark.createDataFrame(rows, schema.MANIFEST)
    up = records.manifest_upsert(m, spark.createDataFrame([("p", "c", 2, 2.0, None, "content", [], True, None)], schema.MANIFEST))
    assert up.count() == 2 and up.where("path = 'p'").first().size == 2
    assert records.manifest_delete(up, spark.createDataFrame([("q",)], "path string")).count() == 1
    assert [r.path for r in records.manifest_paths(m, "d").collect()] == ["q"] and records.manifest_paths(m).count() == 2


def test_from_rows(spark):
    r = spark.createDataFrame([("a", "x", '["p","q"]', "1", "2024-01-02T03:04:05", "oops")], "id string, content string, entity_ids string, verified string, created_at string, confidence string")
    got = records.from_rows(r).first()
    assert got.entity_ids == ["p", "q"] and got.verified is True and got.created_at == datetime(2024, 1, 2, 3, 4, 5) and got.confidence is None and got.metadata is None


def test_peers(spark):
    df = spark.createDataFrame([(i, ["x"] if i % 2 else ["y", "z"]) for i in range(30)], "id long, entity_ids array<string>")
    got = records.peers(df, df.where("id in (3, 4)"), 5).collect()
    assert sorted((r.id, r.peer) for r in got) == [(3, 1), (3, 5), (3, 7), (3, 9), (3, 11), (4, 0), (4, 2), (4, 6), (4, 8), (4, 10)]


def test_notes(spark):
    rows = [(f"r{i}", t, "fact", "user") for i, t in enumerate(["kafka broker settings", "lunch menu", "office plants"])]
    base = made(spark, rows)
    none = spark.createDataFrame([], schema.CONCEPT_LINKS)
    after, links, kind = notes.create_note(base, none, "n1", "Remember the Broker", NOW, about="kafka broker", when="2024-03-05 00:00:00")
    n = after.where("id = 'n1'").first()
    assert kind == "memory" and n.is_note and n.category == "temporal" and json.loads(n.metadata) == {"anchor": "kafka broker", "anchor_memory_id": "r0"}
    assert [(r.source_memory_id, r.target_memory_id, r.link_type, r.confidence) for r in links.collect()] == [("n1", "r0", "annotates", 1.0)]
    after2, links2, kind2 = notes.create_note(after, links, "n2", "Buy it", "2024-03-01 01:00:00", about="Some Unknown Thing", when="2024-02-01 00:00:00")
    assert kind2 == "topic" and "some unknown thing" in after2.where("id = 'n2'").first().entity_ids and links2.count() == 1
    ids = lambda **k: [r.id for r in records.list_notes(after2, NOW, **k).collect()]
    assert ids(upcoming=True) == ["n1"] and ids(overdue=True) == ["n2"] and ids() == ["n2", "n1"] and ids(about="some unknown thing") == ["n2"] and ids(limit=1) == ["n2"]
    with pytest.raises(ValueError):
        ids(upcoming=True, overdue=True)


def test_images(spark):
    meta = lambda **k: json.dumps(k)
    rows = [("i1", "a", "context", "document", meta(ext=".PNG", path="/p/1.png", rel="1.png", size=10)), ("i2", "b", "context", "document", meta(ext=".jpg", path="/p/2.jpg", rel="0.jpg", size=99, online_only=True)), ("i3", "c", "context", "document", meta(ext=".svg", path="/p/3.svg")), ("i4", "d", "context", "document", meta(ext=".psd", path="/p/4.psd")), ("t", "e", "context", "document", meta(ext=".txt", path="/p/1.png"))]
    r = made(spark, rows, "id string, content string, category string, source string, metadata string")
    none = spark.createDataFrame([], schema.CONCEPT_LINKS)
    assert [x.id for x in images.jobs(r, none).collect()] == ["i2", "i1"] and images.jobs(r, none, limit=1).first().id == "i2"
    assert images.find(r, "/p/1.png").first().id == "i1" and images.find(r, "/p/4.psd").count() == 0
    told = spark.createDataFrame([("i1", "a red box"), ("zz", "?")], "id string, content string")
    r2, l2 = images.put(r, none, told, NOW)
    assert [x.id for x in images.jobs(r2, l2).collect()] == ["i2"] and [x.id for x in images.missing(r, told).collect()] == ["zz"]
    assert {x.id: x.current_description for x in images.jobs(r2, l2, include_all=True).collect()} == {"i1": "a red box", "i2": None}
    r3, l3 = images.put(r2, l2, spark.createDataFrame([("i1", "a blue box")], "id string, content string"), "2024-03-02 00:00:00")
    assert {x.id: x.current_description for x in images.jobs(r3, l3, include_all=True).collect()}["i1"] == "a blue box"
    contents = spark.createDataFrame([("/p/1.png", b"one"), ("/p/2.jpg", b"two")], "path string, content binary")
    got = lambda **k: {x.id: (x.image_b64 and images.decode(x.image_b64), x.oversized) for x in images.with_bytes(images.jobs(r, none), contents, **k).collect()}
    assert got() == {"i2": (b"two", False), "i1": (None, False)} and got(include_bytes=True)["i1"] == (b"one", False)
    assert got(max_bytes=50)["i2"] == (None, True) and got(budget=50)["i2"] == (None, False)

    def captioner(job):
        if job["id"] == "i2":
            raise OSError("gone")
        return job["mime"]

    assert {x.id: (x.content, x.error) for x in images.describe(images.jobs(r, none), captioner).collect()} == {"i1": ("image/png", None), "i2": (None, "OSError: gone")}
    svg = b'<svg xmlns="http://www.w3.org/2000/svg"><title>T</title><g><text>a<tspan>b</tspan> c </text></g><text>c</text><rect>no</rect></svg>'
    assert images.svg_lines(svg) == "T\na\nb\nc" and images.svg_lines(b"<x") == "" and images.svg_lines(None) == ""
    assert spark.createDataFrame([(svg,)], "c binary").select(images.svg_text(F.col("c")).alias("t")).first().t == "T\na\nb\nc"


def test_full_search(spark):
    rows = [("a", "kafka broker one", "fact", "user"), ("b", "kafka stream two", "fact", "user"), ("c", "unrelated words", "fact", "user"), ("n", "note text", "fact", "user")]
    r = made(spark, rows).withColumn("is_note", F.col("id") == "n")
    edge = lambda s, t, k, w: (f"{s}{t}", s, t, k, "", w, 1.0, "user", False, None, None)
    links = spark.createDataFrame([edge("a", "c", "relates_to", 0.9), edge("n", "a", "annotates", 1.0)], schema.CONCEPT_LINKS)
    s, q = spark.createDataFrame([], schema.QUERY_SESSIONS), spark.createDataFrame([], schema.QUERY_RESULTS)
    got = full_search(r, links, s, q, "kafka broker", NOW, "s1", around=Around(1, 0.5))
    assert [(x.id, x.origin) for x in got.results.orderBy("place").collect()] == [("a", 0), ("b", 0), ("c", 1)]
    assert [(x.result_id, x.note_id) for x in got.notes.collect()] == [("a", "n")]
    assert got.query_results.count() == 3 and got.sessions.first().id == "s1"
    assert {x.id: x.retrieval_count for x in got.records.collect()} == {"a": 1, "b": 1, "c": 1, "n": 0}
    embed = hooks.Hashing(64)
    r2 = r.withColumn("embedding", hooks.embedding(embed)(F.col("content")))
    by_vector = full_search(r2, links, s, q, "unrelated", NOW, "s2", embed=lambda t: embed.embed_batch([t])[0].tolist(), where=Filter(category="fact"))
    assert by_vector.results.orderBy("place").first().id == "c" and by_vector.results.count() == 4
    with pytest.raises(ValueError):
        full_search(r, links, s, q, "x", NOW, "s", limit=0)


def test_resolver_hook(spark):
    r = made(spark, [(x, f"record {x}", "fact", "user") for x in "abcde"]).withColumn("flagged_for_review", F.col("id").isin("a", "b", "c", "d"))
    judged = consolidate.note_authority(r, spark.createDataFrame([("a", 0, "b")], "id string, pos int, other string"))

    def resolver(x):
        return {"a": [("DELETE", "b", ""), ("UPDATE", None, "kept")], "b": [("NONE", None, "")], "c": [("ADD", None, " merged fact ")], "d": [("ODD", None, "")]}[x["id"]]

    after, actions = consolidate.resolve(r, judged, resolver, NOW)
    got = {x.id: x for x in after.collect()}
    assert got["b"].is_archived and not got["a"].is_archived and json.loads(got["a"].metadata) == {"resolution_reason": "kept"}
    assert not any(x.flagged_for_review for x in got.values()) and len(got) == 6 and [x.content for x in got.values() if x.id.startswith("add-")] == ["merged fact"]
    assert actions.count() == 4


def test_full_consolidation(spark):
    rows = [(x, "Alpha Beta and Gamma", "fact", "user") for x in "abcd"]
    r = made(spark, rows).withColumns({"flagged_for_review": F.col("id").isin("a", "b", "n"), "is_note": F.col("id") == "b", "is_stale": F.col("id").isin("c", "d"), "staleness_score": F.when(F.col("id") == "c", 9.5).when(F.col("id") == "d", 7.0).otherwise(0.0), "usefulness_score": F.when(F.col("id") == "d", 9.0).otherwise(0.0), "last_accessed_at": F.when(F.col("id") == "d", F.lit(NOW).cast("timestamp_ntz"))})
    links, summaries = spark.createDataFrame([], schema.CONCEPT_LINKS), spark.createDataFrame([], schema.SUMMARIES)
    contra = spark.createDataFrame([("a", 0, "b")], "id string, pos int, other string")
    run = lambda rec, lk, sm: consolidate.run_full(rec, lk, sm, contra, NOW, lambda c, xs: f"{c} {len(xs)}")
    out = run(r, links, summaries)
    row = consolidate.report(out, r).first()
    assert (row.links, row.resolved, row.archived, row.rehabilitated) == (6, 1, 2, 1) and row.summaries > 0
    got = {x.id: x for x in out["records"].collect()}
    assert got["a"].superseded_by == "b" and got["c"].is_archived and not got["d"].is_stale and got["d"].staleness_score == 5.0
    lk = links.unionByName(out["links"], allowMissingColumns=True)
    again = run(out["records"].select(*r.columns), lk, out["summaries"].select(*summaries.columns))
    assert again["links"].count() == 0 and consolidate.report(again, out["records"]).first().resolved == 0


def test_files_to_text(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n, b in (("a.md", b"x  \r\ny"), ("sub/b.pdf", b"PDF"), ("c.pdf", b"bad"), ("slow.docx", b"z"), ("d.unknown", b"\xffq"), ("big.txt", b"x" * 500), ("long.csv", b"1"), ("none.epub", b"e")):
        (tmp_path / n).write_bytes(b)

    def pdf(path, data):
        if data == b"bad":
            raise RuntimeError("broken")
        return "from pdf  "

    conv = files.Converters({".pdf": pdf, ".docx": lambda p, d: time.sleep(5) or "late", ".csv": lambda p, d: "y" * 100}, timeout=0.5)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.method, r.error) for r in files.read_text(spark, str(tmp_path), 400, conv, 50).collect()}
    assert got["a.md"] == ("x\ny", "text", None) and got["b.pdf"] == ("from pdf", "convert", None) and got["c.pdf"][2] == "RuntimeError: broken"
    assert got["slow.docx"][2] == "timed out" and got["d.unknown"][0] == "�q" and got["big.txt"][2] == "file too large" and got["long.csv"] == (None, None, "output too large") and got["none.epub"][2] == "no converter"
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.expand(spark, [str(tmp_path), str(tmp_path / "a.md")], ["*.md", "*.pdf"])) == ["a.md", "b.pdf", "c.pdf"]
    with pytest.raises(FileNotFoundError):
        files.expand(spark, [str(tmp_path / "nope")], ["*"])
    listed = files.with_online_only(files.listing(spark, str(tmp_path)))
    assert listed.where("online_only").count() == 0 and listed.count() == 8


def test_render_names_with_commas(spark):
    rows = [("/f/a, b.txt", "a, b.txt", "f", "a, b.txt", 2048, 0.0, True), ("/f/c.txt", "c.txt", "f", "c.txt", 5, 0.0, False)]
    df = spark.createDataFrame(rows, "path string, rel string, folder string, name string, size long, mtime double, online_only boolean")
    got = {r.path: r.text for r in files.render(df, "root").collect()}
    assert got["/f/a, b.txt"] == "File: a, b.txt (text file, 2.0 KB, modified 1970-01-01)\nLocation: root / f\nAlongside 1 file(s) in this folder: c.txt.\nStatus: online-only (not downloaded)."
    assert got["/f/c.txt"].endswith("folder: a, b.txt.")


def test_load_corpus(spark, tmp_path):
    good = {"content": "x", "category": "FACT", "metadata": {"k": 1}, "valid_from": "2024-01-01T00:00:00"}
    (tmp_path / "a.json").write_text(json.dumps([good, {"content": "y", "category": "no"}, {"content": " ", "category": "fact"}]))
    (tmp_path / "b.json").write_text(json.dumps({"memories": [{"content": "z", "category": "skill", "source": "web"}]}))
    (tmp_path / "c.json").write_text("broken")
    got = sorted(records.load_corpus(spark, [str(tmp_path)]).collect(), key=lambda r: r.content)
    assert [(r.content, r.category, r.source, r.metadata) for r in got] == [("x", "fact", "document", '{"k":1}'), ("z", "skill", "document", "{}")] and got[0].valid_from == datetime(2024, 1, 1)


def test_evaluators(spark):
    ranked = spark.createDataFrame([(1, "a", 1, "alpha beta"), (1, "b", 2, "gamma"), (1, "c", 3, "x"), (2, "d", 1, "y")], "query_id long, id string, rank int, text string")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q")], "query_id long, id string")
    assert [tuple(r) for r in evaluate.judged(ranked, rel, 2).orderBy("query_id").collect()] == [(1, 2, 1, 1.0, 0.5), (2, 1, 0, 0.0, 0.0)]
    ev = spark.createDataFrame([(1, "alpha"), (1, "gamma delta"), (1, "none"), (3, "x")], "query_id long, text string")
    assert {r.query_id: round(r.recall, 3) for r in evaluate.text_recall(ranked, ev, 2).collect()} == {1: 0.667, 3: 0.0}
    keys = ranked.withColumn("other", F.col("rank") * 10)
    targets = spark.createDataFrame([(1, "20"), (2, "zz")], "query_id long, key string")
    assert {r.query_id: r.hit for r in evaluate.hit_at(keys, targets, 2, ["id", "other"]).collect()} == {1: 1.0, 2: 0.0}
    other = spark.createDataFrame([(1, "b", 1), (1, "q", 2)], "query_id long, id string, rank int")
    assert {r.query_id: round(r.jaccard, 3) for r in evaluate.agreement(ranked, other, 2).collect()} == {1: 0.333, 2: 0.0}
    sums = spark.createDataFrame([("k", 'NASA 12.5 "one two"', ["NASA in 1999", 'said "one two"']), ("e", "x", ["nothing"])], "key string, summary string, sources array<string>")
    assert {r.key: r.coverage and round(r.coverage, 3) for r in evaluate.coverage(sums).collect()} == {"k": 0.667, "e": None}
    xs = [5, 1, 9, 7, 7, 2, 8]
    df = spark.createDataFrame([(x,) for x in xs], "v int")
    for p in (0.0, 0.5, 0.9, 1.0):
        assert evaluate.nearest_rank(df, "v", p).first().v == sorted(xs)[min(len(xs) - 1, int(p * len(xs)))]
    links = spark.createDataFrame([("a",), ("a",), ("b",), ("",)], "entity string")
    assert tuple(evaluate.top_share(links, 1).first()) == (4, 50.0)


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.is_local_url(F.lit(u))) for u in ("http://localhost:1/x", "https://u@127.0.0.9", "http://[::1]:8/", "http://example.com", "localhost", "http://localhost.evil.com")] == [True, True, True, False, False, False]
    js = ['<think>{"a":0}</think> say {"a": 1} end', 'x ```json\n{"b": [2]}\n``` y', "none", "{bad}", "[1]"]
    assert [one(T.extract_json(F.lit(j))) for j in js] == ['{"a":1}', '{"b":[2]}', "{}", "{}", "{}"]
    assert one(T.base64url_text(F.lit("L2hvbWUvdS9wcm9q"))) == "/home/u/proj" and one(T.base64url_text(F.lit("!!"))) is None
    assert one(T.type_label(F.lit(".PDF"))) == "PDF document" and one(T.type_label(F.lit(".zzz"))) == "ZZZ file" and one(T.type_label(F.lit(""))) == "file"
    times = {"1704164650": "2024-01-02T03:04:10Z", "1704164650000": "2024-01-02T03:04:10Z", "2024-01-02T03:04:10Z": "2024-01-02T03:04:10Z", "2024-01-02T05:04:10+02:00": "2024-01-02T03:04:10Z", "2024-01-02 03:04:10": "2024-01-02T03:04:10Z", "2024-01-02": "2024-01-02T00:00:00Z", "soon": None, "": None}
    assert {k: one(T.to_utc(F.lit(k))) for k in times} == times
    emb = hooks.Hashing(64).embed_batch(["Kafka broker", "kafka broker!", "", None])
    assert (emb[0] == emb[1]).all() and abs(float((emb[0] ** 2).sum()) - 1) < 1e-6 and not emb[2].any() and not emb[3].any()
    with pytest.raises(ValueError):
        state.Snapshots(spark, "/x/", forbidden=("/x",))


def test_entities_of_real_text(spark):
    """The expression against the same rule in Python, over texts as they are."""
    import re

    from tessera.functions.text import CAP_PHRASE, CAP_WORD, QUOTED, STOP_WORDS

    def plain(t):
        found = [m[0] for m in re.finditer(CAP_PHRASE, t)] + [m[0] for m in re.finditer(CAP_WORD, t)] + [m[1] for m in re.finditer(QUOTED, t)]
        keys = [k for k in (x.lower().strip() for x in found) if len(k) >= 2 and k not in STOP_WORDS]
        return list(dict.fromkeys(keys))[:24]

    extra = [(-1, 'ÉAlpha Übung Straße Beta Gamma "é x" ÑB Cñ D E')]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = docs.select("doc_id", "text", T.entities(F.col("text")).alias("e")).collect()
    assert sum(not r.text.isascii() for r in got) > 20
    for r in got:
        assert r.e == plain(r.text), r.doc_id


def test_chunks_are_the_fold(spark):
    def fold(text, hard):
        out, buf = [], ""
        for p in (x.strip(" \t\n\r\f\x0b") for x in text.strip(" \t\n\r\f\x0b").split("\n\n")):
            if not p:
                continue
            if len(p) > hard:
                out += [buf] if buf else []
                out += [p[i : i + hard] for i in range(0, len(p), hard)]
                buf = ""
            elif buf and len(buf) + 2 + len(p) > hard:
                out, buf = [*out, buf], p
            else:
                buf = f"{buf}\n\n{p}" if buf else p
        return out + ([buf] if buf else [])

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = ["\n\n".join(t[i : i + 180] for i in range(0, len(t), 180)) for t in texts[:80]] + ["", "\n\n", "a\n\n\n\nb", "é" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for hard in (400, 150):
        got = {r.i: r.k for r in df.select("i", T.chunks(F.col("t"), hard).alias("k")).collect()}
        assert all(got[i] == fold(t, hard) for i, t in enumerate(texts))


def test_hashing_embedder_is_the_plain_sum(spark):
    import hashlib
    import re

    import numpy as np

    from tessera.operators.vector import feature_vector

    def plain(text, dim):
        toks = [t for t in re.split("[^a-z0-9]+", text.lower()) if len(t) >= 2]
        feats = ["w:" + t for t in toks] + ["w:" + " ".join(toks[i : i + 2]) for i in range(len(toks) - 1)]
        feats += ["c:" + f"^{t}$"[i : i + n] for t in toks for n in (3, 4, 5) for i in range(len(t) + 3 - n)]
        v = np.zeros(dim)
        for f in feats:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            v[h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    for t in ("Kafka broker, the Broker!", "a bb ccc", "", "x", "Ünïcode straße 12 3", "aa.bb aa"):
        assert np.allclose(feature_vector(t, 64), plain(t, 64), atol=1e-6)


def test_tables_are_released(spark):
    from tessera.plans import shared

    df = shared.materialize(spark.range(3), "t")
    assert df.count() == 3 and shared.release(spark) >= 1 and shared.release(spark) == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|No such file|PATH_NOT_FOUND"):
        df.selectExpr("sum(id)").collect()


def test_a_written_table_leaves_no_shuffle_files(spark):
    from tessera.plans import shared

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if (n := f.getName()).startswith("shuffle_")}
    before, until = shuffles(), time.time() + 10
    df = shared.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3), "t")
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and df.count() == 7 and spark.conf.get(shared.CLEANUP, "false") == "false"


def test_discarded_tables_are_gone(spark):
    from tessera.plans import shared

    keep, drop = shared.materialize(spark.range(3), "t"), shared.materialize(spark.range(4), "t")
    files = drop.inputFiles()
    shared.discard(drop, spark.range(1))
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files) and keep.count() == 3


def test_rankings_count_what_tokens_say(spark):
    """Counts by replacing against counts over token lists and over places."""
    import re

    from tessera.operators import lexical as L

    texts = ["a a a b", "the then other the", "", "aaa aa AAAA a1", "ana banana anana", "é a-a_a", " lead a", "x" * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    words, grams = [("a", False), ("the", True), ("aa", True), ("ana", False)], ["ana", "the", "aaa"]
    for r in L.counted(df, words, grams).collect():
        t = texts[r.id]
        if t is None:
            assert r.dl is None
            continue
        toks = re.findall("[a-z0-9]+", t.lower())
        assert r.dl == len(toks) and [r[f"f{i}"] for i in range(4)] == [sum(x.startswith(w) if pre else x == w for x in toks) for w, pre in words], t
        assert [r[f"g{i}"] for i in range(3)] == [len(re.findall(f"(?={g})", t.lower())) for g in grams], t


def test_nearest_by_cells(spark):
    """Many queries: the same as a full comparison, most pairs never made where vectors lie in clusters."""
    import numpy as np

    from tessera.operators import vector as V

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    m = centres[rng.integers(0, 12, 600)] + rng.normal(scale=0.05, size=(600, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(600, None), (601, [0.0] * 8), (602, [1.0] * 7), (603, [float(x) for x in m[0]])]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    q = v.where("id % 3 = 0 or id > 599").select(F.col("id").alias("query_id"), "vector")
    want = {}
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x and len(x) == 8 and any(x)}
    for i in unit:
        if i % 3 == 0 or i > 599:
            best = sorted((-round(float(unit[i] @ y), 6) + 0.0, j) for j, y in unit.items())[:5]
            want[i] = [(j, -s) for s, j in best]

    def told(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r.id, r.score))
        return out

    got, pruned = V.by_cells(v, q.where("vector is not null"), 5, 8, cells=16, block=20)
    for found in (told(got), told(V.nearest(v, q, 5)), told(V.nearest(v, q, 5, few=10))):
        assert set(found) == set(want)
        for i, x in found.items():
            assert [s for _, s in x] == pytest.approx([s for _, s in want[i]], abs=1.1e-6)
    assert pruned > 0.6
    assert V.nearest(v.where("false"), q, 5).count() == 0 and V.nearest(v.where("false"), q, 5, few=10).count() == 0 and V.nearest(v, q.where("false"), 5).count() == 0


def test_entity_finder_and_token_buckets(spark):
    import hashlib

    import numpy as np

    def find(text):
        if "fail" in text:
            raise ValueError("no model")
        return ["  Paris ", "the", "x", "paris", "Rome"] if text else []

    df = spark.createDataFrame([("Azure Sky saw rome",), ("fail Azure Sky",), (None,)], "c string")
    plain = [r.e for r in df.select(T.entities(F.col("c")).alias("e")).collect()]
    got = [r.e for r in df.select(hooks.entity_finder(find)(F.col("c")).alias("e")).collect()]
    assert got[0] == plain[0] + [e for e in ("paris", "rome") if e not in plain[0]] and got[1] == plain[1] and not got[2]
    assert len(df.select(hooks.entity_finder(lambda t: [f"name {i}" for i in range(99)])(F.col("c")).alias("e")).first().e) == 24
    (v,) = hooks.TokenBuckets(16).embed_batch(["Red red deer"])
    want = np.zeros(16)
    for t in ("red", "red", "deer"):
        d = hashlib.sha256(t.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 16] += int.from_bytes(d[4:8], "big") / 0xFFFFFFFF * 2 - 1
    assert np.allclose(v, want / np.linalg.norm(want), atol=1e-6) and not hooks.TokenBuckets().embed_batch([" "])[0].any()


def test_hashing_embedder_names_a_word_once(monkeypatch):
    from tessera.operators import vector

    asked, real = [], vector._place
    monkeypatch.setattr(vector, "_place", lambda f, dim: asked.append(f) or real(f, dim))
    vector._word.cache_clear()
    v = vector.feature_vector("onceword twiceword " * 500, 64)
    assert len(asked) < 100 and abs(float((v * v).sum()) - 1) < 1e-5
