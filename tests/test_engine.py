"""Operators of the record engine on small tables, and all SQL twins."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera import catalog, schema
from tessera.functions import text as T
from tessera.operators import cochange, consolidate, feedback, graph, history, state
from tessera.operators.components import connected_components
from tessera.operators.lexical import query_terms
from tessera.queries import drivers, graphs
from tessera.settings import Documents, Links, Segments
from tessera.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    a = sorted(([plain(v) for v in r] for r in got.select(*cols).collect()), key=str)
    res = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    b = sorted(([plain(r[names.index(c)]) for c in cols] for r in res.fetchall()), key=str)
    assert sorted(names) == cols
    assert [[str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r] for r in a] == [[str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r] for r in b]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (2, 5)], "src long, dst long")
    assert {(r.node, r.component) for r in connected_components(e).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 8), (8, 8)}
    assert connected_components(e.where("false")).count() == 0


def greedy(pairs, cap):
    room, out = {}, []
    for a, b, shared, strength in sorted(pairs, key=lambda p: (-p[2], -p[3], p[0], p[1])):
        if room.get(a, cap) > 0 and room.get(b, cap) > 0:
            room[a], room[b] = room.get(a, cap) - 1, room.get(b, cap) - 1
            out.append((a, b))
    return set(out)


def test_cap_per_node_is_the_greedy_scan(spark):
    pairs = [(a, b, (a * 7 + b * 3) % 5 + 2, ((a * b) % 7) / 7) for a in range(9) for b in range(a + 1, 9)]
    df = spark.createDataFrame(pairs, "id1 long, id2 long, shared long, strength double")
    got = {(r.id1, r.id2) for r in graph.cap_per_node(df, Links(max_per_node=2)).collect()}
    assert got == greedy(pairs, 2)
    assert graph.cap_per_node(df.where("false")).count() == 0
    for scan in (1, 5, 20):
        assert {(r.id1, r.id2) for r in graph.cap_per_node(df, Links(max_per_node=2), scan).collect()} == greedy(pairs, 2)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """Each link of the chain depends on the one before, which a round a link would take."""
    n, rounds = 300, []
    pairs = [(i, i + 1, 2 + i, 0.5) for i in range(n)]
    real = graph._scan
    monkeypatch.setattr(graph, "_scan", lambda links: rounds.append(1) or real(links))
    df = spark.createDataFrame(pairs, "id1 long, id2 long, shared long, strength double")
    assert {(r.id1, r.id2) for r in graph.cap_per_node(df, Links(max_per_node=1), 100).collect()} == greedy(pairs, 1)
    assert len(rounds) <= 3


@pytest.mark.parametrize("least,jaccard", [(1, 0.0), (2, 0.0), (3, 0.0), (1, 0.4), (2, 0.5), (1, 1.0)])
def test_similar_pairs(spark, least, jaccard):
    """Against all pairs of sets, also where a common entity is dealt to blocks."""
    import random

    rng = random.Random(least + int(10 * jaccard))
    sets = {i: {e for e in (rng.choice("aaaabbbccd") if rng.random() < 0.6 else f"e{rng.randrange(12)}" for _ in range(rng.randrange(9)))} for i in range(60)} | {60: {"e1", "e2"}, 61: {"e1", "e2"}}
    rows = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "id long, entity string")
    weights = graph.by_rarity(rows).withColumn("weight", F.col("df") * 1.0)
    df = {r.entity: r.df for r in weights.collect()}
    want = {}
    for a in sets:
        for b in sets:
            both = sets[a] & sets[b]
            if a < b and len(both) >= least and len(both) / len(sets[a] | sets[b]) >= jaccard:
                want[a, b] = (len(both), min(both), sum(df[e] for e in both), len(sets[a]), len(sets[b]))
    for block in (2000, 7):
        got = graph.similar_pairs(rows, weights, least, jaccard, block).collect()
        assert {(r.id1, r.id2): tuple(r)[2:] for r in got} == want and len(got) == len(want)


def fold(turns, s):
    if len(turns) <= s.max_turns:
        return [(turns[0][0], turns[-1][0])]
    out, cur = [], []
    for t in turns:
        last = next((x[1] for x in reversed(cur) if x[1] is not None), None)
        if cur and (s.gap_minutes > 0 and last is not None and t[1] is not None and t[1] - last > s.gap_minutes * 60 or len(cur) >= s.target_turns and t[2]):
            out.append(cur)
            cur = []
        cur.append(t)
        if len(cur) >= s.max_turns:
            out.append(cur)
            cur = []
    out += [cur] if cur else []
    if len(out) > 1 and len(out[-1]) < s.min_turns:
        out[-2:] = [out[-2] + out[-1]]
    if s.max_segments and len(out) > s.max_segments:
        out[s.max_segments - 1 :] = [sum(out[s.max_segments - 1 :], [])]
    return [(x[0][0], x[-1][0]) for x in out]


@pytest.mark.parametrize("s", [Segments(target_turns=5, min_turns=3, max_turns=8, gap_minutes=30), Segments(target_turns=4, min_turns=2, max_turns=6, gap_minutes=0, max_segments=2)])
def test_segments_are_the_fold(spark, s):
    rows, want = [], set()
    for sid in range(6):
        n = 3 + sid * 5
        turns = [(i, None if (i + sid) % 11 == 0 else i * 60 + (7200 if i > n // 2 else 0), (i + sid) % 3 == 0) for i in range(n)]
        rows += [(sid, i, datetime(1970, 1, 1) + timedelta(seconds=t) if t is not None else None, "user" if u else "assistant") for i, t, u in turns]
        want |= {(sid, i, lo, hi) for i, (lo, hi) in enumerate(fold(turns, s))}
    df = spark.createDataFrame(rows, "session_id long, seq int, ts timestamp_ntz, role string")
    assert {tuple(r) for r in history.segments(df, s).collect()} == want


def test_window():
    now = datetime(2024, 3, 1)
    assert history.window("2w", None, None, now)[0] == datetime(2024, 2, 16)
    assert history.window(None, None, None, now)[0] == datetime(2023, 12, 2)
    with pytest.raises(ValueError):
        history.window("2h", None, None, now)
    with pytest.raises(ValueError):
        history.window("2d", now, None, now)


def test_text_functions(spark):
    rows = ['The Azure SQL Server met "open source" and Azure', "a  \r\n<!-- x\ny -->b\n\n\n\nc\n", "AKIA" + "A" * 16 + " Authorization: Basic x", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(T.entities(F.col("t")).alias("e"), T.clean_markdown(F.col("t")).alias("c"), T.redact(F.col("t")).alias("r"), T.redact(T.redact(F.col("t"))).alias("r2"), T.chunks(F.col("t"), 5).alias("k"))
    got = df.collect()
    assert got[0].e == ["the azure sql server", "azure", "sql", "server", "open source"]
    assert got[1].c == "a\nb\n\nc"
    assert got[2].r == "[REDACTED:aws_key] Authorization: [REDACTED:auth_header]" and got[2].r == got[2].r2
    assert got[3].k == [] and got[4].c is None


def test_query_terms():
    assert query_terms("Sql a to") == [("sql", True), ("a", False), ("to", False), ("sqla", True)]


def test_state(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "id long, v string")
    assert sorted(map(tuple, state.upsert(a, b.distinct(), "id").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, state.insert_or_ignore(a, b, "id").collect())) == [(1, "x"), (2, "y"), (3, "w")]
    s = state.Snapshots(spark, f"file://{tmp_path}/s")
    assert s.read("t") is None
    s.write("t", a)
    s.upsert("t", b.distinct(), "id")
    assert s.read("t").count() == 3


def test_session_feedback_is_given_once(spark):
    one = spark.createDataFrame([("s", "q", None, None, None, [], [], False)], schema.QUERY_SESSIONS)
    res = spark.createDataFrame([("s", "m1", 1.0, False, False, False)], schema.QUERY_RESULTS)
    done, marked, events = feedback.session_feedback(one, res, ["m1"], ["m1"], 4)
    assert marked.first().was_useful and marked.first().was_stale and tuple(events.first()) == ("m1", 1, 1)
    with pytest.raises(ValueError):
        feedback.session_feedback(done, res, [], [])
    with pytest.raises(KeyError):
        feedback.session_feedback(one.where("false"), res, [], [])


def test_consolidation_is_idempotent(spark):
    rec = catalog.QUERIES  # the twins cover single steps; here: links are not made twice
    assert "anomalies" in rec
    m = spark.createDataFrame([(i, ["ab", "cd"], True, False) for i in range(4)], "id long, entity_ids array<string>, is_active boolean, is_archived boolean")
    none = spark.createDataFrame([], "source_memory_id long, target_memory_id long, link_type string")
    links = consolidate.link_concepts(m, none)
    assert links.count() == 6
    assert consolidate.link_concepts(m, links.select("source_memory_id", "target_memory_id", "link_type")).count() == 0


def test_neighbours_give_the_components_of_all_pairs(spark):
    s = Documents(block_cap=10**6)
    d = spark.createDataFrame([(i, "f", float(i * i * 400 % 50000)) for i in range(40)], "doc_id long, folder string, mtime double")
    b = cochange.blocks(d, s)
    pairs = cochange.pair_distances(b, s).where(F.col("distance") <= s.eps)
    want = {tuple(r) for r in connected_components(pairs, "a", "b").collect()}
    assert {tuple(r) for r in cochange.clusters(b, s).collect()} == want and want


def test_listing(spark, tmp_path):
    for p in ("a/x.md", "a/y.html", "b/z.md", ".DS_Store"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("hello")
    got = files.listing(spark, str(tmp_path), include=["*.md"], exclude=["b"])
    assert [r.rel for r in got.collect()] == ["a/x.md"]
    assert "Alongside 1 file(s)" in files.render(files.listing(spark, str(tmp_path)), "root").where("path like '%x.md'").first().text


def test_checks(spark):
    row = spark.createDataFrame([("", "fact", "user", 2.0, 1.0, 1.0)], "content string, category string, source string, confidence double, usefulness_score double, staleness_score double")
    assert {r.check for r in schema.violations(row, schema.MEMORY_CHECKS).collect() if r.rows} == {"content_length", "confidence"}


def test_every_selected_concept_gets_a_summary(spark):
    chosen = {r.concept: r.memory_count for r in catalog.QUERIES["concept_selection"](spark, SF).collect()}
    got = catalog.QUERIES["summary_generation"](spark, SF).collect()
    assert len(got) == len(chosen) > 50 and {r.concept: r.memory_count for r in got} == chosen


def test_pair_queries_use_common_entities(spark):
    from collections import Counter

    from tessera.queries.graphs import records

    live = {r.id: set(r.entity_ids) - set(Links().stoplist) for r in records(spark, SF).where("is_active and not is_archived").collect()}
    want = {(a, b): (len(live[a] & live[b]), min(live[a] & live[b])) for a in live for b in live if a < b and live[a] & live[b]}
    assert max(Counter(e for x in live.values() for e in x).values()) > 0.02 * len(live)  # the cap would bite
    assert {(r.id1, r.id2): (r.shared, r.entity) for r in catalog.QUERIES["co_occurrence_pairs_all"](spark, SF).collect()} == want
    got = {(r.id1, r.id2): r for r in catalog.QUERIES["concept_strength_all"](spark, SF).collect()}
    assert set(got) == {k for k, v in want.items() if v[0] >= 2}
    assert all(r.jaccard == round(r.shared / len(live[a] | live[b]), 6) for (a, b), r in got.items())
    taken = {(r.id1, r.id2) for r in catalog.QUERIES["cap_per_node"](spark, SF).collect()}
    assert taken == greedy([(a, b, r.shared, r.strength) for (a, b), r in got.items()], 3)


def _above_pairs(df):
    """The plan's operators that the pairs themselves go through, once found."""
    plan = df._jdf.queryExecution().sparkPlan().toString().split("MapInArrow")
    assert len(plan) > 1
    return plan[0]


def test_pairs_are_not_joined_or_shuffled_once_found(spark):
    rows = spark.createDataFrame([(i, e) for i in range(30) for e in ("all", f"e{i % 3}")], "id long, entity string")
    got = graph.co_occurrence(rows)
    assert "Join" not in _above_pairs(got) and got.count() == 435 and got.where("shared = 2").count() == 135


def test_strengths_of_all_pairs_are_not_joined_once_found(spark):
    r = spark.createDataFrame([(i, ["x", "y", f"e{i % 3}"], True, False) for i in range(30)], "id long, entity_ids array<string>, is_active boolean, is_archived boolean")
    got = graph.concept_pairs(r)
    assert "Join" not in _above_pairs(got) and got.count() == 435 and {x.jaccard for x in got.collect()} == {0.5, 1.0}


def test_pairs_with_strengths_are_whole_as_they_are_found(spark, monkeypatch):
    """Nothing is left to do to a pair after its blocks met, texts are not written with entities, and a block's own pairs are looked at once."""
    r = spark.createDataFrame([(i, ["x", "y"] + [f"e{j}" for j in range(i % 7)], True, False) for i in range(40)], "id long, entity_ids array<string>, is_active boolean, is_archived boolean")
    got = graph.concept_pairs(r)
    assert "round" not in _above_pairs(got)
    sets = {x.id: set(x.entity_ids) for x in r.collect()}
    df = {e: sum(e in v for v in sets.values()) for v in sets.values() for e in v}
    seen = {(x.id1, x.id2): x for x in got.collect()}
    assert set(seen) == {(a, b) for a in sets for b in sets if a < b}
    for (a, b), x in seen.items():
        both = sets[a] & sets[b]
        weight = sum(math.log(41 / (df[e] + 1)) + 1 for e in both) / (len(both) * (math.log(41) + 1))
        assert (x.shared, x.entity, x.jaccard) == (len(both), min(both), round(len(both) / len(sets[a] | sets[b]), 6)) and abs(x.strength - weight) < 1e-6 and round(x.strength, 6) == x.strength
    written, real = [], graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df, tag: written.append(df.columns) or real(df, tag))
    assert catalog.QUERIES["concept_strength"](spark, SF).count() and written and not any("content" in c for c in written)
    n, names = 50, pa.array(["x"])
    block = [pa.array(range(n)), np.ones(n, np.int64), np.zeros(n, np.int64), names, np.ones(1)]
    steps = list(graph._met_blocks(block, block, pa.concat_arrays([names, names]).dictionary_encode(), True, 1, n * (n - 1) // 2))
    assert len(steps) == 1 and len(steps[0][0]) == n * (n - 1) // 2


def _columns_written(spark, monkeypatch, name):
    written, real = [], graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df, tag: written.append(df.columns) or real(df, tag))
    assert catalog.QUERIES[name](spark, SF).count()
    return written


def test_all_pairs_write_no_texts(spark, monkeypatch):
    written = _columns_written(spark, monkeypatch, "co_occurrence_pairs_all")
    assert written and not any("content" in c for c in written)


def test_all_strengths_write_no_texts(spark, monkeypatch):
    written = _columns_written(spark, monkeypatch, "concept_strength_all")
    assert written and not any("content" in c for c in written)


def test_ends_with_room_for_all_their_links_are_not_scanned(spark, monkeypatch):
    pairs = [(a, b, (a * 7 + b * 3) % 5 + 2, ((a * b) % 7) / 7) for a in range(9) for b in range(a + 1, 9)] + [(20, 21, 3, 0.5), (21, 22, 3, 0.5)]
    df = spark.createDataFrame(pairs, "id1 long, id2 long, shared long, strength double")
    seen, real = [], graph._scan
    monkeypatch.setattr(graph, "_scan", lambda links: seen.extend(links.select("id1", "id2").collect()) or real(links))
    assert {(r.id1, r.id2) for r in graph.cap_per_node(df, Links(max_per_node=2)).collect()} == greedy(pairs, 2)
    assert seen and all(r.id1 < 20 for r in seen)
    seen.clear()
    assert graph.cap_per_node(df, Links(max_per_node=8)).count() == len(pairs) and not seen
    monkeypatch.setattr(consolidate, "cap_per_node", None)  # as many links as records may have: nothing to cap
    m = spark.createDataFrame([(i, ["ab", "cd"], True, False) for i in range(4)], "id long, entity_ids array<string>, is_active boolean, is_archived boolean")
    none = spark.createDataFrame([], "source_memory_id long, target_memory_id long, link_type string")
    assert consolidate.link_concepts(m, none, Links(max_per_node=3)).count() == 6


def test_known_links_are_left_out_where_records_meet(spark, monkeypatch):
    """Whichever way they go and wherever their ends lie, with no join of the pairs found; of very many, by a join."""
    m = spark.createDataFrame([(i, ["ab", "cd"] + ["ef"] * (i % 2), i != 7, False) for i in range(24)], "id long, entity_ids array<string>, is_active boolean, is_archived boolean")
    old = [(b, a, "relates_to") if (a + b) % 2 else (a, b, "relates_to") for a in range(24) for b in range(a + 1, 24) if (a * b) % 5 == 1] + [(99, 3, "relates_to"), (None, 3, "relates_to")]
    existing = spark.createDataFrame(old + [(0, 1, "other")], "source_memory_id long, target_memory_id long, link_type string")
    want = {(a, b) for a in range(24) for b in range(a + 1, 24) if (a * b) % 5 != 1 and 7 not in (a, b)}
    for known in (16, 0):
        monkeypatch.setattr(graph, "KNOWN", known)
        links = consolidate.link_concepts(m, existing)
        got = [(r.source_memory_id, r.target_memory_id) for r in links.collect()]
        assert set(got) == want and len(got) == len(want)
        assert ("LeftAnti" in links._jdf.queryExecution().toString()) == (known == 0)


def test_links_of_concepts_write_no_texts(spark, monkeypatch):
    written, real = [], drivers.materialize
    monkeypatch.setattr(drivers, "materialize", lambda df, tag: written.append(df.columns) or real(df, tag))
    assert catalog.QUERIES["concept_links"](spark, SF).count()
    assert written and not any("content" in c for c in written)


def test_sets_that_meet_carry_ranks_only(spark):
    sets = spark.createDataFrame([(i, [1, 2, 3], [7, 8, 9], [0.5, 0.5, 0.5]) for i in range(3)], "id long, ranks array<long>, names array<long>, weights array<double>")
    got = graph._met(sets, 1, 0.5, 500)
    assert not {"names", "weights"} & set(got.columns) and got.count() == 6


def test_links_are_capped_slice_by_slice(spark, monkeypatch):
    """The links that the scan takes of all pairs, though no more than a slice of them is ever written down."""
    import random

    rng = random.Random(5)
    made = [(i, sorted({rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(12))} | {"every"}), i % 17 != 0, False) for i in range(70)]
    r = spark.createDataFrame(made + [(i, ["kl", "mn", "op"], True, False) for i in range(200, 206)], "id long, entity_ids array<string>, is_active boolean, is_archived boolean").cache()
    s, real, written = Links(max_per_node=3), graph.materialize, []
    pairs = {(x.id1, x.id2): tuple(x) for x in graph.concept_pairs(r, s).collect()}
    want = greedy([(a, b, x[2], x[5]) for (a, b), x in pairs.items()], 3)
    monkeypatch.setattr(graph, "materialize", lambda df, tag: (out := real(df, tag), tag != "slice" or written.append(out.count()))[0])
    got = [tuple(x) for x in graph.capped_pairs(r, s, most=len(pairs) // 2).collect()]
    assert {x[:2] for x in got} == want and len(got) == len(want) and all(x == pairs[x[:2]] for x in got)
    assert len(written) > 1 and max(written) <= len(pairs) // 2
    assert graph._millionths(np.array([0.0000005, 0.1234565, 0.5, 1.0])).tolist() == [1, 123457, 500000, 1000000]


def test_the_query_does_not_write_all_pairs(spark, monkeypatch):
    tags, real = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, tag: tags.append(tag) or real(df, tag))
    assert catalog.QUERIES["cap_per_node"](spark, SF).count() and "slice" in tags and "pairs" not in tags
