"""Streams end in the tables that the batch operators make."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import history, sync
from tessera.operators.state import Snapshots
from tessera.settings import Segments
from tessera.sources.tables import table
from tessera.streaming import periodic, trees, turns
from tessera.streaming.history import watch_sessions

SF = "/root/testdata/sf0.001"
NOW = "2024-03-01 00:00:00"


def test_tree_runs_are_incremental(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("alpha")
    (root / "sub" / "b.txt").write_text("beta one\n\nbeta two")
    store = Snapshots(spark, f"file://{tmp_path}/store")
    run = lambda **k: trees.index_tree(spark, str(root), store, NOW, "docs", **k).first().asDict()
    assert run() == {"new": 2, "changed": 0, "unchanged": 0, "gone": 0}
    assert run() == {"new": 0, "changed": 0, "unchanged": 2, "gone": 0} and store.read("records").count() == 2
    assert run(mode="content") == {"new": 0, "changed": 2, "unchanged": 0, "gone": 0}
    live = store.read("records").where("is_active and not is_archived")
    assert sorted(json.loads(r.metadata)["record_role"] for r in live.collect()) == ["chunk", "chunk", "file", "file"]
    (root / "a.md").write_text("alpha changed")
    (root / "sub" / "b.txt").unlink()
    (root / "c.md").write_text("gamma")
    assert run(mode="content") == {"new": 1, "changed": 1, "unchanged": 0, "gone": 1}
    live = store.read("records").where("is_active and not is_archived")
    assert {r.content for r in live.where(F.get_json_object("metadata", "$.record_role") == "chunk").collect()} == {"alpha changed", "gamma"}
    assert {r.path.rsplit("/", 1)[1] for r in store.read("manifest").collect()} == {"a.md", "c.md"}
    ids = {i for r in store.read("manifest").collect() for i in r.memory_ids}
    assert ids == {r.id for r in live.collect()}
    q = trees.watch_tree(spark, str(root), store, lambda: NOW, "docs", f"{tmp_path}/ck", "content")
    q.awaitTermination(120)
    assert store.read("records").where("is_active").count() == live.count()
    (root / "c.md").unlink()  # no new file, and yet
    trees.watch_tree(spark, str(root), store, lambda: NOW, "docs", f"{tmp_path}/ck", "content").awaitTermination(120)
    assert store.read("manifest").count() == 1
    (root / "d.md").write_text("delta")
    trees.watch_tree(spark, str(root), store, lambda: NOW, "docs", f"{tmp_path}/ck", "content").awaitTermination(120)
    assert store.read("manifest").count() == 2


def test_sessions_are_watched(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    line = lambda i, sid: json.dumps({"type": "user" if i % 2 == 0 else "assistant", "sessionId": sid, "timestamp": f"2024-01-01T00:{i:02}:00Z", "message": {"content": f"turn {i}"}})
    (root / "a.jsonl").write_text("\n".join(line(i, "a") for i in range(6)))
    store = Snapshots(spark, f"file://{tmp_path}/store")
    go = lambda: watch_sessions(spark, "claude_code", str(root), store, lambda: NOW, f"{tmp_path}/ck", Segments(target_turns=2, min_turns=1, max_turns=3)).awaitTermination(180)
    go()
    one = sync.stored_segments(store.read("records")).count()
    go()
    assert sync.stored_segments(store.read("records")).count() == one > 1
    (root / "a.jsonl").write_text("\n".join(line(i, "a") for i in range(2)))  # rewritten, and no new file
    go()
    assert [(r.session_id, r.segment_index) for r in sync.stored_segments(store.read("records")).where("not is_archived").collect()] == [("a", 0)]
    (root / "b.jsonl").write_text(line(0, "b"))
    go()
    live = sync.stored_segments(store.read("records")).where("not is_archived")
    assert sorted((r.session_id, r.segment_index) for r in live.collect()) == [("a", 0), ("b", 0)]


def test_segment_stream_is_the_batch_fold(spark, tmp_path):
    for k, s in enumerate([Segments(target_turns=5, min_turns=3, max_turns=8, gap_minutes=30), Segments(target_turns=4, min_turns=2, max_turns=6, gap_minutes=0, max_segments=2)]):
        rows = []
        for sid in range(6):
            n = 3 + sid * 5
            rows += [(sid, i, datetime(2024, 1, 1) + timedelta(minutes=i, hours=2 if i > n // 2 else 0), "user" if (i + sid) % 3 == 0 else "assistant") for i in range(n)]
        flush = [(99, 0, datetime(2024, 2, 1), "user"), (99, 1, datetime(2024, 3, 1), "user")]
        ddl = "session_id long, seq int, ts timestamp, role string"
        src = tmp_path / f"in{k}"
        batch = spark.createDataFrame(rows, ddl)
        want = {tuple(r) for r in history.segments(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")), s).collect()}
        parts = [[r for r in rows if r[1] < 9], [r for r in rows if 9 <= r[1] < 17], [r for r in rows if r[1] >= 17], flush[:1], flush[1:]]
        for i, part in enumerate(parts):
            spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(src))
            stream = spark.readStream.schema(ddl).parquet(str(src))
            out = turns.segment_stream(stream, s, lateness="6 hours", idle_ms=4 * 3600_000)
            out.writeStream.format("parquet").option("path", str(tmp_path / f"out{k}")).option("checkpointLocation", str(tmp_path / f"ck{k}")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        got = {tuple(r) for r in spark.read.schema(turns.SEGMENT).parquet(str(tmp_path / f"out{k}")).where("session_id < 99").collect()}
        assert got == want


def test_window_counts(spark, tmp_path):
    e = table(spark, SF, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = turns.counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = e.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in want.collect()}
    assert turns.counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "1 hour").isStreaming
    assert turns.gap_sessions(stream.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))).isStreaming


def test_late_turns_go_back(spark):
    t = spark.createDataFrame([(1, 0), (1, 9), (2, 3), (3, 1)], "session_id long, seq int")
    closed = spark.createDataFrame([(1, 4), (1, 7), (2, 3)], "session_id long, turn_hi int")
    go, again = turns.split_late(t, closed)
    assert {tuple(r) for r in go.collect()} == {(1, 9), (3, 1)} and {r.session_id for r in again.collect()} == {1, 2}


def test_periodic(spark, tmp_path):
    runs = []

    def job(n):
        runs.append(n)
        if len(runs) == 1:
            raise RuntimeError("the first run fails")

    q = periodic.every(spark, 0.2, job, f"{tmp_path}/ck")
    for _ in range(100):
        q.processAllAvailable() if len(runs) < 2 else None
        if len(runs) >= 2:
            break
    q.stop()
    assert len(runs) >= 2 and q.exception() is None
    from tessera.operators.records import new_records

    store = Snapshots(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(x, "Alpha Beta words", "fact", "user") for x in "abc"], "id string, content string, category string, source string")
    store.write("records", new_records(rows, NOW))
    store.write("links", spark.createDataFrame([], schema.CONCEPT_LINKS))
    store.write("summaries", spark.createDataFrame([], schema.SUMMARIES))
    for _ in range(2):
        periodic.consolidate_store(store, NOW, lambda c, xs: f"{c} {len(xs)}")
        assert store.read("links").count() == 3 and store.read("records").count() == 3
    assert store.read("summaries").count() > 0
