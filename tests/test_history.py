"""Session dialects, and history kept in step with its files."""

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import history, sync
from tessera.settings import Segments
from tessera.sources import sessions

NOW = "2024-03-01 00:00:00"


def write(path, *objects, lines=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in objects) if lines else json.dumps(objects[0])
    path.write_text(text)


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("session_id", "seq").select(*cols).collect()]


def test_block_lines(spark, tmp_path):
    at = "2024-01-02T03:04:0{}Z"
    write(
        tmp_path / "p" / "one.jsonl",
        {"type": "summary", "cwd": "/w/repo/sub", "sessionId": "s1"},
        "not json",
        {"type": "user", "isSidechain": True, "message": {"content": "hidden"}},
        {"type": "user", "timestamp": at.format(1), "gitBranch": "main", "message": {"content": " hello "}},
        {"type": "assistant", "timestamp": at.format(2), "message": {"model": "m-1", "content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Read"}, {"type": "tool_use", "name": "Bash"}, {"type": "tool_use"}]}},
        {"type": "user", "timestamp": at.format(3), "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"type": "tool_result", "content": ""}, {"type": "text", "text": " "}]}},
        {"type": "assistant", "timestamp": 1704164650, "message": "no object"},
        lines=True,
    )
    write(tmp_path / "two.jsonl", {"type": "user", "message": {"content": "q"}}, lines=True)
    write(tmp_path / "empty.jsonl", {"type": "user", "message": {"content": ""}}, lines=True)
    repos = spark.createDataFrame([("/w/repo", "/w/main")], "path string, target string")
    got = sessions.read_sessions(spark, "claude_code", str(tmp_path), repos=repos)
    assert rows(got.turns.where("session_id = 's1'"), "seq", "role", "text", "tool_name") == [
        (0, "user", "hello", None), (1, "assistant", "hi", None), (2, "tool", "tool_use:Read", "Read"), (3, "tool", "tool_use:Bash", "Bash"),
        (4, "tool", "tool_use:", None), (5, "tool", "a\nb", None), (6, "tool", "(tool result)", None),
    ]
    s = {r.session_id: r for r in got.sessions.collect()}
    assert set(s) == {"s1", "two"}
    assert (s["s1"].repo, s["s1"].repo_path, s["s1"].branch, s["s1"].model, s["s1"].turn_count, s["s1"].tools_used) == ("main", "/w/main", "main", "m-1", 7, ["Read", "Bash"])
    assert (s["s1"].ts_start, s["s1"].ts_end, s["two"].ts_start, s["two"].repo) == ("2024-01-02T03:04:01Z", "2024-01-02T03:04:10Z", sessions.EPOCH, "unknown")


def test_rollout_lines(spark, tmp_path):
    home = tmp_path / "sessions"
    item = lambda role, *texts: {"type": "response_item", "timestamp": "2024-01-01T00:00:05Z", "payload": {"role": role, "content": [{"type": "input_text", "text": t} for t in texts] + [{"type": "image"}]}}
    write(home / "a" / "rollout-2024-x.jsonl", {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "c1", "cwd": "/x/y", "model_provider": "prov"}}, item("developer", " rules "), item("user", "a", "b"), item("user"), {"type": "event_msg"}, lines=True)
    write(home / "rollout-2024-1-2-3-4-5.jsonl", item("assistant", "z"), lines=True)
    write(home / "rollout-gone.jsonl", {"type": "session_meta", "payload": {"id": "moved"}}, item("user", "q"), lines=True)
    write(home / "rollout-kept.jsonl", {"type": "session_meta", "payload": {"id": "lost"}}, item("user", "q"), lines=True)
    write(tmp_path / "session_index.jsonl", {"id": "c1", "thread_name": "My title"}, lines=True)
    write(tmp_path / "external_agent_session_imports.json", {"records": [{"imported_thread_id": "moved", "source_path": "/there"}, {"imported_thread_id": "lost", "source_path": "/not/there"}]})
    got = sessions.read_sessions(spark, "codex", str(home), existing=spark.createDataFrame([("/there",)], "path string"))
    assert rows(got.turns.where("session_id = 'c1'"), "seq", "role", "text") == [(0, "assistant", "rules"), (1, "user", "a\nb")]
    s = {r.session_id: r for r in got.sessions.collect()}
    assert set(s) == {"c1", "1-2-3-4-5", "lost"} and (s["c1"].title, s["c1"].model, s["c1"].repo, s["c1"].ts_start, s["c1"].ts_end) == ("My title", "prov", "y", "2024-01-01T00:00:00Z", "2024-01-01T00:00:05Z")
    assert got.turns.where("session_id = 'moved'").count() == 0


def test_workspace_files(spark, tmp_path):
    folder = base64.urlsafe_b64encode(b"/home/u/proj").decode().rstrip("=")
    at = tmp_path / "workspace-sessions" / folder
    write(at / "k1.json", {"sessionId": "k1", "history": [{"message": {"role": "user", "content": [{"type": "text", "text": "a "}, "b", {"type": "image"}]}}, {"message": {"role": "kiro", "content": "c"}}, {"sender": "agent", "text": "d"}, {"message": {"content": "no role"}}]})
    write(at / "sessions.json", [{"sessionId": "k1", "title": "T", "dateCreated": "1704067200000"}])
    write(at / "bad.json", [1])
    got = sessions.read_sessions(spark, "kiro", str(tmp_path))
    assert rows(got.turns, "role", "text") == [("user", "a\nb"), ("assistant", "c"), ("assistant", "d")]
    s = got.sessions.first()
    assert (s.session_id, s.title, s.repo_path, s.repo, s.ts_start) == ("k1", "T", "/home/u/proj", "proj", "2024-01-01T00:00:00Z")
    assert {r.ts for r in got.turns.collect()} == {datetime(2024, 1, 1)}


def test_message_files(spark, tmp_path):
    messages = [{"role": "user", "content": "q"}, {"role": "assistant", "content": {"b": 1, "a": "é"}, "tool_calls": [{"function": {"name": "grep"}}]}, {"role": "odd", "content": {"tool": "sed"}}, {"role": "user", "content": None}]
    write(tmp_path / "session_1.json", {"session_id": "h1", "session_start": "2024-01-01T00:00:00Z", "model": "m", "messages": messages, "tools": [{"function": {"name": "awk"}}]})
    write(tmp_path / "session_cron_1.json", {"messages": messages})
    write(tmp_path / "deep" / "session_2.json", {"messages": messages})
    got = sessions.read_sessions(spark, "hermes", str(tmp_path))
    assert rows(got.turns, "role", "text", "tool_name") == [("user", "q", None), ("assistant", '{"a": "é", "b": 1}', "grep"), ("tool", '{"tool": "sed"}', "sed")]
    s = got.sessions.first()
    assert (s.session_id, s.tools_used, s.ts_start, s.ts_end, s.repo) == ("h1", ["awk", "grep", "sed"], "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "hermes")


def test_dialects(spark, tmp_path):
    with pytest.raises(ValueError):
        sessions.read_sessions(spark, "nobody", str(tmp_path))
    for agent in sessions.DIALECTS:
        got = sessions.read_sessions(spark, agent, str(tmp_path / "none"))
        assert got.sessions.count() == 0 and got.turns.count() == 0


def test_repositories(spark, tmp_path):
    (tmp_path / "r" / ".git").mkdir(parents=True)
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / ".git").write_text("gitdir: /main/one/.git/worktrees/t\n")
    cwds = spark.createDataFrame([(f"{tmp_path}/r/a/b",), (f"{tmp_path}/tree",), ("/else/where/",), (None,)], "cwd string")
    found = sessions.repositories(cwds)
    assert {r.path: r.target for r in found.collect()} == {f"{tmp_path}/r": f"{tmp_path}/r", f"{tmp_path}/tree": "/main/one"}
    got = {r.cwd: (r.repo, r.repo_path) for r in sessions.resolve_repo(cwds, found).collect()}
    assert got == {f"{tmp_path}/r/a/b": ("r", f"{tmp_path}/r"), f"{tmp_path}/tree": ("one", "/main/one"), "/else/where/": ("where", "/else/where"), None: ("unknown", "")}


def session_file(path, n, last="done", sid="s"):
    turn = lambda i: {"type": "user" if i % 2 == 0 else "assistant", "sessionId": sid, "timestamp": f"2024-01-01T00:{i:02}:00Z", "message": {"content": f"fix turn {i} AKIA{'A' * 16}" if i < n - 1 else last}}
    write(path, *[turn(i) for i in range(n)], lines=True)


def tables(spark):
    return spark.createDataFrame([], schema.MEMORIES), spark.createDataFrame([], schema.MANIFEST)


def test_sync_follows_files(spark, tmp_path):
    s = Segments(target_turns=4, min_turns=2, max_turns=5)
    session_file(tmp_path / "a.jsonl", 12, sid="a")
    session_file(tmp_path / "b.jsonl", 3, sid="b")

    def run(records, manifest, how=s, **more):
        read = sessions.read_sessions(spark, "claude_code", str(tmp_path))
        files = sync.file_state(spark, read.sessions.select(F.col("source_path").alias("path")))
        return sync.sync(read, records, manifest, files, NOW, how, **more)

    records, manifest, report = run(*tables(spark))
    one = report.first()
    segs = sync.stored_segments(records)
    n = segs.count()
    assert one.written == n >= 3 and one.updated == 0 and one.skipped == 0 and one.scanned == 2
    got = sync.shaped(records).where("session_id = 'a'").orderBy("segment_index").collect()
    assert [r.segment_index for r in got] == list(range(len(got))) and {r.segment_count for r in got} == {len(got)}
    assert got[0].title == "fix turn 0 [REDACTED:aws_key]" and got[0].summary.startswith("Asked: fix turn 0 [REDACTED:aws_key] Outcome: ") and got[0].kind == "fix" and got[0].collection == "claude-code"
    assert "AKIA" not in json.dumps([r.asDict() for r in records.drop("embedding").collect()], default=str)
    assert manifest.count() == 2 and sum(len(r.memory_ids) for r in manifest.collect()) == n

    again = run(records, manifest)
    assert (again[2].first().skipped, again[2].first().segments_written) == (2, 0) and again[0].count() == records.count()

    session_file(tmp_path / "a.jsonl", 4, sid="a")  # rewritten and shorter: one segment is left
    records3, manifest3, report3 = run(records, manifest)
    r = report3.first()
    assert r.skipped == 1 and r.scanned == 1
    live = sync.stored_segments(records3).where("not is_archived and session_id = 'a'").collect()
    assert [x.segment_index for x in live] == [0] and records3.count() == records.count()

    other = Segments(target_turns=3, min_turns=2, max_turns=5)  # other settings: all again
    assert run(records3, manifest3, other)[2].first().skipped == 0
    stats = {(r.by, r.name): (r.segments, r.sessions) for r in sync.history_stats(records3).collect()}
    assert stats[("all", "*")] == (2, 2) and stats[("collection", "claude-code")] == (2, 2)


def test_distiller_hook(spark, tmp_path):
    s = Segments(target_turns=4, min_turns=2, max_turns=5, prompt_chars=60)
    session_file(tmp_path / "a.jsonl", 12, sid="a")
    read = sessions.read_sessions(spark, "claude_code", str(tmp_path))

    def distiller(facts, turns, before):
        assert len(facts["transcript"]) <= 60 and facts["transcript"].startswith("[") and len(turns) > 1
        if facts["idx"] == 1:
            raise RuntimeError("no answer")
        return {"title": f"T{facts['idx']}", "summary": f"after {before!r} sk-{'k' * 24}", "kind": "docs", "outcome": "ok"}, f"ctx{facts['idx']}"

    p = sync.prepare(read, tables(spark)[0], s, distiller)
    out = {json.loads(r.metadata)["segment_index"]: (r.content, json.loads(r.metadata)) for r in p.rows.collect()}
    assert out[0][0] == "after '' [REDACTED:openai_sk]" and out[0][1]["title"] == "T0" and out[0][1]["distiller_version"] == 2 and out[0][1]["outcome"] == "ok"
    assert out[1][1]["distiller_version"] == 1 and out[1][0].startswith("Asked: ")
    assert "after ''" in out[2][0]
    assert (p.report.first().llm_calls, p.report.first().llm_fallbacks) == (len(out) - 1, 1)
    few = sync.prepare(read, tables(spark)[0], s, distiller, budget=1).report.first()
    assert (few.llm_calls, few.llm_fallbacks) == (1, len(out) - 1)
    none = sync.prepare(read, tables(spark)[0], s, distiller, only_since="2030-01-01").report.first()
    assert (none.llm_calls, none.llm_fallbacks) == (0, 0)


def test_history_search(spark):
    def rec(i, text, repo, day, kind="session_summary"):
        return (str(i), text, "episodic", "agent", json.dumps({"record_type": kind, "repo": repo, "session_id": f"s{i}", "segment_index": 2}), day)

    rows_ = [rec(1, "parser bug fixed", "r1", datetime(2024, 2, 20)), rec(2, "parser parser rewrite", "r2", datetime(2024, 2, 25)), rec(3, "parser old", "r1", datetime(2023, 1, 1)), rec(4, "parser undated", "r1", None), rec(5, "parser other", "r1", datetime(2024, 2, 26), "file")]
    from tessera.operators.records import new_records

    df = new_records(spark.createDataFrame(rows_, "id string, content string, category string, source string, metadata string, valid_from timestamp_ntz"), NOW)
    now = datetime(2024, 3, 1)
    got = lambda **k: {r.session_id for r in history.search(df, "parser", now, **k).collect()}
    assert got() == {"s1", "s2", "s3", "s4"} and got(repo="r1") == {"s1", "s3", "s4"} and got(since="30d") == {"s1", "s2", "s4"} and len(got(limit=2)) == 2
    assert history.search(df, "parser", now, repo="r2").first().segment_index == 2


def test_elide():
    lines = [f"[{'USER' if i % 5 == 0 else 'TOOL'}] {'x' * 40} {i}" for i in range(20)]
    roles = ["user" if i % 5 == 0 else "tool" for i in range(20)]
    assert history.elide(lines, roles, 10_000) == lines and history.elide([], [], 5) == []
    for most in (600, 300, 150, 60, 20):
        out = history.elide(lines, roles, most)
        assert len("\n".join(out)) <= most
        if most >= 150:
            assert out[0] == lines[0] and out[-1] == lines[-1] and any("turns elided" in x for x in out)
    assert all(x in history.elide(lines, roles, 600) for x in lines if x.startswith("[USER]"))


def test_gap_counts_parts_of_seconds(spark):
    t = [(1, 0, datetime(2024, 1, 1, 0, 0, 0, 600000), "user"), (1, 1, datetime(2024, 1, 1, 0, 45, 1, 0), "user"), (1, 2, datetime(2024, 1, 1, 1, 30, 1, 0), "user")]
    df = spark.createDataFrame(t, "session_id long, seq int, ts timestamp_ntz, role string")
    assert [r.segment for r in history.by_gap(df, 45).orderBy("seq").collect()] == [0, 1, 1]


def _ticks(spark, root, name):
    """A query and its SQL over three events: the second silence is over 45 minutes, but only 2700 seconds begin in it."""
    import duckdb

    from tessera import catalog

    at = ["2024-01-15 00:00:00.5", "2024-01-15 10:00:00.1", "2024-01-15 10:45:00.9", "2024-01-15 11:30:01.0"]
    df = spark.createDataFrame([(i, t, 2, "error" if i == 2 else "view", 0.0, "") for i, t in enumerate(at)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{root}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{root}/events.parquet/*.parquet'")
    res = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in res.description]
    want = sorted(res.fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(root)).select(*cols).collect()) == want and want
    return want


def test_segments_count_seconds_as_their_sql_does(spark, tmp_path):
    assert _ticks(spark, tmp_path, "segment_gap") == [(2, 0, 0, 0), (2, 1, 1, 2), (2, 2, 3, 3)]


def test_orphans_count_seconds_as_their_sql_does(spark, tmp_path):
    assert _ticks(spark, tmp_path, "orphan_sweep") == [(2, 1), (2, 2)]


def test_statistics_count_seconds_as_their_sql_does(spark, tmp_path):
    assert _ticks(spark, tmp_path, "history_stats") == [("*", 1, 3, "2024-01-15", "2024-01-15"), ("fix", 1, 1, "2024-01-15", "2024-01-15"), ("investigation", 1, 2, "2024-01-15", "2024-01-15")]


def test_logs_are_not_parsed_again_by_each_step_of_a_run(spark, monkeypatch):
    from tessera import catalog

    seen, real = [], sync.sync
    monkeypatch.setattr(sync, "sync", lambda read, *a, **how: seen.extend([*read.sessions.inputFiles(), *read.turns.inputFiles()]) or real(read, *a, **how))
    assert catalog.QUERIES["session_sync"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen and all(f.endswith(".parquet") for f in seen)
