"""Agents' session logs as tables of sessions and turns.

Every dialect is a plan: files are read whole, parsed as variants, and taken
apart with column expressions; what does not parse is passed over, never an
error. A session is keyed by its file until its id is known.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import base64url_text, strip, to_utc
from tessera.plans.shared import materialize

# The time of a session that has none.
EPOCH = "1970-01-01T00:00:00Z"
TURN_COLUMNS = ("session_id", "agent", "seq", "ts", "role", "text", "tool_name", "source_path")
SESSION_COLUMNS = ("session_id", "agent", "repo", "repo_path", "branch", "ts_start", "ts_end", "turn_count", "tools_used", "title", "source_path", "model")


@dataclass(frozen=True)
class Sessions:
    sessions: DataFrame
    turns: DataFrame


def _there(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(source_path, text) of the files under ``root`` whose name fits; none where there is no such folder."""
    if not _there(spark, root):
        return spark.createDataFrame([], "source_path string, text string")
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return f.select(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("source_path"), F.make_valid_utf8("value").alias("text"))


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def parsed(files: DataFrame) -> DataFrame:
    """(source_path, v) of files that are one JSON object."""
    f = files.select("source_path", F.try_parse_json("text").alias("v"))
    return f.where(is_kind(F.col("v"), "OBJECT"))


def parsed_lines(files: DataFrame) -> DataFrame:
    """(source_path, line, v) of every line that is a JSON object."""
    lines = files.select("source_path", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.select("source_path", "line", F.try_parse_json(strip(F.col("raw"))).alias("v")).where(is_kind(F.col("v"), "OBJECT"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def first(value: Column, order: Column, known: Column | None = None) -> Column:
    """The first value that is there and not empty."""
    good = value.isNotNull() & (value != "")
    good = good & known if known is not None else good
    return F.min_by(F.when(good, value), F.when(good, order))


def numbered(turns: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("source_path").orderBy(*order)
    return turns.withColumn("seq", (F.row_number().over(w) - 1).cast("int"))


def flat_text(c: Column, depth: int = 3) -> Column:
    """Text of a message's content: a string, or its text blocks and tool results in lines."""
    blocks = get(c, "$", "array<variant>")
    own = F.when(is_kind(c, "STRING"), get(c, "$")).otherwise("")
    if depth == 0:
        return own
    part = lambda b: F.when(get(b, "$.type") == "text", F.coalesce(get(b, "$.text"), F.lit(""))).when(get(b, "$.type") == "tool_result", flat_text(get(b, "$.content", "variant"), depth - 1))
    lines = F.filter(F.transform(blocks, part), lambda x: x.isNotNull() & (x != ""))
    return F.when(blocks.isNotNull(), F.array_join(lines, "\n")).otherwise(own)


_TURN = "struct<role:string,text:string,tool_name:string>"


def _turn(role: Column, text: Column, tool: Column | None = None) -> Column:
    return F.struct(role.alias("role"), text.alias("text"), (tool if tool is not None else F.lit(None).cast("string")).alias("tool_name"))


def _finish(agent: str, turns: DataFrame, sessions: DataFrame, repos: DataFrame | None) -> Sessions:
    """``turns`` by source_path; ``sessions`` (source_path, session_id, cwd or repo, ...) with what the dialect knows."""
    n = turns.groupBy("source_path").agg(F.count("*").cast("int").alias("turn_count"))
    s = sessions.join(n, "source_path")
    if "repo" not in s.columns:
        s = resolve_repo(s, repos)
    have = {"agent": F.lit(agent), "branch": F.lit(""), "title": F.lit(""), "model": F.lit(""), "tools_used": F.array().cast("array<string>")}
    s = s.withColumns({c: F.coalesce(F.col(c), v) if c in s.columns else v for c, v in have.items()})
    ids = s.select("source_path", "session_id")
    t = turns.join(ids, "source_path").withColumns({"agent": F.lit(agent), "ts": F.to_timestamp_ntz("ts", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))})
    t = t if "tool_name" in t.columns else t.withColumn("tool_name", F.lit(None).cast("string"))
    return Sessions(s.select(*SESSION_COLUMNS), t.select(*TURN_COLUMNS))


def block_lines(spark: SparkSession, root: str, repos: DataFrame | None = None) -> Sessions:
    """JSON lines, a file a session; a message's content is a string or blocks."""
    lines = parsed_lines(whole_files(spark, root, "*.jsonl"))
    lines = lines.where(~F.coalesce(get("v", "$.isSidechain", "boolean"), F.lit(False)))
    lines = lines.withColumn("type", get("v", "$.type")).withColumn("chat", F.col("type").isin("user", "assistant"))
    lines = lines.withColumn("message", get("v", "$.message", "variant")).withColumn("at", F.when(F.col("chat"), to_utc(get("v", "$.timestamp"))))
    said = F.col("chat") & is_kind(F.col("message"), "OBJECT")
    content = get("message", "$.content", "variant")
    blocks = get("message", "$.content", "array<variant>")

    def turn(b: Column) -> Column:
        kind, text, name = get(b, "$.type"), strip(F.coalesce(get(b, "$.text"), F.lit(""))), F.coalesce(get(b, "$.name"), F.lit(""))
        result = strip(flat_text(get(b, "$.content", "variant")))
        return (
            F.when((kind == "text") & (text != ""), _turn(F.col("type"), text))
            .when(kind == "tool_use", _turn(F.lit("tool"), F.concat(F.lit("tool_use:"), name), F.when(name != "", name)))
            .when(kind == "tool_result", _turn(F.lit("tool"), F.when(result == "", "(tool result)").otherwise(result)))
        )

    plain = strip(F.coalesce(get(content, "$"), F.lit("")))
    found = F.when(blocks.isNotNull(), F.filter(F.transform(blocks, turn), lambda t: t.isNotNull())).when(plain != "", F.array(_turn(F.col("type"), plain)))
    turns = lines.where(said).select("source_path", "line", F.col("at").alias("ts"), F.posexplode(found.cast(f"array<{_TURN}>")).alias("place", "t")).select("source_path", "line", "place", "ts", "t.*")
    turns = numbered(turns, "line", "place")
    at = F.col("line")
    s = lines.groupBy("source_path").agg(
        first(get("v", "$.sessionId"), at).alias("id"),
        first(get("v", "$.cwd"), at).alias("cwd"),
        first(get("v", "$.gitBranch"), at).alias("branch"),
        first(get("message", "$.model"), at, F.col("type") == "assistant").alias("model"),
        first(F.col("at"), at).alias("ts_start"),
        F.max_by("at", F.when(F.col("at").isNotNull(), at)).alias("ts_end"),
    )
    tools = turns.where("tool_name is not null").groupBy("source_path", "tool_name").agg(F.min("seq").alias("seq")).groupBy("source_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tool_name"))), lambda x: x["tool_name"]).alias("tools_used"))
    s = s.join(tools, "source_path", "left").withColumn("session_id", F.coalesce("id", stem(F.col("source_path"))))
    s = s.withColumns({"ts_start": F.coalesce("ts_start", F.lit(EPOCH)), "ts_end": F.coalesce("ts_end", "ts_start", F.lit(EPOCH))})
    return _finish("claude_code", turns, s, repos)


def rollout_lines(spark: SparkSession, root: str, repos: DataFrame | None = None, existing: DataFrame | None = None) -> Sessions:
    """JSON lines ``rollout-*``: a line about the session, then its items.

    Titles come from the index file beside ``root``, and sessions that its list
    of imports names are left out if the file they came from is one of
    ``existing`` (path), so that no session is lost or told twice.
    """
    lines = parsed_lines(whole_files(spark, root, "rollout-*.jsonl")).withColumns({"type": get("v", "$.type"), "at": to_utc(get("v", "$.timestamp")), "p": get("v", "$.payload", "variant")})
    meta = F.col("type") == "session_meta"
    parts = F.transform(get("p", "$.content", "array<variant>"), lambda b: F.when(get(b, "$.type").isin("input_text", "output_text"), strip(F.coalesce(get(b, "$.text"), F.lit("")))))
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")
    role = F.coalesce(get("p", "$.role"), F.lit(""))
    turns = lines.where("type = 'response_item'").select("source_path", "line", F.col("at").alias("ts"), F.when(role == "developer", "assistant").otherwise(role).alias("role"), text.alias("text")).where("text <> ''")
    turns = numbered(turns, "line")
    at = F.col("line")
    model = F.coalesce(F.nullif(get("p", "$.model"), F.lit("")), get("p", "$.model_provider"), F.lit(""))
    last = lambda v, good: F.max_by(F.when(good, v), F.when(good, at))
    known = lambda c: c.isNotNull() & (c != "")
    s = lines.groupBy("source_path").agg(
        last(get("p", "$.id"), meta & known(get("p", "$.id"))).alias("id"),
        last(get("p", "$.cwd"), meta & known(get("p", "$.cwd"))).alias("cwd"),
        last(model, meta).alias("model"),
        last(F.col("at"), meta & F.col("at").isNotNull()).alias("begun"),
    )
    times = turns.where("ts is not null").groupBy("source_path", "ts").agg(F.min("line").alias("l")).groupBy("source_path").agg(F.min_by("ts", "l").alias("t0"), F.max_by("ts", "l").alias("t1"))
    name = stem(F.col("source_path"))
    pieces = F.split(name, "-")
    by_name = F.when(F.size(pieces) >= 5, F.array_join(F.slice(pieces, -5, 5), "-")).otherwise(name)
    s = s.join(times, "source_path", "left").withColumn("session_id", F.coalesce("id", by_name))
    s = s.withColumns({"ts_start": F.coalesce("begun", "t0", F.lit(EPOCH)), "ts_end": F.coalesce("t1", "begun", F.lit(EPOCH))})
    home = os.path.dirname(root.rstrip("/"))
    index = parsed_lines(whole_files(spark, f"{home}/session_index.jsonl", "*"))
    titles = index.groupBy(get("v", "$.id").alias("session_id")).agg(F.max_by(F.coalesce(get("v", "$.thread_name"), F.lit("")), "line").alias("title"))
    s = s.join(titles, "session_id", "left").withColumn("title", F.when(F.col("id").isNotNull(), F.col("title")))
    if existing is not None:
        listed = whole_files(spark, f"{home}/external_agent_session_imports.json", "*").select(F.try_parse_json("text").alias("v"))
        records = F.coalesce(get("v", "$.records", "array<variant>"), get("v", "$", "array<variant>"))
        moved = listed.select(F.explode(records).alias("r")).select(get("r", "$.imported_thread_id").alias("session_id"), get("r", "$.source_path").alias("path"))
        s = s.join(moved.join(existing.select("path").distinct(), "path", "left_semi"), "session_id", "left_anti")
    return _finish("codex", turns.join(s.select("source_path"), "source_path", "left_semi"), s, repos)


def workspace_files(spark: SparkSession, root: str, repos: DataFrame | None = None) -> Sessions:
    """One JSON file a session, in folders named by the base64 of their workspace's path."""
    files = whole_files(spark, f"{root.rstrip('/')}/workspace-sessions", "*.json")
    files = files.where(F.size(F.split(F.element_at(F.split("source_path", "/workspace-sessions/"), -1), "/")) == 2)
    folder = F.regexp_extract("source_path", "([^/]+)/[^/]+$", 1)
    side = files.where("source_path like '%/sessions.json'").select(folder.alias("folder"), F.try_parse_json("text").alias("v"))
    listed = side.select("folder", F.explode(get("v", "$", "array<variant>")).alias("i")).select("folder", get("i", "$.sessionId").alias("key"), "i")
    mapped = side.select("folder", F.explode(get("v", "$", "map<string,variant>")).alias("key", "i"))
    told = listed.unionByName(mapped).where("key is not null and key <> ''").where(is_kind(F.col("i"), "OBJECT"))
    told = told.groupBy("folder", "key").agg(F.max(F.struct(F.coalesce(get("i", "$.title"), F.lit("")).alias("title"), to_utc(get("i", "$.dateCreated")).alias("date"))).alias("m")).select("folder", "key", F.col("m.title").alias("side_title"), "m.date")
    docs = parsed(files.where("source_path not like '%/sessions.json'")).withColumns({"folder": folder, "key": stem(F.col("source_path"))}).join(told, ["folder", "key"], "left")
    content = lambda m, i: F.coalesce(get(m, "$.content", "variant"), get(i, "$.text", "variant"))
    block = lambda b: F.when(F.coalesce(get(b, "$.type"), F.lit("")).isin("text", ""), strip(F.coalesce(get(b, "$.text"), get(b, "$.content"), F.when(is_kind(b, "STRING"), get(b, "$")), F.lit(""))))
    items = docs.select("source_path", "date", F.posexplode(get("v", "$.history", "array<variant>")).alias("line", "i")).where(is_kind(F.col("i"), "OBJECT"))
    items = items.withColumn("m", F.coalesce(get("i", "$.message", "variant"), F.col("i"))).where(is_kind(F.col("m"), "OBJECT")).withColumn("c", content("m", "i"))
    lines = F.filter(F.transform(get("c", "$", "array<variant>"), block), lambda x: x.isNotNull() & (x != ""))
    text = F.when(get("c", "$", "array<variant>").isNotNull(), F.array_join(lines, "\n")).when(is_kind(F.col("c"), "STRING"), strip(get("c", "$"))).otherwise("")
    role = F.coalesce(F.nullif(get("m", "$.role"), F.lit("")), get("i", "$.sender"), F.lit(""))
    turns = items.select("source_path", "line", F.col("date").alias("ts"), F.when(role.isin("agent", "kiro"), "assistant").otherwise(role).alias("role"), text.alias("text")).where("role <> '' and text <> ''")
    turns = numbered(turns, "line")
    some = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    s = docs.select(
        "source_path",
        some(get("v", "$.sessionId"), F.col("key")).alias("session_id"),
        some(get("v", "$.title"), F.col("side_title")).alias("title"),
        some(get("v", "$.workspacePath"), get("v", "$.workspaceDirectory"), base64url_text(F.col("folder"))).alias("cwd"),
        F.coalesce("date", F.lit(EPOCH)).alias("ts_start"),
    ).withColumn("ts_end", F.col("ts_start"))
    return _finish("kiro", turns, s, repos)


def _sorted_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False))

    return run(text)


def message_files(spark: SparkSession, root: str, repos: DataFrame | None = None) -> Sessions:
    """One JSON file ``session_*`` a session with a list of messages; those of background jobs are left out."""
    files = whole_files(spark, root, "session_*.json")
    files = files.where(~F.regexp_extract("source_path", "([^/]*)$", 1).startswith("session_cron_"))
    if _there(spark, root):  # this folder only
        depth = F.length(F.regexp_replace("source_path", "[^/]", ""))
        base = len(re.sub("[^/]", "", re.sub("^file:/+", "/", root.rstrip("/")))) + 1
        files = files.where(depth == base)
    docs = parsed(files)
    rows = docs.select("source_path", F.posexplode(get("v", "$.messages", "array<variant>")).alias("line", "m")).where(is_kind(F.col("m"), "OBJECT"))
    rows = rows.withColumn("c", get("m", "$.content", "variant")).withColumn("made", is_kind(F.col("c"), "OBJECT") | is_kind(F.col("c"), "ARRAY"))
    rows = rows.withColumn("json", _sorted_json(F.when(F.col("made"), F.to_json("c"))))
    text = strip(F.when(F.col("made"), F.col("json")).when(is_kind(F.col("c"), "STRING"), get("c", "$")).otherwise(""))
    role = F.coalesce(get("m", "$.role"), F.lit(""))
    called = F.when(role == "assistant", get("m", "$.tool_calls[0].function.name"))
    tool = F.coalesce(*[F.nullif(x, F.lit("")) for x in (called, get("c", "$.name"), get("c", "$.tool"))])
    turns = rows.select("source_path", "line", F.lit(None).cast("string").alias("ts"), F.when(role.isin("user", "assistant", "tool"), role).otherwise("tool").alias("role"), text.alias("text"), tool.alias("tool_name")).where("text <> ''")
    turns = numbered(turns, "line")
    top = docs.select("source_path", F.explode(get("v", "$.tools", "array<variant>")).alias("t")).select("source_path", get("t", "$.function.name").alias("tool_name"))
    tools = turns.select("source_path", "tool_name").unionByName(top).where("tool_name is not null and tool_name <> ''").groupBy("source_path").agg(F.sort_array(F.collect_set("tool_name")).alias("tools_used"))
    some = lambda path, other: F.coalesce(F.nullif(get("v", path), F.lit("")), other)
    start = some("$.session_start", F.lit(EPOCH))
    s = docs.select("source_path", some("$.session_id", stem(F.col("source_path"))).alias("session_id"), start.alias("ts_start"), some("$.last_updated", start).alias("ts_end"), F.coalesce(get("v", "$.model"), F.lit("")).alias("model"), F.lit("hermes").alias("repo"), F.lit("").alias("repo_path"))
    return _finish("hermes", turns, s.join(tools, "source_path", "left"), repos)


#: Every dialect by its agent's name.
DIALECTS: dict[str, Callable[..., Sessions]] = {"claude_code": block_lines, "codex": rollout_lines, "kiro": workspace_files, "hermes": message_files}


def read_sessions(spark: SparkSession, agent: str, root: str, **how) -> Sessions:
    """Sessions and turns of one agent's folder; an unknown agent is an error."""
    if agent not in DIALECTS:
        raise ValueError(f"no dialect {agent!r}; there are {', '.join(sorted(DIALECTS))}")
    return DIALECTS[agent](spark, root, **how)


def written(read: Sessions) -> Sessions:
    """``read`` as tables, so that what asks for it many times does not parse the logs many times."""
    return Sessions(materialize(read.sessions, "sessions"), materialize(read.turns, "turns"))


def repositories(rows: DataFrame) -> DataFrame:
    """(path, target) of the repositories at or above the folders of ``rows``
    (cwd): folders with a ``.git`` folder, or with a ``.git`` file that names
    the main one (target). The tasks look where they run, at each folder once."""
    parts = F.split(F.regexp_replace("cwd", "(?<=.)/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = rows.where("cwd like '/_%'").select(F.explode(above).alias("path")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path in b["path"]:
                mark = os.path.join(path, ".git")
                if os.path.isdir(mark):
                    found.append((path, path))
                elif os.path.isfile(mark):
                    with open(mark, errors="replace") as f:
                        named = re.match(r"gitdir:\s*(.+)", f.read().strip())
                    main = os.path.normpath(os.path.join(path, named[1].strip())) if named else path
                    found.append((path, re.sub(r"/[.]git(/.*)?$", "", main) if "/.git" in main else path))
            yield pd.DataFrame(found, columns=["path", "target"])

    return folders.mapInPandas(run, "path string, target string")


def resolve_repo(rows: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """``rows`` (cwd) with ``repo`` and ``repo_path``: the nearest repository of
    ``repos`` (path, target) at or above cwd, else cwd's own name; ``unknown`` without a cwd."""
    empty = F.col("cwd").isNull() | (F.col("cwd") == "")
    clean = F.regexp_replace("cwd", "(?<=.)/+$", "")
    base = rows.withColumn("_cwd", F.when(~empty, clean))
    if repos is not None:
        parts = F.split("_cwd", "/")
        above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"))))
        up = base.where("_cwd is not null").select("_cwd").distinct().select("_cwd", above.alias("a")).select("_cwd", "a.*")
        found = up.join(repos, "path").groupBy("_cwd").agg(F.max_by("target", "depth").alias("_root"))
        base = base.join(found, "_cwd", "left")
    else:
        base = base.withColumn("_root", F.lit(None).cast("string"))
    place = F.coalesce("_root", "_cwd")
    name = F.coalesce(F.nullif(F.regexp_extract(place, "([^/]*)$", 1), F.lit("")), F.lit("unknown"))
    return base.withColumns({"repo": name, "repo_path": F.coalesce(place, F.lit(""))}).drop("_cwd", "_root")
