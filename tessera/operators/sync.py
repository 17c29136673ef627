"""Session history: segments as records, kept in step with the files they come from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import redact
from tessera.operators.history import distil, elide, segments, signature, turns_of
from tessera.operators.records import meta, new_records
from tessera.operators.state import archive, upsert
from tessera.plans.shared import materialize
from tessera.settings import Segments
from tessera.sources.sessions import EPOCH, Sessions

# The collection of each agent's sessions, and the kind of record.
COLLECTIONS: dict[str, str] = {
    "claude_code": "claude-code",
    "codex": "codex",
    "kiro": "kiro",
    "hermes": "hermes",
}
RECORD_TYPE = "session_summary"
#: (summary as a dict, turns as dicts, context of the segment before) -> (title, summary, kind and outcome as a dict, context for the next).
Distiller = Callable[[dict[str, Any], list[dict[str, Any]], str], tuple[dict[str, str], str]]


def settings_signature(s: Segments = Segments()) -> str:
    gap = int(s.gap_minutes) if float(s.gap_minutes).is_integer() else s.gap_minutes
    return hashlib.sha256(f"{s.target_turns}|{s.min_turns}|{s.max_turns}|{gap}|{s.enabled}".encode()).hexdigest()[:16]


def segment_rows(read: Sessions, s: Segments = Segments(), version: int = 1) -> DataFrame:
    """Every segment with its session's cells, times, and the hash of what it was made from."""
    turns = read.turns.select("session_id", "seq", "ts", "role", "text", "tool_name")
    segs = segments(turns, s)
    told = turns_of(turns, segs)
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(EPOCH))
    g = told.groupBy("session_id", "idx").agg(
        F.min("seq").alias("turn_lo"),
        F.max("seq").alias("turn_hi"),
        iso(F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("seq")))).alias("seg_start"),
        iso(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("seq")))).alias("seg_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", redact(F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), "\n").alias("transcript"),
    )
    many = g.groupBy("session_id").agg(F.count("*").cast("int").alias("segment_count"), F.min_by("seg_start", "idx").alias("session_ts_start"), F.max_by("seg_end", "idx").alias("session_ts_end"))
    j = g.join(many, "session_id").join(read.sessions, "session_id")
    hashed = signature(version, F.coalesce("model", F.lit("")), F.col("transcript"), settings_signature(s))
    return j.select("*", F.concat_ws("#", "session_id", "idx").alias("segment_id"), hashed.alias("content_hash"), F.lit(settings_signature(s)).alias("seg_signature"), F.lit(version).alias("distiller_version")).drop("transcript")


def stored_segments(records: DataFrame) -> DataFrame:
    """(id, segment_id, session_id, segment_index, content_hash, distiller_version, seg_signature, is_archived) of the records that are segments."""
    r = records.where(meta("record_type") == RECORD_TYPE).where(meta("segment_id").isNotNull())
    return r.select("id", meta("segment_id").alias("segment_id"), meta("session_id").alias("session_id"), meta("segment_index").cast("int").alias("segment_index"), F.coalesce(meta("content_hash"), F.lit("")).alias("content_hash"), meta("distiller_version").cast("int").alias("distiller_version"), meta("seg_signature").alias("seg_signature"), "is_archived")


@dataclass(frozen=True)
class Prepared:
    rows: DataFrame  # records to write, with ``existing`` true for those that replace one
    counts: DataFrame  # (session_id, n): segments a session has now
    cached: DataFrame  # (segment_id, id): unchanged segments
    report: DataFrame  # (llm_calls, llm_fallbacks), one row


def prepare(read: Sessions, records: DataFrame, s: Segments = Segments(), distiller: Distiller | None = None, budget: int = 0, only_since: str | None = None) -> Prepared:
    """Segments of ``read`` that are new or changed, distilled; nothing is written.

    Without a distiller a segment's title, summary and kind come from its
    turns. With one, a session's segments go to it in order, each with what it
    said for the next; ``budget`` bounds how many sessions' segments may (0: no
    bound), ``only_since`` leaves older sessions out, and where it fails the
    plain way is taken. All text is redacted. ``facts["transcript"]`` is the
    segment's turns as text of at most ``s.prompt_chars``, with gaps marked.
    """
    rows = materialize(segment_rows(read, s, 2 if distiller else 1), "segments")
    if distiller and only_since:
        rows = rows.withColumn("distiller_version", F.when(F.col("session_ts_start") < only_since, 1).otherwise(F.col("distiller_version")))
    old = stored_segments(records).select("segment_id", F.col("id").alias("old_id"), F.col("content_hash").alias("old_hash"))
    known = rows.join(old, "segment_id", "left")
    fresh = known.where("old_hash is null or old_hash <> content_hash")
    cached = known.where("old_hash = content_hash").select("segment_id", F.col("old_id").alias("id"))
    turns = turns_of(read.turns.select("session_id", "seq", "ts", "role", "text", "tool_name"), rows.select("session_id", "idx", "turn_lo", "turn_hi")).join(fresh.select("session_id", "idx"), ["session_id", "idx"], "left_semi")
    plain = distil(turns, ["session_id", "idx"]).select("session_id", "idx", "title", "summary", "kind")
    tools = F.when(F.size("tools_used") > 0, F.concat(F.lit("tools: "), F.array_join(F.array_sort("tools_used"), ", ")))
    told = fresh.join(plain, ["session_id", "idx"])
    title = F.when(F.col("title_") != "", F.col("title_")).otherwise(F.substring(F.coalesce("session_title", F.lit("")), 1, 80))
    told = told.select(*[F.col(c) for c in fresh.columns if c != "title"], fresh["title"].alias("session_title"), plain["title"].alias("title_"), plain["summary"], plain["kind"]).withColumn("title", redact(title)).withColumn("summary", F.substring(F.concat_ws(" ", F.nullif(F.col("summary"), F.lit("")), tools), 1, 600)).withColumns({"outcome": F.lit(""), "used": F.lit(False), "failed": F.lit(False)})
    if distiller:
        told = _by_model(told, turns, distiller, budget, s.prompt_chars)
        version = F.when(F.col("used"), 2).otherwise(1)
        told = told.withColumn("distiller_version", version)
    content = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.lit("(no summary)"))
    names = F.coalesce(*[F.when(F.col("agent") == a, c) for a, c in COLLECTIONS.items()], F.col("agent"))
    envelope = {
        "record_type": F.lit(RECORD_TYPE), "collection": names, "agent": F.col("agent"), "repo": F.col("repo"), "repo_path": F.col("repo_path"), "branch": F.col("branch"), "kind": F.col("kind"),
        "session_id": F.col("session_id"), "ts_start": F.col("seg_start"), "ts_end": F.col("seg_end"), "turn_count": F.col("turn_hi") - F.col("turn_lo") + 1, "tools_used": F.col("tools_used"),
        "source_path": F.col("source_path"), "source_offset": F.lit(0), "model": F.col("model"), "distiller_version": F.col("distiller_version"), "segment_id": F.col("segment_id"), "segment_index": F.col("idx"),
        "segment_count": F.col("segment_count"), "turn_lo": F.col("turn_lo"), "turn_hi": F.col("turn_hi"), "title": F.col("title"), "outcome": F.col("outcome"),
        "session_ts_start": F.col("session_ts_start"), "session_ts_end": F.col("session_ts_end"), "content_hash": F.col("content_hash"), "seg_signature": F.col("seg_signature"),
    }
    own = F.concat(F.lit("seg-"), F.substring(F.sha2("segment_id", 256), 1, 24))
    out = told.select(
        F.coalesce("old_id", own).alias("id"), content.alias("content"), F.lit("episodic").alias("category"), F.lit("agent").alias("source"),
        F.try_to_timestamp("seg_start", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz").alias("valid_from"),
        F.to_json(F.struct(*[v.alias(k) for k, v in envelope.items()])).alias("metadata"), F.col("old_id").isNotNull().alias("existing"), "segment_id", "session_id", "used", "failed",
    )
    out = materialize(out, "prepared")
    counts = rows.select("session_id", F.col("segment_count").alias("n")).distinct()
    report = out.agg(F.count_if("used").alias("llm_calls"), F.count_if("failed").alias("llm_fallbacks"))
    return Prepared(out.drop("used", "failed"), counts, cached, report)


def _by_model(told: DataFrame, turns: DataFrame, distiller: Distiller, budget: int, most: int = 12000) -> DataFrame:
    """``told`` after the distiller: a session's segments in order, each session in one task."""
    given = told
    asked = F.col("distiller_version") == 2
    if budget:
        order = told.where(asked).select("session_id", "idx").orderBy("session_id", "idx").limit(budget).withColumn("_may", F.lit(True))
        given = told.join(order, ["session_id", "idx"], "left").withColumn("_may", F.coalesce("_may", F.lit(False)))
    else:
        given = told.withColumn("_may", asked)
    text = turns.groupBy("session_id", "idx").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "role", redact(F.coalesce("text", F.lit(""))).alias("text"))))).alias("_turns"))
    rows = given.join(text, ["session_id", "idx"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, before = pdf.sort_values("idx"), ""
        out = []
        for r in pdf.to_dict("records"):
            before = before if r["_may"] else ""
            got, used, failed = {}, False, bool(r["distiller_version"] == 2 and not r["_may"])
            if r["_may"]:
                try:
                    facts = {k: r[k] for k in ("session_id", "idx", "agent", "repo", "branch", "model", "title", "summary", "kind")}
                    said = json.loads(r["_turns"])
                    facts["transcript"] = "\n".join(elide([f"[{t['role'].upper()}] {t['text']}" for t in said], [t["role"] for t in said], most))
                    got, before = distiller(facts, said, before)
                    used = True
                except Exception:  # the plain way stands
                    failed, before = True, ""
            out.append((r["session_id"], r["idx"], got.get("title", r["title"]), got.get("summary", r["summary"]), got.get("kind", r["kind"]), got.get("outcome", ""), used, failed))
        return pd.DataFrame(out, columns=["session_id", "idx", "title", "summary", "kind", "outcome", "used", "failed"])

    cells = ["title", "summary", "kind", "outcome", "used", "failed"]
    made = rows.select("session_id", "idx", "agent", "repo", "branch", "model", "title", "summary", "kind", "distiller_version", "_may", "_turns").groupBy("session_id").applyInPandas(run, f"session_id {told.schema['session_id'].dataType.simpleString()}, idx int, title string, summary string, kind string, outcome string, used boolean, failed boolean")
    made = made.withColumns({c: redact(F.col(c)) for c in ("title", "summary", "outcome")})
    return told.drop(*cells).join(made, ["session_id", "idx"])


def commit(records: DataFrame, p: Prepared, now: str) -> tuple[DataFrame, DataFrame]:
    """(records, report) after the prepared segments: each replaces the record of
    its segment_id or is added, and segments past a session's last are archived."""
    cells = [c for c in p.rows.columns if c in records.columns]
    new = new_records(p.rows.select(*cells), now).select(*records.columns)
    after = upsert(records, new, "id")
    live = stored_segments(after).where("not is_archived").join(p.counts, "session_id").where("segment_index >= n")
    counts = p.rows.agg(F.count_if(~F.col("existing")).alias("written"), F.count_if("existing").alias("updated"))
    report = counts.join(p.cached.agg(F.count("*").alias("llm_cache_hits"))).join(p.report).withColumn("segments_written", F.col("written") + F.col("updated"))  # one row each
    return archive(after, live.select("id")), report


def unchanged(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (path, size, mtime, content_hash) that the manifest has just so; a hash that is not known on either side counts as equal."""
    m = manifest.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_t"), F.col("content_hash").alias("_h"))
    same = (F.col("_s") == F.col("size")) & (F.col("_t") == F.col("mtime")) & (F.col("_h").isNull() | F.col("content_hash").isNull() | (F.col("_h") == F.col("content_hash")))
    return files.join(m, "path").where(same).select(*files.columns)


def must_redistil(sessions: DataFrame, records: DataFrame, version: int, sig: str) -> DataFrame:
    """(session_id) of ``sessions`` without live segments, or with one of an older distiller or of other settings."""
    s = stored_segments(records).where("not is_archived")
    other = (F.coalesce("distiller_version", F.lit(0)) < version) | ~F.col("seg_signature").eqNullSafe(F.lit(sig))
    state = s.groupBy("session_id").agg(F.bool_or(other).alias("_old"))
    return sessions.select("session_id").distinct().join(state, "session_id", "left").where("_old is null or _old").select("session_id")


def file_state(spark, paths: DataFrame) -> DataFrame:
    """(path, size, mtime, content_hash) of files, read by the tasks that hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    h = hashlib.sha256()
                    with open(p, "rb") as f:
                        for part in iter(lambda: f.read(1 << 16), b""):
                            h.update(part)
                    st = os.stat(p)
                    rows.append((p, st.st_size, st.st_mtime, h.hexdigest()))
                except OSError:
                    rows.append((p, 0, 0.0, None))
            yield pd.DataFrame(rows, columns=["path", "size", "mtime", "content_hash"])

    return paths.select("path").distinct().mapInPandas(run, "path string, size long, mtime double, content_hash string")


def backfill(read: Sessions, records: DataFrame, manifest: DataFrame, files: DataFrame, now: str, s: Segments = Segments(), **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, manifest, report) after all of ``read``; ``files`` is the state of its source files, looked at once."""
    files = materialize(files, "files")
    p = prepare(read, records, s, **how)
    after, report = commit(records, p, now)
    after = materialize(after, "records")
    ids = stored_segments(after).where("not is_archived").join(read.sessions.select("session_id", F.col("source_path").alias("path"), "agent"), "session_id")
    ids = ids.groupBy("path").agg(F.first("agent").alias("collection"), F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("memory_ids"))
    seen = files.join(ids, "path").select("path", "collection", "size", "mtime", "content_hash", F.lit("content").alias("index_mode"), "memory_ids", F.lit(False).alias("online_only"), F.lit(now).cast("timestamp_ntz").alias("last_seen"))
    scanned = read.sessions.agg(F.count("*").alias("scanned"))
    return after, materialize(upsert(manifest, seen.select(*manifest.columns), "path"), "manifest"), materialize(report.join(scanned), "report")  # one row each


def sync(read: Sessions, records: DataFrame, manifest: DataFrame, files: DataFrame, now: str, s: Segments = Segments(), **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``backfill``, but sessions whose file is unchanged and whose segments
    are of this distiller and these settings are skipped (``skipped`` in the report)."""
    version, files = 2 if how.get("distiller") else 1, materialize(files, "files")
    again = must_redistil(read.sessions, records, version, settings_signature(s))
    same = unchanged(files, manifest).select(F.col("path").alias("source_path"))
    skip = materialize(read.sessions.join(same, "source_path", "left_semi").join(again, "session_id", "left_anti").select("session_id"), "skip")
    todo = Sessions(read.sessions.join(skip, "session_id", "left_anti"), read.turns.join(skip, "session_id", "left_anti"))
    after, manifest, report = backfill(todo, records, manifest, files, now, s, **how)
    return after, manifest, report.join(skip.agg(F.count("*").alias("skipped")))  # one row each


def shaped(records: DataFrame) -> DataFrame:
    """Segment records as rows of a report: 16 columns, blanks and zeros where a cell is missing."""
    text = lambda p: F.coalesce(meta(p), F.lit(""))
    num = lambda p, d: F.coalesce(meta(p).cast("int"), F.lit(d))
    cells: dict[str, Column] = {"date": F.coalesce(F.date_format("valid_from", "yyyy-MM-dd"), F.lit(""))}
    cells |= {c: text(c) for c in ("ts_start", "agent", "collection", "repo", "branch", "kind", "title")}
    cells |= {"summary": F.col("content"), "session_id": text("session_id"), "source_path": text("source_path")}
    cells |= {"segment_index": num("segment_index", 0), "segment_count": num("segment_count", 1), "turn_lo": num("turn_lo", 0), "turn_hi": num("turn_hi", 0), "outcome": text("outcome")}
    keep = [c for c in ("id", "valid_from") if c in records.columns]
    return records.select(*keep, *[v.alias(k) for k, v in cells.items()])


def history_stats(records: DataFrame) -> DataFrame:
    """(by, name, segments, sessions, earliest, latest): over all, by collection and by kind."""
    r = records.where("not is_archived").where(meta("record_type") == RECORD_TYPE)
    r = r.select(F.coalesce(meta("collection"), F.lit("unknown")).alias("collection"), F.coalesce(meta("kind"), F.lit("unknown")).alias("kind"), F.nullif(meta("session_id"), F.lit("")).alias("sid"), F.date_format("valid_from", "yyyy-MM-dd").alias("day"))
    keys = F.explode(F.array(*[F.struct(F.lit(b).alias("by"), n.alias("name")) for b, n in (("all", F.lit("*")), ("collection", F.col("collection")), ("kind", F.col("kind")))]))
    return r.select(keys.alias("k"), "sid", "day").groupBy("k.by", "k.name").agg(F.count("*").alias("segments"), F.count_distinct("sid").alias("sessions"), F.min("day").alias("earliest"), F.max("day").alias("latest"))
