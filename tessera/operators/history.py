"""Sessions: segments, summaries, timelines."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import kind, redact
from tessera.settings import Segments


def by_gap(turns: DataFrame, minutes: float, tick: int = 1) -> DataFrame:
    """Adds ``segment``: a new one after a silence longer than ``minutes``, by a
    clock that ticks every ``tick`` microseconds: 1,000,000 counts the seconds that begin in a silence."""
    w = Window.partitionBy("session_id").orderBy("seq")
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    at = at - F.pmod(at, F.lit(tick))
    micros = at - F.lag(at).over(w)
    return turns.withColumn("_new", (F.coalesce(micros, F.lit(0)) > minutes * 60_000_000).cast("int")).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def segments(turns: DataFrame, s: Segments = Segments()) -> DataFrame:
    """(session_id, idx, turn_lo, turn_hi): turns of a session, cut where it
    falls silent, at the user turn after ``target_turns``, and at
    ``max_turns``; a short last segment joins the one before; ``max_segments``
    folds the tail. A session of up to ``max_turns`` turns is one segment.

    The rules depend on where the last cut was, so a session is folded in
    order by one expression over its (seq, microseconds, role) triples.
    """
    item = F.struct("seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("role") == "user").alias("user"))
    t = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("ts"))
    if not s.enabled:
        whole = F.array(F.struct(F.lit(0).alias("lo"), (F.size("ts") - 1).alias("hi")))
        return _numbered(t.select("session_id", "ts", whole.alias("segs")))
    seg = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    start = F.struct(none.alias("out"), F.lit(0).alias("lo"), F.lit(0).alias("i"), F.lit(None).cast("long").alias("last"))

    def step(a: Column, x: Column) -> Column:
        n = a["i"] - a["lo"]
        silent = F.lit(False) if s.gap_minutes <= 0 else F.coalesce((n > 0) & (x["at"] - a["last"] > int(s.gap_minutes * 60_000_000)), F.lit(False))
        cut = silent | ((n >= s.target_turns) & x["user"])
        out = F.when(cut, F.concat(a["out"], F.array(seg(a["lo"], a["i"] - 1)))).otherwise(a["out"])
        lo = F.when(cut, a["i"]).otherwise(a["lo"])
        last = F.coalesce(x["at"], F.when(cut, F.lit(None).cast("long")).otherwise(a["last"]))
        full = a["i"] - lo + 1 >= s.max_turns
        return F.struct(F.when(full, F.concat(out, F.array(seg(lo, a["i"])))).otherwise(out).alias("out"), F.when(full, a["i"] + 1).otherwise(lo).alias("lo"), (a["i"] + 1).alias("i"), F.when(full, F.lit(None).cast("long")).otherwise(last).alias("last"))

    end = lambda a: F.when(a["lo"] < a["i"], F.concat(a["out"], F.array(seg(a["lo"], a["i"] - 1)))).otherwise(a["out"])
    segs = F.aggregate("ts", start, step, end)
    t = t.select("session_id", "ts", F.when(F.size("ts") <= s.max_turns, F.array(seg(F.lit(0), F.size("ts") - 1))).otherwise(segs).alias("segs"))
    n = F.size("segs")
    runt = (n >= 2) & (F.element_at("segs", -1)["hi"] - F.element_at("segs", -1)["lo"] + 1 < s.min_turns)
    joined = F.concat(F.slice("segs", F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(seg(F.get("segs", n - 2)["lo"], F.element_at("segs", -1)["hi"])))
    t = t.withColumn("segs", F.when(runt, joined).otherwise(F.col("segs")))
    if s.max_segments > 0:
        folded = F.concat(F.slice("segs", 1, s.max_segments - 1) if s.max_segments > 1 else none, F.array(seg(F.get("segs", F.lit(s.max_segments - 1))["lo"], F.element_at("segs", -1)["hi"])))
        t = t.withColumn("segs", F.when(n > s.max_segments, folded).otherwise(F.col("segs")))
    return _numbered(t)


def _numbered(t: DataFrame) -> DataFrame:
    at = lambda i: F.get("ts", i)["seq"]
    return t.select("session_id", "ts", F.posexplode("segs").alias("idx", "g")).select("session_id", "idx", at(F.col("g.lo")).alias("turn_lo"), at(F.col("g.hi")).alias("turn_hi"))


def turns_of(turns: DataFrame, segs: DataFrame) -> DataFrame:
    """Turns with the ``idx`` of their segment."""
    return turns.join(segs, "session_id").where("seq between turn_lo and turn_hi").drop("turn_lo", "turn_hi")


def distil(turns: DataFrame, keys: list[str], tools: str | None = None) -> DataFrame:
    """Per group: title, summary and kind from its first user turn, last
    assistant turn and tools, redacted before anything is cut. First and last
    come from min_by and max_by, which combine before the shuffle; blank turns do not count."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != ""
    user, bot = (F.col("role") == "user") & said, (F.col("role") == "assistant") & said
    aggs = [
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("seq"))).alias("asked"),
        F.max_by(F.when(bot, F.col("text")), F.when(bot, F.col("seq"))).alias("outcome"),
        F.count("*").alias("n_turns"),
    ]
    if tools:
        aggs.append(F.array_sort(F.collect_set(tools)).alias("tools"))
    g = turns.groupBy(*keys).agg(*aggs).withColumns({c: redact(F.col(c)) for c in ("asked", "outcome")})
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    title = F.substring(flat(F.regexp_extract(F.coalesce("asked", F.lit("")), r"^\s*([^\n]*)", 1)), 1, 80)
    parts = [F.when(F.col("asked").isNotNull(), F.concat(F.lit("Asked: "), F.substring(flat(F.col("asked")), 1, 200)))]
    parts.append(F.when(F.col("outcome").isNotNull(), F.concat(F.lit("Outcome: "), F.substring(flat(F.col("outcome")), 1, 300))))
    if tools:
        parts.append(F.when(F.size("tools") > 0, F.concat(F.lit("tools: "), F.array_join("tools", ", "))))
    summary = F.substring(F.concat_ws(" ", *parts), 1, 600)
    return g.select(*keys, "n_turns", title.alias("title"), summary.alias("summary"), kind(F.concat_ws(" ", "asked", "outcome")).alias("kind"))


def elide(lines: list[str], roles: list[str], most: int) -> list[str]:
    """A transcript of at most ``most`` characters, each gap marked. The first
    and the last line always stay (cut, if they alone are too long); others go
    from the middle outwards, and a user's lines only when all the rest is gone."""
    n = len(lines)
    if sum(map(len, lines)) + n - 1 <= most or not n:
        return list(lines)
    rest = sorted(range(1, n - 1), key=lambda i: (roles[i] == "user", abs(i - n // 2)))
    keep = set(range(n))

    def told() -> list[str]:
        out, last = [], -1
        for i in sorted(keep):
            if i - last > 1:
                out.append(f"… [{i - last - 1} turns elided] …")
            out.append(lines[i])
            last = i
        return out

    while rest and sum(map(len, t := told())) + len(t) - 1 > most:
        keep.discard(rest.pop(0))
    out = told()
    over = sum(map(len, out)) + len(out) - 1 - most
    if over > 0:  # two lines and a mark: the longer end gives way first
        for i in sorted({0, len(out) - 1}, key=lambda i: -len(out[i])):
            cut = min(over, len(out[i]))
            out[i], over = out[i][: len(out[i]) - cut], over - cut
    return out if over <= 0 else ["\n".join(out)[:most]]


def signature(version: int, model: Column, transcript: Column, settings: str = "") -> Column:
    """Hash that tells whether a segment must be distilled again."""
    return F.sha2(F.concat_ws("|", F.lit(str(version)), F.lit(settings), model, redact(transcript)), 256)


def orphans(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """Stored segments (session_id, segment_index) past the session's present number (session_id, n)."""
    return stored.join(counts, "session_id").where("segment_index >= n").drop("n")


def window(since: str | None, start: datetime | None, end: datetime | None, now: datetime) -> tuple[datetime, datetime]:
    """A time window: ``<n>d``, ``w``, ``m`` (30 days) or ``y`` (365), or two ends; 90 days if nothing is given."""
    if since and (start or end):
        raise ValueError("since excludes start and end")
    if since:
        m = re.fullmatch(r"(\d+)([dwmy])", since.strip())
        if not m:
            raise ValueError(f"not a window: {since!r}")
        return now - timedelta(days=int(m[1]) * {"d": 1, "w": 7, "m": 30, "y": 365}[m[2]]), now
    return (start or (end or now) - timedelta(days=90)).replace(tzinfo=None), (end or now).replace(tzinfo=None)


def timeline(rows: DataFrame, start: datetime, end: datetime, limit: int, grouped: bool = False) -> DataFrame:
    """Rows (valid_from, session_id, segment_index) in the window, both ends
    in, newest first; ``grouped`` puts a session's rows together where its
    first one stands, in order, and tells each its ``place`` there. ``limit`` is the report's length."""
    got = rows.where(F.col("valid_from").between(F.lit(start), F.lit(end))).orderBy(F.desc("valid_from"), "session_id", "segment_index").limit(limit)
    if not grouped:
        return got
    w = Window.orderBy(F.desc("valid_from"), "session_id", "segment_index")
    ranked = got.withColumn("_r", F.row_number().over(w))
    ranked = ranked.withColumn("_g", F.min("_r").over(Window.partitionBy("session_id")))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("_g", "segment_index"))).orderBy("place").drop("_r", "_g")


def search(records: DataFrame, query: str, now: datetime, repo: str | None = None, since: str | None = None, limit: int = 10, indexes=None) -> DataFrame:
    """The best segments for a query, in order (``place``), shaped for a report.

    The search knows nothing of repositories and dates, so more is fetched than
    asked for (up to 100) and cut afterwards; segments without a date pass ``since``."""
    from tessera.operators.records import meta
    from tessera.operators.search import search as ranked
    from tessera.operators.sync import RECORD_TYPE, shaped

    fetch = min(100, max(3 * limit, 100) if repo is not None or since is not None else 3 * limit)
    found = ranked(records, query, str(now), fetch, indexes=indexes)
    rows = found.join(records, "id").where(meta("record_type") == RECORD_TYPE)
    if repo is not None:
        rows = rows.where(F.coalesce(meta("repo"), F.lit("")) == repo)
    if since is not None:
        rows = rows.where(F.col("valid_from").isNull() | (F.col("valid_from") >= F.lit(window(since, None, None, now)[0]).cast("timestamp_ntz")))
    best = rows.orderBy(F.desc("score"), "id").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # at most ``limit`` rows
    order = best.select("id", place.alias("place"))
    return shaped(best).join(order, "id").orderBy("place")


def stats(rows: DataFrame) -> DataFrame:
    """Sessions, segments and the first and last day, over all and by kind."""
    aggs = F.count_distinct("session_id").alias("sessions"), F.count("*").alias("segments"), F.date_format(F.min("valid_from"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("valid_from"), "yyyy-MM-dd").alias("last_day")
    return rows.rollup("kind").agg(*aggs).withColumn("kind", F.coalesce("kind", F.lit("*")))
