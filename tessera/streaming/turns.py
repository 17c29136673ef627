"""Streams of turns: segments as they close, counts by time, late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.settings import Segments

SEGMENT = "session_id long, idx int, turn_lo int, turn_hi int"
#: What a session keeps: its last sealed segment, and the open turns (at most max_turns of each).
STATE = "idx int, total int, held_lo int, held_hi int, seqs array<int>, times array<long>, users array<boolean>"


def gap_sessions(turns: DataFrame, minutes: int = 45, lateness: str = "2 hours") -> DataFrame:
    """(session_id, start, end, n) of spells without a silence over ``minutes``, where only that rule counts."""
    spell = F.session_window("ts", f"{minutes} minutes")
    return turns.withWatermark("ts", lateness).groupBy("session_id", spell).agg(F.count("*").alias("n")).select("session_id", "session_window.start", "session_window.end", "n")


def segment_stream(turns: DataFrame, s: Segments = Segments(), lateness: str = "2 hours", idle_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """(session_id, idx, turn_lo, turn_hi) of ``history.segments``, each when it
    is final: turns (session_id long, seq, ts, role) come in, a segment goes out
    once the next one is sealed, and the rest when a session was idle for
    ``idle_ms`` of event time past the watermark.

    The state of a session is its open turns and one sealed segment, which
    waits because a short last one joins it. ``max_segments`` folds the tail
    into a segment that only ends with the session.
    """
    gap = int(s.gap_minutes * 60_000_000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            idx, total, lo, hi, seqs, times, users = state.get
            held, open_ = ((lo, hi) if lo >= 0 else None), list(zip(seqs, times, users, strict=True))
        else:
            idx, total, held, open_ = 0, 0, None, []
        out: list[tuple[int, int, int, int]] = []

        def seal(a: int, b: int) -> None:
            nonlocal held, idx
            if held is not None and s.max_segments and idx + 1 >= s.max_segments:
                held = (held[0], b)  # the tail folds
                return
            if held is not None:
                out.append((key[0], idx, *held))
                idx += 1
            held = (a, b)

        def fold(turn: tuple[int, int, bool], window: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
            last = next((t for _, t, _ in reversed(window) if t >= 0), -1)
            silent = gap > 0 and window and last >= 0 and turn[1] >= 0 and turn[1] - last > gap
            if silent or (len(window) >= s.target_turns and turn[2]):
                seal(window[0][0], window[-1][0])
                window = []
            window = [*window, turn]
            if len(window) >= s.max_turns:
                seal(window[0][0], window[-1][0])
                window = []
            return window

        if state.hasTimedOut:
            if total > s.max_turns and s.enabled:
                if open_:
                    if held is not None and len(open_) < s.min_turns:
                        held = (held[0], open_[-1][0])
                    else:
                        seal(open_[0][0], open_[-1][0])
            elif open_:
                held = (open_[0][0], open_[-1][0])
            if held is not None:
                out.append((key[0], idx, *held))
            state.remove()
        else:
            for b in batches:
                micros = b["ts"].map(lambda t: -1 if pd.isna(t) else int(pd.Timestamp(t).value // 1000))
                for seq, at, role in sorted(zip(b["seq"].tolist(), micros.tolist(), b["role"].tolist(), strict=True)):
                    turn = (int(seq), int(at), role == "user")
                    total += 1
                    if not s.enabled:
                        open_ = [open_[0] if open_ else turn, turn]
                    elif total <= s.max_turns:
                        open_.append(turn)
                    elif total == s.max_turns + 1:  # too long for one segment: now the rules count, from the start
                        first, open_ = [*open_, turn], []
                        for t in first:
                            open_ = fold(t, open_)
                    else:
                        open_ = fold(turn, open_)
            a, z = held if held is not None else (-1, -1)
            state.update((idx, total, a, z, [x for x, _, _ in open_], [x for _, x, _ in open_], [x for _, _, x in open_]))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), max((t // 1000 for _, t, _ in open_), default=0), 0) + idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "idx", "turn_lo", "turn_hi"])

    marked = turns.withWatermark("ts", lateness).select("session_id", "seq", "ts", "role")
    return marked.groupBy("session_id").applyInPandasWithState(run, SEGMENT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counts(events: DataFrame, size: str = "6 hours", step: str | None = None, lateness: str = "2 hours", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(start, keys..., n) in tumbling windows, or sliding ones with a ``step``; later rows than the watermark are dropped by Spark."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    return events.withWatermark("ts", lateness).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def split_late(turns: DataFrame, closed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, sessions to do again): turns that belong to the part
    of a session that ``closed`` (session_id, turn_hi) has as final are late;
    their sessions (session_id) are read and distilled again as a whole, and
    the orphan sweep takes what that leaves over."""
    last = closed.groupBy("session_id").agg(F.max("turn_hi").alias("_hi"))
    j = turns.join(last, "session_id", "left")
    late = F.col("_hi").isNotNull() & (F.col("seq") <= F.col("_hi"))
    return j.where(~late).drop("_hi"), j.where(late).select("session_id").distinct()
