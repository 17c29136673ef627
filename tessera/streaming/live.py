"""Segments of sessions as they grow, revised when turns come late, again or out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.settings import Segments

#: ``gone`` segments were told before and are no longer there.
REVISION = "session_id long, idx int, turn_lo int, turn_hi int, gone boolean"
Turn = tuple[int, int, bool]


def fold(turns: list[Turn], s: Segments) -> list[tuple[int, int]]:
    """(turn_lo, turn_hi) of a session's turns (seq, microseconds or -1, from the
    user) in order, by the rules of ``operators.history.segments``."""
    if not turns:
        return []
    if not s.enabled or len(turns) <= s.max_turns:
        return [(turns[0][0], turns[-1][0])]
    gap, cuts, lo, last = int(s.gap_minutes * 60_000_000), [], 0, -1
    for i, (_, at, user) in enumerate(turns):
        n = i - lo
        silent = gap > 0 and n > 0 and at >= 0 and last >= 0 and at - last > gap
        if silent or (n >= s.target_turns and user):
            cuts.append((lo, i - 1))
            lo, last = i, -1
        last = at if at >= 0 else last
        if i - lo + 1 >= s.max_turns:
            cuts.append((lo, i))
            lo, last = i + 1, -1
    if lo < len(turns):
        cuts.append((lo, len(turns) - 1))
    if len(cuts) > 1 and cuts[-1][1] - cuts[-1][0] + 1 < s.min_turns:
        cuts[-2:] = [(cuts[-2][0], cuts[-1][1])]
    if s.max_segments and len(cuts) > s.max_segments:
        cuts[s.max_segments - 1 :] = [(cuts[s.max_segments - 1][0], cuts[-1][1])]
    return [(turns[a][0], turns[b][0]) for a, b in cuts]


class _Session(StatefulProcessor):
    """A session's turns by their number, and what was told of it.

    A batch writes the turns it brings and no others. The timer, set past the
    last turn, forgets a session that has been idle so long; a turn that comes
    even later starts it again from what comes.
    """

    def __init__(self, s: Segments, idle_ms: int) -> None:
        self.s, self.idle_ms = s, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "seq int", "at long, user boolean")
        self.told = handle.getMapState("told", "idx int", "lo int, hi int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = -1
        for b in rows:
            for seq, ts, role in zip(b["seq"].tolist(), b["ts"].tolist(), b["role"].tolist(), strict=True):
                at = -1 if pd.isna(ts) else int(pd.Timestamp(ts).value // 1000)
                newest = max(newest, at)
                self.turns.updateValue((int(seq),), (at, role == "user"))  # a turn told again is the same turn
        turns = sorted((int(k[0]), int(v[0]), bool(v[1])) for k, v in self.turns.iterator())
        now = dict(enumerate(fold(turns, self.s)))
        before = {int(k[0]): (int(v[0]), int(v[1])) for k, v in self.told.iterator()}
        out = []
        for idx, (lo, hi) in now.items():
            if before.get(idx) != (lo, hi):
                self.told.updateValue((idx,), (lo, hi))
                out.append((key[0], idx, lo, hi, False))
        for idx in before.keys() - now.keys():
            self.told.removeKey((idx,))
            out.append((key[0], idx, *before[idx], True))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        last = max([at for _, at, _ in turns] + [0]) // 1000
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(sorted(out), columns=["session_id", "idx", "turn_lo", "turn_hi", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.told.clear()
        yield pd.DataFrame({"session_id": [], "idx": [], "turn_lo": [], "turn_hi": [], "gone": []})

    def close(self) -> None:
        """Nothing is held open."""


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keeps maps by entry; to be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_segments(turns: DataFrame, s: Segments = Segments(), lateness: str = "2 hours", idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """(session_id, idx, turn_lo, turn_hi, gone): revisions of the segments of a
    stream of turns (session_id long, seq, ts, role), told as soon as they follow
    from what has come. The last revision of each (session_id, idx) that is not
    ``gone`` is what ``history.segments`` gives for all turns so far, in whatever
    order, batch or number of copies they came, as long as a session was not
    forgotten. A turn before the watermark is dropped by Spark: set ``lateness`` to what is to be waited for."""
    use_rocksdb(turns.sparkSession)
    marked = turns.withWatermark("ts", lateness).select("session_id", "seq", "ts", "role")
    return marked.groupBy("session_id").transformWithStateInPandas(_Session(s, idle_ms), REVISION, "Update", "EventTime")
