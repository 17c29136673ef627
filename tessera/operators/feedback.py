"""Feedback and session transitions: each takes tables and gives new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import raised
from tessera.settings import Scoring


def apply_feedback(records: DataFrame, feedback: DataFrame, s: Scoring = Scoring()) -> DataFrame:
    """``feedback`` (id, useful, stale: number of events). A useful event raises
    usefulness and reinforcement; a stale one raises staleness, or flags a
    note instead; is_stale follows staleness. Untouched records stay."""
    f = feedback.groupBy("id").agg(F.sum("useful").alias("_u"), F.sum("stale").alias("_s"))
    j = records.join(f, "id", "left")
    u, t = F.coalesce("_u", F.lit(0)), F.coalesce("_s", F.lit(0))
    stale = F.when(F.col("is_note"), F.col("staleness_score")).otherwise(raised(F.col("staleness_score"), s.stale_step * t, s.cap))
    new = {
        "usefulness_score": raised(F.col("usefulness_score"), s.useful_step * u, s.cap),
        "is_stale": F.when(F.col("_u").isNull() & F.col("_s").isNull(), F.col("is_stale")).otherwise(stale >= s.stale_at),
        "flagged_for_review": F.col("flagged_for_review") | (F.col("is_note") & (t > 0)),
        "staleness_score": stale,
    }
    if "reinforcement_count" in records.columns:
        new["reinforcement_count"] = F.col("reinforcement_count") + u.cast("int")
    return j.withColumns(new).select(*records.columns)


def missing(records: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback for records that are not there, an error to its sender."""
    return feedback.select("id").distinct().join(records.select("id"), "id", "left_anti")


def touch(records: DataFrame, returned: DataFrame, now: str) -> DataFrame:
    """The transition that search leaves to its caller: retrieval counters and last access of the returned ids."""
    j = records.join(returned.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return j.withColumns({"retrieval_count": F.col("retrieval_count") + hit.cast("int"), "last_accessed_at": F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_accessed_at"))}).select(*records.columns)


def session_feedback(session: DataFrame, results: DataFrame, useful: list[str], stale: list[str], rating: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A session's one-time feedback: (session, results, events for ``apply_feedback``).

    An unknown or concluded session is an error; an id in both lists counts for both."""
    row = session.head(1)
    if not row:
        raise KeyError("no such session")
    if row[0]["concluded"]:
        raise ValueError("the session is concluded")
    ids = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    done = session.withColumns({"useful_ids": ids(useful), "stale_ids": ids(stale), "confidence_rating": F.lit(rating).cast("int"), "concluded": F.lit(True)})
    in_list: Column = F.col("memory_id").isin(*useful) if useful else F.lit(False)
    in_stale: Column = F.col("memory_id").isin(*stale) if stale else F.lit(False)
    marked = results.withColumns({"was_useful": F.col("was_useful") | in_list, "was_stale": F.col("was_stale") | in_stale, "was_accessed": F.col("was_accessed") | in_list | in_stale})
    events = session.sparkSession.createDataFrame([(i, int(i in useful), int(i in stale)) for i in dict.fromkeys([*useful, *stale])], "id string, useful int, stale int")
    return done, marked, events


def feedback_prompt(results: DataFrame, records: DataFrame, template: str = "{memories}\n\n{answer}", answer: str = "") -> DataFrame:
    """(session_id, prompt): what a session returned, a line ``id :: content`` each, in the caller's template. A page of results is one short list."""
    rows = results.join(records.select(F.col("id").cast("string").alias("memory_id"), "content"), "memory_id")
    lines = F.array_sort(F.collect_list(F.struct((-F.col("relevance_score")).alias("s"), "memory_id", F.concat_ws(" :: ", "memory_id", "content").alias("line"))))
    told = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    text = F.replace(F.replace(F.lit(template), F.lit("{answer}"), F.lit(answer)), F.lit("{memories}"), F.col("told"))
    return rows.groupBy("session_id").agg(told.alias("told")).select("session_id", text.alias("prompt"))
