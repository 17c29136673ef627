"""Models are asked once a question, whatever happens."""

import pytest

from tessera import schema
from tessera.operators import consolidate
from tessera.operators.answers import Answers
from tessera.operators.state import Snapshots


def counting(path, fail=()):
    """A hook that leaves a line a call; workers are other processes."""

    def hook(*args):
        what = args[0]["q"] if isinstance(args[0], dict) else args[0]
        with open(path, "a") as f:
            f.write(f"{what}\n")
        if what in fail:
            raise OSError("busy")
        return f"said of {what}"

    return hook


def calls(path):
    return sorted(path.read_text().split("\n")[:-1]) if path.exists() else []


def test_each_question_once(spark, tmp_path):
    log = tmp_path / "calls"
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(["a", "b", "a", None, "c"])], "id long, q string")
    got = Answers("m").ask(rows, ["q"], counting(log))
    assert {(r.id, r.answer) for r in got.collect()} == {(0, "said of a"), (1, "said of b"), (2, "said of a"), (3, "said of None"), (4, "said of c")}
    assert got.count() == 5 and calls(log) == ["None", "a", "b", "c"]
    assert Answers("m").ask(rows.where("false"), ["q"], counting(log)).count() == 0 and len(calls(log)) == 4


def test_a_later_run_asks_what_is_missing(spark, tmp_path):
    log, store = tmp_path / "calls", Snapshots(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(q,) for q in "abcdef"], "q string")
    got = Answers("m", "1", store, 2).ask(rows, ["q"], counting(log, "c"))
    assert {(r.q, r.error) for r in got.where("error is not null").collect()} == {("c", "OSError: busy")} and len(calls(log)) == 6
    again = Answers("m", "1", store, 2).ask(rows.union(spark.createDataFrame([("g",)], "q string")), ["q"], counting(log))
    assert again.where("answer is not null").count() == 7 and calls(log) == sorted("abcdef" + "cg")
    Answers("m", "2", store).ask(rows, ["q"], counting(log)).count()
    assert len(calls(log)) == 14  # another version is another question


def test_a_run_that_dies_keeps_what_was_paid_for(spark, tmp_path, monkeypatch):
    log, store = tmp_path / "calls", Snapshots(spark, f"file://{tmp_path}/s")
    rows = spark.range(40).selectExpr("cast(id as string) q")
    real, n = store.upsert, []

    def upsert(*args):
        n.append(1)
        if len(n) == 3:
            raise OSError("the driver dies")
        return real(*args)

    monkeypatch.setattr(store, "upsert", upsert)
    with pytest.raises(OSError):
        Answers("m", "1", store, 10).ask(rows, ["q"], counting(log))
    kept, before = store.read("answers_m").count(), len(calls(log))
    assert 0 < kept < before < 40
    assert Answers("m", "1", store, 10).ask(rows, ["q"], counting(log)).where("answer is not null").count() == 40
    assert len(calls(log)) == before + 40 - kept


def test_summaries_are_asked_for_once(spark, tmp_path):
    log, store = tmp_path / "calls", Snapshots(spark, f"file://{tmp_path}/s")
    contents = spark.createDataFrame([("x", 3, ["p", "q"]), ("y", 4, ["r"])], "concept string, memory_count long, contents array<string>")
    none = spark.createDataFrame([], schema.SUMMARIES)
    one = consolidate.generate_summaries(contents, none, counting(log), Answers("summarizer", store=store))
    ids = {r.concept: r.id for r in one.collect()}
    assert {r.concept: r.id for r in one.collect()} == ids and one.count() == 2 and calls(log) == ["x", "y"]
    two = consolidate.generate_summaries(contents, one, counting(log), Answers("summarizer", store=store))
    assert {r.concept: (r.id, r.summary_text) for r in two.collect()} == {c: (i, f"said of {c}") for c, i in ids.items()} and calls(log) == ["x", "y"]
