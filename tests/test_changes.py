"""Files and their changes as a data source."""

import os

import pytest

from tessera.sources import changes as C


def run(spark, root, tmp_path, name, **options):
    """One run of a stream to its end; what it told, by file name."""
    out = f"{tmp_path}/out-{name}"
    df = C.changes(spark, str(root), f"{tmp_path}/listings", **options)
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    return out


def told(spark, out, before=()):
    rows = spark.read.schema(C.SCHEMA).parquet(out).collect()
    return sorted((r.path.rsplit("/", 1)[1], r.event, None if r.content is None else bytes(r.content).decode()) for r in rows if r not in before), rows


def test_new_rewritten_and_deleted_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("one")
    (root / "sub" / "b.txt").write_text("two")
    (root / "c.bin").write_text("no")
    out = run(spark, root, tmp_path, "x", glob="*.txt", content="true")
    first, seen = told(spark, out)
    assert first == [("a.txt", "new", "one"), ("b.txt", "new", "two")]
    run(spark, root, tmp_path, "x", glob="*.txt", content="true")
    assert told(spark, out, seen)[0] == []
    (root / "a.txt").write_text("one more")  # rewritten, and no new file
    (root / "sub" / "b.txt").unlink()
    run(spark, root, tmp_path, "x", glob="*.txt", content="true")
    more, seen2 = told(spark, out, seen)
    assert more == [("a.txt", "changed", "one more"), ("b.txt", "gone", None)]
    os.utime(root / "a.txt", (1_700_000_000, 1_700_000_000))
    (root / "d.txt").write_text("")
    run(spark, root, tmp_path, "x", glob="*.txt", content="true")
    assert told(spark, out, seen2)[0] == [("a.txt", "changed", "one more"), ("d.txt", "new", "")]


def test_batch_and_groups(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"f{i}").write_text("x" * 1000)
    df = C.files(spark, str(tmp_path), group="11000", content="true")
    assert df.rdd.getNumPartitions() == 5 and df.where("length(content) = 1000 and event = 'new'").count() == 10
    assert C.files(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="state"):
        spark.readStream.format(C.NAME).load(str(tmp_path)).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck0").trigger(availableNow=True).start().awaitTermination(60)


def test_differences():
    old, new = {"a": (1, 1.0), "b": (2, 2.0), "c": (3, 3.0)}, {"a": (1, 1.0), "b": (2, 9.0), "d": (0, 0.0)}
    assert C.differences(old, new) == [("b", "changed", 2, 9.0), ("c", "gone", 3, 3.0), ("d", "new", 0, 0.0)] and C.differences(new, new) == []
    assert C.grouped([], 10) == [] and [len(g.files) for g in C.grouped([("p", "gone", 10**9, 0.0)] * 3, 10)] == [3]
