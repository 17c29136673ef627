"""Versions of all tables at once: crashes at every step, changed buckets only, other writers."""

import os
import re

import pytest

from tessera.operators import state


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, v string")


def contents(store, name="records"):
    df = store.read(name)
    return None if df is None else sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return state.Snapshots(spark, f"file://{tmp_path}/s", buckets=8)


def test_a_version_is_all_tables(spark, store):
    assert store.version() == 0 and store.read("records") is None
    assert store.commit({"records": rows(spark, ("a", "1")), "manifest": spark.createDataFrame([("p", "c")], "path string, collection string")}) == 1
    assert store.commit({"records": rows(spark, ("a", "2"), ("b", None))}) == 2
    assert contents(store) == [("a", "2"), ("b", None)] and store.read("manifest").count() == 1
    assert sorted(map(tuple, store.read("records", version=1).collect())) == [("a", "1")]
    assert store.commit({"records": store.read("records")}) == 2  # nothing differs, nothing is written


STEPS = ["_put", "_digests", "_publish", "create", "rename"]


@pytest.mark.parametrize("step", STEPS)
def test_a_crash_leaves_the_old_state(spark, store, monkeypatch, step):
    store.commit({"records": rows(spark, ("a", "1"), ("b", "1")), "links": rows(spark, ("x", "1"))})
    before = contents(store), contents(store, "links")

    def die(*_, **__):
        raise OSError("the writer dies")

    with monkeypatch.context() as m:
        if step in ("create", "rename"):
            real = store._publish

            def publish(number, body):
                if step == "create":  # a part of the draft is on the disk
                    out = store._fs().create(store._path("_versions", ".draft-x"), False)
                    out.write(body[:10].encode())
                    out.close()
                die()

            assert real
            m.setattr(store, "_publish", publish)
        else:
            m.setattr(store, step, die)
        with pytest.raises(OSError):
            store.commit({"records": rows(spark, ("a", "2")), "links": rows(spark, ("y", "2"))})
    assert store.version() == 1 and (contents(store), contents(store, "links")) == before
    again = state.Snapshots(spark, store.root, buckets=8)
    assert again.commit({"records": rows(spark, ("a", "3")), "links": rows(spark, ("y", "3"))}) == 2
    assert contents(again) == [("a", "3")] and contents(again, "links") == [("y", "3")]


def test_only_changed_buckets_are_written(spark, store):
    n = 200
    base = spark.range(n).selectExpr("cast(id as string) id", "'x' v")
    store.commit({"records": base})
    parts = store._state()[1]["records"]["parts"]
    assert len(parts) == 8
    store.commit({"records": base.selectExpr("id", "if(id = '7', 'new', v) v")})
    after = store._state()[1]["records"]["parts"]
    assert sum(parts[b] != after[b] for b in parts) == 1 and store.read("records").where("v = 'new'").count() == 1 and store.read("records").count() == n
    store.upsert("records", rows(spark, ("7", "newer"), ("9999", "added")), "id")
    last = store._state()[1]["records"]["parts"]
    assert 1 <= sum(after[b] != last.get(b) for b in after) <= 2
    got = dict(contents(store))
    assert len(got) == n + 1 and got["7"] == "newer" and got["9999"] == "added"
    store.commit({"records": store.read("records").where("false")})
    assert contents(store) == [] and store.read("records").columns == ["id", "v"]


def test_another_writer_is_noticed(spark, store):
    store.commit({"records": rows(spark, ("a", "1"))})
    other = state.Snapshots(spark, store.root, buckets=8)
    number, body = store._state()
    other.commit({"records": rows(spark, ("a", "2"))})
    with pytest.raises(state.Conflict):
        store._publish(number + 1, str(body))
    assert contents(store) == [("a", "2")] and not [x for x in store._names("_versions") if not re.fullmatch(r"\d+|\..*\.crc", x)]


def test_nested_and_odd_columns(spark, store):
    df = spark.sql("select 'a' id, map('k', 1) m, named_struct('x', array(1, 2)) s, cast(null as binary) b, timestamp_ntz'2024-01-01' t")
    store.commit({"records": df})
    assert store.commit({"records": df}) == 1
    assert store.commit({"records": df.selectExpr("id", "map('k', 2) m", "s", "b", "t")}) == 2 and store.read("records").first().m == {"k": 2}


def test_vacuum(spark, store):
    for i in range(4):
        store.commit({"records": rows(spark, ("a", str(i)))})
    assert store.vacuum(keep=1) == 3 and store.versions() == [4] and contents(store) == [("a", "3")]


def test_guard(spark, tmp_path):
    (tmp_path / "s").mkdir()
    os.symlink(tmp_path / "s", tmp_path / "link")
    for root in ("s", "s/", "./s", "x/../s", "link", "s/inner", "."):
        with pytest.raises(ValueError):
            state.Snapshots(spark, f"{tmp_path}/{root}", forbidden=(f"file://{tmp_path}/s",))
    state.Snapshots(spark, f"{tmp_path}/s2", forbidden=(f"{tmp_path}/s",))
