"""New contents against a store."""

import pytest

from tessera.operators.dedup import Contents
from tessera.operators.state import Snapshots


def test_fresh_contents(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s", buckets=8)
    known = Contents(store, bits=16)
    df = lambda *rows: spark.createDataFrame(rows, "id long, content string, digest string, _maybe int").select("id", "content")
    one = known.fresh(df((3, "a", "", 0), (1, "a", "", 0), (2, None, "", 0), (5, "", "", 0), (5, "", "", 0)))
    assert sorted((r.id, r.content) for r in one.collect()) == [(1, "a"), (2, None), (5, "")]
    known.add(one)
    again = known.fresh(df((9, "a", "", 0), (8, None, "", 0), (7, "b", "", 0), (6, "b", "", 0)))
    assert [(r.id, r.content) for r in again.collect()] == [(6, "b")]
    assert known.fresh(df().where("false")).count() == 0
    with pytest.raises(ValueError):
        Contents(store, bits=40)


def test_a_full_filter_mistakes_nothing(spark, tmp_path):
    """More contents than bits: every new one is looked up, and found to be new."""
    known = Contents(Snapshots(spark, f"file://{tmp_path}/s", buckets=4), bits=16)
    old = spark.range(40_000).selectExpr("id", "concat('old ', id) content")
    known.add(known.fresh(old))
    assert known._bitmap().all() or (known._bitmap() > 0).mean() > 0.9
    batch = spark.range(500).selectExpr("id", "concat(if(id % 2 = 0, 'new ', 'old '), id) content")
    got = known.fresh(batch)
    assert {r.id for r in got.collect()} == set(range(0, 500, 2))
    known.add(got)
    assert known.fresh(batch).count() == 0
