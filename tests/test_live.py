"""Revisions of segments: shuffled, late and repeated turns end where the batch ends."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import history
from tessera.settings import Segments
from tessera.streaming import live

RULES = [Segments(target_turns=5, min_turns=3, max_turns=8, gap_minutes=30), Segments(target_turns=4, min_turns=2, max_turns=6, gap_minutes=0, max_segments=2), Segments(enabled=False)]
DDL = "session_id long, seq int, ts timestamp, role string"


def some_turns(sessions=5, seed=1):
    rng = random.Random(seed)
    rows = []
    for sid in range(sessions):
        at = datetime(2024, 1, 1, sid)
        for i in range(rng.choice([1, 5, 9, 20, 33])):
            at += timedelta(minutes=rng.choice([1, 2, 5, 45]))
            rows.append((sid, i * 2, at, rng.choice(["user", "assistant"])))
    return rows


@pytest.mark.parametrize("rule", range(3))
def test_fold_is_the_batch_fold(spark, rule):
    rows = [r for seed in range(6) for r in some_turns(5, seed) if r[0] >= 0]
    rows = [(s + 10 * seed, *r) for seed in range(6) for s, *r in some_turns(5, seed)]
    want = {tuple(r) for r in history.segments(spark.createDataFrame(rows, DDL).withColumn("ts", F.col("ts").cast("timestamp_ntz")), RULES[rule]).collect()}
    got = set()
    for sid in {r[0] for r in rows}:
        turns = sorted((q, int(t.timestamp() * 1_000_000), role == "user") for s, q, t, role in rows if s == sid)
        got |= {(sid, i, a, b) for i, (a, b) in enumerate(live.fold(turns, RULES[rule]))}
    assert got == want


def test_stream_ends_where_the_batch_ends(spark, tmp_path):
    """Turns in any order, some twice, some long after their neighbours; then more of the same sessions."""
    rng, rows, s = random.Random(2), some_turns(6, 3), RULES[0]
    late = [r for r in rows if rng.random() < 0.25]
    rest = [r for r in rows if r not in late]
    rng.shuffle(rest)
    batches = [rest[: len(rest) // 2], rest[len(rest) // 2 :] + rest[:5], late + late[:3]]
    for part in batches:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.live_segments(spark.readStream.schema(DDL).parquet(f"{tmp_path}/in"), s, lateness="30 days")
        told = []
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n, told=told: told.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(180)
        have = {} if part is batches[0] else have  # noqa: F821
        for r in told:
            if r.gone:
                have.pop((r.session_id, r.idx), None)
        have |= {(r.session_id, r.idx): (r.turn_lo, r.turn_hi) for r in told if not r.gone}
        so_far = spark.read.schema(DDL).parquet(f"{tmp_path}/in").distinct().withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        assert {(*k, *v) for k, v in have.items()} == {tuple(r) for r in history.segments(so_far, s).collect()}
