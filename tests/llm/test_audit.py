"""The filter audit against a plain run of every order."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audit

LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, "short", "en"), (4, None, "en"), (5, "", None), (6, "x " * 200, "en"),
    (7, LONG.upper(), ""), (8, "A# " * 150, "de"), (9, "short", None), (None, "short", "de"), (10, "É|" * 60, "de"), (11, LONG + " €", "en"), (11, LONG + " *", "en"), (12, "a b\x1cc " * 100, "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (7, None, 1), (None, 1, 1), (99, 1, 1)]


def plain(rows, labels):
    """Documents go through the filters one after another."""
    lab = defaultdict(lambda: [0, 0])
    for k, q, t in labels:
        if k is not None:
            lab[k] = [max(lab[k][0], int(q == 1)), max(lab[k][1], int(t == 1))]
    docs = []
    for k, t, lang in rows:
        t = t or ""
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        bad = {f for f, yes in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t)), strict=True) if yes}
        small = -(10**20) if k is None else k
        if any((u or "") == t and (-(10**20) if j is None else j) < small for j, u, _ in rows):
            bad.add("E")
        docs.append((lang or "", bad, *(lab[k] if k is not None else (0, 0))))
    out, total = {}, defaultdict(int)
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            here = own
            for step, f in enumerate(order, 1):
                gone, rest = [d for d in here if f in d[1]], [d for d in here if f not in d[1]]
                out[part, order, step] = [len(rest), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] += len(gone)
                here = rest
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_against_a_plain_run(spark):
    docs = spark.createDataFrame([(*r, 1, "m") for r in ROWS], "doc_id long, text string, lang string, mask int, digest string").repartition(3)
    got = audit.interactions(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == plain(ROWS, LABELS)


def test_table():
    table = audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and len(set(audit.ORDERS)) == 120
    assert all(table[1 << i, j] == o.index(f) for i, f in enumerate("ABCDE") for j, o in enumerate(audit.ORDERS))


def test_empty_and_long(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    long = spark.createDataFrame([(1, "ab " * 1_000_000, "en"), (2, "ab " * 1_000_000, "en")], "doc_id long, text string, lang string")
    assert {(r.removed, r.redundant) for r in audit.interactions(long, labels).where("filter_order = 'BEACD' and step = 2").collect()} == {(0, 1)}


def test_many_parts(spark, monkeypatch):
    """Partial arrays that are told early add up all the same."""
    monkeypatch.setattr(audit, "MOST_PARTS", 2)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), (F.col("id") % 7).cast("string").alias("lang"))
    got = audit.interactions(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = got.where("filter_order = 'ABCDE' and step = 1").collect()
    assert sorted(r.part for r in rows) == [str(i) for i in range(7)] and sum(r.removed for r in rows) == 300 and got.count() == 4200


@pytest.mark.parametrize("text,mask", [("", 1), ("A", 5), ("$", 9), ("a " * 100, 2), ("é" * 9 + "A", 1), ("é" * 8 + "A", 5)])
def test_masks(text, mask):
    assert audit.failed(text.encode()) == mask and np.int32(mask) < 32
