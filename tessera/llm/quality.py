"""Quality rules whose thresholds follow each language and source.

Every document is measured. Ratios of the documents that pass the base rules
go into mergeable quantile sketches, counts of logarithmic bins (relative
error ``gamma`` - 1), one per language, source and measure. A sketch is plain
rows, so partial sketches of one key are added up before the shuffle and
merged sketches of a language, or of all, are sums of its sources'. A
document is held against fences read from the finest sketch with at least
``least_rows`` documents: the upper one is p50 + width * spread, and at least
``slack`` above the median; the lower one for the measures with two sides
mirrors it. The spread is the distance of the upper quartile from the median,
but no more than twice that of the lower one, so junk on one side widens no
fence until it is half of a group. Where more is worse only, a fence is no
higher than the language's and that of all, so a source that is mostly junk
does not excuse itself; word lengths differ by nature and have no such bound.
"""

from __future__ import annotations

import math
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, shingles, with_measures
from tessera.plans.shared import materialize

SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Ratio: (numerator, denominator, least distance of a fence from the median, two-sided).
RATIOS: dict[str, tuple[str, str, float, bool]] = {
    "word_length": ("word_chars", "n_words", 0.5, True),
    "symbols": ("n_symbols", "n_words", 0.02, False),
    "dup_lines": ("n_dup_lines", "n_lines", 0.3, False),
    "repeats": ("n_repeat_words", "n_words", 0.3, False),
}
#: Languages times sources up to which their thresholds are broadcast; more are joined by shuffle.
MOST_GROUPS = 10_000
_SPACES = " \t\n\x0b\x0c\r"


def measure(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int, int]:
    """The counts of MEASURES of one whole text; zeros for a null one."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()  # bytes.split knows the six ASCII spaces only
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats, n = 0, len(words) - 2
    if n > 1:
        _, where, counts = np.unique(shingles(hashes.of(words), 3), return_inverse=True, return_counts=True)
        twice = counts[where] > 1
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[i : i + n] |= twice
        repeats = int(covered.sum())
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeats


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row`` beside the MEASURES of its text."""

    def make():
        hashes = WordHashes()
        return lambda texts: list(np.array([measure(t, hashes) for t in texts], np.int64).reshape(-1, 6).T)

    return with_measures(docs, MEASURES, make)


def ratio(name: str) -> Column:
    top, bottom, *_ = RATIOS[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def sketches(rows: DataFrame, gamma: float) -> DataFrame:
    """(lang, source, name, bin, n): bin 0 holds zeros, others values up to gamma**(bin - offset)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("name"), ratio(r).alias("x")) for r in RATIOS]))
    long = rows.select("lang", "source", pairs.alias("p")).select("lang", "source", "p.name", "p.x")
    step = F.ceil(F.log("x") / math.log(gamma)).cast("int")
    bin_ = F.when(F.col("x") <= 0, F.lit(None)).otherwise(step)
    return long.groupBy("lang", "source", "name", bin_.alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], gamma: float, at: tuple[float, ...]) -> DataFrame:
    """Per key and measure the quantiles ``q0``, ``q1``, ... of the merged sketch, and its rows."""
    merged = sketch.groupBy(*keys, "name", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "name").orderBy(F.col("bin").asc_nulls_first())
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2.0 * F.pow(F.lit(gamma), F.col("bin")) / (1.0 + gamma))
    run = merged.withColumn("upto", F.sum("n").over(w)).withColumn("rows", F.sum("n").over(Window.partitionBy(*keys, "name"))).withColumn("value", value)
    qs = [F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * q), F.col("value"))).alias(f"q{i}") for i, q in enumerate(at)]
    return run.groupBy(*keys, "name").agg(F.max("rows").alias("rows"), *qs)


def fences(q: str, width: float, slack: Column) -> tuple[Column, Column]:
    """The lower and the upper fence from the quartiles of the struct ``q``."""
    mid = F.col(f"{q}.q1")
    down, up = mid - F.col(f"{q}.q0"), F.col(f"{q}.q2") - mid
    return mid - F.greatest(width * F.least(down, 2 * up), slack), mid + F.greatest(width * F.least(up, 2 * down), slack)


def thresholds(rows: DataFrame, gamma: float = 1.01, width: float = 10.0, least_rows: int = 200) -> DataFrame:
    """(lang, source, then per ratio ``name_low`` and ``name_high``) for every language and source in ``rows``."""
    sketch = materialize(sketches(rows, gamma), "sketches")
    at = (0.25, 0.5, 0.75)
    fine, mid, whole = (quantiles(sketch, keys, gamma, at) for keys in (["lang", "source"], ["lang"], []))
    pick = lambda d, p: d.select(*[c for c in d.columns if c in ("lang", "source")], "name", F.struct("rows", "q0", "q1", "q2").alias(p))
    f, m, a = pick(fine, "f"), pick(mid, "m").withColumnRenamed("lang", "l2").withColumnRenamed("name", "n2"), pick(whole, "a").withColumnRenamed("name", "n3")
    j = f.join(m, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("name") == F.col("n2"))).join(a, F.col("name") == F.col("n3"))
    q = F.when(F.col("f.rows") >= least_rows, F.col("f")).when(F.col("m.rows") >= least_rows, F.col("m")).otherwise(F.col("a"))
    j = j.select("lang", "source", "name", "m", "a", q.alias("q"))
    slack, two = (F.coalesce(*[F.when(F.col("name") == r, F.lit(v[i])) for r, v in RATIOS.items()]) for i in (2, 3))
    low, own = fences("q", width, slack)
    mid_high = F.when(F.col("m.rows") >= least_rows, fences("m", width, slack)[1])
    high = F.when(two, own).otherwise(F.least(own, mid_high, fences("a", width, slack)[1]))  # least passes nulls over
    cols = [x for r in RATIOS for x in (F.max(F.when(F.col("name") == r, low)).alias(f"{r}_low"), F.max(F.when(F.col("name") == r, high)).alias(f"{r}_high"))]
    return j.groupBy("lang", "source").agg(*cols)


def judged(docs: DataFrame, least_words: int = 50, most_repeats: float = 0.5, **how) -> DataFrame:
    """Every row as ``row`` with its measures, ``base_failed`` and ``kept``.

    The documents are measured twice, once for the sketches and once for the
    verdicts, rather than written with their texts in between. ``docs`` needs text, lang and source; other columns pass unread. A null
    text has no words. Null languages and sources are groups of their own.
    An empty table gives an empty result.
    """
    rows = measured(docs)
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    seen = rows.where("not base_failed").select(F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *[c for c in rows.columns if c != "row"])
    limits = materialize(thresholds(seen, **how), "thresholds").select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct(*[f"{r}_{x}" for r in RATIOS for x in ("low", "high")]).alias("limits"))
    if limits.count() <= MOST_GROUPS:
        limits = F.broadcast(limits)
    j = rows.join(limits, F.col("row.lang").eqNullSafe(F.col("_l")) & F.col("row.source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    good = ~F.col("base_failed")
    for r, (_, _, _, two) in RATIOS.items():
        good &= F.coalesce(ratio(r) <= F.col(f"limits.{r}_high"), F.lit(False))
        if two:
            good &= F.coalesce(ratio(r) >= F.col(f"limits.{r}_low"), F.lit(False))
    return j.withColumn("kept", good)


def filter_quality(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were."""
    return judged(docs, **how).where("kept").select("row.*")
