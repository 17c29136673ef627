"""Keyword and substring ranking by BM25."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.shared import materialize, over_cores

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[tuple[str, bool]]:
    """(term, is prefix): words, those of three letters or more as prefixes; then joined neighbours of four or more."""
    words = re.findall(r"[A-Za-z0-9]+", query)
    out = [(w.lower(), len(w) >= 3) for w in words]
    out += [(j, True) for a, b in zip(words, words[1:], strict=False) if len(j := (a + b).lower()) >= 4]
    return list(dict.fromkeys(out))


def trigram_terms(query: str) -> list[str]:
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z0-9]+", query) if len(w) >= 3))


def tokens(content):
    return F.filter(F.split(F.lower(content), "[^a-z0-9]+"), lambda t: t != "")


def spread(content) -> Column:
    """The tokens of a text with one space between two."""
    return F.trim(F.regexp_replace(F.lower(content), "[^a-z0-9]+", " "))


def _places(text, piece: str) -> Column:
    """How often a piece stands in a text, without a regular expression; for pieces whose places cannot overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def word_counts(words, terms: list[tuple[str, bool]]) -> list[Column]:
    """Length in tokens, then the places of every term in ``spread`` words: whole tokens, or the beginnings of tokens."""
    wide = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    size = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)
    return [size, *[_places(wide, f" {t}" if pre else f" {t} ") for t, pre in terms]]


def trigram_counts(low, terms: list[str]) -> list[Column]:
    """Length in trigrams, then every term's places in a lower-case text, overlapping ones too."""
    apart = lambda t: all(t[:i] != t[-i:] for i in range(1, len(t)))
    return [F.greatest(F.length(low) - 2, F.lit(0)), *[_places(low, t) if apart(t) else F.regexp_count(low, F.lit(f"(?={re.escape(t)})")) for t in terms]]


def counted(records: DataFrame, words: list[tuple[str, bool]], grams: list[str], id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, dl, f0, ..., tl, g0, ...) of every record, written once: the one pass
    over the texts that the rankings need."""
    texts = over_cores(records.select(F.col(id_col).alias("id"), F.col(content).alias("_c")))
    rows = texts.select("id", spread(F.col("_c")).alias("_w"), F.lower("_c").alias("_l"))
    cells = [c.alias(n) for c, n in zip(word_counts(F.col("_w"), words), ["dl", *_names("f", words)], strict=True)] if words else []
    cells += [c.alias(n) for c, n in zip(trigram_counts(F.col("_l"), grams), ["tl", *_names("g", grams)], strict=True)] if grams else []
    return materialize(rows.select("id", *cells), "counts")


def _names(letter: str, terms: list) -> list[str]:
    return [f"{letter}{i}" for i in range(len(terms))]


def _score(rows: DataFrame, length: str, terms: list[str]) -> DataFrame:
    """BM25 of rows (id, length, a count a term). N, the average length and the
    document frequencies come from one aggregate over the same rows, whose
    single row is joined back; no posting is shuffled."""
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).where("false")
    stats = rows.agg(F.count("*").alias("_n"), F.avg(length).alias("_avg"), *[F.count_if(F.col(f) > 0).alias(f"_d{f}") for f in terms])
    any_hit = F.greatest(*[F.col(f) for f in terms], F.lit(0)) > 0
    hits = rows.where(any_hit).join(F.broadcast(stats))  # one row
    parts = F.lit(0.0)
    for name in terms:
        f, df = F.col(name).cast("double"), F.col(f"_d{name}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        parts = parts + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(length) / F.col("_avg")))).otherwise(0.0)
    return hits.select("id", F.round(parts, 6).alias("score"))


def both(records: DataFrame, query: str, id_col: str = "id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """The rankings by words and by substrings, from one pass over the texts."""
    words, grams = query_terms(query), trigram_terms(query)
    rows = counted(records, words, grams, id_col, content)
    return _score(rows, "dl", _names("f", words)), _score(rows, "tl", _names("g", grams))


def bm25(records: DataFrame, query: str, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, score) of every record with a term. Prefix terms count every token they begin."""
    terms = query_terms(query)
    rows = counted(records, terms, [], id_col, content) if terms else records.select(F.col(id_col).alias("id"))
    return _score(rows, "dl", _names("f", terms))


def trigram(records: DataFrame, query: str, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, score) by substrings: f counts overlapping places, the length is that of the trigrams."""
    terms = trigram_terms(query)
    rows = counted(records, [], terms, id_col, content) if terms else records.select(F.col(id_col).alias("id"))
    return _score(rows, "tl", _names("g", terms))


def top(scored: DataFrame, n: int, *, by: str = "score", ascending: bool = False) -> DataFrame:
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return scored.orderBy(order, "id").limit(n)


def pool(limit: int) -> int:
    return max(limit * 5, 50)
