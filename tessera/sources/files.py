"""Directory trees: listing, state against a manifest, records."""

from __future__ import annotations

import os
import re
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import CONVERTIBLE_SUFFIXES, TEXT_SUFFIXES, clean_markdown, human_size, suffix, type_label

# File names that carry no knowledge.
SKIP = (".DS_Store", "Thumbs.db", "Icon", "Icon\r")


def glob_regex(glob: str) -> str:
    out = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
    return f"(?s)^{out}$"


def matches(name: Column, rel: Column, globs: list[str]) -> Column:
    """Whether the name or the path fits one of the globs."""
    if not globs:
        return F.lit(False)
    r = "|".join(glob_regex(g) for g in globs)
    return name.rlike(r) | rel.rlike(r)


def listing(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, rel, folder, name, size, mtime) of the files under ``root``; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    rel = F.regexp_extract("path", re.escape(root.rstrip("/").split("://")[-1]) + "/(.*)$", 1)
    f = f.select("path", rel.alias("rel"), F.regexp_extract(rel, "^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.regexp_extract(rel, "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))
    f = f.where(~F.col("name").isin(*SKIP))
    f = f.where(matches(F.col("name"), F.col("rel"), include)) if include else f
    if exclude:
        parts = F.split("rel", "/")
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        f = f.where(~F.exists(ends, lambda p: matches(F.regexp_extract(p, "([^/]*)$", 1), p, exclude)))
    return f


def expand(spark: SparkSession, paths: list[str], globs: list[str]) -> DataFrame:
    """(path) of files: the given ones, and those in given folders whose name
    fits a glob; each once. A path that is not there is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    out = None
    for p in paths:
        at = hadoop(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(p)
        if fs.getFileStatus(at).isDirectory():
            got = listing(spark, p)
            got = got.where(matches(F.col("name"), F.col("rel"), globs)).select("path")
        else:
            got = spark.read.format("binaryFile").load(p).select("path")
        out = got if out is None else out.unionByName(got)
    return out.distinct() if out is not None else spark.createDataFrame([], "path string")


def with_online_only(files: DataFrame) -> DataFrame:
    """``files`` (path, size) with ``online_only``: a size but no blocks on disk.

    Read from the file system each task sees; a path it cannot see counts as here."""

    @F.pandas_udf("boolean")
    def placeholder(path: pd.Series, size: pd.Series) -> pd.Series:
        def one(p: str, n: int) -> bool:
            try:
                return n > 0 and os.stat(re.sub("^file:/+", "/", p)).st_blocks == 0
            except (OSError, AttributeError):
                return False

        return pd.Series([one(p, n) for p, n in zip(path, size, strict=True)], dtype=bool)

    return files.withColumn("online_only", placeholder("path", "size"))


class Converters:
    """Functions from (name, bytes) to text by suffix, each given ``timeout`` seconds."""

    def __init__(self, by_suffix: dict[str, Callable[[str, bytes], str]], timeout: float | None = None) -> None:
        self.by_suffix, self.timeout = by_suffix, timeout

    def convert(self, path: str, data: bytes) -> tuple[str | None, str | None]:
        """(text, error). A converter that hangs is left behind in a thread that does not keep the worker alive."""
        made = self.by_suffix.get(os.path.splitext(path)[1].lower())
        if made is None:
            return None, "no converter"
        box: dict[str, object] = {}

        def work() -> None:
            try:
                box["text"] = made(path, data)
            except Exception as e:  # one bad file costs itself only
                box["error"] = f"{type(e).__name__}: {e}"

        t = threading.Thread(target=work, daemon=True)
        t.start()
        t.join(self.timeout if self.timeout and self.timeout > 0 else None)
        if t.is_alive():
            return None, "timed out"
        return (box.get("text") or "", None) if "error" not in box else (None, str(box["error"]))  # type: ignore[return-value]


def read_text(spark: SparkSession, root: str, max_bytes: int | None = 25 << 20, converters: Converters | None = None, max_output: int | None = None, extra_text: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, method, error) of every file under ``root``, cleaned.

    Files over ``max_bytes`` are refused. Text suffixes and unknown ones are
    read as UTF-8 with replacement; convertible ones go to their converter,
    whose output may have ``max_output`` characters. What fails has a null
    text and says why.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    s = suffix(F.col("path"))
    route = F.when(s.isin(*TEXT_SUFFIXES, *extra_text), "text").when(s.isin(*CONVERTIBLE_SUFFIXES), "convert").otherwise("text")
    big = F.col("length") > max_bytes if max_bytes and max_bytes > 0 else F.lit(False)
    f = f.select("path", F.when(big, "large").otherwise(route).alias("route"), F.when(~big, F.col("content")).alias("content"))
    plain = f.where("route = 'text'").select("path", clean_markdown(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), F.lit("text").alias("method"), F.lit(None).cast("string").alias("error"))
    large = f.where("route = 'large'").select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("method"), F.lit("file too large").alias("error"))
    hook = converters or Converters({})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [hook.convert(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in got], "error": [e for _, e in got]})

    made = f.where("route = 'convert'").select("path", "content").mapInPandas(run, "path string, text string, error string")
    over = F.length("text") > max_output if max_output else F.lit(False)
    made = made.select("path", F.when(~over, clean_markdown(F.col("text"))).alias("text"), F.when(F.col("error").isNull() & ~over, "convert").alias("method"), F.when(over, "output too large").otherwise(F.col("error")).alias("error"))
    return plain.unionByName(made).unionByName(large)


def classify(files: DataFrame, manifest: DataFrame, mode: str = "metadata") -> DataFrame:
    """``files`` (path, size, mtime) with ``state``: new, changed or unchanged against the manifest.

    Unchanged needs the size, the time and a mode that covers what is asked for."""
    m = manifest.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_t"), F.col("index_mode").alias("_m"))
    same = (F.col("_s") == F.col("size")) & (F.abs(F.col("_t") - F.col("mtime")) < 1e-6) & (F.col("_m").isin("content", "vision") | F.lit(mode == "metadata"))
    state = F.when(F.col("_s").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return files.join(m, "path", "left").withColumn("state", state).drop("_s", "_t", "_m")


def prune(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows whose file is gone."""
    return manifest.join(files.select("path"), "path", "left_anti")


def siblings(files: DataFrame, most: int = 13) -> DataFrame:
    """(folder, n, names): a folder's files, the first names in order.

    Ranks are cut before names are gathered."""
    one = files.select("folder", "path", "name").distinct()
    w = Window.partitionBy("folder").orderBy("name", "path")
    first = one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    names = first.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "path"))), lambda x: x["name"]).alias("names"))
    return one.groupBy("folder").agg(F.count("*").alias("n")).join(names, "folder")


def render(files: DataFrame, root_label: str, most: int = 12) -> DataFrame:
    """(path, text): one file's record, with its place and its neighbours."""
    sib = siblings(files, most + 1)
    s = suffix(F.col("name"))
    # The wording of a record.
    head = F.concat(F.lit("File: "), "name", F.lit(" ("), type_label(s), F.lit(", "), human_size(F.col("size")), F.lit(", modified "), F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd"), F.lit(")"))
    where = F.concat(F.lit("Location: "), F.concat_ws(" / ", F.lit(root_label), F.filter(F.split("folder", "/"), lambda p: p != "")))
    j = files.join(sib, "folder", "left")
    at = F.array_position("names", F.col("name"))
    others = F.slice(F.when(at > 0, F.concat(F.slice("names", F.lit(1), (at - 1).cast("int")), F.slice("names", (at + 1).cast("int"), F.size("names")))).otherwise(F.col("names")), 1, most)
    n = F.col("n") - 1
    more = F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(" more)"))).otherwise("")
    near = F.when(n > 0, F.concat(F.lit("Alongside "), n.cast("string"), F.lit(" file(s) in this folder: "), F.array_join(others, ", "), more, F.lit(".")))
    away = F.when(F.col("online_only"), F.lit("Status: online-only (not downloaded).")) if "online_only" in files.columns else F.lit(None).cast("string")
    return j.select("path", F.concat_ws("\n", head, where, near, away).alias("text"))
