"""Image records: what still needs a description, and descriptions put in."""

from __future__ import annotations

import base64
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.text import mime
from tessera.operators.answers import Answers
from tessera.operators.records import annotating, meta, new_records
from tessera.operators.state import archive, insert_or_ignore

# Suffixes by how an image can be described.
RASTER = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")
SVG = (".svg",)
PROPRIETARY = (".xd", ".vsdx", ".dwg", ".psd", ".eps")
# The elements of an SVG that hold text.
SVG_TEXT = ("text", "tspan", "title", "desc", "textpath")
DESCRIPTION = "image_description"


def file_records(records: DataFrame) -> DataFrame:
    """Image files among the records, with ext, path, rel, size and online_only from their metadata."""
    r = records.where("not is_archived").where(meta("kind").isNull())
    cells = {"ext": F.lower(meta("ext")), "path": meta("path"), "rel": meta("rel"), "size": F.coalesce(meta("size").cast("long"), F.lit(0)), "online_only": F.coalesce(meta("online_only").cast("boolean"), F.lit(False))}
    return r.withColumns(cells).where(F.col("ext").isin(*RASTER, *SVG))


def find(records: DataFrame, path: str) -> DataFrame:
    """The newest image file with this path or relative path, or none."""
    hit = (F.col("path") == path) | (F.col("rel") == path)
    return file_records(records).where(hit).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def jobs(records: DataFrame, links: DataFrame, include_all: bool = False, limit: int = 0) -> DataFrame:
    """(id, path, rel, mime, size, online_only, current_description) of raster
    images by rel and id: those no active description annotates, or all.
    ``limit`` is the length of the list, cut last."""
    files = file_records(records).where(F.col("ext").isin(*RASTER))
    told = annotating(files, links, records, 1, DESCRIPTION).select(F.col("result_id").alias("id"), F.col("id").alias("_d"))
    if include_all:
        text = records.select(F.col("id").alias("_d"), F.col("content").alias("current_description"))
        files = files.join(told.join(text, "_d", "left").select("id", "current_description"), "id", "left")
    else:
        files = files.join(told, "id", "left_anti").withColumn("current_description", F.lit(None).cast("string"))
    out = files.select("id", "path", "rel", mime(F.col("ext")).alias("mime"), "size", "online_only", "current_description").orderBy("rel", "id")
    return out.limit(limit) if limit > 0 else out


def with_bytes(jobs: DataFrame, contents: DataFrame, include_bytes: bool = False, max_bytes: int | None = None, budget: int | None = None) -> DataFrame:
    """``jobs`` with ``image_b64`` and ``oversized``. Bytes come along for files
    that are online only, or for all if asked; none over ``max_bytes``; online
    ones, in order, as far as ``budget`` bytes reach. ``contents`` is (path, content)."""
    want = F.col("online_only") | F.lit(include_bytes)
    over = want & (F.col("size") > max_bytes) if max_bytes is not None else F.lit(False)
    j = jobs.withColumn("oversized", over)
    if budget is not None:
        paid = F.col("online_only") & ~F.col("oversized")
        before = Window.orderBy("rel", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        j = j.withColumn("_spent", F.sum(F.when(paid, F.col("size")).otherwise(0)).over(before))  # a list of jobs, cut by its reader
        want = want & (~paid | (F.col("_spent") <= budget))
    j = j.withColumn("_want", want & ~F.col("oversized"))
    got = contents.join(j.where("_want").select("path"), "path", "left_semi").select("path", F.base64("content").alias("image_b64"))
    out = j.join(got, "path", "left").withColumn("image_b64", F.when(F.col("_want"), F.regexp_replace("image_b64", r"\s", "")))
    return out.select(*jobs.columns, "image_b64", "oversized").orderBy("rel", "id")


def put(records: DataFrame, links: DataFrame, told: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(records, links) after descriptions ``told`` (id, content) of image files:
    earlier ones are archived, the new one annotates its file. Unknown ids do nothing; see ``missing``."""
    files = file_records(records).join(told.select("id", F.col("content").alias("_text")), "id")
    old = annotating(files, links, records, 100, DESCRIPTION).select("id")
    made = files.select(
        F.concat(F.lit("img-"), F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "_text", F.lit(now)), 256), 1, 16)).cast(records.schema["id"].dataType).alias("id"),
        F.col("_text").alias("content"),
        F.lit("context").alias("category"),
        F.lit("document").alias("source"),
        F.to_json(F.struct(F.lit(DESCRIPTION).alias("kind"), F.coalesce("path", F.col("id").cast("string")).alias("source_image"), meta("collection").alias("collection"))).alias("metadata"),
        F.col("id").alias("_file"),
        F.coalesce("rel", "path").alias("_rel"),
    )
    edge = made.select(F.col("id").alias("source_memory_id"), F.col("_file").alias("target_memory_id"), F.lit("annotates").alias("link_type"), F.col("_rel").alias("entity"), F.lit(1.0).alias("strength"), F.lit(1.0).alias("confidence"), F.lit("inference").alias("source"))
    add = [c for c in links.columns if c not in edge.columns]
    edge = edge.select("*", *[F.lit(None).cast(links.schema[c].dataType).alias(c) for c in add]).select(*[F.col(c).cast(links.schema[c].dataType) for c in links.columns])
    new = new_records(made.drop("_file", "_rel"), now)
    kept = archive(records, old)
    return kept.unionByName(new.select(*records.columns)), insert_or_ignore(links, edge, "source_memory_id", "target_memory_id", "link_type")


def missing(records: DataFrame, told: DataFrame) -> DataFrame:
    return told.join(file_records(records), "id", "left_anti")


def describe(jobs: DataFrame, captioner: Callable[[dict], str], answers: Answers | None = None) -> DataFrame:
    """(id, content, error) by ``captioner`` (a job as a dict to text); a failure
    costs its own image only. Written before it is used: each image is asked about once."""
    said = (answers or Answers("captioner")).ask(jobs, jobs.columns, captioner)
    return said.select("id", F.col("answer").alias("content"), "error")


def svg_lines(data: bytes | None) -> str:
    """The text of an SVG's elements, a line each, neighbours that repeat once; nothing if it does not parse."""
    try:
        root = ET.fromstring(data or b"")
    except ET.ParseError:
        return ""
    named = (e for e in root.iter() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1].lower() in SVG_TEXT)
    found = [t for e in named for t in ((e.text or "").strip(), (e.tail or "").strip()) if t]
    return "\n".join(t for i, t in enumerate(found) if not i or t != found[i - 1])


def svg_text(content: Column) -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: svg_lines(None if x is None else bytes(x)))

    return run(content)


def decode(image_b64: str) -> bytes:
    return base64.b64decode(image_b64)
