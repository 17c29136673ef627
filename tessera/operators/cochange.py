"""Documents that change together: blocks, distances, clusters, change-sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import cosine
from tessera.functions.text import suffix
from tessera.operators.components import connected_components
from tessera.operators.density import hdbscan
from tessera.operators.records import meta
from tessera.operators.state import insert_or_ignore
from tessera.plans.shared import materialize
from tessera.settings import Documents


# Suffixes that are no documents for co-change, pictures and what builds leave.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".raw", ".cr2", ".nef", ".psd", ".ico")
ARTIFACT_SUFFIXES = (".dll", ".exe", ".pdb", ".jar", ".class", ".o", ".obj", ".bin", ".crc", ".lib", ".so")


def without_suffixes(docs: DataFrame, path: str = "path", extra: tuple[str, ...] = ()) -> DataFrame:
    """Documents that are no pictures or artifacts, nor of ``extra`` suffixes."""
    return docs.where(~suffix(F.col(path)).isin(*IMAGE_SUFFIXES, *ARTIFACT_SUFFIXES, *(x.lower() for x in extra)))


def _bucket(s: Documents) -> Column:
    return F.floor(F.col("mtime") / min(s.bucket, s.gap)).cast("long") if s.by_folder else F.lit(0).cast("long")


def _block(s: Documents) -> list[str]:
    return ["folder", "bucket"] if s.by_folder else ["bucket"]


def blocks(docs: DataFrame, s: Documents = Documents()) -> DataFrame:
    """``docs`` (doc_id, folder, mtime) with ``bucket``; a block is a folder's
    bucket (or everything, without ``by_folder``), its first ``block_cap``
    documents in (mtime, doc_id) order.

    The cap is a setting of the operator; ``truncated`` counts what it leaves out.
    """
    b = docs.withColumn("bucket", _bucket(s))
    w = Window.partitionBy(*_block(s)).orderBy("mtime", "doc_id")
    return b.withColumn("place", F.row_number().over(w)).where(F.col("place") <= s.block_cap)


def truncated(docs: DataFrame, s: Documents = Documents()) -> DataFrame:
    b = docs.withColumn("bucket", _bucket(s)).groupBy(*_block(s)).agg(F.count("*").alias("n"))
    return b.agg(F.coalesce(F.sum(F.greatest(F.col("n") - s.block_cap, F.lit(0))), F.lit(0)).alias("truncated"))


def time_distance(a: Column, b: Column, tau: float) -> Column:
    return F.least(F.lit(1.0), F.abs(a - b) / tau)


def path_distance(a: Column, b: Column) -> Column:
    """Of two folders: the share of their parts that is not common to both."""
    pa, pb = (F.filter(F.split(c, "/"), lambda x: x != "") for c in (a, b))
    same = F.zip_with(pa, pb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    common = F.when(first == 0, F.size(same)).otherwise(first - 1)
    total = F.size(pa) + F.size(pb)
    return (total - 2 * common) / F.greatest(F.lit(1), total)


def content_distance(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce((1.0 - cosine(a, b)) / 2.0, F.lit(0.5)))


def pair_distances(blocked: DataFrame, s: Documents = Documents()) -> DataFrame:
    """(a, b, distance) of all pairs of a block: the weighted mean of time, path and, where both have a vector, content."""
    cols = _block(s)
    has = "embedding" in blocked.columns
    side = lambda x: blocked.select(*cols, F.col("doc_id").alias(x), F.col("folder").alias(f"f{x}"), F.col("place").alias(f"p{x}"), F.col("mtime").alias(f"m{x}"), *([F.col("embedding").alias(f"e{x}")] if has else []))
    j = side("a").join(side("b"), cols).where("pa < pb")
    parts = [(s.weight_time, time_distance(F.col("ma"), F.col("mb"), s.tau)), (s.weight_path, path_distance(F.col("fa"), F.col("fb")))]
    if has:
        parts.append((s.weight_content, content_distance(F.col("ea"), F.col("eb"))))
    top = sum((F.coalesce(d * w, F.lit(0.0)) for w, d in parts), F.lit(0.0))
    bottom = sum((F.when(d.isNull(), 0.0).otherwise(w) for w, d in parts), F.lit(0.0))
    return j.select(*cols, "a", "b", F.round(F.when(bottom > 0, top / bottom).otherwise(0.0), 6).alias("distance"))


def neighbours(blocked: DataFrame, s: Documents = Documents()) -> DataFrame:
    """(a, b): consecutive documents of a block within reach of each other by time alone.

    Where no vector is there, the distance grows with the time between two
    documents, so joining neighbours in time gives the components that all
    pairs would, with a link per document.
    """
    w = Window.partitionBy("folder", "bucket").orderBy("mtime", "doc_id")
    near = (s.weight_time * time_distance(F.col("mtime"), F.lag("mtime").over(w), s.tau)) / (s.weight_time + s.weight_path)
    return blocked.select(F.col("doc_id").alias("a"), F.lag("doc_id").over(w).alias("b"), near.alias("d")).where((F.col("d") <= s.eps) & F.col("b").isNotNull()).select("a", "b")


def clusters(blocked: DataFrame, s: Documents = Documents()) -> DataFrame:
    """(doc_id, cluster) of documents linked within ``eps``; others are left out."""
    if "embedding" in blocked.columns or not s.by_folder:
        links = pair_distances(blocked, s).where(F.col("distance") <= s.eps).select("a", "b")
    else:
        links = neighbours(blocked, s)
    return connected_components(links, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def split_gaps(members: DataFrame, s: Documents = Documents()) -> DataFrame:
    """Adds ``part``: a cluster is split where its documents are more than ``gap`` apart."""
    w = Window.partitionBy("cluster").orderBy("mtime", "doc_id")
    new = F.coalesce((F.col("mtime") - F.lag("mtime").over(w) > s.gap).cast("int"), F.lit(0))
    return members.withColumn("_new", new).withColumn("part", F.sum("_new").over(w)).drop("_new")


def placed(members: DataFrame, s: Documents = Documents()) -> tuple[DataFrame, DataFrame]:
    """(members with ``changeset_id``, counts): parts of ``min_cluster`` to
    ``max_cluster`` documents become change-sets; counts tells how many parts
    were too large, and how many documents stood in parts too small.

    The id hashes the sorted members and the latest time, half to even. Sizes
    are counted before members are gathered, so no list is longer than the cap."""
    parts = split_gaps(members, s)
    size = parts.groupBy("cluster", "part").agg(F.count("*").alias("size"))
    counts = size.agg(F.count_if(F.col("size") > s.max_cluster).alias("dropped_oversized"), F.coalesce(F.sum(F.when(F.col("size") < s.min_cluster, F.col("size"))), F.lit(0)).alias("dropped_singletons"))
    kept = parts.join(size.where((F.col("size") >= s.min_cluster) & (F.col("size") <= s.max_cluster)), ["cluster", "part"])
    g = kept.groupBy("cluster", "part").agg(F.max("mtime").alias("observed_at"), F.sort_array(F.collect_list(F.col("doc_id").cast("string"))).alias("members"))
    key = F.concat(F.array_join("members", "|"), F.lit("@"), F.bround("observed_at", 0).cast("long").cast("string"))
    ids = g.select("cluster", "part", "observed_at", "members", F.substring(F.sha1(key), 1, 16).alias("changeset_id"))
    return kept.join(ids, ["cluster", "part"]), counts


def changesets(members: DataFrame, s: Documents = Documents()) -> DataFrame:
    """(changeset_id, members, observed_at, size) of ``placed``, a row a change-set."""
    return placed(members, s)[0].select("changeset_id", "members", "observed_at", "size").distinct()


def block_distances(block: pd.DataFrame, s: Documents) -> np.ndarray:
    """The composite distance of every two documents of a block."""
    at = block["mtime"].to_numpy(np.float64)
    time = np.minimum(1.0, np.abs(at[:, None] - at[None, :]) / s.tau)
    parts = [[p for p in (f or "").split("/") if p] for f in block["folder"]]
    path = np.zeros_like(time)
    if len({tuple(p) for p in parts}) > 1:
        for i, p in enumerate(parts):
            for j, q in enumerate(parts[:i]):
                common = next((k for k, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q)))
                path[i, j] = path[j, i] = (len(p) + len(q) - 2 * common) / max(1, len(p) + len(q))
    top, bottom = s.weight_time * time + s.weight_path * path, np.full_like(time, s.weight_time + s.weight_path)
    if "embedding" in block.columns:
        has = block["embedding"].map(lambda v: v is not None).to_numpy()
        dim = next((len(v) for v in block["embedding"] if v is not None), 0)
        m = np.array([v if v is not None else np.zeros(dim) for v in block["embedding"]], np.float64).reshape(len(block), dim)
        norm = np.linalg.norm(m, axis=1)
        zero = norm == 0
        unit = m / np.where(zero, 1.0, norm)[:, None]
        content = (1.0 - np.clip(unit @ unit.T, -1.0, 1.0)) / 2.0
        content[zero, :] = content[:, zero] = 0.5
        both = has[:, None] & has[None, :]
        top, bottom = top + np.where(both, s.weight_content * content, 0.0), bottom + np.where(both, s.weight_content, 0.0)
    out = np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)
    np.fill_diagonal(out, 0.0)
    return out


def components_within(d: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels of the components of pairs within ``eps``; -1 in those of fewer than ``least``."""
    label, n = np.full(len(d), -1), 0
    seen = np.zeros(len(d), bool)
    for i in range(len(d)):
        if seen[i]:
            continue
        members, front = np.zeros(len(d), bool), np.zeros(len(d), bool)
        front[i] = True
        while front.any():
            members |= front
            front = (d[front] <= eps).any(axis=0) & ~members
        seen |= members
        if members.sum() >= least:
            label[members], n = n, n + 1
    return label


def density_labels(block: pd.DataFrame, s: Documents) -> tuple[np.ndarray, np.ndarray]:
    """A block's labels and strengths: by density, or by components where the
    block is small, or where density finds nothing but noise."""
    d = block_distances(block, s)
    if not (s.fallback and len(block) <= s.fallback_max):
        labels, strength = hdbscan(d, s.min_cluster)
        if not s.fallback or (labels >= 0).any():
            return labels, strength
    labels = components_within(d, s.eps, s.min_cluster)
    return labels, (labels >= 0).astype(float)


def density_clusters(blocked: DataFrame, s: Documents = Documents()) -> DataFrame:
    """(doc_id, cluster, strength, folder, mtime) by density within blocks of at
    most ``block_cap`` documents, each one task's matrix; noise is left out."""
    cols = _block(s)
    kind = blocked.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mtime", "doc_id"]).reset_index(drop=True)
        if len(pdf) < max(2, s.min_cluster):
            return pdf.iloc[:0].assign(cluster="", strength=0.0)[["doc_id", "cluster", "strength", "folder", "mtime"]]
        labels, strength = density_labels(pdf, s)
        key = "|".join(str(pdf[c].iloc[0]) for c in cols)
        pdf = pdf.assign(cluster=[f"{key}|{x}" for x in labels], strength=strength)[labels >= 0]
        return pdf[["doc_id", "cluster", "strength", "folder", "mtime"]]

    return blocked.groupBy(*cols).applyInPandas(run, f"doc_id {kind}, cluster string, strength double, folder string, mtime double")


def pair_edges(members: DataFrame) -> DataFrame:
    """(changeset_id, source, target, strength) of every two documents of a
    change-set (changeset_id, doc_id, mtime, strength): the weaker one's strength. Sets are capped, so are their pairs."""
    side = lambda x: members.select("changeset_id", F.col("doc_id").alias(x), F.struct("mtime", "doc_id").alias(f"o{x}"), F.col("strength").alias(f"s{x}"))
    j = side("source").join(side("target"), "changeset_id").where("osource < otarget")
    return j.select("changeset_id", "source", "target", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "ssource", "starget")).alias("strength"))


@dataclass(frozen=True)
class Changes:
    members: DataFrame  # (changeset_id, doc_id, mtime, strength, observed_at, size)
    edges: DataFrame  # (changeset_id, source, target, strength)
    order: DataFrame  # (changeset_id, source, target): consecutive in time
    counts: DataFrame  # (changesets, dropped_oversized, dropped_singletons, truncated), one row
    kind: str


def cluster(docs: DataFrame, s: Documents = Documents(), run_kind: str = "incremental") -> Changes:
    """Change-sets of ``docs`` (doc_id, folder, mtime, embedding if there is one), with their edges and what was left out."""
    docs = docs if s.enabled else docs.where("false")
    found = materialize(density_clusters(blocks(docs, s), s), "clusters")
    sets, dropped = placed(found, s)
    members = materialize(sets.select("changeset_id", "doc_id", "mtime", "strength", "observed_at", "size"), "changesets")
    counts = members.agg(F.count_distinct("changeset_id").alias("changesets")).join(dropped).join(truncated(docs, s))  # one row each
    return Changes(members, pair_edges(members), before_edges(members), counts, run_kind if s.label_kind else "")


def apply_changes(records: DataFrame, links: DataFrame, c: Changes, method: str = "hdbscan") -> tuple[DataFrame, DataFrame]:
    """(records, links) with the change-sets: members' metadata name theirs, and
    the links of a change-set are replaced, so applying twice changes nothing."""
    tag = F.concat(F.lit("changeset:"), F.col("changeset_id"))
    names = c.members.select(tag.alias("entity")).distinct()
    make = lambda e, kind, strength: e.select(F.col("source").alias("source_memory_id"), F.col("target").alias("target_memory_id"), F.lit(kind).alias("link_type"), tag.alias("entity"), strength.alias("strength"), strength.alias("confidence"), F.lit("inference").alias("made"))
    new = make(c.edges, "relates_to", F.col("strength")).unionByName(make(c.order, "before", F.lit(1.0))).withColumnRenamed("made", "source")
    cells = [(F.col(n) if n in new.columns else F.lit(None)).cast(links.schema[n].dataType).alias(n) for n in links.columns]
    links = insert_or_ignore(links.join(names, "entity", "left_anti").select(*links.columns), new.select(*cells), "source_memory_id", "target_memory_id", "link_type")
    iso = F.date_format(F.timestamp_seconds("observed_at").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    told = c.members.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.struct("observed_at", "changeset_id")).alias("x")).select("id", F.col("x.changeset_id").alias("changeset_id"), F.col("x.observed_at").alias("observed_at"))
    told = told.select("id", F.col("changeset_id").alias("_set"), iso.alias("_at"))
    j = records.join(told, "id", "left")
    merged = merge_json(F.col("metadata"), {"changeset_id": F.col("_set"), "changeset_observed_at": F.col("_at"), "changeset_method": F.lit(method)} | ({"changeset_kind": F.lit(c.kind)} if c.kind else {}))
    return j.withColumn("metadata", F.when(F.col("_set").isNotNull(), merged).otherwise(F.col("metadata"))).select(*records.columns), links


def merge_json(text: Column, new: dict[str, Column]) -> Column:
    """A JSON object's text with string members set."""
    old = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    made = F.create_map(*[x for k, v in new.items() for x in (F.lit(k), F.try_parse_json(F.concat(F.lit('"'), v, F.lit('"'))))])
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*new)), made))


def documents_timeline(records: DataFrame, start: str = "1970-01-01 00:00:00", end: str = "9999-12-31 23:59:59", collection: str | None = None, limit: int = 50) -> DataFrame:
    """(id, date, collection, path, title, valid_from) of live documents in the
    window, newest first; pieces of a document's body are left out. ``limit`` is the report's length."""
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    role = meta("record_role")
    rows = records.where((F.col("source") == "document") & ~F.col("is_archived") & F.col("valid_from").between(t(start), t(end)) & (role.isNull() | (role != "chunk")))
    rows = rows if collection is None else rows.where(meta("collection") == collection)
    best = rows.orderBy(F.desc("valid_from"), "id").limit(limit)
    title = F.coalesce(F.nullif(meta("rel"), F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, 80))
    return best.select("id", F.date_format("valid_from", "yyyy-MM-dd").alias("date"), F.coalesce(meta("collection"), F.lit("")).alias("collection"), F.coalesce(meta("path"), F.lit("")).alias("path"), title.alias("title"), "valid_from")


def before_edges(docs: DataFrame) -> DataFrame:
    """(source, target): consecutive documents of a change-set (changeset_id, doc_id, mtime)."""
    w = Window.partitionBy("changeset_id").orderBy("mtime", "doc_id")
    return docs.select("changeset_id", F.col("doc_id").alias("source"), F.lead("doc_id").over(w).alias("target")).where("target is not null")


def changed_with(docs: DataFrame, links: DataFrame, doc_id) -> DataFrame:
    """(doc_id, strength) of the documents that share a change-set with ``doc_id``; 0 without a link in either direction."""
    mine = docs.where(F.col("doc_id") == doc_id).select("changeset_id").distinct()
    peers = docs.join(mine, "changeset_id", "left_semi").where(F.col("doc_id") != doc_id).select("doc_id").distinct()
    s = links.where((F.col("source") == doc_id) | (F.col("target") == doc_id)).select(F.when(F.col("source") == doc_id, F.col("target")).otherwise(F.col("source")).alias("doc_id"), "strength").groupBy("doc_id").agg(F.max("strength").alias("strength"))
    return peers.join(s, "doc_id", "left").select("doc_id", F.coalesce("strength", F.lit(0.0)).alias("strength"))
