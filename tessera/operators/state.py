"""Tables without a MERGE: upserts, insert-or-ignore, versions of all tables at once."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


def upsert(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new`` replace those with their key. ``new`` has each key once."""
    return existing.join(new.select(*key), list(key), "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def upsert_keep_id(existing: DataFrame, new: DataFrame, key: str, keep: str = "id") -> DataFrame:
    """As ``upsert``, but a replaced row keeps its old ``keep`` column."""
    old = existing.select(F.col(key), F.col(keep).alias("_old"))
    return upsert(existing, new.join(old, key, "left").withColumn(keep, F.coalesce("_old", keep)).drop("_old"), key)


def insert_or_ignore(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    fresh = new.join(existing.select(*key), list(key), "left_anti").dropDuplicates(list(key))
    return existing.unionByName(fresh.select(*existing.columns))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key. A partial aggregate would lose columns, so a window; keys are table keys, not hot."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def archive(rows: DataFrame, ids: DataFrame, by: str | None = None) -> DataFrame:
    """Rows of ``ids`` (id) become archived and inactive, and superseded by ``by`` if given."""
    j = rows.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {"is_archived": F.when(hit, True).otherwise(F.col("is_archived")), "is_active": F.when(hit, False).otherwise(F.col("is_active"))}
    if by is not None and "superseded_by" in rows.columns:
        new["superseded_by"] = F.when(hit, by).otherwise(F.col("superseded_by"))
    return j.withColumns(new).select(*rows.columns)


#: Key columns of the engine's own tables, for stores that are not told others.
KEYS = {"records": ("id",), "manifest": ("path", "collection"), "links": ("source_memory_id", "target_memory_id", "link_type"), "summaries": ("concept",), "query_sessions": ("id",), "digests": ("digest",)}
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class Snapshots:
    """Named tables under a root, in numbered versions of all of them together.

    A version is one small file, ``_versions/<number>``, that names for every
    table its schema and the folders of its key buckets. It is written under
    another name and renamed to its number, which fails where that number is
    taken: all tables of a run appear at once or not at all, two writers cannot
    both make a version, and one that dies at any step leaves folders that no
    version names (``vacuum`` deletes them). Folders never change, so readers of
    an older version are not disturbed.

    Tables with a key lie in ``buckets`` parts by its hash, and only parts in
    which a row differs are written again: a run costs the parts it touches.
    """

    def __init__(self, spark: SparkSession, root: str, forbidden: tuple[str, ...] = (), keys: dict[str, tuple[str, ...]] = KEYS, buckets: int = 16) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        own = self._real(self.root)
        for f in forbidden:
            other = self._real(f)
            if own == other or own.startswith(f"{other}/") or other.startswith(f"{own}/"):
                raise ValueError("this root belongs to another store, lies in it or holds it")

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _real(self, where: str) -> str:
        """The place a path names, however it is spelled; links are followed on a local disk."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where.rstrip("/") or "/")
        uri = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().normalize()
        name = os.path.normpath(uri.getPath())
        return f"{uri.getScheme()}://{uri.getAuthority() or ''}{os.path.realpath(name) if uri.getScheme() == 'file' else name}"

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _publish(self, number: int, body: str) -> None:
        """The version file, whole under its number or not there."""
        jvm, fs = self.spark._jvm, self._fs()
        draft, final = self._path("_versions", f".draft-{uuid.uuid4().hex}"), self._path("_versions", f"{number:020d}")
        out = fs.create(draft, False)
        try:
            out.write(body.encode())
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {number} was made by another writer") from e
            raise

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("_versions") if n.isdigit())

    def version(self) -> int:
        """The number of the newest version, 0 for an empty store."""
        return max(self.versions(), default=0)

    def _state(self, number: int | None = None) -> tuple[int, dict]:
        number = self.version() if number is None else number
        if not number:
            return 0, {}
        stream = self._fs().open(self._path("_versions", f"{number:020d}"))
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # tables

    def read(self, name: str, version: int | None = None, parts: set[int] | None = None) -> DataFrame | None:
        """A table as of a version, the newest by default; of some buckets only, if given."""
        return self._open(self._state(version)[1].get(name), name, parts)

    def _open(self, table: dict | None, name: str, parts: set[int] | None = None) -> DataFrame | None:
        if table is None:
            return None
        schema = StructType.fromJson(table["schema"])
        folders = [f"{self.root}/{name}/{f}" for b, f in sorted(table["parts"].items()) if parts is None or int(b) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, key: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int").alias(BUCKET)

    def _put(self, name: str, df: DataFrame, key: list[str], n: int, only: set[int] | None = None) -> dict[str, str]:
        """Writes a table, or some of its buckets, into a new folder; where each bucket lies."""
        folder = uuid.uuid4().hex
        if not key:
            df.write.parquet(f"{self.root}/{name}/{folder}")
            return {"0": folder}
        rows = df.withColumn(BUCKET, self._bucket(key, n))
        if only is not None:
            rows = rows.where(F.col(BUCKET).isin(*only))
        rows.repartition(n if only is None else max(1, len(only)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{name}/{folder}")
        return {d.split("=")[1]: f"{folder}/{d}" for d in self._names(name, folder) if d.startswith(f"{BUCKET}=")}

    def _digests(self, df: DataFrame, key: list[str], n: int) -> dict[int, tuple]:
        """What is in each bucket: rows, and two sums of their hashes."""
        cells = [F.to_json(c, {"ignoreNullFields": "false"}) if isinstance(t, (StructType, MapType)) else F.col(c) for c, t in ((f.name, f.dataType) for f in df.schema)]
        wide = lambda h: F.sum(h.cast("decimal(20, 0)"))
        rows = df.groupBy(self._bucket(key, n)).agg(F.count("*").alias("n"), wide(F.xxhash64(*cells)).alias("a"), wide(F.xxhash64(F.lit(1), *reversed(cells))).alias("b"))
        return {r[BUCKET]: (r.n, r.a, r.b) for r in rows.collect()}  # as many rows as buckets

    def _changed(self, name: str, df: DataFrame, table: dict | None) -> dict:
        """A table's entry after ``df`` is all of it; buckets in which nothing differs keep their folders."""
        own = self.keys.get(name, ("key",) if name.startswith("answers_") else ())
        key = [k for k in own if k in df.columns]
        schema = json.loads(df.schema.json())
        if not key or table is None or table["key"] != key or _types(table["schema"]) != _types(schema):
            return {"schema": schema, "key": key, "buckets": self.buckets, "parts": self._put(name, df, key, self.buckets)}
        n = table["buckets"]
        df = df.select(*[f["name"] for f in table["schema"]["fields"]])
        old, new = self._digests(self._open(table, name), key, n), self._digests(df, key, n)
        differ = {b for b in old.keys() | new.keys() if old.get(b) != new.get(b)}
        fresh = self._put(name, df, key, n, differ & new.keys()) if differ & new.keys() else {}
        return table | {"parts": {b: f for b, f in table["parts"].items() if int(b) not in differ} | fresh}

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """One version with all of ``tables`` replaced by what is given; the rest stay
        as they are. The frames may read the store: nothing that they read changes."""
        number, state = self._state()
        new = {name: self._changed(name, df, state.get(name)) for name, df in tables.items()}
        if all(state.get(name) == entry for name, entry in new.items()):
            return number
        self._publish(number + 1, json.dumps(state | new))
        return number + 1

    def write(self, name: str, df: DataFrame) -> int:
        return self.commit({name: df})

    def upsert(self, name: str, new: DataFrame, *key: str) -> int:
        """Rows of ``new`` replace those with their key. Where that is the table's
        own key, only the buckets of the new rows are read and written."""
        number, state = self._state()
        table = state.get(name)
        if table is None:
            return self.commit({name: new})
        if list(key) != table["key"]:
            return self.commit({name: upsert(self._open(table, name), new, *key)})
        n = table["buckets"]
        touched = {r[0] for r in new.select(self._bucket(list(key), n)).distinct().collect()}
        if not touched:
            return number
        rows = upsert(self._open(table, name, touched), new, *key)
        self._publish(number + 1, json.dumps(state | {name: table | {"parts": table["parts"] | self._put(name, rows, list(key), n, touched)}}))
        return number + 1

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the newest versions, and the folders that no kept version
        names; how many folders went. To be run when nothing writes."""
        numbers = self.versions()
        kept = numbers[-keep:]
        named = {(t, f.split("/")[0]) for n in kept for t, e in self._state(n)[1].items() for f in e.get("parts", {}).values()}
        fs, gone = self._fs(), 0
        for n in self._names("_versions"):
            if not n.isdigit() or int(n) not in kept:
                fs.delete(self._path("_versions", n), False)
        for t in self._names():
            for f in self._names(t) if t != "_versions" else []:
                if (t, f) not in named:
                    gone += bool(fs.delete(self._path(t, f), True))
        return gone


def _types(schema: dict) -> list[tuple]:
    return sorted((f["name"], json.dumps(f["type"], sort_keys=True)) for f in schema["fields"])
