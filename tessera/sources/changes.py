"""A folder's files as a Spark data source, in batch and as a stream of changes.

``spark.readStream.format("tessera_files")`` tells of new, rewritten and deleted
files, which Spark's own file source does not: its offsets are lists of names it
has seen, these are the state of the whole folder. A listing (path, size, time)
is kept once, under the hash of its content, in the folder ``state``; an offset
names one. What lies between two offsets is the difference of their listings,
however often a batch is planned again, and equal states are equal offsets.

Options: ``path``; ``state`` (streams; a folder that drivers of later runs see
too); ``glob`` on file names; ``content`` (``true`` also reads the bytes);
``group`` (bytes of files a partition, 64 MB).
"""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "tessera_files"
SCHEMA = "path string, event string, size long, mtime double, content binary"
#: (size, time in seconds) by path.
Listing = dict[str, tuple[int, float]]


def place(where: str) -> tuple[pafs.FileSystem, str, str]:
    """A file system, a path in it, and what stands before its paths in names."""
    if "://" not in where and not where.startswith("file:"):
        return pafs.LocalFileSystem(), where, "file:"
    if where.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + where.removeprefix("file:").lstrip("/"), "file:"
    fs, path = pafs.FileSystem.from_uri(where)
    scheme, rest = where.split("://", 1)
    inner = path.lstrip("/")
    return fs, path, f"{scheme}://{rest[: rest.find(inner)] if inner else rest}"


def listed(root: str, glob: str = "*") -> Listing:
    """All files under a folder; one that is not there has none. Times are whole milliseconds."""
    fs, path, before = place(root)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return {before + f.path: (f.size, f.mtime_ns // 1_000_000 / 1000) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, glob)}


def differences(old: Listing, new: Listing) -> list[tuple[str, str, int, float]]:
    """(path, event, size, mtime) in the order of paths."""
    out = [(p, "new" if p not in old else "changed", *new[p]) for p in new if old.get(p) != new[p]]
    return sorted(out + [(p, "gone", *old[p]) for p in old if p not in new])


@dataclass
class Group(InputPartition):
    """Files that one task reads."""

    files: list[tuple[str, str, int, float]]


def grouped(events: list[tuple[str, str, int, float]], size: int) -> list[Group]:
    out: list[Group] = []
    held = size
    for e in events:
        cost = 0 if e[1] == "gone" else e[2] + 4096
        if held + cost > size or not out:
            out.append(Group([]))
            held = 0
        out[-1].files.append(e)
        held += cost
    return out


class _Files:
    def __init__(self, options: dict) -> None:
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.content = options.get("content", "false").lower() == "true"
        self.group, self.state = int(options.get("group", 64 << 20)), options.get("state")

    def rows(self, group: Group | None) -> Iterator[tuple]:
        """The files of a group; a folder without files has one group, which is none."""
        for path, event, size, mtime in group.files if group else []:
            body = None
            if self.content and event != "gone":
                fs, at, _ = place(path)
                try:
                    with fs.open_input_stream(at) as f:
                        body = f.read()
                except FileNotFoundError:  # gone since; the next listing says so
                    body = None
            yield path, event, size, mtime, body


class FileReader(_Files, DataSourceReader):
    def partitions(self) -> list[Group]:
        return grouped(differences({}, listed(self.root, self.glob)), self.group)

    def read(self, partition: Group) -> Iterator[tuple]:
        return self.rows(partition)


class ChangeReader(_Files, DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        if not self.state:
            raise ValueError("a stream of changes needs a folder `state` for its listings")

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        body = json.dumps(sorted((p, *x) for p, x in listed(self.root, self.glob).items())).encode()
        name = hashlib.sha256(body).hexdigest()
        fs, folder, _ = place(self.state)
        at = f"{folder.rstrip('/')}/{name}"
        if fs.get_file_info(at).type == pafs.FileType.NotFound:
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{at}.draft", compression=None) as f:
                f.write(gzip.compress(body, mtime=0))
            fs.move(f"{at}.draft", at)
        return {"listing": name}

    def _listing(self, offset: dict) -> Listing:
        if not offset["listing"]:
            return {}
        fs, folder, _ = place(self.state)
        with fs.open_input_stream(f"{folder.rstrip('/')}/{offset['listing']}", compression=None) as f:
            return {p: (size, mtime) for p, size, mtime in json.loads(gzip.decompress(f.read()))}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        return grouped(differences(self._listing(start), self._listing(end)), self.group)

    def read(self, partition: Group) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Listings stay: a run may go back to an offset; old ones can be deleted by age."""


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


def files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """All files of a folder as events ``new``."""
    spark.dataSource.register(Files)
    return spark.read.format(NAME).options(**options).load(root)


def changes(spark: SparkSession, root: str, state: str, **options: str) -> DataFrame:
    """A stream of the folder's changes."""
    spark.dataSource.register(Files)
    return spark.readStream.format(NAME).options(state=state, **options).load(root)
