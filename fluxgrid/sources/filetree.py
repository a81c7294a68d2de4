"""Writer of whole file trees, and a list of files that has the empty ones too.

Rows of the writer become files under a staging folder, which is renamed into
place when all tasks have succeeded.

    files.write.format("filetree").mode("append").option("path", out).save()

Rows have ``path`` (below the tree), ``source`` (a file to link or copy) and
``content`` (bytes to write); one of the latter is null.  The tree must lie on
a file system that driver and executors share.  A file is made under a name of
its attempt and then renamed, so a retried or doubled task leaves the same
tree; only the rename of the staging folder publishes it.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, source string, content binary"
STAGING, PREVIOUS = ".tmp", ".previous"


@dataclass
class TaskFiles(WriterCommitMessage):
    """What one task made: files by mode (hardlink, copy, written)."""

    modes: dict[str, int] = field(default_factory=dict)


def local(path: str) -> str:
    """The path without its scheme; other file systems than a shared mount are refused."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme != "file":
            raise ValueError(f"a file tree needs a shared mount, not {path}")
        return "/" + rest.lstrip("/")
    return path


def _place(source: str | None, content: bytes | None, target: str) -> str:
    os.makedirs(os.path.dirname(target), exist_ok=True)
    attempt = f"{target}.{uuid.uuid4().hex}"
    if source is None:
        with open(attempt, "wb") as f:
            f.write(content or b"")
        mode = "written"
    else:
        try:
            os.link(local(source), attempt)
            mode = "hardlink"
        except OSError:
            shutil.copy2(local(source), attempt)
            mode = "copy"
    # a link to the same file under both names would make the rename do nothing
    if os.path.exists(target) and os.path.samefile(attempt, target):
        os.unlink(attempt)
    else:
        os.replace(attempt, target)
    return mode


class FileTreeWriter(DataSourceWriter):
    """Refuses an existing tree, or an earlier run's staging folder; with ``overwrite`` the old tree stays until the new one is whole.

    ``notes`` is JSON of small files to add (name to text); if ``report`` names
    one that holds a JSON object, the counts by mode become its
    ``materialization``.  ``folders`` is a JSON list of folders that are made
    even if nothing lies in them.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.out, self.overwrite = local(options["path"]).rstrip("/"), overwrite
        self.staging, self.previous = self.out + STAGING, self.out + PREVIOUS
        self.notes, self.report = json.loads(options.get("notes", "{}")), options.get("report")
        if os.path.exists(self.out) and not overwrite:
            raise FileExistsError(f"refusing to overwrite {self.out}")
        for left in (self.staging, self.previous):
            if os.path.exists(left):
                raise FileExistsError(f"an earlier run has left {left}")
        for folder in ["", *json.loads(options.get("folders", "[]"))]:
            os.makedirs(os.path.join(self.staging, self._inside(folder) if folder else ""), exist_ok=True)

    @staticmethod
    def _inside(path: str) -> str:
        if path.startswith("/") or "\\" in path or ".." in path.split("/"):
            raise ValueError(f"{path} leaves the tree")
        return path

    def write(self, iterator: Iterator) -> TaskFiles:
        modes: Counter = Counter()
        for row in iterator:
            modes[_place(row["source"], row["content"], os.path.join(self.staging, self._inside(row["path"])))] += 1
        return TaskFiles(dict(modes))

    def commit(self, messages: list) -> None:
        try:
            modes: Counter = Counter()
            for m in messages:
                modes.update(m.modes if m else {})
            for name, text in self.notes.items():
                if name == self.report:
                    text = json.dumps(json.loads(text) | {"materialization": dict(sorted(modes.items()))}, indent=2, sort_keys=True) + "\n"
                _place(None, text.encode(), os.path.join(self.staging, self._inside(name)))
            swapped = self.overwrite and os.path.exists(self.out)
            if swapped:
                os.rename(self.out, self.previous)
            try:
                os.rename(self.staging, self.out)
            except OSError:
                if swapped:
                    os.rename(self.previous, self.out)
                raise
            if swapped:
                shutil.rmtree(self.previous)
        except Exception:
            self.abort(messages)
            raise

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(dict(self.options), overwrite)


def write_tree(files: DataFrame, out: str, notes: dict[str, str] | None = None, report: str | None = None, folders: list[str] | None = None, overwrite: bool = False) -> None:
    """Writes the rows as a tree; two rows of one path are an error before anything is written."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FileTree)
    clash = files.groupBy("path").count().where("count > 1").orderBy("path").first()
    if clash:
        raise ValueError(f"{clash['count']} rows want to be {clash['path']}")
    rows = files.select("path", F.col("source").cast("string").alias("source"), F.col("content").cast("binary").alias("content"))
    writer = rows.write.format("filetree").mode("overwrite" if overwrite else "append").option("path", out)
    for name, value in (("notes", json.dumps(notes or {})), ("folders", json.dumps(folders or [])), ("report", report)):
        if value is not None:
            writer = writer.option(name, value)
    writer.save()


@dataclass
class Folder(InputPartition):
    """A folder of which one task lists the files; a deep one with all below it."""

    path: str
    deep: bool


class FileListReader(DataSourceReader):
    """One task per folder of the first levels.  The driver looks for folders only, ``levels`` deep; tasks list the rest."""

    def __init__(self, options: dict) -> None:
        self.root, self.levels = local(options["path"]), int(options.get("levels", "3"))

    def partitions(self) -> list:
        found, level = [], [self.root]
        for depth in range(self.levels):
            last = depth == self.levels - 1
            found += [Folder(p, last) for p in level]
            level = [] if last else [e.path for p in level for e in os.scandir(p) if e.is_dir()]
        return found

    def read(self, partition: Folder) -> Iterator[tuple]:
        walk = os.walk(partition.path, followlinks=True) if partition.deep else [next(os.walk(partition.path))]
        for folder, _, names in walk:
            for name in names:
                place = os.path.join(folder, name)
                yield f"file:{os.path.abspath(place)}", os.path.getsize(place)


class FileList(DataSource):
    """(path, bytes) of every file below a folder.  Spark's own file sources leave empty files out."""

    @classmethod
    def name(cls) -> str:
        return "filelist"

    def schema(self) -> str:
        return "path string, bytes bigint"

    def reader(self, schema) -> FileListReader:
        return FileListReader(dict(self.options))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileList)
    return spark.read.format("filelist").option("path", root).load()
