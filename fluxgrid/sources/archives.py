"""ZIP archives as tables: the directory is read once, members by ranges of bytes in many tasks, each checked against its CRC."""

from __future__ import annotations

import hashlib
import os
import stat
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fluxgrid.functions import scalars as S
from fluxgrid.sources.filetree import local, write_tree

SCHEMA = "archive string, name string, bytes bigint, is_link boolean, is_folder boolean, crc_ok boolean, sha256 string, content binary"
#: Compressed bytes that a task reads, unless one member is larger; bytes that are unpacked at once.
RANGE, PIECE = 64 << 20, 1 << 20


@dataclass
class Members(InputPartition):
    """Neighbouring members: (name, offset of the local header, packed and whole size, method, CRC, link, folder)."""

    archive: str
    entries: list[tuple]


class ZipReader(DataSourceReader):
    """``content`` says up to which size members come with their bytes (none by default); any member is hashed and checked.

    The archive must lie where driver and executors can open it.  Memory is
    bounded by a piece and by ``content``; a damaged member is a row with
    ``crc_ok`` false, not a failure.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.most, self.range = local(options["path"]), int(options.get("content", "-1")), int(options.get("range", str(RANGE)))

    def partitions(self) -> list:
        with zipfile.ZipFile(self.path) as archive:
            found = sorted(archive.infolist(), key=lambda m: m.header_offset)
        out, size = [], self.range
        for m in found:
            if size >= self.range:
                out.append(Members(self.path, []))
                size = 0
            link = stat.S_ISLNK(m.external_attr >> 16)
            out[-1].entries.append((m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, link, m.is_dir()))
            size += m.compress_size
        return out or [Members(self.path, [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        with open(partition.archive, "rb") as f:
            for name, offset, packed, size, method, crc, link, folder in partition.entries:
                digest, check, held, n = hashlib.sha256(), 0, [], 0
                keep = size <= self.most
                try:
                    for piece in _pieces(f, offset, packed, method):
                        digest.update(piece)
                        check, n = zlib.crc32(piece, check), n + len(piece)
                        if n > size:
                            raise ValueError("more bytes than the directory says")
                        held += [piece] if keep else []
                    ok = check == crc and n == size
                except (ValueError, zlib.error):
                    ok = False
                yield partition.archive, name, size, link, folder, ok, digest.hexdigest() if ok else None, b"".join(held) if ok and keep else None


def _pieces(f, offset: int, packed: int, method: int) -> Iterator[bytes]:
    """Unpacked pieces of the member whose local header stands at ``offset``."""
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    f.seek(int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), os.SEEK_CUR)
    unpack = {zipfile.ZIP_STORED: None, zipfile.ZIP_DEFLATED: zlib.decompressobj(-15)}.get(method, False)
    if unpack is False:
        raise ValueError("unknown method")
    while packed:
        raw = f.read(min(PIECE, packed))
        if not raw:
            raise ValueError("cut off")
        packed -= len(raw)
        while raw and unpack is not None:
            yield unpack.decompress(raw, PIECE)
            raw = unpack.unconsumed_tail
        if unpack is None:
            yield raw
    if unpack is not None:
        yield unpack.flush()


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def read_zip(spark: SparkSession, path: str, content: int = -1, range_bytes: int = RANGE) -> DataFrame:
    """A row per member of the archive, with its bytes if they are at most ``content``."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zipmembers").option("path", path).option("content", content).option("range", range_bytes).load()


def member_problems(members: DataFrame, required: list[str]) -> DataFrame:
    """(name, problem): unsafe paths and links, damaged members, and required ones that are absent."""
    c: Column = S.first_failure([(S.unsafe_path(F.col("name")), "unsafe ZIP path"), (F.col("is_link"), "symbolic link"), (~F.col("crc_ok"), "corrupt ZIP member")])
    bad = members.select("name", c.alias("problem")).where("problem is not null")
    want = members.sparkSession.createDataFrame([(n,) for n in required], "name string")
    return bad.unionByName(want.join(members, "name", "left_anti").select("name", F.lit("missing").alias("problem")))


def extract(spark: SparkSession, path: str, out: str, required: list[str], below: str = "", notes: dict[str, str] | None = None) -> dict:
    """Unpacks the members under the folder ``below`` as a tree, if the archive has no problem; returns what it holds.

    All problems are found before anything is written; the tree appears whole or
    not at all, and an existing one is refused.  A member is one row while it is
    written, so it must be below 2 GB.
    """
    members = read_zip(spark, path)
    problems = member_problems(members, required).orderBy("problem", "name").limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{p.problem}: {p.name}" for p in problems))
    start = below.rstrip("/") + "/" if below else ""
    whole = read_zip(spark, path, content=1 << 62).where(~F.col("is_folder") & F.col("name").startswith(start))
    # the bytes are those that were judged: their CRC is checked again as they are read
    rows = whole.select(F.substring("name", len(start) + 1, 1 << 30).alias("path"), F.lit(None).cast("string").alias("source"), F.coalesce("content", F.raise_error(F.concat(F.lit("changed while read: "), "name")).cast("binary")).alias("content"))
    write_tree(rows, out, notes)
    total = members.agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes")).first()
    return {"members": total.members, "bytes": total.bytes}
