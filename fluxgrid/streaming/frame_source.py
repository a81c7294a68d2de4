"""A streaming source of camera frames: each batch has the newest frame of every camera since the last one, and how many it displaced.

A camera is a folder below the source's path; producers publish frames there as
files, whole or not at all.  The offset is each camera's newest frame number,
so a batch that is run again after a restart has the same frames.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fluxgrid.sources.filetree import local

SCHEMA = "camera string, frame_id bigint, captured_ns bigint, payload binary, dropped_since_last int"
CLOSED, FAILED = "_closed", "_failed"
_FRAME = re.compile(r"frame-(\d{20})-(\d{20})\.bin")


class FrameFolder:
    """The producer's side of one camera: numbers grow, a closed one takes no more, a fault goes to the readers."""

    def __init__(self, path: str) -> None:
        self.path = local(path)
        os.makedirs(self.path, exist_ok=True)

    def _put(self, name: str, data: bytes) -> None:
        attempt = os.path.join(self.path, f".{uuid.uuid4().hex}")
        with open(attempt, "wb") as f:
            f.write(data)
        os.replace(attempt, os.path.join(self.path, name))

    def publish(self, frame_id: int, captured_ns: int, payload: bytes) -> None:
        if os.path.exists(os.path.join(self.path, CLOSED)):
            raise RuntimeError("the camera is closed")
        self._put(f"frame-{frame_id:020d}-{captured_ns:020d}.bin", payload)

    def close(self) -> None:
        """No frame comes after this; one that is not read yet still can be."""
        self._put(CLOSED, b"")

    def fail(self, message: str) -> None:
        self._put(FAILED, message.encode())


@dataclass
class Newest(InputPartition):
    camera: str
    path: str
    frame_id: int
    captured_ns: int
    dropped: int


class FrameReader(DataSourceStreamReader):
    """Option ``keep``: "false" removes frames once a batch that passed them is committed."""

    def __init__(self, options: dict) -> None:
        self.root, self.keep = local(options["path"]), options.get("keep", "true") == "true"

    def _frames(self, camera: str) -> list[tuple[int, int, str]]:
        folder = os.path.join(self.root, camera)
        names = os.listdir(folder)
        if FAILED in names:
            with open(os.path.join(folder, FAILED), encoding="utf-8") as f:
                raise RuntimeError(f"camera {camera} failed: {f.read()}")
        return sorted((int(m[1]), int(m[2]), os.path.join(folder, m[0])) for m in map(_FRAME.fullmatch, names) if m)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        cameras = sorted(e.name for e in os.scandir(self.root) if e.is_dir()) if os.path.isdir(self.root) else []
        return {c: found[-1][0] for c in cameras if (found := self._frames(c))}

    def partitions(self, start: dict, end: dict) -> list:
        out = []
        for camera, last in sorted(end.items()):
            fresh = [f for f in self._frames(camera) if start.get(camera, -1) < f[0] <= last]
            if fresh:
                number, captured, path = fresh[-1]
                out.append(Newest(camera, path, number, captured, len(fresh) - 1))
        return out

    def read(self, partition: Newest) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield partition.camera, partition.frame_id, partition.captured_ns, f.read(), partition.dropped

    def commit(self, end: dict) -> None:
        if not self.keep:
            for camera, last in end.items():
                for number, _, path in self._frames(camera):
                    if number <= last and os.path.exists(path):
                        os.unlink(path)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


def read_frames(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """The stream of the newest frames of all cameras below ``path``."""
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("frames").option("path", path).option("keep", str(keep).lower()).load()
