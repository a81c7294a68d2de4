"""Helpers shared by the training-data operators.

Everything that one stage hands to another goes through Spark's own readers
and writers into the folder named by ``spark.checkpoint.dir``, which driver and
executors share, so a lost executor costs a recomputed task and nothing else.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is small enough to be broadcast; beyond it, a shuffled join does the work.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python task handles at once.
CHUNK_BYTES = 1 << 20
#: What operators remember in a Python worker between tasks; workers are shared, so a memory-hungry operator may empty them.
WORKER_CACHES: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where none is set, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not place:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isEmpty() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = now.get() if now.isDefined() else tempfile.mkdtemp(prefix="fluxgrid-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(place)
    return place


#: Paths written inside each open ``scratch`` block, innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes an execution's shuffle files when it ends: what it wrote is committed and never recomputed from them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialise`` writes within are removed at the end, but for those handed to the yielded function, which an outer block has then."""
    own: list[str] = []
    kept: list[str] = []
    _SCRATCH.append(own)

    def keep(df: DataFrame) -> DataFrame:
        held = {f.rpartition("/")[0] for f in df.inputFiles()}
        kept.extend(path for path in own if any(h.endswith(path.partition(":")[2] or path) for h in held))
        own[:] = [path for path in own if path not in kept]
        return df

    try:
        yield keep
    finally:
        _SCRATCH.pop()
        if _SCRATCH:
            _SCRATCH[-1].extend(kept)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in own:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later stages start from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; unlike a written table it keeps the partitions as they are."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, batches for Python have at most so many rows: for stages whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join where ``right`` is unique by ``on``: broadcast only if it is counted to be small, else shuffled.

    In the shuffled form the adaptive planner splits partitions that a hot key makes large.
    """
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, on, how)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of about ``most`` bytes of text each; a longer text is a chunk of its own."""
    if not len(column):
        return
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def trim() -> None:
    """Hand what this Python worker has freed back to the machine: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):  # a C library without malloc_trim keeps its memory
            ctypes.CDLL(None).malloc_trim(0)


def release_worker_memory() -> None:
    """Also give back what other operators' tasks left in this Python worker."""
    for cache in WORKER_CACHES:
        cache.clear()
    trim()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with the worker's freed memory handed back when a task ends."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return to_the_end


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """``fit`` of all rows, run in one task: a bounded sample goes to an executor and only the model to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_memory()
        got = list(batches)
        table = pa.Table.from_batches(got) if got else schema.empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], names=["model"])
        release_worker_memory()

    schema = pa.schema([(f.name, {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in rows.schema])
    with tidy(rows.sparkSession):
        got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0][0]) if got else fit(schema.empty_table())


def as_string(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as 32-bit-offset strings, nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.string()) if column.type != pa.string() else column, "")


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fixed train and test folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def global_order(df: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys``, with the partition in ``_part``, checkpointed.

    A later pass over the result sees the same partitions, so counts by partition
    (as few as there are partitions) give every row its global place without one
    task ever holding all rows.
    """
    n = max(shuffle_partitions(df.sparkSession), 2)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return checkpointed(ranged.withColumn("_part", F.spark_partition_id()))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges of one task, by union-find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b long); component: smallest node.

    Few edges, by count, are united in one task.  More alternate large-star and
    small-star steps: each needs only the minimum of a node's neighbours, which
    is pre-aggregated before the shuffle, so a hub is never gathered in one
    task.  Lineage is cut after each round.
    """
    edges = edges.where("a <> b").select("a", "b")
    if edges.count() <= BROADCAST_ROWS:
        return edges.coalesce(1).mapInArrow(_united, "node long, component long")
    now = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = materialise(now, "edges")
    stamp = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of u is tied to the least of u's closed neighbourhood
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.withColumnRenamed("lo", "u").join(least, "u").select("hi", F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small star: every neighbour below u, and u, are tied to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        now = materialise(tied.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == stamp:
            break
        stamp = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots.join(now.select(F.col("hi").alias("node")), "node", "left_anti"))
