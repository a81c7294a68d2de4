"""Results that depend on the order of all rows of a key, made without gathering a key: folds as affine maps, exact order statistics, digests of sorted rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fluxgrid.session import counted, shared_dir, written

#: Rows that a fold works on at once, and cells of a refinement round.
BLOCK, CELLS = 512, 4_096


def key_changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows, but for the first, whose key differs from the one above."""
    n = batch.num_rows
    differs = np.zeros(max(n - 1, 0), bool)
    for c in keys:
        column = batch.column(c)
        a, b = column.slice(1), column.slice(0, max(n - 1, 0))
        differs |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(differs) + 1


def segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """(rows of one key, whether that key is another than that of the rows before) of sorted batches; a key may come in several parts."""
    last: tuple | None = None
    for batch in batches:
        edges = [0, *key_changes(batch, keys).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                part = batch.slice(a, b - a)
                key = tuple(part.column(c)[0].as_py() for c in keys)
                yield part, key != last
                last = key


def _ranges(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Range partitions by key and order: a key with most of the rows lies in most of them, in order."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    by = [*keys, *order]
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by)


def _map_of(values: np.ndarray, keep: float) -> tuple[float, float]:
    """(a, b): folding the values into e gives a * e + b."""
    n = len(values)
    return keep**n, float((1 - keep) * (keep ** np.arange(n - 1, -1, -1.0) @ values))


def ewma(rows: DataFrame, keys: list[str], order: str, value: str, keep: float = 0.85) -> DataFrame:
    """Per key, keep * before + (1 - keep) * value in order, seeded by the first value; and ``n``, its rows.

    Each range partition folds a key's rows to one affine map; a key has no more
    maps than there are partitions, and they are composed in order.  A null
    value makes the key's result null.
    """
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in ("_a", "_b", "_v")], *[T.StructField(c, T.LongType()) for c in ("_part", "_n", "_nulls")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[list] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        for part, fresh in segments(batches, keys):
            values = pc.cast(part.column("_x"), pa.float64()).to_numpy(zero_copy_only=False)
            if fresh:
                if now:
                    done.append(now)
                if len(done) >= BLOCK:
                    yield out()
                    done.clear()
                now = [*[part.column(k)[0].as_py() for k in keys], 1.0, 0.0, float(values[0]), part.column("_p")[0].as_py(), 0, 0]
            a, b = _map_of(values, keep)
            at = len(keys)
            now[at], now[at + 1], now[at + 4], now[at + 5] = now[at] * a, now[at + 1] * a + b, now[at + 4] + len(values), now[at + 5] + part.column("_x").null_count
        if now:
            done.append(now)
            yield out()

    small = _ranges(rows.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_x")), keys, ["_o", "_x"])
    maps = small.select(*keys, "_x", F.spark_partition_id().cast("long").alias("_p")).mapInArrow(run, schema)
    g = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", "_a", "_b", "_v"))).alias("_m"), F.sum("_n").cast("int").alias("n"), F.sum("_nulls").alias("_z"))
    fold = F.aggregate("_m", F.get("_m", F.lit(0))["_v"], lambda e, m: e * m["_a"] + m["_b"])
    return g.select(*keys, F.when(F.col("_z") == 0, fold).alias("ewma"), "n")


def _folded(values: np.ndarray, start: float, keep: float) -> np.ndarray:
    """The fold after each value, from ``start``: blocks by one matrix, the last of a block going into the next."""
    k = np.arange(BLOCK)
    matrix = np.where(k[:, None] >= k, (1 - keep) * keep ** np.maximum(k[:, None] - k, 0.0), 0.0)
    carry = keep ** (k + 1.0)
    out = np.empty(len(values))
    for a in range(0, len(values), BLOCK):
        v = values[a : a + BLOCK]
        out[a : a + len(v)] = matrix[: len(v), : len(v)] @ v + carry[: len(v)] * start
        start = out[a + len(v) - 1]
    return out


def running_ewma(rows: DataFrame, keys: list[str], order: list[str], value: str, keep: float = 0.85) -> DataFrame:
    """(keys, order, ewma): the fold after every row, in two passes over range partitions.

    Only the first key of a partition can go on from the one before, so one
    affine map per partition, composed on the driver, tells each where to start.
    """
    fields = [rows.schema[k] for k in keys]
    shared_dir(rows.sparkSession)
    ranged = _ranges(rows.select(*keys, *order, F.col(value).cast("double").alias("_x")), keys, order).checkpoint()
    placed = ranged.withColumn("_p", F.spark_partition_id())
    ends = T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("head", T.StructType(fields)), T.StructField("tail", T.StructType(fields)), *[T.StructField(c, T.DoubleType()) for c in ("a", "b", "ta", "tb", "seed")]])
    arrow = to_arrow_schema(ends)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail = key = None
        for part, fresh in segments(batches, keys):
            values = part.column("_x").to_numpy(zero_copy_only=False)
            if fresh:
                key = {k: part.column(k)[0].as_py() for k in keys}
                head = tail if tail is not None and head is None else head
                tail = [key, 1.0, 0.0, float(values[0]), part.column("_p")[0].as_py()]
            a, b = _map_of(values, keep)
            tail[1], tail[2] = tail[1] * a, tail[2] * a + b
        if tail is not None:
            head = head or tail
            yield pa.RecordBatch.from_pylist([{"_p": tail[4], "head": head[0], "tail": tail[0], "a": head[1], "b": head[2], "ta": tail[1], "tb": tail[2], "seed": tail[3]}], schema=arrow)

    starts: dict[int, float] = {}
    before, value_before = None, 0.0
    for r in sorted(placed.select(*keys, "_x", "_p").mapInArrow(summed, ends).collect(), key=lambda r: r["_p"]):  # one row per partition
        goes_on = before is not None and r["head"] == before
        if goes_on:
            starts[r["_p"]] = value_before
        if r["head"] == r["tail"]:
            value_before = r["a"] * (value_before if goes_on else r["seed"]) + r["b"]
        else:
            value_before = r["ta"] * r["seed"] + r["tb"]
        before = r["tail"]

    out = T.StructType([*fields, *[rows.schema[c] for c in order], T.StructField("ewma", T.DoubleType())])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = 0.0, True
        for part, fresh in segments(batches, keys):
            values = part.column("_x").to_numpy(zero_copy_only=False)
            if fresh:
                last = starts.get(part.column("_p")[0].as_py(), float(values[0])) if first else float(values[0])
                first = False
            folded = _folded(values, last, keep)
            last = float(folded[-1])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in (*keys, *order)], pa.array(folded)], names=[*keys, *order, "ewma"])

    return placed.mapInArrow(applied, out)


def _share(by_magnitude: bool) -> Column:
    """Where ``_x`` stands between ``lo`` and ``hi``, from 0 to 1: growing with it, whatever is rounded."""
    x, lo, hi = F.col("_x"), F.col("lo"), F.col("hi")
    if by_magnitude:
        unit = F.greatest(F.greatest(F.abs(lo), F.abs(hi)) * 1e-300, F.lit(5e-324))
        x, lo, hi = (F.signum(v) * F.log(1 + F.abs(v) / unit) for v in (x, lo, hi))
    # halves keep the width of the widest range finite, and may make that of the narrowest zero
    return F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], cells: int = CELLS) -> DataFrame:
    """(keys, count, p: the interpolated percentiles) of the finite values, with memory in proportion to ``cells`` for a key of any size.

    An order statistic is found by refining the range it lies in: rows in the
    range are counted by cell, and the cell that holds the rank, cut to the
    least and greatest value in it, is the next range, until it is one value.
    Cells are even on the values in one round and on their magnitudes in the
    next, so that values of any spread need few.  Each round leaves fewer
    distinct values, so it ends for any values.  Only tables of ranges, a row
    per key and rank, pass from round to round.
    """
    x = F.col(value).cast("double")
    sure = rows.select(*keys, x.alias("_x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # nulls among the keys are values like others
    known = [F.coalesce(F.to_json(F.struct(*keys)), F.lit("")).alias("_k")] if keys else [F.lit("").alias("_k")]
    sure = sure.select(*keys, *known, "_x")
    base = written(sure.groupBy(*keys, "_k").agg(F.count("*").alias("count"), F.min("_x").alias("lo"), F.max("_x").alias("hi")), "ranges")
    at = [F.lit(p) * (F.col("count") - 1) for p in shares]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at])))
    open_ = written(base.select("_k", F.explode(wanted).alias("rank"), "lo", "hi").withColumn("left", F.col("rank")), "ranges")
    done = []
    while True:
        done.append(open_.where("lo = hi").select("_k", "rank", F.col("lo").alias("v")))
        going = open_.where("lo < hi")
        if going.isEmpty():
            break
        spans = counted(written(going.select("_k", "lo", "hi").distinct(), "spans"))
        inside = sure.select("_k", "_x").join(spans, "_k").where("_x between lo and hi")
        cell = F.least(F.floor(F.coalesce(_share(len(done) % 2 == 0), F.lit(0.0)) * cells), F.lit(cells - 1))
        cell = F.when(F.col("_x") == F.col("hi"), cells).otherwise(cell)
        tally = inside.groupBy("_k", "lo", "hi", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = F.sum("n").over(W.partitionBy("_k", "lo", "hi").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow))
        tally = tally.withColumn("_to", upto)
        found = going.join(tally, ["_k", "lo", "hi"]).where("left >= _to - n and left < _to")
        open_ = written(found.select("_k", "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("left") - (F.col("_to") - F.col("n"))).alias("left")), "ranges")
    values = reduce(DataFrame.unionByName, done).groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_v"))
    j = base.join(values, "_k")

    def between(a: Column) -> Column:
        low, high = F.try_element_at("_v", F.floor(a)), F.try_element_at("_v", F.ceil(a))
        return low + (high - low) * (a - F.floor(a))

    return j.select(*keys, "count", F.array(*[between(a) for a in at]).alias("p"))


def sorted_digest(rows: DataFrame, keys: list[str], order: list[Column], line: Column, name: str, count: str) -> DataFrame:
    """Per key the sha256 over its lines in order, and how many there are.

    A digest cannot be put together from parts: a key's sorted rows stream
    through one task in batches, which carries nothing but the digest.
    """
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField(name, T.StringType()), T.StructField(count, T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n = None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, digest.hexdigest(), n], arrow, strict=True)], schema=arrow)
        for part, fresh in segments(batches, keys):
            if fresh:
                if digest is not None:
                    yield row()
                key, digest, n = [part.column(k)[0].as_py() for k in keys], hashlib.sha256(), 0
            digest.update("".join(part.column("_line").to_pylist()).encode())
            n += part.num_rows
        if digest is not None:
            yield row()

    placed = rows.select(*keys, *[o.alias(f"_o{k}") for k, o in enumerate(order)], line.alias("_line"))
    ranged = (placed.repartition(*keys) if keys else placed.coalesce(1)).sortWithinPartitions(*keys, *[f"_o{k}" for k in range(len(order))])
    return ranged.select(*keys, "_line").mapInArrow(run, out)
