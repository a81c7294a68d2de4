"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how many copies each of its documents gets
on average.  The whole copies are given at once; the fractions are rounded
dependently: two documents exchange words, at random but without changing
their sum or either expectation, until one fraction is integral.  Blocks of a
source's documents do so independently and keep at most one open document
each; those meet in a reduction tree of fixed fan-in, until one per source is
left and goes to the nearer whole number.  So a source misses its target by at
most half a document.  All random choices are hashes of ids, and blocks
depend on ids and counts only: reruns agree whatever the partitions are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common

WEIGHTS, BUDGET, MOST_COPIES = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a block and open documents that a node of the tree joins.
BLOCK, FAN_IN = 128, 16
_KEPT = "doc_id long, size long, source string, source_size long, target double, base long, fraction double, copies long, key string, block long, row long, tie long"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("size", pa.int64()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("base", pa.int64()), ("fraction", pa.float64()), ("copies", pa.int64()), ("key", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("tie", pa.int64())]
)


def _uniform(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) from two ids."""
    m = (1 << 64) - 1
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9 + 1) & m
    for k in (30, 27):
        x = ((x ^ (x >> k)) * (0xBF58476D1CE4E5B9 if k == 30 else 0x94D049BB133111EB)) & m
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def exchange(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """Move words between fractions ``p`` of size ``s`` and ``q`` of ``t`` until one is 0 or 1.

    ``p * s + q * t`` stays, and over ``u`` uniform in [0, 1) so do both expectations.
    """
    up = min((1 - p) * s, q * t)  # words that p can take from q
    down = min(p * s, (1 - q) * t)
    if u * (up + down) < down:
        p, q = (1.0 if (1 - p) * s <= q * t else p + up / s), (0.0 if q * t <= (1 - p) * s else q - up / t)
    else:
        p, q = (0.0 if p * s <= (1 - q) * t else p - down / s), (1.0 if (1 - q) * t <= p * s else q + down / t)
    return p, q


def round_block(rows: list[tuple[int, int, float]], seed: int, last: bool) -> list[float]:
    """Fractions of (doc_id, size, fraction) rows after exchanges in order; at most one stays open, none if ``last``."""
    out = [f for _, _, f in rows]
    held = -1
    for k, (doc, size, _) in enumerate(rows):
        if not 0.0 < out[k] < 1.0:
            continue
        if held < 0:
            held = k
            continue
        out[held], out[k] = exchange(out[held], rows[held][1], out[k], size, _uniform(rows[held][0], doc, seed))
        held = held if 0.0 < out[held] < 1.0 else k if 0.0 < out[k] < 1.0 else -1
    if last and held >= 0:
        out[held] = float(round(out[held]))  # the nearer of both: the source misses its target by half a document at most
    return out


def _rounded(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        # long documents first: what stays open at the end is short
        rows.sort(key=lambda r: (-r["size"], r["doc_id"] is None, r["doc_id"] or 0, r["fraction"], r["tie"], r["row"] or 0))
        after = round_block([(r["doc_id"] or 0, r["size"], r["fraction"]) for r in rows], seed, last)
        for r, f in zip(rows, after, strict=True):
            r["fraction"], r["copies"] = f, None if 0.0 < f < 1.0 else r["base"] + int(f)
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    return run


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, n, target) for every source: weights by rank, cut at ``most`` times the size and reshared.

    Ranks come from a range-partitioned order; a round of resharing is one
    aggregate over sources, so their number may be large.
    """
    spark = sizes.sparkSession
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by = common.global_order(by, [F.col("source").asc_nulls_last()], "sources")
    counts = {r[0]: r[1] for r in by.groupBy("_part").count().collect()}
    base, at = {}, 0
    for part in sorted(counts):
        base[part], at = at, at + counts[part]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = None
        for batch in batches:
            if batch.num_rows:
                k = base[batch.column(3)[0].as_py()] if k is None else k
                w = [float(weights[(k + i) % len(weights)]) for i in range(batch.num_rows)]
                k += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(w, pa.float64())], names=["source", "source_size", "n", "weight"])

    by = common.materialise(by.mapInArrow(ranked, "source string, source_size long, n long, weight double"), "shares")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    goal, level = budget * total, None  # level: words per unit of weight of the sources that are not cut
    while True:
        cut = F.lit(False) if level is None else F.col("weight") * level >= F.col("source_size") * most
        spent, free = by.agg(F.sum(F.when(cut, F.col("source_size") * most)), F.sum(F.when(~cut, F.col("weight")))).first()
        now = (goal - (spent or 0)) / free if free else math.inf
        if not free or level is not None and now <= level * (1 + 1e-12):
            break
        level = now
    limit = F.col("source_size") * float(most)
    target = limit if level is None else F.least(limit, F.col("weight") * F.lit(level))
    return by.select("source", "source_size", "n", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES, seed: int = 11, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    ``taken`` is ``size`` times ``copies``, a whole number of at most ``most``.
    A null text has size 0 and takes 0 words; a null source is a source of its
    own, after all others.  Documents with the same id, or none, are separate
    documents; ``row`` names a column of unique longs to tell them apart by, which
    is returned too and decides nothing but between equal texts of one id.
    Other columns are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.lit(None).cast("long").alias("row") if row is None else F.col(row).cast("long").alias("row"), F.xxhash64("text").alias("tie"))
    sized = common.materialise(sized, "sized")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("key")
    by = common.materialise(shares(sized, weights, budget, most).select(key, "source_size", "n", "target"), "targets")
    rows = common.small_join(sized.withColumn("key", key), by, ["key"], "inner")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(copies + 1e-12)).withColumn("fraction", F.greatest(copies - F.col("base"), F.lit(0.0)))
    rows = rows.withColumn("fraction", F.when((F.col("fraction") < 1e-12) | (F.col("size") == 0), 0.0).otherwise(F.col("fraction")))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie"), blocks)).withColumn("copies", F.lit(None).cast("long"))
    names = [f.split()[0] for f in _KEPT.split(", ")]
    largest = by.agg(F.max("n")).first()[0] or 0
    left = math.ceil(largest / BLOCK)
    done, depth = [], 0
    open_ = rows.select(*names)
    while True:
        last = left <= 1
        after = common.materialise(open_.groupBy("key", "block").applyInArrow(_rounded(seed + depth, last), _KEPT), "rounded")
        done.append(after.where("copies is not null"))
        if last:
            break
        open_ = after.where("copies is null").withColumn("block", F.floor(F.col("block") / FAN_IN))
        left, depth = math.ceil(left / FAN_IN), depth + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *([] if row is None else [F.col("row").alias(row)]))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the 3 : 1 : 2 mix of half again their size takes of each."""
    return mix_sources(common.table(spark, sf_dir, "documents"))
