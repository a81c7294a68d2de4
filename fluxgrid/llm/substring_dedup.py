"""Substring deduplication: words of windows that start more than once go, wherever they stand.

Pass 1 counts windows in a count-min sketch.  A window is counted where its
anchor is, the 8-word gram of least hash: equal windows have equal anchors at
different places, so the anchor's count is no less than the window's, and there
are about fourteen times fewer anchors than windows.  Tasks emit the cells of
their partial sketches, Spark adds them, and what is left is a bit per cell:
counted twice or more.  Pass 2 groups exactly those windows whose cells are all
set; the few that stand once after all return to their document as exceptions.
Pass 3 removes what is estimated to be repeated and no exception.

The sketch has a fixed size, whatever the input is.  An input of more anchors
than it has cells makes the estimates loose: pass 2 then groups more windows
and finds more exceptions, and no result changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common
from fluxgrid.llm.shingles import mix, word_hashes

#: Words of a window, and of the grams among which its anchor is chosen.
WINDOW, GRAM = 35, 8
#: Rows of the sketch, and bits of a cell's number: 2 x 2^28 cells are 64 MB when merged.
ROWS, CELL_BITS = 2, 28
#: Anchors that a task gathers before it emits their cells.
FLUSH = 1 << 21
#: Bits of a block of the merged sketch, as bitmap_construct_agg makes them.
_BLOCK_BITS = 15
U = np.uint64
_STEP, _BASE = U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15)
#: The inverse of the base modulo 2^64.
_BACK = U(pow(int(_BASE), -1, 1 << 64))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _STEP + right)


class Windows:
    """The windows of a chunk of texts: their hashes, their anchors, and which of them lie in one text."""

    def __init__(self, texts: pa.Array) -> None:
        self.words, self.first = word_hashes(texts, lower=False)
        n, size = len(self.words), np.diff(self.first)
        h = self.words
        span = 1
        while 2 * span <= WINDOW and n >= WINDOW:
            h = _joined(h[:-span], h[span:])
            span *= 2
            if span == GRAM:
                grams = h
        if n < WINDOW:
            self.at = self.hash = self.anchor = np.empty(0, np.int64)
            self.starts = self.lengths = np.empty(0, np.int64)
            self.gram = np.empty(0, np.uint64)
            return
        rest = WINDOW - span
        whole = _joined(h[:-rest], h[rest:]) if rest else h
        #: places in the chunk where a window of one text starts
        self.at = np.flatnonzero(np.arange(len(whole)) + WINDOW <= np.repeat(self.first[1:], size)[: len(whole)])
        self.hash = whole[self.at]
        # the leftmost least gram: 32 bits of its hash, then its place
        key = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        wide, across = 1, WINDOW - GRAM + 1
        while 2 * wide <= across:
            key = np.minimum(key[:-wide], key[wide:])
            wide *= 2
        if across > wide:
            key = np.minimum(key[: wide - across], key[across - wide :])
        place = (key[self.at] & U(0xFFFFFFFF)).astype(np.int64)
        #: windows that share an anchor stand in a row
        self.starts = np.flatnonzero(np.diff(place, prepend=-1))
        self.lengths = np.diff(np.append(self.starts, len(place)))
        self.gram = grams[place[self.starts]]

    def checks(self, at: np.ndarray) -> np.ndarray:
        """A second hash of the windows at these places, of other making: 32 bits."""
        n = len(self.words)
        power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64) for base in (_BASE, _BACK))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.words + _STEP) * power[:-1], out=sums[1:])
        return (mix((sums[at + WINDOW] - sums[at]) * back[at]) >> U(32)).astype(np.uint32).view(np.int32)


def cells(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    """The anchor's cell in each row of the sketch, numbered through."""
    return [((gram >> U(k * bits)) & U((1 << bits) - 1)) + U(k << bits) for k in range(ROWS)]


def sketch(texts: DataFrame, bits: int = CELL_BITS) -> np.ndarray:
    """Bytes of the merged sketch: a bit for each cell that anchors were counted in twice or more.

    What reaches the driver is bounded by the size of the sketch, never by the input.
    """

    def counted(grams: list[np.ndarray]) -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(grams), return_counts=True)
        every = np.concatenate(cells(gram, bits)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.tile(np.minimum(n, 2), ROWS).astype(np.int32))], names=["cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            text = common.as_string(batch, "text")
            for a, b in common.chunks(text):
                held.append(Windows(text.slice(a, b - a)).gram)
                size += len(held[-1])
                if size >= FLUSH:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    merged = texts.select("text").mapInArrow(common.trimmed(run), "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    blocks = merged.groupBy(F.shiftright("cell", _BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))).alias("bits"))
    size = 1 << (_BLOCK_BITS - 3)
    out = np.zeros(max((ROWS << bits) >> 3, size), np.uint8)
    with common.tidy(texts.sparkSession):
        for block, found in blocks.toLocalIterator():
            out[block * size : (block + 1) * size] = np.frombuffer(found, np.uint8)
    return out


def estimated(windows: Windows, held: np.ndarray, bits: int) -> np.ndarray:
    """Which windows the sketch estimates to stand twice or more: all that do, and some others."""
    yes = np.ones(len(windows.gram), bool)
    for cell in cells(windows.gram, bits):
        yes &= (held[(cell >> U(3)).astype(np.int64)] >> (cell & U(7)).astype(np.uint8)) & 1 != 0
    return np.repeat(yes, windows.lengths)


def exceptions(texts: DataFrame, shared, bits: int = CELL_BITS) -> DataFrame:
    """(key, places): windows that the sketch estimates to be repeated and that stand once; places count in the text.

    Each window is a row and is added up before it is shuffled, so a window of
    millions of texts is one row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keys = common.as_string(batch, "text"), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in common.chunks(text):
                windows = Windows(text.slice(a, b - a))
                held = np.flatnonzero(estimated(windows, shared.value, bits))
                if not len(held):
                    continue
                at = windows.at[held]
                owner = np.searchsorted(windows.first, at, side="right") - 1
                # a window that stands here already is no exception: one row of it says so
                high, low = windows.hash[held], windows.checks(at)
                order = np.lexsort((low, high))
                head = np.flatnonzero(np.concatenate([[True], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)]))
                n = np.minimum(np.diff(np.append(head, len(order))), 2)
                first = order[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high[first].view(np.int64)), pa.array(low[first]), pa.array(n.astype(np.int32)), pa.array(keys[a + owner[first]]), pa.array((at - windows.first[owner])[first].astype(np.int32))],
                    names=["high", "low", "n", "key", "place"],
                )

    found = texts.select("text", "key").mapInArrow(common.trimmed(run), "high long, low int, n int, key long, place int")
    single = found.groupBy("high", "low").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("place").alias("place")).where("n = 1")
    return single.groupBy("key").agg(F.collect_list("place").alias("places"))


def substring_dedup(docs: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words; fewer than 35 words make no window and stay.  Rows
    that repeat a text, with the same id or another or none, lose all their
    windows.  Only doc_id and text are read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    shared = spark.sparkContext.broadcast(sketch(texts, bits))
    once = common.materialise(exceptions(texts, shared, bits), "exceptions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, places, ids = common.as_string(batch, "text"), batch.column(2), batch.column(0)
            for a, b in common.chunks(text):
                part = text.slice(a, b - a)
                windows = Windows(part)
                first = windows.first
                starts = np.zeros(first[-1] + 1, np.int64)
                starts[windows.at[estimated(windows, shared.value, bits)]] = 1
                for k, own in enumerate(places.slice(a, b - a)):
                    if own.is_valid:
                        starts[first[k] + own.values.to_numpy()] = 0
                # a word goes if one of the 35 windows that end with it or behind it, in its text, starts a repeated one
                before = np.cumsum(starts[:-1])
                before = before - np.concatenate([np.zeros(min(WINDOW, len(before)), np.int64), before[: max(len(before) - WINDOW, 0)]])
                stays = before == 0
                size, sums = np.diff(first), np.concatenate([[0], np.cumsum(~stays)])
                digests = [hashlib.sha256(b" ".join(compress((t or "").encode().split(), stays[first[k] : first[k + 1]]))).hexdigest() for k, t in enumerate(part.to_pylist())]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(sums[first[1:]] - sums[first[:-1]], pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    # exceptions grow with the input: the planner broadcasts them only where their files are under its own limit of bytes
    return texts.join(once, "key", "left").select("doc_id", "text", "places").mapInArrow(common.trimmed(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All whole documents without the words of repeated windows; rows, nulls and short texts as in ``substring_dedup``."""
    return substring_dedup(common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS x FROM places WHERE i + 34 <= len(w)),
repeated AS (SELECT r, i FROM windows WHERE x IN (SELECT x FROM windows GROUP BY x HAVING count(*) > 1)),
words AS (
  SELECT p.r, p.i, p.w[p.i] AS x, max((d.i IS NOT NULL)::INT) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM places p LEFT JOIN repeated d ON p.r = d.r AND p.i = d.i),
kept AS (SELECT r, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS t FROM words GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
