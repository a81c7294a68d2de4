"""Best-fit packing of documents into fixed-length sequences, large items matched first.

Only lengths matter, and there are at most ``capacity`` of them, so packing is
planned on their histogram: pieces above a third of the capacity are matched
greedily, at most two to a sequence, each with the largest that still fits
(which leaves the fewest sequences); shorter ones go, longest first, where
they leave the least gap.  Equal sequences are planned at once, as runs.  A
piece finds its place from its rank among pieces of its length; ranks come from
a range-partitioned order with counts by partition.  The plan is the same as
one over all pieces at once, with nothing but the histogram on the driver.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common, tokens

CAPACITY = 4096


class Plan:
    """Runs of slots: (length, first rank, sequences, pieces in each, first sequence, first offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._rank: dict[int, int] = defaultdict(int)
        self._gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
        self._order: list[int] = []
        left = {n: c for n, c in counts.items() if c > 0}
        if left and not 0 < min(left) <= max(left) <= capacity:
            raise ValueError("lengths must be between 1 and the capacity")
        self._match(left)
        for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._fit(length, left[length])

    def _put(self, length: int, sequences: int, each: int, first: int, gap: int) -> None:
        self.runs.append((length, self._rank[length], sequences, each, first, self.capacity - gap))
        self._rank[length] += sequences * each
        if rest := gap - length * each:
            if rest not in self._gaps:
                self._gaps[rest] = []
                bisect.insort(self._order, rest)
            self._gaps[rest].append((first, sequences))

    def _match(self, left: dict[int, int]) -> None:
        large = sorted(n for n in left if 3 * n > self.capacity)
        while large:
            longest = large[-1]
            at = bisect.bisect_right(large, self.capacity - longest) - 1
            partner = large[at] if at >= 0 else 0
            n = left[longest] // 2 if partner == longest else min(left[longest], left[partner]) if partner else left[longest]
            if not n:  # one left of a length that fits only with itself
                at -= 1
                partner = large[at] if at >= 0 else 0
                n = 1
            first = self.sequences
            self.sequences += n
            rank = self._rank[longest]
            self.runs.append((longest, rank, n, 1, first, 0))
            self._rank[longest] += n
            left[longest] -= n
            if partner:
                self._put(partner, n, 1, first, self.capacity - longest)
                left[partner] -= n
            elif longest < self.capacity:
                self._rank[longest] -= n
                self.runs.pop()
                self._put(longest, n, 1, first, self.capacity)
            large = [x for x in large if left[x]]

    def _fit(self, length: int, n: int) -> None:
        while n:
            at = bisect.bisect_left(self._order, length)
            if at == len(self._order):
                each = self.capacity // length
                full, rest = divmod(n, each)
                for sequences, pieces in ((full, each), (1, rest)):
                    if sequences and pieces:
                        self._put(length, sequences, pieces, self.sequences, self.capacity)
                        self.sequences += sequences
                return
            gap = self._order[at]
            first, sequences = self._gaps[gap].pop()
            if not self._gaps[gap]:
                del self._gaps[gap], self._order[at]
            each = gap // length
            full = min(n // each, sequences)
            n -= full * each
            if full:
                self._put(length, full, each, first, gap)
            if full < sequences:
                used = int(n > 0)
                if used:
                    self._put(length, 1, n, first + full, gap)
                    n = 0
                if spare := sequences - full - used:
                    if gap not in self._gaps:
                        self._gaps[gap] = []
                        bisect.insort(self._order, gap)
                    self._gaps[gap].append((first + full + used, spare))

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs sorted by (length, first rank), and that pair as one key."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 6)
        return runs, (runs[:, 0] << 48) | runs[:, 1]


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, ids and the end id cut only where too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in tokens.encoded_documents(batch, path):
                raw = ids.astype("<u4").tobytes()
                for j, at in enumerate(range(0, len(ids), capacity)):
                    part = raw[4 * at : 4 * (at + capacity)]
                    row.append(k)
                    piece.append(j)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone, one piece of length 1.  Documents
    with the same id, or with a null one, are packed each.  Only doc_id and
    text are read; an empty table gives no rows.
    """
    cut = common.materialise(pieces(docs, path or tokens.vocabulary_path(), capacity), "pieces")
    placed = common.global_order(cut, [F.col("length").desc(), F.col("doc_id"), F.col("piece")], "lengths")
    # as many rows as lengths and partitions together: partitions are ranges of lengths
    here = defaultdict(list)
    for part, length, n in placed.groupBy("_part", "length").count().collect():
        here[part].append((length, n))
    counts: dict[int, int] = defaultdict(int)
    before: dict[int, dict[int, int]] = {}
    for part in sorted(here):
        before[part] = {}
        for length, n in here[part]:
            before[part][length] = counts[length]
            counts[length] += n
    runs, keys = Plan(counts, capacity).lookup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if ranks is None:
                ranks = dict(before[batch.column(5)[0].as_py()])
            length = batch.column(3).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.diff(length, prepend=-1))
            rank = np.arange(len(length)) - np.repeat(head, np.diff(np.append(head, len(length))))
            for a, b in zip(head, np.append(head[1:], len(length)), strict=True):
                rank[a:b] += ranks[int(length[a])]
                ranks[int(length[a])] += b - a
            got = runs[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            inside = rank - got[:, 1]
            sequence, offset = got[:, 4] + inside // got[:, 3], got[:, 5] + inside % got[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(common.trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return best_fit_pack(common.table(spark, sf_dir, "documents"))
