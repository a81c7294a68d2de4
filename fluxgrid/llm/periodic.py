"""Periodic run detection: stretches of a text that repeat with a short period, at least four times over.

A run of period q and length 4q or more has at least 3q words that equal the
word q further on, so one of them stands on the grid of the multiples of 3q.
Over all periods the grids have about n ln(n) / 3 points.  The longest common
extensions to both sides of all (period, grid point) pairs are found together,
by binary search over prefix hashes; runs are then verified word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common
from fluxgrid.llm.shingles import word_hashes

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of a period and a grid point that are looked at together.
PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class _Prefixes:
    """Hashes of all stretches of one text, by sums of prefixes modulo 2^64."""

    def __init__(self, words: np.ndarray) -> None:
        self.power = np.full(len(words) + 1, _BASE)
        self.power[0] = 1
        self.power = np.cumprod(self.power, dtype=np.uint64)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.power[:-1], out=self.sums[1:])

    def recur(self, at: np.ndarray, size: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from ``at`` stand again ``period`` words later (a wrong yes is possible)."""
        near = self.sums[at + size] - self.sums[at]
        return near * self.power[period] == self.sums[at + period + size] - self.sums[at + period]


def _longest(holds, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The greatest size between the bounds that holds, for all pairs at once."""
    while (least < most).any():
        middle = (least + most + 1) // 2
        yes = holds(middle)
        least, most = np.where(yes, middle, least), np.where(yes, most, middle - 1)
    return least


def _grid(n: int, most_pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(periods, grid points) of a text of ``n`` words, in blocks."""
    periods = np.arange(1, n // LEAST_PERIODS + 1)
    step = (LEAST_PERIODS - 1) * periods
    points = (n - periods - 1) // step + 1
    ends = np.cumsum(points)
    a = 0
    while a < len(periods):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + most_pairs, side="right")))
        q = np.repeat(periods[a:b], points[a:b])
        within = np.arange(len(q)) - np.repeat(ends[a:b] - points[a:b] - base, points[a:b])
        yield q, within * (LEAST_PERIODS - 1) * q
        a = b


def _exact(words: list[bytes], q: int, g: int) -> tuple[int, int, int]:
    """(start, end, period) around a grid point, word by word: where a hash said yes wrongly."""
    a = b = g
    while b + q < len(words) and words[b] == words[b + q]:
        b += 1
    while a and words[a - 1] == words[a - 1 + q]:
        a -= 1
    return a, b + q, q


def runs_of(words: list[bytes], hashes: np.ndarray, most_pairs: int = PAIRS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    prefixes = _Prefixes(hashes)
    found: dict[tuple[int, int, int], int] = {}
    for q, g in _grid(n, most_pairs):
        same = hashes[g] == hashes[g + q]
        q, g = q[same], g[same]
        # of the 3q or more words around a point of a run, a whole period stands before or behind it
        forth = np.flatnonzero(g + 2 * q <= n)
        back = np.flatnonzero(g >= q)
        hit = np.zeros(len(q), bool)
        hit[forth] = prefixes.recur(g[forth], q[forth], q[forth])
        hit[back] |= prefixes.recur(g[back] - q[back], q[back], q[back])
        q, g = q[hit], g[hit]
        if not len(q):
            continue
        after = _longest(lambda size: prefixes.recur(g, size, q), np.ones_like(g), n - q - g)  # noqa: B023
        before = _longest(lambda size: prefixes.recur(g - size, size, q), np.zeros_like(g), g)  # noqa: B023
        length = before + after + q
        keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        triples = np.stack([g - before, g + after + q, q], 1)[keep]
        if len(triples):
            unique, at = np.unique(triples, axis=0, return_index=True)
            found.update(zip(map(tuple, unique.tolist()), g[keep][at].tolist(), strict=True))
    least: dict[tuple[int, int], int] = {}
    for (a, b, q), point in sorted(found.items()):
        # the same stretch with a multiple of its smallest period, which comes first and is verified, is the same run
        if (a, b) in least and q % least[a, b] == 0:
            continue
        if words[a : b - q] != words[a + q : b]:
            a, b, q = _exact(words, q, point)
            if b - a < max(LEAST_WORDS, LEAST_PERIODS * q):
                continue
        least[a, b] = min(q, least.get((a, b), q))
    return sorted((a, b - a, q) for (a, b), q in least.items())


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """Which word stands at each place: every tenth id by checksum repeats a stretch of its text, others are as they are."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + np.arange(n - a) % p
    return at


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest exact length / period; of equal ones the first, then the shorter period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _row(doc_id: int | None, words: list[bytes], hashes: np.ndarray) -> tuple:
    at = planted(len(words), doc_id)
    words, hashes = [words[k] for k in at.tolist()], hashes[at]
    runs = runs_of(words, hashes)
    listed = hashlib.sha256("".join(f"{a},{size},{q}\n" for a, size, q in runs).encode()).hexdigest()
    if not runs:
        return doc_id, 0, None, None, None, None, listed, hashlib.sha256(b" ".join(words)).hexdigest()
    change = np.zeros(len(words) + 1, np.int64)
    for a, size, q in runs:
        change[a + q] += 1
        change[a + size] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
    start, length, period = _strongest(runs)
    return doc_id, len(runs), start, length, period, 1000 * length // period, listed, hashlib.sha256(b" ".join([words[k] for k in kept])).hexdigest()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, its number of runs, the strongest run, and digests of all runs and of the text without repeats.

    A null text has no words, a null id no planted stretch; short texts have no
    run: four nulls and the digest of nothing.  Rows with equal ids stand each.
    Only doc_id and text are read; nothing is shuffled, and a text of n words
    needs memory in proportion to n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = common.as_string(batch, "text"), batch.column(0).to_pylist()
            for a, b in common.chunks(texts):
                part = texts.slice(a, b - a)
                hashes, first = word_hashes(part, lower=False)
                edges = first.tolist()
                rows = [_row(ids[a + k], (text or "").encode().split(), hashes[edges[k] : edges[k + 1]]) for k, text in enumerate(part.to_pylist())]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.string()) for c in columns[6:])], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.trimmed(run), SCHEMA)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The periodic runs of all whole documents; rows, nulls and empty texts as in ``periodic_runs``."""
    return periodic_runs(common.table(spark, sf_dir, "documents"))
