"""Token ids as Re-Pair grammars: a shard file format with random access.

Documents are range-partitioned and sorted by id (equal ids by a hash of the
text), encoded, and cut into shards.  Within a shard the most frequent adjacent
pairs are replaced by new nonterminals, again and again, until no pair occurs
often enough to save more bytes than its rule takes, or the 16-bit symbols are used up.  One
round replaces all pairs at least ``1 / STEP`` as frequent as the most frequent
one.  No pair crosses a document's end.  A shard stores the rules, the
number of ids that each nonterminal expands to, where each document begins in
symbols and in ids, and the symbols in 16 bits where they fit: a document, or
any range of ids, is decoded without the rest.  Shards are rows of a Parquet
table, written and read by Spark, so any file system that Spark reaches will do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common, tokens

#: Ids of a shard (a longer document is a shard of its own); span of counts that one round replaces.
SHARD_IDS, STEP = 1 << 20, 256
#: A rule takes 12 bytes and each use saves 2 (16-bit symbols), so it is worth its place from 7 uses on.
LEAST_COUNT = 7
#: A pair's code where none stands: its halves are never used.
NONE = 0xFFFFFFFF

SHARD_COLUMNS = "part int, shard int, first_id_at long, doc_ids array<long>, doc_start array<long>, doc_symbol array<long>, base long, rules binary, lengths binary, width int, symbols binary, n_ids long"
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("first_id_at", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_start", pa.list_(pa.int64())), ("doc_symbol", pa.list_(pa.int64())), ("base", pa.int64()), ("rules", pa.binary()), ("lengths", pa.binary()), ("width", pa.int32()), ("symbols", pa.binary()), ("n_ids", pa.int64())]
)


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, whether each is a document's last, rules as id pairs, first nonterminal) of concatenated documents."""
    seq, last = ids.astype(np.uint32), np.zeros(len(ids), bool)
    last[ends - 1] = True
    base = int(seq.max(initial=0)) + 1
    narrow = base < NONE & 0xFFFF  # symbols stay in 16 bits if ids are
    most = (NONE & 0xFFFF) - base if narrow else 1 << 30
    rules: list[np.ndarray] = []
    made = 0
    while made < most and len(seq) > 1:
        half, often, end = seq, None, last[:-1]
        if not narrow:
            # a pair is as frequent as its rarer half at most, so only the frequent symbols are numbered, from 1
            count = np.bincount(seq, minlength=base + made)
            often = np.flatnonzero(count >= least)
            if len(often) >= NONE & 0xFFFF:
                often = np.sort(often[np.argsort(-count[often], kind="stable")[: (NONE & 0xFFFF) - 1]])
            rank = np.zeros(len(count), np.uint32)
            rank[often] = np.arange(1, len(often) + 1)
            half = rank[seq]
            end = end | (half[:-1] == 0) | (half[1:] == 0)
        code = (half[:-1] << np.uint32(16)) | half[1:]
        code[end] = NONE
        runs = np.sort(code)
        head = np.concatenate([[0], np.flatnonzero(runs[1:] != runs[:-1]) + 1])
        pair, times = runs[head], np.diff(head, append=len(runs))
        worth = (times >= least) & (pair != NONE)
        pair, times = pair[worth], times[worth]
        if not len(pair):
            break
        worth = times >= max(least, int(times.max()) // STEP)
        pair = pair[worth][np.argsort(-times[worth], kind="stable")[: most - made]]
        at, which = _places(code, pair)
        # occurrences that overlap: in a run of adjacent ones, every second stands
        head = np.ones(len(at), bool)
        head[1:] = np.diff(at) > 1
        start = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        stands = (at - start) % 2 == 0
        at, which = at[stands], which[stands]
        used = np.bincount(which, minlength=len(pair))
        keep = used >= least
        if not keep.any():
            # pairs in each other's way: the most frequent goes alone, or none is worth a rule
            alone = pair[[int(used.argmax())]]
            at, which = _places(code, alone)
            free = np.ones(len(at), bool)
            for k in range(1, len(at)):
                free[k] = at[k] - at[k - 1] > 1 or not free[k - 1]
            at, which, pair = at[free], which[free], alone
            if len(at) < least:
                break
            keep = np.ones(1, bool)
        at, which = at[keep[which]], (np.cumsum(keep) - 1)[which[keep[which]]]
        pair = pair[keep].astype(np.int64)
        pair = np.stack([pair >> 16, pair & 0xFFFF], axis=1)
        rules.append(pair if often is None else often[pair - 1])
        seq[at] = base + made + which
        last[at] |= last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        made += len(pair)
    return seq, last, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), base


def _places(code: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where one of the pairs stands, in order; which one) by a table of hashed pairs; pairs that lose their slot take part in the next pass."""
    odd, left = 2654435761, np.arange(1, len(pair) + 1, dtype=np.int32)
    places, found = [], []
    while len(left):
        bits = max(10, len(left).bit_length() + 3)
        shift, table = np.uint32(32 - bits), np.zeros(1 << bits, np.int32)
        slot = (pair[left - 1] * np.uint32(odd)) >> shift
        table[slot] = left
        hit = table[(code * np.uint32(odd)) >> shift]
        at = np.flatnonzero(hit)
        which = hit[at] - 1
        true = pair[which] == code[at]
        places.append(at[true])
        found.append(which[true])
        left, odd = left[table[slot] != left], odd * 747796405 % (1 << 32)
    if len(places) == 1:
        return places[0], found[0]
    at, which = np.concatenate(places), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    return at[order], which[order]


class Grammar:
    """A shard's rules; decodes whole symbol ranges or any range of ids."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray) -> None:
        self.base, self.rules = base, rules
        self.length = np.concatenate([np.ones(base, np.int64), lengths])
        self.begin = np.cumsum(lengths) - lengths
        flat = rules.ravel().astype(np.int64)
        while len(inner := np.flatnonzero(flat >= base)):  # as often as rules are nested
            half = np.ones(len(flat), np.int64)
            half[inner] = 2
            second = np.cumsum(half)[inner] - 1
            inside = flat[inner] - base
            flat = np.repeat(flat, half)
            flat[second - 1], flat[second] = rules[inside, 0], rules[inside, 1]
        self.flat = flat.astype(np.uint32)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        count = self.length[symbols]
        ends = np.cumsum(count)
        out = np.repeat(symbols, count)
        inner = np.flatnonzero(out >= self.base)
        if len(inner):
            inside = inner - np.repeat(ends - count, count)[inner]
            out[inner] = self.flat[self.begin[out[inner] - self.base] + inside]
        return out.astype(np.uint32)

    def between(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the symbols' expansion; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.length[symbols.astype(np.int64)])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before : stop - before]


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = [0] * len(rules)
    for k, (x, y) in enumerate(rules.tolist()):
        out[k] = (1 if x < base else out[x - base]) + (1 if y < base else out[y - base])
    return np.array(out, np.int64)


def _row(part: int, shard: int, at: int, doc_ids: list, parts: list[np.ndarray]) -> dict:
    sizes = np.array([len(p) for p in parts])
    ids = np.concatenate(parts)
    symbols, last, rules, base = compress(ids, np.cumsum(sizes))
    width = 2 if base + len(rules) <= 1 << 16 else 4
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    return {
        "part": part, "shard": shard, "first_id_at": at, "doc_ids": doc_ids, "doc_start": np.cumsum(sizes) - sizes, "doc_symbol": first, "base": base,
        "rules": rules.astype("<u4").tobytes(), "lengths": _lengths(rules, base).astype("<u4").tobytes(), "width": width, "symbols": symbols.astype(f"<u{width}").tobytes(), "n_ids": len(ids),
    }


def _written(path: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, at = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            row = _row(part, shard, at, doc_ids, parts)
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=_SCHEMA)

        for batch in batches:
            own = batch.column(0).to_pylist()
            for k, ids in tokens.encoded_documents(batch, path, 4 * common.CHUNK_BYTES):
                if held and held + len(ids) > shard_ids:
                    yield flush()
                    shard, at, doc_ids, parts, held = shard + 1, at + held, [], [], 0
                doc_ids.append(own[k])
                parts.append(ids)
                held += len(ids)
        if held:
            yield flush()

    return run


def write_token_ids(docs: DataFrame, out: str, path: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents, each with the end id, in ascending ``doc_id`` order (nulls first) as shards at ``out``.

    Rows with one id, or without, come in the order of a hash of their texts, so reruns place them alike and no task holds them all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(common.shuffle_partitions(docs.sparkSession), 2)
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(_written(path or tokens.vocabulary_path(), shard_ids), SHARD_COLUMNS).write.parquet(out)


def _grammar(row: dict) -> tuple[Grammar, np.ndarray]:
    """(rules, symbols) of a stored shard."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    return Grammar(row["base"], rules, np.frombuffer(row["lengths"], "<u4").astype(np.int64)), np.frombuffer(row["symbols"], f"<u{row['width']}")


def _offsets(shards: DataFrame) -> dict[int, int]:
    """Ids before each partition: one row per partition reaches the driver."""
    totals = {r[0]: r[1] for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()}
    offsets, at = {}, 0
    for part in sorted(totals):
        offsets[part], at = at, at + totals[part]
    return offsets


def _digests(offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("part", "first_id_at", "base", "rules", "lengths", "width", "symbols", "n_ids")}
                grammar, symbols = _grammar(row)
                ids = memoryview(grammar.expand(symbols).astype("<u4").view(np.uint8))
                doc_ids, start = batch.column("doc_ids")[k].values, batch.column("doc_start")[k].values.to_numpy()
                ends = np.append(start[1:], row["n_ids"])
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(start + (offsets[row["part"]] + row["first_id_at"])), pa.array(ends - start), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return run


def read_token_digests(spark, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards at ``out`` alone."""
    shards = spark.read.schema(SHARD_COLUMNS).parquet(out)
    return shards.mapInArrow(_digests(_offsets(shards)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(wanted: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar, symbols = _grammar(row)
                starts, firsts = [*row["doc_start"], row["n_ids"]], [*row["doc_symbol"], len(symbols)]
                for k, doc_id in enumerate(row["doc_ids"]):
                    if doc_id in wanted:
                        ids = grammar.between(symbols[firsts[k] : firsts[k + 1]], 0, starts[k + 1] - starts[k])
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def read_documents(spark, out: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the given documents; only shards that hold one are read, and only its own symbols are expanded."""
    shards = spark.read.schema(SHARD_COLUMNS).parquet(out)
    held = shards.where(F.exists("doc_ids", lambda x: x.isin(doc_ids)))
    return held.mapInArrow(_documents(doc_ids), "doc_id long, ids array<long>")


def _ranges(offsets: dict[int, int], start: int, stop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = offsets[row["part"]] + row["first_id_at"]
                a, b = max(start - at, 0), min(stop - at, row["n_ids"])
                if a < b:
                    grammar, symbols = _grammar(row)
                    ids = grammar.between(symbols, a, b)
                    yield pa.RecordBatch.from_arrays([pa.array([at + a], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["start", "ids"])

    return run


def read_id_range(spark, out: str, start: int, stop: int) -> DataFrame:
    """(start, ids) of the stored ids ``start`` to ``stop``, one row per shard that holds some of them."""
    shards = spark.read.schema(SHARD_COLUMNS).parquet(out)
    return shards.mapInArrow(_ranges(_offsets(shards), start, stop), "start long, ids array<long>")


def op4_repair_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents' ids written as Re-Pair shards and read back.

    Null and empty texts are their end id alone; documents with equal or null
    ids are kept each, in the order of a hash of their texts; other columns are
    not read; an empty table gives no rows.
    """
    out = f"{common.shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_token_ids(common.table(spark, sf_dir, "documents"), out)
    return read_token_digests(spark, out)
