"""Exact n-gram Jaccard self-join by PartEnum signatures.

A text's features are its distinct word shingles as 64-bit fingerprints; equal
sets are one *node*.  Sizes fall into bands of a factor four.  Each band cuts
the feature domain into ``parts`` ranges; a signature stands for all features
that a set has in one part, the enumerated subset being that single part.  Two
sets with Jaccard >= t differ in at most ``(1 - t) / t`` of the smaller's size
features, hence in at most so many parts; among the non-empty parts, which by
the choice of ``parts`` are more than that, some signature is the same.  In an
order common to all sets, the first (differences + 1) signatures of either side,
its *main* ones, then share one.  All are sent, so that what a node has besides hot
ones is known.  A set whose size reaches into the band below emits there too; two such sets meet
in their own band, so that below only groups with a set of that band matter.

Signatures with more than ``group_cap`` nodes are *hot*.  A node that has more others
than a link may change does without them.  The rest, which are *bound* (large groups
of near copies, texts that are mostly common passages), settle in two steps.
First a few pivots of each hot group are compared with all of it, which connects
the families.  A bound node then links with no other component if more of its hot
signatures than a link may change are held by its own component's bound nodes alone.
Until then a bound node is one row with its signatures, which are rows only while they are grouped.
Those left meet by their features: with needed overlap ``t * size``, the
``size - t * size + 1`` rarest in an order common to all hold a shared one, and only
components that share one are compared, pivots first.  No pair is dropped by a cap.

A pair of a small group must share as many signatures as a link leaves either side.
Pairs not connected yet are compared on bitmaps of their features, whose differing
bits are no more than the features that differ, and if that leaves a link possible,
exactly, on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common
from fluxgrid.llm.shingles import U, mix, shingle_sets

#: Largest size of the first band and its parts; both grow by four from band to band.
BAND_SIZE, BAND_PARTS = 384, 256
#: Signatures of a bucket, of the slices in which a task works through it, and bytes of text that make one.
BUCKET_ROWS, SLICE_ROWS, BYTES_PER_SIGNATURE = 2_000_000, 300_000, 9
LOW_BITS = U((1 << 47) - 1)


def _fingerprint(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ U(len(s))]))[0].astype(np.int64)) if len(s) else 0


def _band(size: int) -> int:
    band, most = 0, BAND_SIZE
    while size > most:
        band, most = band + 1, most * 4
    return band


def signatures(s: np.ndarray, band: int) -> np.ndarray:
    """One signature for each non-empty part of the band's domain, in their common order."""
    parts = BAND_PARTS << (2 * band)
    part = ((s >> U(32)) * U(parts)) >> U(32)
    head = np.flatnonzero(np.diff(part, prepend=U(parts)))
    out = mix(np.add.reduceat(mix(s), head) ^ mix(part[head] + U(band << 40)))
    out.sort()
    return out


def _entries(s: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(band, signatures, how many are main) of a set, for its own band and, near the edge, the one below."""
    band = _band(len(s))
    need = len(s) * (den - num) // num + 1
    for b in range(band, max(band - 2, -1), -1):
        if b < band and len(s) * num > (BAND_SIZE << (2 * b)) * den:
            break
        yield b, signatures(s, b), need


def _sized(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_worker_memory()
        for batch in batches:
            text = common.as_string(batch, "text")
            n, fp = [], []
            for a, b in common.chunks(text):
                sets = shingle_sets(text.slice(a, b - a))
                n += map(len, sets)
                fp += map(_fingerprint, sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "h", "n_shingles", "node"])

    return common.trimmed(run)


def _signed(num: int, den: int, buckets: int):
    """Blocks of signatures by bucket: one row per bucket and flush, so that rows stay few whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes, sigs, owner, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            sig, own = np.concatenate(sigs), np.repeat(np.arange(len(owner)), owner)
            bucket = ((sig & LOW_BITS) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            table = np.array(nodes, dtype=np.int64)
            fp, size, info = table[:, 0], table[:, 1].astype(np.uint32), (table[:, 2] << 27 | table[:, 3]).astype(np.uint32)
            out = {"bucket": [], "sig": [], "own": [], "nodes": []}
            for k in range(buckets):
                at = order[cut[k] : cut[k + 1]]
                if len(at):
                    used, local = np.unique(own[at], return_inverse=True)
                    out["bucket"].append(k)
                    out["sig"].append(np.ascontiguousarray(sig[at].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
                    out["own"].append(local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes())
                    out["nodes"].append(fp[used].tobytes() + size[used].tobytes() + info[used].tobytes())
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("sig", pa.binary()), ("own", pa.binary()), ("nodes", pa.binary())]))

        for batch in batches:
            text = common.as_string(batch, "text")
            for a, b in common.chunks(text):
                for s in shingle_sets(text.slice(a, b - a)):
                    if not len(s) or (fp := _fingerprint(s)) in seen:
                        continue
                    if len(seen) < 300_000:  # spares copies within the task; those beyond are only sent twice
                        seen.add(fp)
                    for band, sig, need in _entries(s, num, den):
                        sig &= LOW_BITS
                        sig[:need] |= U(1 << 47)
                        nodes.append((fp, len(s), band, len(sig)))
                        sigs.append(sig)
                        owner.append(len(sig))
                        held += len(sig)
                if held > 500_000:
                    yield flush()
                    nodes, sigs, owner, held = [], [], [], 0
        if held:
            yield flush()
        common.release_worker_memory()

    return run


def _pairs_of_groups(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs within runs of at most the cap: run by length, one triangle each."""
    left, right = [], []
    for g in np.unique(count):
        at, (i, j) = first[count == g], np.triu_indices(int(g), 1)
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _grouped(num: int, den: int, cap: int):
    """The pairs of a bucket's small groups (kind 0; size: signatures shared, sent and sent_b: how many of a's and b's a link leaves) and the members of its hot ones (kind 1)."""
    schema = pa.schema([(k, {"kind": pa.int32(), "band": pa.int32(), "main": pa.bool_()}.get(k, pa.int64())) for k in ("kind", "a", "b", "size", "band", "sent", "sent_b", "main")])

    def run(table: pa.Table) -> pa.Table:
        sig, own, nodes, base = [], [], [], 0
        for s, o, t in zip(table["sig"].to_pylist(), table["own"].to_pylist(), table["nodes"].to_pylist(), strict=True):
            n = len(t) // 16
            rest = np.frombuffer(t, np.uint32, offset=8 * n).astype(np.int64)
            rows = np.empty((n, 4), np.int64)
            rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = np.frombuffer(t, np.int64, n), rest[:n], rest[n:] >> 27, rest[n:] & ((1 << 27) - 1)
            wide = np.zeros((len(s) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(s, np.uint8).reshape(-1, 6)
            sig.append(wide.view(np.uint64).ravel())
            own.append((np.frombuffer(o, np.uint16 if n < 1 << 16 else np.uint32) + np.int64(base)).astype(np.int32))
            nodes.append(rows)
            base += n
        sig, own, nodes = np.concatenate(sig), np.concatenate(own), np.concatenate(nodes)
        ids, local = np.unique(nodes[:, 0], return_inverse=True)
        slices = len(sig) // SLICE_ROWS + 1
        slice_ = ((sig & LOW_BITS) >> U(20)) % U(slices)
        found, hot = [], []
        for k in range(slices):
            at = slice_ == U(k)
            x, y = _slice(sig[at], own[at], nodes, local, len(ids), num, den, cap)
            found.append(x)
            hot.append(y)
        code, times, *leaves = (np.concatenate(x) for x in zip(*found, strict=True))
        code, at, back = np.unique(code, return_index=True, return_inverse=True)
        shared = np.zeros(len(code), np.int64)
        np.add.at(shared, back, times)
        rows, g, main = (np.concatenate(x) for x in zip(*hot, strict=True))
        p, h, n = len(code), len(rows), max(len(ids), 1)
        return pa.Table.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1], np.int32), [p, h])),
                pa.array(np.concatenate([ids[code // 32 // n], rows[:, 0]])),
                pa.array(np.concatenate([ids[code // 32 % n], g])),
                pa.array(np.concatenate([shared, rows[:, 1]])),
                pa.array(np.concatenate([code % 32, rows[:, 2]]).astype(np.int32)),
                pa.array(np.concatenate([leaves[0][at], rows[:, 3]])),
                pa.array(np.concatenate([leaves[1][at], rows[:, 3]])),
                pa.array(np.concatenate([np.zeros(p, bool), main])),
            ],
            schema=schema,
        )

    return run


def _slice(sig: np.ndarray, own: np.ndarray, nodes: np.ndarray, local: np.ndarray, width: int, num: int, den: int, cap: int):
    """((pair and band as one number, signatures shared, left of either side) of small groups, (node rows, signature, main) of hot ones)."""
    main, sig = (sig >> U(47)) == 1, sig & LOW_BITS
    order = np.lexsort((local[own], sig))
    sig, own, main = sig[order], own[order], main[order]
    new = np.ones(len(sig), bool)  # a node that several tasks have sent counts once
    new[1:] = (sig[1:] != sig[:-1]) | (local[own[1:]] != local[own[:-1]])
    sig, own, main = sig[new], own[new], main[new]
    first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
    count = np.diff(np.append(first, len(sig)))
    home = nodes[own, 1] <= BAND_SIZE << (2 * nodes[own, 2])  # sets that are of the band, not from the one above
    of_band = np.bitwise_or.reduceat(home, first) if len(first) else home
    some = (count > 1) & (count <= cap) & of_band
    i, j = _pairs_of_groups(first[some], count[some])
    small, large = np.minimum(nodes[own[i], 1], nodes[own[j], 1]), np.maximum(nodes[own[i], 1], nodes[own[j], 1])
    fits = (small * den >= large * num) & (home[i] | home[j])
    i, j = own[i[fits]], own[j[fits]]
    low = local[i] < local[j]
    i, j = np.where(low, i, j), np.where(low, j, i)
    code, at, times = np.unique((local[i] * width + local[j]) * 32 + nodes[i, 2], return_index=True, return_counts=True)
    i, j = i[at], j[at]
    change = np.minimum(nodes[i, 1], nodes[j, 1]) * (den - num) // num
    hot = np.repeat((count > cap) & of_band, count)
    return (code, times, nodes[i, 3] - change, nodes[j, 3] - change), (nodes[own[hot]], sig[hot].astype(np.int64), main[hot])


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Bytes with the bits of a set's features; at least four to three for a feature."""
    bits = np.zeros((BAND_SIZE << (2 * _band(len(s)))) * 4 // 3, bool)
    bits[(s % U(len(bits))).astype(np.int64)] = True
    return np.packbits(bits)


def _may_link(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of whose features, as far as their bitmaps tell, no more differ than a link allows."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        sizes = np.minimum(batch.column(2).to_numpy(), batch.column(3).to_numpy())
        for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            p, q = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
            n = min(len(p), len(q))  # lengths are powers of two, so the longer folds to the shorter
            p, q = (np.bitwise_or.reduce(v.reshape(-1, n), axis=0) for v in (p, q))
            keep[k] = int(np.bitwise_count(p ^ q).sum(dtype=np.int64)) * num <= (den - num) * int(sizes[k])
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = common.as_string(batch, "text")
        for a, b in common.chunks(text):
            sets = shingle_sets(text.slice(a, b - a))
            found = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_bitmap(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *found], names=["node", "n", "features", "bits"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        inter, union = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for k in range(len(x)):
            p, q = np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)
            both = np.sort(np.concatenate([p, q]), kind="stable")
            inter[k] = np.count_nonzero(both[1:] == both[:-1])
            union[k] = len(both) - inter[k]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter), pa.array(union)], names=["a", "b", "inter", "uni"])


def _with_sides(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (a, b) with columns of either node.  Few pairs are broadcast, and then only the sets that they name are shuffled."""
    few = pairs.count() <= common.BROADCAST_ROWS
    side = {k: sets.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns)) for k in "ab"}
    if few:
        side["a"] = side["a"].join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
    one = side["b"].join(F.broadcast(pairs) if few else pairs, "b")
    return one.join(side["a"], "a").select("a", "b", *(f"{c}_{k}" for c in columns for k in "ab"))


def _linking(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link.  ``a`` may be a hub: its features are joined last and not shuffled with each pair."""
    spark = sets.sparkSession
    with common.arrow_rows(spark, 2_000):
        pairs = common.materialise(pairs, "apart")
        pairs = common.materialise(_with_sides(pairs, sets, ["n", "bits"]).mapInArrow(common.trimmed(partial(_may_link, num=num, den=den)), "a long, b long"), "may")
    with common.arrow_rows(spark, 400):
        got = _with_sides(pairs, sets, ["features"]).mapInArrow(common.trimmed(_compared), "a long, b long, inter long, uni long")
        return common.materialise(got.where(F.col("inter") * den >= F.col("uni") * num).select("a", "b"), "links")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, features = batch.column(0).to_numpy(), [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        size = np.array([len(x) for x in features])
        if len(size):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(features))], names=["node", "size", "feature"])


def _prefixes(population: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(g, node, size, rest): the features by which nodes of ``population`` meet, one row each.

    In an order common to all, rarest in the population first, a link shares one
    of the first ``size - needed + 1`` features of either side.  Features that one
    node has lead to nobody and are left out, but count.  ``rest`` is how
    many features the node has from there on: an overlap that is first met there is no larger.
    """
    with common.arrow_rows(population.sparkSession, 400):
        rows = sets.join(population.select("node"), "node", "left_semi").select("node", "features").mapInArrow(common.trimmed(_exploded), "node long, size long, feature long")
        rows = common.materialise(rows, "features")
    often = rows.groupBy("feature").agg(F.count("*").alias("n")).where("n > 1")
    by = rows.join(often, "feature").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "feature"))).alias("f"))
    alone = F.col("size") - F.size("f")
    wanted = F.col("size") - F.ceil(F.col("size") * num / den) + 1 - alone
    by = by.select("node", "size", alone.alias("alone"), F.slice("f", F.lit(1), F.greatest(wanted, F.lit(0)).cast("int")).alias("f"))
    met = by.select("node", "size", "alone", F.posexplode("f").alias("pos", "f"))
    return common.materialise(met.select(F.col("f.feature").alias("g"), "node", "size", (F.col("size") - F.col("alone") - F.col("pos")).alias("rest")), "prefixes")


def _by_main(bound: DataFrame, *more: str) -> DataFrame:
    """(g, node, size, rest, more): bound nodes by their main signatures."""
    return bound.select(F.explode("mains").alias("g"), "node", "size", F.col("size").alias("rest"), *more)


def _several(groups: DataFrame) -> DataFrame:
    """(g): the groups that hold several components c."""
    return common.materialise(groups.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("g"), "several")


def _of_several(groups: DataFrame) -> DataFrame:
    return common.materialise(common.small_join(groups, _several(groups), ["g"], "left_semi"), "mixed")


class _Links:
    """Components as far as they are known.  Only pairs that are not connected yet are compared."""

    def __init__(self, sets: DataFrame, num: int, den: int) -> None:
        self.sets, self.num, self.den = sets, num, den
        self.label: DataFrame | None = None
        self.labelled = 0

    def _with_component(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        if self.label is None:
            return rows.withColumn(name, F.col(node))
        known = self.label.select(F.col("node").alias(node), F.col("component").alias(name))
        return common.small_join(rows, known, [node], "left", self.labelled).withColumn(name, F.coalesce(name, node))

    def learn(self, pairs: DataFrame) -> None:
        """Compare the pairs (a, b) that are apart."""
        apart = self._with_component(self._with_component(pairs.select("a", "b").distinct(), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
        got = _linking(apart, self.sets, self.num, self.den)
        if self.label is not None:
            if got.isEmpty():
                return
            got = got.union(self.label.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.label = common.materialise(common.connected_components(got), "label")
        self.labelled = self.label.count()

    def mixed(self, groups: DataFrame) -> DataFrame:
        """(g, node, size, rest, c): the groups that hold several components."""
        return _of_several(self._with_component(groups.select("g", "node", "size", "rest"), "node", "c"))

    def unsettled(self, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of the bound nodes (node, band, size, mains, others): those that may link with another component, and the groups (g, node, size, rest, c) of their main signatures that hold several.

        What only one component's bound nodes hold is missing from any bound node of another, and a link leaves no more than ``size * (1 - t) / t`` of them missing.
        """
        seen = common.materialise(self._with_component(bound, "node", "c"), "seen")
        each = seen.select(F.explode(F.concat("mains", "others")).alias("g"), "node", "band", "size", "c")
        pure = common.small_join(each, _several(each), ["g"], "left_anti").groupBy("node", "band").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        settled = common.materialise(pure.where(F.col("n") > F.floor(F.col("size") * (self.den - self.num) / self.num)).select("node", "band"), "settled")
        left = common.materialise(common.small_join(seen, settled, ["node", "band"], "left_anti"), "left")
        return left.drop("c"), _of_several(_by_main(left, "c"))

    def _can(self) -> Column:
        return F.least("rest_a", "rest_b") * (self.num + self.den) >= (F.col("size_a") + F.col("size_b")) * self.num

    def star(self, groups: DataFrame, ranks: list[Column]) -> DataFrame:
        """(a, b): each group's nodes with its pivots, the nodes that come first by one of the ranks."""
        draws = [F.max(F.struct(r.alias("r"), F.xxhash64("node").alias("h"), *_side("a"))) for r in ranks]
        pivots = groups.groupBy("g").agg(F.array(*draws).alias("p")).select("g", F.explode("p").alias("p")).select("g", "p.a", "p.size_a", "p.rest_a")
        pivots = common.materialise(pivots.distinct(), "pivots")
        met = common.small_join(groups.select("g", *_side("b")), pivots, ["g"], "inner")
        return met.where((F.col("a") != F.col("b")) & self._can()).select("a", "b")

    def stragglers(self, groups: DataFrame) -> DataFrame:
        """(a, b): all that is still apart in a group; nodes of its largest component need not meet each other."""
        by = groups.groupBy("g", "c").agg(F.count("*").alias("n"))
        top = common.materialise(by.groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("top")), "top")
        now = common.materialise(common.small_join(groups, top, ["g"], "inner"), "stragglers")
        x = now.where("c <> top").select("g", *_side("a"), F.col("c").alias("c1"), "top")
        y = now.select("g", *_side("b"), F.col("c").alias("c2"))
        met = x.join(y, "g").where((F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("top")) | (F.col("a") < F.col("b"))) & self._can())
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _side(k: str) -> list[Column]:
    return [F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("rest").alias(f"rest_{k}")]


def _by_hash(seed: int, n: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed + i), F.col("node")) for i in range(n)]


def _linked(pairs: DataFrame, bound: DataFrame | None, sets: DataFrame, num: int, den: int, rounds: tuple[int, ...] = (2,)) -> DataFrame:
    """(node, component) of all linked nodes: of the pairs, and of the bound nodes (node, band, size, mains, others) with their hot signatures."""
    links = _Links(sets, num, den)
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links.learn(first if bound is None else first.union(links.star(_by_main(bound), _by_hash(0, 1))))
    links.learn(pairs)
    if bound is None:
        return links.label
    for k, n in enumerate(rounds):
        bound, mixed = links.unsettled(bound)
        if mixed.isEmpty():
            return links.label
        links.learn(links.star(mixed, _by_hash(100 * k + 1, n)))
    population = common.materialise(links.unsettled(bound)[1].select("node").distinct(), "unsettled")
    if population.isEmpty():
        return links.label
    groups = links.mixed(_prefixes(population, sets, num, den))
    for k, n in enumerate(rounds):
        if groups.isEmpty():
            return links.label
        links.learn(links.star(groups, [F.col("rest") / F.col("size"), *_by_hash(1_000 + 100 * k, n - 1)]))
        groups = links.mixed(groups)
    if not groups.isEmpty():
        links.learn(links.stragglers(groups))
    return links.label


def ngram_jaccard_join(docs: DataFrame, num: int = 75, den: int = 100, group_cap: int = 32) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``.

    Documents whose five-word shingle sets have Jaccard >= ``num / den`` are
    linked; ``component_id`` is the smallest ``doc_id`` reachable by links.
    Null texts count as empty; empty ones are linked with nothing.  Only
    ``doc_id`` and ``text`` are read, so further columns do not matter.  Rows
    that repeat a ``doc_id`` are separate rows, linked by their own texts.  Rows
    without ``doc_id`` are linked as others are, but name no component: theirs is the
    smallest id among those reachable, null if there is none.  An empty table
    gives no rows.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must be in (0, 1]")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    with common.scratch(docs.sparkSession) as keep:
        return _joined(docs, num, den, group_cap, keep)


def _joined(docs: DataFrame, num: int, den: int, group_cap: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result, lazily, from the two tables that are kept."""
    sized = common.materialise(docs.mapInArrow(_sized(num, den), "doc_id long, h long, n_shingles long, node long"), "sized")

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, size // BYTES_PER_SIGNATURE // BUCKET_ROWS)
    blocks = docs.select("text").mapInArrow(_signed(num, den, buckets), "bucket int, sig binary, own binary, nodes binary")
    found = blocks.groupBy("bucket").applyInArrow(_grouped(num, den, group_cap), "kind int, a long, b long, size long, band int, sent long, sent_b long, main boolean")
    found = common.materialise(found, "groups")

    # hot groups: a node is free of them if more other signatures are left than a link may change; bound if not
    hot = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("g"), "size", "band", "main", "sent")
    lists = [F.collect_list(F.when(which, F.col("g"))).alias(k) for k, which in (("mains", F.col("main")), ("others", ~F.col("main")))]
    heat = hot.groupBy("node", "band").agg(F.count("*").alias("hot"), F.first("size").alias("size"), F.first("sent").alias("sent"), *lists)
    free = F.col("sent") - F.col("hot") > F.floor(F.col("size") * (den - num) / num)
    heat = common.materialise(heat.select("node", "band", "hot", "size", *(F.when(~free, F.col(k)).alias(k) for k in ("mains", "others")), free.alias("free")), "heat")
    bound = common.materialise(heat.where("not free").select("node", "band", "size", "mains", "others"), "bound")
    some_bound = not bound.isEmpty()

    # of all pairs of small groups, those that share as many signatures as a link leaves either side, less its hot ones
    pairs = found.where("kind = 0").groupBy("a", "b", "band").agg(F.sum("size").alias("shared"), F.first("sent").alias("sent_a"), F.first("sent_b").alias("sent_b"))
    for side in ("a", "b"):
        pairs = pairs.join(heat.select(F.col("node").alias(side), "band", F.col("hot").alias(f"hot_{side}")), [side, "band"], "left")
        pairs = pairs.where(F.col("shared") >= F.col(f"sent_{side}") - F.coalesce(f"hot_{side}", F.lit(0)))
    pairs = pairs.select("a", "b").distinct()

    # the shingle sets of all nodes that any comparison needs, from one document each, found by its id and text
    pairs = common.materialise(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    if some_bound:
        wanted = wanted.union(bound.select("node"))
    named = sized.where("n_shingles > 0").select("node", F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h").alias("d"))
    holder = named.groupBy("node").agg(F.min("d").alias("d")).join(wanted.distinct(), "node")
    holder = common.materialise(holder.select("node", F.coalesce("d.doc_id", F.lit(0)).alias("id"), F.col("d.bare").alias("bare"), F.col("d.h").alias("h")), "holder")
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("bare"), "h", "text")
    texts = common.small_join(texts, holder, ["id", "bare", "h"], "inner").groupBy("node").agg(F.first("text").alias("text"))
    sets = common.materialise(texts.mapInArrow(common.trimmed(_as_sets), "node long, n long, features binary, bits binary"), "sets")
    label = _linked(pairs, bound if some_bound else None, sets, num, den)

    # back to documents; only nodes that are linked or have copies need a lookup
    per = sized.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    per = per.join(label, "node", "left")
    group = per.where("component is not null").groupBy("component").agg(F.min("low").alias("root"))
    found = per.where("component is not null or copies > 1").join(group, "component", "left").select("node", F.coalesce("root", "low").alias("component_id"))
    found = keep(common.materialise(found, "found"))
    return common.small_join(keep(sized), found, ["node"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """All documents with the class that five-word shingles at Jaccard 0.75 put them in."""
    return ngram_jaccard_join(common.table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
n AS (SELECT doc_id, len(s) AS n FROM sets),
f AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM f x JOIN f y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(min(r) AS BIGINT) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY 1, 2
"""
