"""Embedding near-duplicates: an exact metric range join over pivot cells.

On unit vectors, cosine >= c is Euclidean distance <= r = sqrt(2 - 2c).  Pivots,
a sample whose size grows with the table, split the vectors into cells by
nearest pivot.  If y of cell q is within r of x of cell h, then by the triangle
inequality d(x, q) <= d(x, h) + 2r and d(x, q) <= (radius of q) + r, and by the
hyperplane between the pivots (d(x, q)^2 - d(x, h)^2) / (2 d(h, q)) <= r: x is
replicated to the cells where all three hold, so that each cell joins alone.  A
cell's own vectors are dealt to tiles, its vectors and replicas to strips, both of
bounded size, and each tile meets each strip in a task.  Equal vectors are
one row with a count.  A vector's links are counted in its own cell only, once each;
tiles return counts and a spanning forest of their links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common

#: Vectors that a cell has on average, that a tile and a strip have, and that are compared at once.
CELL, TILE, STRIP, BLOCK = 8_192, 4_096, 16_384, 1_024
#: Least number of pivots, bytes up to which every task holds them, and distances to pivots that a task works on at once.
LEAST_PIVOTS, MOST_PIVOT_BYTES, DISTANCES = 4, 64 << 20, 4 << 20
COSINE = 0.95
EDGE = 1e-9


def unit(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row numbers, lengths, unit vectors in double) of the rows that can link."""
    column = batch.column(batch.schema.get_field_index(name))
    rows, vectors = [], []
    for k, v in enumerate(column):
        if v.is_valid:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if len(x) and np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                x = x / top  # squares neither overflow nor vanish
                rows.append(k)
                vectors.append(x / math.sqrt(float(x @ x)))
    return np.array(rows, np.int64), np.array([len(v) for v in vectors], np.int64), vectors


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows; those that cannot link have no size and no vector."""
    for batch in batches:
        rows, size, vectors = unit(batch, "embedding")
        sizes, found = [None] * batch.num_rows, [None] * batch.num_rows
        for k, n, v in zip(rows.tolist(), size.tolist(), vectors, strict=True):
            sizes[k], found[k] = n, v.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(found, pa.binary())], names=["vec_id", "size", "v"])


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _step(pivots: np.ndarray) -> int:
    """Vectors that are held against all pivots at once."""
    return max(16, min(BLOCK, DISTANCES // len(pivots)))


def _assigned(pivots: dict[int, np.ndarray]):
    """The cell of each vector, its nearest pivot of its dimension, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            cell, far = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _matrix(batch.column(2).take(pa.array(at)), size)
                step = _step(pivots[int(size)])
                for a in range(0, len(at), step):
                    dots = x[a : a + step] @ pivots[int(size)].T
                    best = dots.argmax(axis=1)
                    cell[at[a : a + step]] = best
                    far[at[a : a + step]] = np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(best)), best], 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["vec_id", "size", "v", "copies", "cell", "far"])

    return run


def _dealt(pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], tiles: dict[tuple[int, int], int], r: float, strips: dict[tuple[int, int], int] | None = None):
    """One row for each block of the join that needs a vector: (size, cell, tile, strip, own, ...).

    A cell is the tiles of its own vectors times the strips of all that it
    compares them with: an own vector is ``own`` in its tile, in every strip;
    every vector of the cell and every replica is in one strip, in every tile.
    Without ``strips``, only (size, cell, rows), counts for them.
    """
    reach = {s: np.array([radius.get((s, c), -10.0) for c in range(len(p))]) for s, p in pivots.items()}
    count = {s: np.array([tiles.get((s, c), 0) for c in range(len(p))]) for s, p in pivots.items()}
    widths = {s: np.array([(strips or {}).get((s, c), 1) for c in range(len(p))]) for s, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, homes = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            ids = batch.column(0).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                step = _step(pivots[int(size)])
                for a in range(0, len(at), step):
                    some = at[a : a + step]
                    x, home = _matrix(batch.column(2).take(pa.array(some)), size), homes[some]
                    d = np.sqrt(np.maximum(2 - 2 * x @ pivots[int(size)].T, 0))
                    near = d[np.arange(len(some)), home][:, None]
                    gap = np.maximum(np.sqrt(np.maximum(2 - 2 * pivots[int(size)][home] @ pivots[int(size)].T, 0)), 1e-12)
                    take = (d <= near + 2 * r + EDGE) & (d <= reach[int(size)] + r + EDGE) & ((d * d - near * near) / (2 * gap) <= r + EDGE)
                    take[np.arange(len(some)), home] = True
                    row, cell = np.nonzero(take)
                    n = count[int(size)][cell]
                    row, cell, n = row[n > 0], cell[n > 0], n[n > 0]
                    if strips is None:
                        cells, times = np.unique(cell, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), size, np.int32)), pa.array(cells.astype(np.int32)), pa.array(times)], names=["size", "cell", "rows"])
                        continue
                    wide = widths[int(size)]
                    mixed = ids[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    turn = lambda bits, k, m: ((mixed[k] >> np.uint64(bits)) % m.astype(np.uint64)).astype(np.int64)  # noqa: E731, B023
                    r1, c1, t1 = _spread(row, cell, n)
                    r2, c2, s2 = _spread(np.arange(len(some)), home, wide[home])
                    row_, cell_ = np.concatenate([r1, r2]), np.concatenate([c1, c2])
                    tile = np.concatenate([t1, turn(33, r2, np.maximum(count[int(size)][c2], 1))])
                    strip = np.concatenate([turn(21, r1, wide[c1]), s2])
                    own = np.repeat([False, True], [len(r1), len(r2)])
                    pick = pa.array(some[row_])
                    columns = [np.full(len(row_), size, np.int32), cell_.astype(np.int32), tile.astype(np.int32), strip.astype(np.int32), own]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(batch.column(k).take(pick) for k in (0, 3, 2))], names=["size", "cell", "tile", "strip", "own", "vec_id", "copies", "v"])

    return run


def _spread(row: np.ndarray, cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (row, cell) ``n`` times, with the number of the repetition."""
    return np.repeat(row, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Forest:
    """Union-find by path halving over row numbers; the least is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _joined(cosine: float):
    """Links of a tile: (vec_id, links, root): a count for its own vectors, an edge to the least of each group for all."""
    schema = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        flag = table["own"].to_numpy()
        all_ids, v = table["vec_id"].to_numpy(), _matrix(table["v"], size)
        ids, at = np.unique(all_ids, return_inverse=True)
        own, other_rows = at[flag], at[~flag]
        mine, x, copies = v[flag], v[~flag], table["copies"].to_numpy()[~flag]
        links = np.zeros(len(own), np.int64)
        forest = Forest(len(ids))
        for a in range(0, len(own), BLOCK):
            part = slice(a, a + BLOCK)
            for b in range(0, len(x), BLOCK):
                dots = mine[part] @ x[b : b + BLOCK].T
                hit = dots >= cosine - EDGE
                i, j = np.nonzero(hit)
                edge = np.abs(dots[i, j] - cosine) <= EDGE
                if edge.any():  # as close to the bound as rounding: the sum in exact arithmetic decides
                    for k in np.flatnonzero(edge):
                        hit[i[k], j[k]] = math.fsum((mine[a + i[k]] * x[b + j[k]]).tolist()) >= cosine
                    i, j = np.nonzero(hit)
                left, right = own[a + i], other_rows[b + j]
                other = left != right
                links[part] += np.bincount(i[other], weights=copies[b + j[other]], minlength=len(links[part])).astype(np.int64)
                # a spanning forest needs each row's and each column's least partner, and those that these do not connect
                _connect(forest, left[other], right[other])
        root = np.array([forest.find(k) for k in range(len(ids))])
        is_own = np.zeros(len(ids), bool)
        is_own[own] = True
        count = np.zeros(len(ids), np.int64)
        count[own] = links
        keep = is_own | (root != np.arange(len(ids)))
        return pa.Table.from_arrays([pa.array(ids[keep]), pa.array(count[keep]), pa.array(ids[root[keep]])], schema=schema)

    return run


def _connect(forest: Forest, left: np.ndarray, right: np.ndarray) -> None:
    """Join all linked rows: rounds of numpy on current roots, each halving what is left at least."""
    while len(left):
        up = np.fromiter((forest.find(k) for k in left.tolist()), np.int64, len(left)) if len(left) < 64 else _roots(forest, left)
        to = np.fromiter((forest.find(k) for k in right.tolist()), np.int64, len(right)) if len(right) < 64 else _roots(forest, right)
        apart = up != to
        if not apart.any():
            return
        left, right = up[apart], to[apart]
        pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)]), axis=1)
        first = np.unique(pairs[1], return_index=True)[1]
        for x, y in zip(pairs[0, first].tolist(), pairs[1, first].tolist(), strict=True):
            forest.join(x, y)
        left, right = pairs[0], pairs[1]


def _roots(forest: Forest, rows: np.ndarray) -> np.ndarray:
    some, back = np.unique(rows, return_inverse=True)
    return np.array([forest.find(k) for k in some.tolist()])[back]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, tile: int = TILE, strip: int = STRIP) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing; nor do vectors of different lengths.  Rows that repeat a
    ``vec_id``, or have none, are vectors like others: each counts as one and
    gets its own row.  A component is named by its smallest id, by none if it
    has none; a row is kept if its id, or lack of one, is its component's.
    Other columns are not read.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    all_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = common.materialise(all_.mapInArrow(_units, "vec_id long, size int, v binary"), "units")
    # equal vectors are one node with a number of its own: ids may be shared by different vectors
    same = units.where("v is not null").groupBy("size", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    named = common.materialise(same.withColumn("vec_id", F.monotonically_increasing_id()), "nodes")
    nodes = named.select("vec_id", "size", "v", "copies")
    totals = {r[0]: r[1] for r in nodes.groupBy("size").count().collect()}  # by vector length: a schema's, so few
    pivots: dict[int, np.ndarray] = {}
    for size, n in totals.items():
        k = min(max(LEAST_PIVOTS, math.ceil(n / cell)), max(1, MOST_PIVOT_BYTES // (8 * size)))
        chosen = nodes.where(F.col("size") == size).orderBy(F.xxhash64("v"), "v").limit(k).select("v").collect()
        pivots[size] = np.stack([np.frombuffer(r[0], np.float64) for r in chosen])
    assigned = nodes.mapInArrow(_assigned(pivots), "vec_id long, size int, v binary, copies long, cell int, far double")
    assigned = common.materialise(assigned, "assigned")
    cells = assigned.groupBy("size", "cell").agg(F.max("far"), F.count("*")).collect()  # as many as pivots
    radius = {(s, c): far for s, c, far, _ in cells}
    tiles = {(s, c): math.ceil(n / tile) for s, c, _, n in cells}
    r = math.sqrt(2 - 2 * cosine)
    rows = assigned.mapInArrow(_dealt(pivots, radius, tiles, r), "size int, cell int, rows long").groupBy("size", "cell").agg(F.sum("rows")).collect()
    strips = {(s, c): math.ceil(n / strip) for s, c, n in rows}
    dealt = assigned.mapInArrow(_dealt(pivots, radius, tiles, r, strips), "size int, cell int, tile int, strip int, own boolean, vec_id long, copies long, v binary")
    found = dealt.groupBy("size", "cell", "tile", "strip").applyInArrow(_joined(cosine), "vec_id long, links long, root long")
    found = common.materialise(found, "found")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    label = common.connected_components(found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    per = named.join(counts, "vec_id").join(label.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    per = per.select("size", "v", "first_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("_group"))
    # only vectors with links need a lookup; the rest are their own component
    per = common.materialise(per.where("n_links > 0"), "linked")
    names = per.groupBy("_group").agg(F.min("first_id").alias("component_id"))
    per = common.materialise(per.join(names, "_group").select("size", "v", "n_links", "component_id"), "named")
    # a broadcast is bounded by bytes: a hundred for each row that other tables may have
    weight = per.count() * (8 * max(totals, default=0) + 100) // 100
    told = common.small_join(units, per.withColumn("_linked", F.lit(True)), ["size", "v"], "left", rows=weight)
    component = F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")
    return told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component, F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8_near_vectors(spark, sf_dir: str) -> DataFrame:
    """All embeddings with their links at cosine 0.95 and their component."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
