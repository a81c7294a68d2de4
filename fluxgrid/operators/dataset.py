"""Labelled-image datasets: parsing, harmonising, de-duplicating, auditing, decontaminating."""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S


def split_rank(split: Column) -> Column:
    return F.when(split == "test", 3).when(split == "val", 2).otherwise(1)


def _fields(lines: DataFrame) -> DataFrame:
    """Non-blank lines with ``_n`` (tokens), ``class_id`` and four numbers ``_1`` to ``_4``; ``_c`` has all numbers of a longer line.

    Each is a column of its own projection, so that no rule splits or parses a line again.
    """
    t = lines.withColumn("_t", S.tokens(F.col("text"))).withColumn("_n", F.size("_t")).where("_n > 0")
    numbers = {f"_{k}": S.parse_float(F.get("_t", F.lit(k))) for k in range(1, 5)}
    longer = F.when((F.col("_n") >= 7) & (F.col("_n") % 2 == 1), F.transform(F.slice("_t", 2, F.col("_n") - 1), lambda x: S.parse_float(x)))
    return t.withColumns({"class_id": S.parse_int(F.get("_t", F.lit(0))), **numbers, "_c": longer}).drop("_t")


def _boxes(t: DataFrame) -> DataFrame:
    """Adds center and size of a detection or a polygon as ``_cx``, ``_cy``, ``_w``, ``_h``: nulls if a line is neither."""
    four = F.col("_n") == 5
    for k in range(1, 5):
        four = four & F.col(f"_{k}").isNotNull()
    sure = F.when(~F.exists("_c", lambda x: x.isNull()), F.col("_c"))
    at = lambda odd: F.filter(sure, lambda _, i: i % 2 == odd)
    t = t.withColumns({"_x1": F.array_min(at(0)), "_x2": F.array_max(at(0)), "_y1": F.array_min(at(1)), "_y2": F.array_max(at(1))})
    x1, x2, y1, y2 = (F.col(c) for c in ("_x1", "_x2", "_y1", "_y2"))
    box = {"_cx": ("_1", (x1 + x2) / 2), "_cy": ("_2", (y1 + y2) / 2), "_w": ("_3", x2 - x1), "_h": ("_4", y2 - y1)}
    return t.withColumns({name: F.when(four, F.col(field)).otherwise(polygon) for name, (field, polygon) in box.items()}).drop("_1", "_2", "_3", "_4", "_c", "_x1", "_x2", "_y1", "_y2")


def parse_labels(lines: DataFrame, class_map: DataFrame) -> DataFrame:
    """Adds status (kept, dropped, error), error, target_class and the box to each non-blank line.

    ``class_map`` has (source, class_id, source_class, target_class, mapped).
    A line of a class mapped to nothing is dropped before its box is looked at.
    """
    t = _boxes(_fields(lines))
    known = class_map.select("source", F.col("class_id").cast("bigint").alias("class_id"), "source_class", "target_class", "mapped")
    j = t.join(known, ["source", "class_id"], "left")
    cx, cy, w, h = (F.col(c) for c in ("_cx", "_cy", "_w", "_h"))
    unit = lambda x: S.finite(x) & x.between(0.0, 1.0)
    error = S.first_failure(
        [
            (F.col("class_id").isNull(), "invalid class id"),
            (F.col("source_class").isNull(), "class id outside source taxonomy"),
            (~F.coalesce("mapped", F.lit(False)), "source class has no explicit mapping"),
            (F.col("target_class").isNull(), F.lit(None).cast("string")),
            (cx.isNull(), "neither detection nor polygon"),
            (~(unit(cx) & unit(cy) & unit(w) & unit(h)), "not normalized"),
            ((w <= 0) | (h <= 0), "width and height must be positive"),
            ((cx - w / 2 < -1e-6) | (cx + w / 2 > 1 + 1e-6), "outside image width"),
            ((cy - h / 2 < -1e-6) | (cy + h / 2 > 1 + 1e-6), "outside image height"),
        ]
    )
    j = j.withColumn("error", error)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("target_class").isNull(), "dropped").otherwise("kept")
    kept = F.col("status") == "kept"
    out = j.withColumn("status", status)
    out = out.withColumns({name: F.when(kept, value) for name, value in (("center_x", cx), ("center_y", cy), ("width", w), ("height", h))})
    return out.drop("_n", "_cx", "_cy", "_w", "_h", "mapped")


def audit_lines(lines: DataFrame, classes: int) -> DataFrame:
    """(key columns, line_no, error) of each non-blank line; the audit's rules: five fields, no polygons, no edge test."""
    t = _fields(lines)
    k, x, y, w, h = (F.col(c) for c in ("class_id", "_1", "_2", "_3", "_4"))
    no = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "))
    error = S.first_failure(
        [
            (F.col("_n") != 5, F.concat(no, F.lit("expected 5 tokens, found "), F.col("_n").cast("string"))),
            (k.isNull() | x.isNull() | y.isNull() | w.isNull() | h.isNull(), F.concat(no, F.lit("non-numeric field"))),
            (~k.between(0, classes - 1), F.concat(no, F.lit("class "), k.cast("string"), F.lit(f" outside [0,{classes})"))),
            (~(x.between(0.0, 1.0) & y.between(0.0, 1.0)), F.concat(no, F.lit("center outside normalized bounds"))),
            (~((w > 0) & (w <= 1.0) & (h > 0) & (h <= 1.0)), F.concat(no, F.lit("box size outside normalized bounds"))),
        ]
    )
    return t.withColumn("error", error).drop("_n", "_1", "_2", "_3", "_4", "_c")


def errors_by_key(audited: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, its errors in line order.

    Lines without an error are left out by the aggregation: a filter would be
    pushed below the parsing and repeat it for every rule.
    """
    bad = audited.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("line_no", "error")))).alias("_e"))
    return bad.where(F.size("_e") > 0).select(*keys, F.transform("_e", lambda e: e["error"]).alias("errors"))


def pair_labels(images: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Images with ``has_label``: a left outer join by stem."""
    return images.join(labels.select(*keys).distinct().withColumn("has_label", F.lit(True)), keys, "left").withColumn("has_label", F.coalesce("has_label", F.lit(False)))


def orphan_labels(labels: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    return labels.join(images.select(*keys).distinct(), keys, "left_anti")


def deduplicate_by_priority(images: DataFrame) -> DataFrame:
    """Adds ``status``: kept, duplicate, all_dropped or missing_label.

    ``images`` has source, split, path, sha256, has_label, lines (non-blank) and
    kept_lines.  Order: split priority, source, path.  The first image that has
    labels left claims its hash; an earlier one whose labels were all dropped
    claims nothing, a later one is a duplicate whatever its labels are.
    """
    rank = F.struct((-split_rank(F.col("split"))).alias("p"), "source", "path")
    claims = F.col("has_label") & ~((F.col("lines") > 0) & (F.col("kept_lines") == 0))
    first = F.min(F.when(claims, F.col("_rank"))).over(W.partitionBy("sha256"))
    status = F.when(~F.col("has_label"), "missing_label").when(F.col("_rank") > F.col("_first"), "duplicate").when(~claims, "all_dropped").otherwise("kept")
    return images.withColumn("_rank", rank).withColumn("_first", F.when(F.col("has_label"), first)).withColumn("status", status).drop("_rank", "_first")


def build_statistics(judged: DataFrame) -> DataFrame:
    """The counters of a build in one pass; annotations dropped by mapping count only for images that were parsed."""
    is_ = lambda s: F.col("status") == s
    parsed = is_("kept") | is_("all_dropped")
    return judged.agg(
        F.count("*").alias("images_seen"),
        F.count_if(is_("missing_label")).alias("missing_label_files"),
        F.count_if(is_("duplicate")).alias("duplicate_images_skipped"),
        F.count_if(is_("all_dropped")).alias("images_skipped_after_all_labels_dropped"),
        F.coalesce(F.sum(F.when(parsed, F.col("lines") - F.col("kept_lines"))), F.lit(0)).alias("annotations_dropped_by_mapping"),
        F.coalesce(F.sum(F.when(is_("kept"), F.col("kept_lines"))), F.lit(0)).alias("annotations_retained"),
        *[F.count_if(is_("kept") & (F.col("split") == s)).alias(f"images_{s}") for s in ("train", "val", "test")],
    )


def ambiguous_lineages(images: DataFrame) -> DataFrame:
    """Lineage keys that occur in several splits, with how many images have them."""
    by = images.withColumn("lineage", S.lineage_key(F.col("stem"))).groupBy("lineage")
    return by.agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count("*").alias("images")).where(F.size("splits") > 1)


def exact_groups(records: DataFrame) -> DataFrame:
    """Hashes with several paths: sorted splits and paths, and whether they cross splits."""
    g = records.groupBy("sha256").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("n"))
    return g.where("n > 1").withColumn("cross_split", F.size("splits") > 1)


#: Keys that one hash may be looked up under in one slice.
MOST_PROBES = 4_096


def probe_plan(threshold: int, weights: list[float], n: int) -> list[tuple[int, list[int]]]:
    """Slices of the 64 bits as (mask, flips): hashes within ``threshold`` bits agree in a slice's bits after one of its flips.

    With m slices, some slice differs in no more than threshold / m bits, and
    all but the first threshold mod m + 1 slices need look one bit less far.
    Bits go to the slices in turn, by ``weights`` (their entropy), so that each
    tells as much as another and neighbours are apart.  m is chosen for ``n``
    hashes: keys to look up against pairs that will meet.
    """
    if not 0 <= threshold < 64:
        raise ValueError("the threshold must be in [0, 63]")
    order = sorted(range(64), key=lambda b: (-weights[b], b))
    best = None
    for m in range(1, threshold + 2):
        reach, rest = divmod(threshold, m)
        slices = [(order[k::m], reach if k <= rest else reach - 1) for k in range(m)]
        keys = [sum(comb(len(bits), i) for i in range(r + 1)) for bits, r in slices]
        if max(keys) > MOST_PROBES:
            continue
        met = sum(k / 2 ** sum(weights[b] for b in bits) for k, (bits, _) in zip(keys, slices, strict=True))
        cost = n * sum(keys) + n * n / 2 * min(met, m)
        if best is None or cost < best[0]:
            best = (cost, [s for s in slices if s[1] >= 0])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = lambda bits: signed(sum(1 << b for b in bits))
    return [(masks(bits), [masks(flip) for i in range(reach + 1) for flip in combinations(bits, i)]) for bits, reach in best[1]]


#: Comparisons within a tile that cost as much as one row of a join; most hashes to a side of a tile, and of them compared at once; blocks of a large table.
ROW_COST, TILE, STRIP, LEAST_BLOCKS = 50, 16_384, 32, 16


def _rows_met(plan: list[tuple[int, list[int]]], weights: list[float], n: int) -> float:
    """Keys and meeting rows that a plan makes of ``n`` hashes, by the bits' entropy."""
    share = lambda mask: 2.0 ** -sum(weights[b] for b in range(64) if mask >> b & 1)
    return n * sum(len(flips) + n / 2 * min(len(flips) * share(mask & (1 << 64) - 1), 1) for mask, flips in plan)


def _tiled_pairs(values: DataFrame, threshold: int, n: int) -> DataFrame:
    """(hash_l, hash_r, distance) of distinct values by comparing all, a tile of two blocks to a group.

    Where most slices meet by chance, that takes less than rows that meet to be
    dropped.  A task holds two blocks and a strip of their distances.
    """
    blocks = max(-(-n // TILE), min(LEAST_BLOCKS, -(-n // 256)))

    def run(tile: pa.Table) -> pa.Table:
        block, h = tile["block"].to_numpy(), tile["dhash64"].to_numpy()
        i = block.min()
        left, right = h[block == i], h[block != i]
        one = not len(right) and tile["one"][0].as_py()
        right = left if one else right
        out = [np.empty((3, 0), np.int64)]
        for at in range(0, len(left), STRIP):
            part = left[at : at + STRIP]
            distance = np.bitwise_count((part[:, None] ^ right[None, :]).view(np.uint64))
            a, b = np.nonzero(distance <= threshold)
            x, y = part[a], right[b]
            keep = x < y if one else np.ones(len(x), bool)
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y), distance[a, b].astype(np.int64)])[:, keep])
        found = np.concatenate(out, axis=1)
        return pa.table({"hash_l": found[0], "hash_r": found[1], "distance": found[2].astype(np.int32)})

    own = F.pmod(F.xxhash64("dhash64"), F.lit(blocks))
    rows = values.where("dhash64 is not null").select("dhash64", own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    rows = rows.select("dhash64", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") == F.col("other")).alias("one"))
    return rows.groupBy("i", "j").applyInArrow(run, "hash_l long, hash_r long, distance int")


def _spread(pairs: DataFrame, hashes: DataFrame, more: tuple[str, ...]) -> DataFrame:
    """The pairs with ``more`` columns of both sides."""
    for s in "lr" if more else "":
        pairs = pairs.join(hashes.select(F.col("dhash64").alias(f"hash_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in more]), f"hash_{s}")
    return pairs.select("hash_l", "hash_r", "distance", *[f"{c}_{s}" for c in more for s in "lr"])


def hash_pairs(hashes: DataFrame, threshold: int, *more: str) -> DataFrame:
    """(hash_l, hash_r, distance, and ``more`` columns of both) of distinct ``dhash64`` values, hash_l < hash_r, that differ in at most ``threshold`` bits.

    One hash of a pair is looked up under all keys within a slice's reach, the
    other lies under its own, so hashes meet by equality.  A pair is kept in the
    first slice that finds it.  Where that would make more rows than comparing
    all in tiles is worth, tiles are compared.  The figures for the plan, a count and how often
    each bit is set, are one row.
    """
    h = F.col("dhash64")
    bit = lambda k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(1).cast("bigint"))
    first, *ones = hashes.agg(F.count("*"), *[F.coalesce(F.sum(bit(k)), F.lit(0)) for k in range(64)]).first()
    share = [one / first if first else 0.5 for one in ones]
    entropy = [-sum(p * log2(p) for p in (s, 1 - s) if p > 0) for s in share]
    plan = probe_plan(threshold, entropy, first)
    if first * first / 2 < ROW_COST * _rows_met(plan, entropy, first):
        return _spread(_tiled_pairs(hashes.select("dhash64"), threshold, first), hashes, more)
    both = lambda s: [F.col(c).alias(f"{c}_{s}") for c in more]
    keyed = hashes.select(h.alias("hash_r"), *both("r"), F.posexplode(F.array(*[h.bitwiseAND(F.lit(mask)) for mask, _ in plan])).alias("k", "key"))
    flips = F.array(*[F.array(*[F.lit(f) for f in flip]) for _, flip in plan])
    asked = hashes.select(h.alias("hash_l"), *both("l"), F.posexplode(F.array(*[h.bitwiseAND(F.lit(mask)) for mask, _ in plan])).alias("k", "own"))
    asked = asked.select("hash_l", *[f"{c}_l" for c in more], "k", F.explode(F.transform(F.get(flips, F.col("k")), lambda f: F.col("own").bitwiseXOR(f))).alias("key"))
    x = F.col("hash_l").bitwiseXOR(F.col("hash_r"))
    earlier = F.lit(False)
    for k, (mask, flip) in enumerate(plan[:-1]):
        reach = max(bin(f & (1 << 64) - 1).count("1") for f in flip)
        earlier = earlier | ((F.col("k") > k) & (F.bit_count(x.bitwiseAND(F.lit(mask))) <= reach))
    met = asked.join(keyed, ["k", "key"]).where((F.col("hash_l") < F.col("hash_r")) & (F.bit_count(x) <= threshold) & ~earlier)
    return met.select("hash_l", "hash_r", F.bit_count(x).cast("int").alias("distance"), *[f"{c}_{s}" for c in more for s in "lr"])


def near_pairs(records: DataFrame, threshold: int, order: list[str] | None = None) -> DataFrame:
    """Pairs of different split and content whose 64-bit hashes differ in at most ``threshold`` bits.

    Hashes meet first, each value once; then they are spread out to their
    splits, to their contents and to rows, always by equality.  So neither many
    images of one hash in one split nor many copies of one image make pairs
    that a filter would have to drop.
    """
    order = order or ["path"]
    place = lambda c: F.when(F.col(c) == "train", 0).when(F.col(c) == "val", 1).otherwise(2)
    contents = records.select("dhash64", "split", "sha256").distinct()
    values = records.groupBy("dhash64").agg(F.collect_set("split").alias("splits"))
    met = hash_pairs(values, threshold, "splits")
    both = met.unionByName(met.select(F.col("hash_r").alias("hash_l"), F.col("hash_l").alias("hash_r"), "distance", F.col("splits_r").alias("splits_l"), F.col("splits_l").alias("splits_r")))
    own = values.where(F.size("splits") > 1)
    both = both.unionByName(own.select(F.col("dhash64").alias("hash_l"), F.col("dhash64").alias("hash_r"), F.lit(0).alias("distance"), F.col("splits").alias("splits_l"), F.col("splits").alias("splits_r")))
    side = lambda df, s, *more: df.select(F.col("dhash64").alias(f"hash_{s}"), F.col("split").alias(f"split_{s}"), *more)
    both = both.withColumn("split_l", F.explode("splits_l")).withColumn("split_r", F.explode("splits_r")).where("split_l <> split_r").drop("splits_l", "splits_r")
    both = both.where(place("split_l") <= place("split_r"))  # rows are ordered by split first
    for s in "lr":
        both = both.join(side(contents, s, F.col("sha256").alias(f"sha256_{s}")), [f"hash_{s}", f"split_{s}"])
    both = both.where("sha256_l <> sha256_r")
    for s, name in (("l", "left"), ("r", "right")):
        rows = side(records, s, F.col("sha256").alias(f"sha256_{s}"), F.col("path").alias(f"{name}_path"), F.struct(place("split").alias("r"), *order).alias(f"_o{s}"))
        both = both.join(rows, [f"hash_{s}", f"split_{s}", f"sha256_{s}"])
    out = both.where("_ol < _or")
    return out.select(F.col("distance").alias("hamming_distance"), F.col("split_l").alias("left_split"), "left_path", F.col("split_r").alias("right_split"), "right_path")


def removals(pairs: DataFrame, source_of=S.source_prefix) -> DataFrame:
    """Per path to remove: the paths kept instead, by (distance, left, right), and the least distance.

    Only pairs within one source count; the split of lower priority goes.  It is
    not transitive: a removed image still removes others.
    """
    same = pairs.where(source_of(F.col("left_path")) == source_of(F.col("right_path")))
    left_goes = split_rank(F.col("left_split")) < split_rank(F.col("right_split"))
    same = same.where(split_rank(F.col("left_split")) != split_rank(F.col("right_split")))
    by = same.select(F.when(left_goes, F.col("left_path")).otherwise(F.col("right_path")).alias("removed_path"), F.struct("hamming_distance", "left_path", "right_path", F.when(left_goes, F.col("right_path")).otherwise(F.col("left_path")).alias("kept")).alias("_k"))
    g = by.groupBy("removed_path").agg(F.array_sort(F.collect_list("_k")).alias("_k"))
    return g.select("removed_path", F.transform("_k", lambda k: k["kept"]).alias("kept_paths"), F.get("_k", F.lit(0))["hamming_distance"].alias("min_distance"))


def decontaminate(records: DataFrame, pairs: DataFrame, source_of=S.source_prefix) -> DataFrame:
    """The records that stay."""
    return records.join(removals(pairs, source_of).select(F.col("removed_path").alias("path")), "path", "left_anti")


def counts_zero_filled(rows: DataFrame, key: str, domain: list) -> DataFrame:
    """Counts by key with a row for every value of the domain."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    every = spark.createDataFrame([(v,) for v in domain], f"{key} {kind}")
    return every.join(rows.groupBy(key).count(), key, "left").select(key, F.coalesce("count", F.lit(0)).alias("count"))


def suppress_overlaps(detections: DataFrame, keys: list[str], most_iou: float) -> DataFrame:
    """Greedy non-maximum suppression per key, class and frame: a box goes if a better kept one overlaps it more.

    Boxes of one frame are few; the fold over them runs inside one expression.
    """
    item = F.struct((-F.col("confidence")).alias("o"), "box_id", "confidence", "box")
    g = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_a"))
    empty = F.filter("_a", lambda _: F.lit(False))
    kept = F.aggregate("_a", empty, lambda acc, d: F.when(F.exists(acc, lambda k: S.iou(k["box"], d["box"]) > most_iou), acc).otherwise(F.concat(acc, F.array(d))))
    return g.select(*keys, F.inline(kept)).drop("o")
