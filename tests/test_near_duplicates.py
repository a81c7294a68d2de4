"""The near-duplicate queries must have pairs and removals to work on, and those of a plain comparison of all pairs."""

import math
import random

import pytest

from fluxgrid.functions import scalars as S
from fluxgrid.operators import dataset as D
from fluxgrid.plans import catalog

BITS = 18
RANK = {"train": 0, "val": 1}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_all_pairs(spark, sf):
    records = catalog.hash_records(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")).select("path", "split", "dhash64").collect()
    ordered = sorted(records, key=lambda r: (RANK.get(r.split, 2), r.path))
    pairs = {(a.path, b.path) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if a.split != b.split and (a.dhash64 ^ b.dhash64).bit_count() <= BITS}
    got = catalog.QUERIES["near_dup_pairs"](spark, sf).collect()
    assert {(r.left_path, r.right_path) for r in got} == pairs and len(got) == len(pairs)
    # of one source, the record of the split that comes first in train, val, test goes
    gone = {a for a, b in pairs if a.split("__")[0] == b.split("__")[0]}
    assert gone and {r.removed_path for r in catalog.QUERIES["removals"](spark, sf).collect()} == gone
    assert {r.path for r in catalog.QUERIES["decontaminate"](spark, sf).collect()} == {r.path for r in records} - gone


@pytest.mark.parametrize(("threshold", "n"), [(0, 10), (1, 10**6), (4, 10**4), (4, 10**8), (18, 5_000), (18, 10**6), (40, 100), (63, 10)])
def test_every_near_hash_is_looked_up(threshold, n):
    """Hashes within the threshold agree in some slice after one of its flips, whatever the plan."""
    draw = random.Random(threshold)
    plan = D.probe_plan(threshold, [draw.choice([0.0, 0.3, 1.0]) for _ in range(64)], n)
    whole = (1 << 64) - 1
    assert max(len(flips) for _, flips in plan) <= D.MOST_PROBES
    for _ in range(200):
        x = sum(1 << b for b in draw.sample(range(64), draw.randint(0, threshold)))
        assert any(x & mask & whole in {f & whole for f in flips} for mask, flips in plan)


def test_meetings_grow_as_results_do(spark):
    """Keys and meetings by the plan's own figures, for ten times the hashes, against the pairs that there are to find."""
    pairs_share = sum(math.comb(64, i) for i in range(19)) / 2**64
    ratio = []
    for n in (20_000, 200_000, 2_000_000):
        plan = D.probe_plan(18, [1.0] * 64, n)
        met = n * n / 2 * sum(len(flips) / 2 ** bin(mask & (1 << 64) - 1).count("1") for mask, flips in plan)
        ratio.append(met / (n * n / 2 * pairs_share))
    exact = sum(2.0**-w for _, w in S.slice_layout(18)) / pairs_share  # of slices that must be equal
    assert ratio[0] >= ratio[1] >= ratio[2] and ratio[2] < exact / 8


def test_many_images_of_one_hash(spark):
    rows = [("train", f"t{k:05d}", f"c{k}", 7) for k in range(3_000)] + [("val", f"v{k:05d}", "copy", 7) for k in range(200)] + [("test", f"x{k:05d}", "copy", 7) for k in range(200)] + [("test", "near", "n", 6)]
    got = D.near_pairs(spark.createDataFrame(rows, "split string, path string, sha256 string, dhash64 bigint").where("path < 't00010' or path > 't02000' "), 2)
    left = 10 + 999
    assert got.count() == left * 400 + left + 200


def test_unstructured_hashes_are_compared_in_tiles(spark):
    draw = random.Random(3)
    values = list({draw.getrandbits(64) - (1 << 63) for _ in range(2_000)}) + [0, 1, 3, -1, -(1 << 63)]
    values = list(set(values))
    far = (1 << 64) - 1
    rows = spark.createDataFrame([(v, [str(v)]) for v in values], "dhash64 bigint, splits array<string>")
    got = D.hash_pairs(rows, 20, "splits")
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # keys met 20 times the pairs
    want = sorted((min(a, b), max(a, b), ((a ^ b) & far).bit_count()) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & far).bit_count() <= 20)
    found = got.collect()
    assert sorted((r.hash_l, r.hash_r, r.distance) for r in found) == want and len(want) > 100
    assert all((r.splits_l, r.splits_r) == ([str(r.hash_l)], [str(r.hash_r)]) for r in found)
