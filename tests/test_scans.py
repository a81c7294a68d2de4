"""Folds, order statistics and digests of keys that hold nearly all rows, against plain restatements."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.operators import reports as R
from fluxgrid.operators import scans as C
from fluxgrid.operators import sequences as Q


def folded(values, keep=0.85):
    out = [values[0]]
    for v in values[1:]:
        out.append(keep * out[-1] + (1 - keep) * v)
    return out


def test_a_fold_of_a_million_rows_of_one_key(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 1000 < 3, F.col("id") % 1000 + 1).otherwise(0).alias("k"), ((F.col("id") * 7919) % n).alias("at"), ((F.col("id") * 104729) % 1009 / 7.0).alias("v"))
    ids = np.arange(n)
    key = np.where(ids % 1000 < 3, ids % 1000 + 1, 0)
    at, v = (ids * 7919) % n, (ids * 104729) % 1009 / 7.0
    got = {r.k: r for r in C.ewma(rows, ["k"], "at", "v").collect()}
    running = C.running_ewma(rows, ["k"], ["at"], "v").toPandas()
    for k in range(4):
        order = np.argsort(at[key == k])
        want = folded(v[key == k][order].tolist())
        assert got[k].n == len(want) and abs(got[k].ewma - want[-1]) < 1e-9
        own = running[running.k == k].sort_values("at").ewma.to_numpy()
        assert np.abs(own - np.array(want)).max() < 1e-9


def test_folds_of_small_keys(spark):
    draw = random.Random(4)
    data = {(a, b): [draw.choice([0.0, 1.5, -3.0, 1e6]) for _ in range(draw.randrange(1, 9))] for a in (None, "x", "y") for b in (1, 2)}
    rows = [(a, b, k, v) for (a, b), values in data.items() for k, v in enumerate(values)]
    draw.shuffle(rows)
    table = spark.createDataFrame([*rows, ("z", 1, 0, None), ("z", 1, 1, 2.0)], "a string, b int, at int, v double")
    got = {(r.a, r.b): r for r in C.ewma(table, ["a", "b"], "at", "v").collect()}
    assert all(abs(got[k].ewma - folded(v)[-1]) < 1e-9 and got[k].n == len(v) for k, v in data.items())
    assert got["z", 1].ewma is None and got["z", 1].n == 2
    running = {(r.a, r.b, r.at): r.ewma for r in C.running_ewma(table.where("a is null or a <> 'z'"), ["a", "b"], ["at"], "v").collect()}
    assert all(abs(running[(*k, i)] - x) < 1e-9 for k, v in data.items() for i, x in enumerate(folded(v)))
    assert C.ewma(table.where("false"), ["a"], "at", "v").collect() == C.running_ewma(table.where("false"), ["a"], ["at"], "v").collect() == []


@pytest.mark.parametrize("shape", ["even", "tied", "steep", "one", "tiny"])
def test_exact_percentiles_of_one_key(spark, shape):
    n = 1_000_000 if shape == "even" else 100_000
    u = (F.col("id") * 7919 % n) / F.lit(float(n))
    w = (np.arange(n) * 7919 % n) / float(n)
    made = {
        "even": (u * 100 - 30, w * 100 - 30),
        "tied": (F.floor(u * 3).cast("double"), np.floor(w * 3)),
        "steep": (F.pow(F.lit(2.0), F.floor(u * 600) - 300), 2.0 ** (np.floor(w * 600) - 300)),
        "one": (F.lit(4.25), np.full(n, 4.25)),
        "tiny": (F.floor(u * 4) * F.lit(5e-324), np.floor(w * 4) * 5e-324),
    }[shape]
    rows = spark.range(n, numPartitions=8).select(F.lit("k").alias("k"), made[0].alias("v"))
    odd = spark.createDataFrame([("other", 7.0), ("other", float("nan")), ("other", None), (None, 1.0), (None, 2.0), ("none", None)], "k string, v double")
    got = {r.k: r for r in C.exact_percentiles(rows.unionByName(odd), ["k"], "v", [0.0, 0.5, 0.95, 0.999, 1.0], 64).collect()}
    assert got["k"]["count"] == n and list(got["k"].p) == pytest.approx(np.percentile(made[1], [0, 50, 95, 99.9, 100]).tolist(), rel=1e-12, abs=5e-324)
    assert list(got["other"].p) == [7.0] * 5 and list(got[None].p) == pytest.approx([1, 1.5, 1.95, 1.999, 2]) and "none" not in got


def test_summaries_by_either_way_are_the_same(spark):
    rows = spark.range(5_000).select((F.col("id") % 3 * F.col("id") % 2).alias("k"), F.when(F.col("id") % 50 == 0, None).otherwise(F.sqrt("id")).alias("value")).unionByName(spark.createDataFrame([(None, 3.0), (9, None)], "k bigint, value double"))
    close = lambda rs: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rs), key=repr)
    want = close(Q.summarize(rows, ["k"]).collect())
    for most in (0, 900, 10**6):
        assert close(Q.summarize(rows, ["k"], most_held=most).collect()) == want
    plan = Q.summarize(rows, ["k"], most_held=0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tree_hash_of_many_files(spark):
    names = [f"d{k % 7}/{'sub-x/' if k % 3 else ''}f{k:05d}" for k in range(20_000)] + ["__pycache__/a.pyc", "d1/.DS_Store", "d1/x.pyc"]
    files = spark.createDataFrame([("t" if k % 9 else None, p, f"{k:064x}") for k, p in enumerate(names)], "tree string, path string, sha256 string").repartition(5)
    got = {r.tree: (r.tree_sha256, r.files) for r in R.tree_hash(files, ["tree"]).collect()}
    for tree in ("t", None):
        own = sorted(((p.split("/"), p, f"{k:064x}") for k, p in enumerate(names[:20_000]) if (k % 9 != 0) == (tree is not None)))
        assert got[tree] == (hashlib.sha256("".join(f"{p}\0{s}\n" for _, p, s in own).encode()).hexdigest(), len(own))


def restated_cover(records, count, empties=3):
    chosen = []
    for value in sorted({c for _, cs in records for c in cs}):
        left = [(k, cs) for k, cs in records if value in cs and k not in chosen]
        if left:
            chosen.append(max(left, key=lambda r: (len(set(r[1])), -r[0]))[0])
    chosen += [k for k, cs in records if not cs][: min(empties, max(0, count - len(chosen)))]
    rest, slots = [k for k, _ in records if k not in chosen], max(0, count - len(chosen))
    if slots and rest:
        for i in range(slots):
            k = rest[min(int(i * (len(rest) / slots)), len(rest) - 1)]
            chosen += [k] if k not in chosen else []
    return chosen[:count]


@pytest.mark.parametrize("seed", range(5))
def test_cover_equals_the_sequential_choice(spark, seed):
    draw = random.Random(seed)
    classes = "abcdefghij"[: draw.randrange(1, 11)]
    records = [(k, draw.sample(classes, draw.randrange(0, min(4, len(classes)) + 1)) if draw.random() < 0.8 else []) for k in range(draw.choice([40, 300]))]
    table = spark.createDataFrame(records, "k int, c array<string>").repartition(4)
    got = R.cover_sample(table, "k", "c", 25).orderBy("position").collect()
    assert [r.k for r in got] == restated_cover(records, 25)
