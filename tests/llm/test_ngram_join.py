import random

import pytest
from pyspark.sql import types as T

from fluxgrid.llm.ngram_join import ngram_jaccard_join

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType())])


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(rows, num, den):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids, root = sorted(sets), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, families, copies, length, edits, passage=0):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéß") for _ in range(4)) for _ in range(400)]
    shared = [draw.choice(vocabulary) for _ in range(passage)]
    rows = []
    for _ in range(families):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(1, length))]
        for _ in range(draw.randint(1, copies)):
            w = list(base)
            for _ in range(draw.randint(0, edits)):
                at = draw.randrange(len(w))
                w[at : at + draw.randint(0, 2)] = [draw.choice(vocabulary)]
            at = draw.randint(0, len(w))
            w[at:at] = shared
            rows.append((len(rows), draw.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize(
    ("seed", "args", "cap"),
    [(1, (30, 4, 60, 3), 32), (2, (4, 25, 400, 12), 3), (3, (60, 2, 40, 2, 60), 4), (4, (12, 8, 900, 40), 2), (5, (40, 3, 12, 2, 30), 2), (6, (2, 120, 150, 9), 4), (7, (50, 2, 30, 2, 90), 3)],
)
def test_equals_brute_force(spark, seed, args, cap):
    rows = corpus(seed, *args)
    rows += [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, rows[0][1]), (10_004, "One two"), (10_005, "one\ttwo"), (10_006, "one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in ngram_jaccard_join(df, group_cap=cap).collect())
    assert got == brute(rows, 75, 100)


def test_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_without_an_id_are_linked_and_repeated_ids_keep_their_texts(spark):
    long_ = " ".join(f"w{k}" for k in range(40))
    rows = [(None, long_), (None, long_ + " end"), (7, long_), (8, "other words that are here alone"), (8, long_ + " more"), (None, "alone without any partner at all"), (None, ""), (None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_jaccard_join(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect())
    assert got == sorted([(0, 36, 7), (0, 37, 7), (7, 36, 7), (8, 2, 8), (8, 37, 7), (0, 2, 0), (0, 0, 0), (0, 0, 0)])


def test_slices_of_a_bucket_give_the_same_result(spark, monkeypatch):
    from fluxgrid.llm import ngram_join

    rows = corpus(9, 10, 20, 300, 15, 40)
    monkeypatch.setattr(ngram_join, "SLICE_ROWS", 50)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in ngram_jaccard_join(df, group_cap=4).collect()) == brute(rows, 75, 100)


def test_families_with_a_common_passage_settle_without_their_features(spark, monkeypatch):
    """All signatures are hot, and the passage's groups hold every family; what only a family holds shows that it links with no other."""
    from fluxgrid.llm import ngram_join

    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passage, rows = [word() for _ in range(120)], []
    for _ in range(5):
        base = [word() for _ in range(200)]
        for _ in range(30):
            w = list(base)
            w[draw.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w + passage)))
    taken, prefixes = [], ngram_join._prefixes
    monkeypatch.setattr(ngram_join, "_prefixes", lambda population, *rest: taken.append(population.count()) or prefixes(population, *rest))
    got = sorted(tuple(r) for r in ngram_jaccard_join(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), group_cap=6).collect())
    assert got == brute(rows, 75, 100)
    assert sum(taken) == 0


def test_bound_nodes_are_carried_as_rows_of_their_own_and_meet_in_one_band(spark, monkeypatch):
    """Near copies about the edge of a band, some of them not linked: what is carried is a row per node and band, and no group below the edge is only of sets above it."""
    from fluxgrid.llm import ngram_join

    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows = []
    for length in (394, 389, 440):
        base = [word() for _ in range(length)]
        for k in range(24):
            w = list(base)
            for at in draw.sample(range(0, length, 6), k):
                w[at] = word()
            rows.append((len(rows), " ".join(w[: length - draw.choice([0, 0, 8])])))
    carried, unsettled = [], ngram_join._Links.unsettled

    def counted(self, bound):
        left, mixed = unsettled(self, bound)
        carried.append((left.count(), {r.band for r in left.select("band").distinct().collect()}))
        return left, mixed

    monkeypatch.setattr(ngram_join._Links, "unsettled", counted)
    got = sorted(tuple(r) for r in ngram_jaccard_join(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), group_cap=6).collect())
    assert got == brute(rows, 75, 100)
    assert carried and all(n <= 2 * len(rows) for n, _ in carried)


def test_bitmaps_keep_all_links_and_drop_strangers():
    import numpy as np
    import pyarrow as pa

    from fluxgrid.llm.ngram_join import _bitmap, _may_link

    draw, sides, links = np.random.default_rng(5), [], []
    for size in (1, 5, 300, 380, 400, 1_500, 1_600, 9_000):
        for common in (size, size * 9 // 10, size * 7 // 10, 0):
            x = draw.integers(0, 1 << 63, size).astype(np.uint64)
            y = np.concatenate([x[:common], draw.integers(0, 1 << 63, size - common).astype(np.uint64)])
            for p, q in ((x, y), (x, x[:common])):
                sides.append((p, q))
                links.append(100 * len(np.intersect1d(p, q)) >= 75 * len(np.union1d(p, q)))
    columns = [[k for k in range(len(sides))]] * 2 + [[len(s[k]) for s in sides] for k in (0, 1)] + [[_bitmap(s[k]).tobytes() for s in sides] for k in (0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n_a", "n_b", "bits_a", "bits_b"])
    kept = set(next(iter(_may_link(iter([batch]), 75, 100))).column(0).to_pylist())
    assert {k for k, linked in enumerate(links) if linked} <= kept
    assert not any(len(q) and not len(np.intersect1d(p, q)) for p, q in (sides[k] for k in kept))
