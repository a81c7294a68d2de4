"""Periodic runs against a scan of every period, and the contract's columns against a restatement."""

import hashlib
import random
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from fluxgrid.llm import periodic
from fluxgrid.llm.shingles import word_hashes

NOTHING = hashlib.sha256(b"").hexdigest()


def scanned(words):
    """Every maximal stretch of each period, by walking through the text once per period."""
    n, least = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                least[i, j + q] = min(q, least.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in least.items())


def restated(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = scanned(words)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = hashlib.sha256("".join(f"{a},{size},{q}\n" for a, size, q in runs).encode()).hexdigest()
    collapsed = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), listed, collapsed)


def drawn(rng):
    words = []
    for _ in range(rng.randrange(1, 5)):
        block = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 9))]
        words += (block * rng.randrange(1, 8))[: rng.randrange(1, 60)]
    return words


@pytest.mark.parametrize("most_pairs", [1, 7, 1 << 20])
def test_runs_equal_a_scan_of_every_period(most_pairs):
    rng = random.Random(most_pairs)
    for _ in range(300):
        words = drawn(rng)
        hashes, _ = word_hashes(pa.array([" ".join(words)]), lower=False)
        assert periodic.runs_of([w.encode() for w in words], hashes, most_pairs) == scanned(words)


def test_words_are_verified_where_hashes_collide():
    words = [w.encode() for w in "x y z x y z x y z x y z x y q x y z r a a a a a a a b".split()]
    same = word_hashes(pa.array(["k"]), lower=False)[0].repeat(len(words))  # all words hash alike
    found = periodic.runs_of(words, same)
    assert all(words[a : a + size - q] == words[a + q : a + size] for a, size, q in found)
    assert set(found) <= set(scanned(words))


def test_one_word_a_hundred_thousand_times():
    text = "again " * 100_000
    hashes, _ = word_hashes(pa.array([text]), lower=False)
    assert periodic.runs_of(text.encode().split(), hashes) == [(0, 100_000, 1)]


def test_rows(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(drawn(rng) * rng.randrange(1, 3))) for k in range(150)] + [(None, "a b " * 20), (None, None), (7, ""), (7, None), (900, " \t\n "), (901, "a\x1cb " * 9), (902, "é a " * 30), (900, "w " * 6)]
    docs = spark.createDataFrame([(*r, "other", 1) for r in rows], "doc_id long, text string, period string, n_runs int").repartition(3)
    got = sorted(map(tuple, periodic.periodic_runs(docs).collect()), key=repr)
    assert got == sorted((restated(*r) for r in rows), key=repr)
    assert any(r[1] > 1 for r in got) and any(r[2] is None and r[6] == NOTHING for r in got)
    assert periodic.periodic_runs(docs.where("false")).collect() == []


def test_query_equals_restatement(spark):
    sf = "/root/testdata/sf0.001"
    want = sorted((restated(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=repr)
    assert sorted(map(tuple, periodic.op11_periodic_runs(spark, sf).collect()), key=repr) == want
