"""Stages that return to whole rows, on null and repeated ids."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from fluxgrid.llm import mixing

SCHEMA = "doc_id long, text string, source string, copies string"


def words(k, n=12):
    return " ".join(f"w{k}x{j}" for j in range(n))


ROWS = [(k, words(k, 5 + k % 9), f"s{k % 3}", "c") for k in range(60)]
ROWS += [(None, words(100 + k), "s0", None) for k in range(4)] + [(7, words(7, 12), "s1", "c")] * 3 + [(8, words(200), "s2", "c"), (None, None, None, None)]


def test_mix_takes_each_row_as_often_as_the_mix_says(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = Counter(tuple(r) for r in corpus_pipeline.mix(spark, docs, "").collect())
    copies = mixing.mix_sources(docs.withColumn("n", F.monotonically_increasing_id()), row="n").join(docs.withColumn("n", F.monotonically_increasing_id()).select("n", "text"), "n").collect()
    want = Counter()
    for r in copies:
        want[r.doc_id, r.text] += r.copies
    assert sum(got.values()) == sum(want.values())
    have = Counter()
    for r, n in got.items():
        have[r[0], r[1]] += n
    assert have == +want and any(i is None for i, _ in have)
    held = Counter(ROWS)
    assert all(n <= 2 * held[r] for r, n in got.items())


def test_deduplicate_keeps_one_row_of_a_group(spark):
    rows = ROWS + [(500, words(100), "s0", "c"), (501, words(3, 5 + 3 % 9), "s0", "c")]
    got = Counter(tuple(r) for r in corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    best = {}
    for r in rows:  # texts that are not equal are far from each other
        if r[1] is not None:
            key = r[1]
            best[key] = min(best.get(key, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert got == Counter([*best.values(), (None, None, None, None)])
