"""Substring deduplication against a dictionary of all windows, with a sketch of usual size and with ones that are full."""

import hashlib
import random
import re
from collections import Counter

import pytest

from fluxgrid.llm import substring_dedup


def restated(docs):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (34, 35, 36, 60, 400)]
    docs = []
    for k in range(120):
        w = fresh(rng.randrange(0, 120))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        docs.append((k, rng.choice([" ", "\n", " \t"]).join(w)))
    whole = fresh(90)
    docs += [(500, " ".join(whole)), (501, " ".join(whole)), (502, " ".join([*whole[:45], "edited", *whole[46:]])), (503, " ".join(whole).upper())]
    docs += [(600, " ".join(fresh(50) * 2)), (601, "tick " * 300), (602, "tick " * 35), (603, "tick " * 34), (604, " ".join(["tick", "tock"] * 40))]
    docs += [(None, None), (None, " ".join(passages[3])), (None, " ".join(passages[3])), (700, ""), (700, " "), (700, "short"), (701, "a\x1cb é " * 40), (702, " ".join(fresh(60) * 1)), (702, " ".join(fresh(60)))]
    return docs


@pytest.mark.parametrize("bits", [3, 12, 28])
def test_equals_a_dictionary_of_windows(spark, bits):
    docs = corpus()
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, n_words int").repartition(4)
    got = substring_dedup.substring_dedup(table, bits)
    assert sorted(map(tuple, got.collect()), key=repr) == restated(docs)
    assert got.where("n_removed > 0 and n_removed < n_words").count() > 20


def test_a_shuffled_join_of_many_exceptions_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 50)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = corpus()
        table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        assert sorted(map(tuple, substring_dedup.substring_dedup(table, 3).collect()), key=repr) == restated(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_empty_and_short_tables(spark):
    table = spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string")
    assert substring_dedup.substring_dedup(table.where("false")).collect() == []
    assert [(r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(table).orderBy("doc_id").collect()] == [(2, 0), (0, 0)]


def test_a_passage_of_every_document_is_one_group(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(k, f"own{k} {passage} end{k}") for k in range(2_000)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert {(r.n_words, r.n_removed) for r in got.collect()} == {(62, 60)}
