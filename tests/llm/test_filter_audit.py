"""The filter audit against applying the filters one by one, document by document."""

import re
from collections import Counter
from itertools import permutations

from fluxgrid.llm import filter_audit


def fails(docs):
    out = []
    for doc_id, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(
            {
                "A": len(w) < 200,
                "B": 100 * len(set(w)) < 50 * len(w),
                "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)),
                "E": doc_id is not None and any(o is not None and o < doc_id and (s or "") == t for o, s, _ in docs),
            }
        )
    return out


def audited(docs, labels):
    failed, out = fails(docs), []
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for part in sorted({s or "" for _, _, s in docs}):
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        total = Counter()
        rows = []
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if failed[k][f]]
                left = [k for k in left if not failed[k][f]]
                total[f] += len(gone)
                alone = sum(failed[k][f] and sum(failed[k].values()) == 1 for k in own)
                rows.append([part, order, step, len(left), len(gone), sum(failed[k][f] for k in own) - len(gone), alone, sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone), f])
        out += [tuple([*r[:-1], total[r[-1]]]) for r in rows]
    return sorted(out)


def frames(spark, docs, labels, parts):
    table = spark.createDataFrame([(*d, "x", 9) for d in docs], "doc_id long, text string, source string, part string, mask int").repartition(parts)
    return table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


LONG = " ".join(f"word{k}" for k in range(210))


def test_equals_filters_one_by_one(spark):
    docs = [(k, LONG if k % 3 else f"{LONG} more {k}", f"s{k % 2}") for k in range(60)]
    docs += [(100 + k, ("SHOUT " * 300 if k % 2 else LONG + " # | ") + ("x" if k % 5 else ""), "s0") for k in range(20)]
    docs += [(None, LONG, None), (None, None, "s1"), (7, LONG, "s1"), (7, LONG, "s1"), (0, "", ""), (200, "", None), (201, None, None), (202, "a\x1cb \x85 Ü", "s0"), (50, "twice", "s0"), (50, "twice", "s0")]
    labels = [(k, k % 2, (k + 1) % 3 == 0) for k in range(0, 120, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9, None, None)]
    labels = [(i, q, int(x) if x is not None else None) for i, q, x in labels]
    for parts in (1, 5):
        got = filter_audit.filter_audit(*frames(spark, docs, labels, parts))
        assert sorted(map(tuple, got.collect())) == audited(docs, labels)


def test_one_text_over_many_partitions(spark):
    """A hot text fills whole ranges; its smallest id stands in the first of them."""
    docs = [(k, "the same text", "hot") for k in range(5_000)] + [(k, f"text {k}", "rest") for k in range(5_000, 5_400)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        table, _ = frames(spark, docs, [(1, 1, 1)], 4)
        masks = filter_audit.failure_masks(table)
        repeats = masks.where("mask & 16 <> 0")
        assert repeats.count() == 4_999 and repeats.where("doc_id = 0").count() == 0 and masks.count() == 5_400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_empty_tables(spark):
    table, labels = frames(spark, [(1, "a", "s")], [(1, 1, 1)], 1)
    assert filter_audit.filter_audit(table.where("false"), labels).collect() == []
    rows = filter_audit.filter_audit(table, labels.where("false")).collect()
    assert len(rows) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in rows)
