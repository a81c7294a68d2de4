"""Filter interaction audit: what each filter removes in every order of all filters.

Duplicates are found by sorting: rows are range-partitioned by fingerprint and
id, sorted by fingerprint, whole text and id, and compared with their
predecessor.  Only the ends of the partitions, as many as there are
partitions, are settled on the driver.  A row's failures are then a mask of
five bits, and rows with the same mask count alike in every order, so counters
by part and mask are all that any order needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common

FILTERS = "ABCDE"
#: The word separators, and the most rows of a batch with whole texts.
_SPACE, BATCH_ROWS = r"[\x20\x09-\x0D]+", 2_000
_ALL = (1 << len(FILTERS)) - 1


def failures(text: Column, words: Column) -> Column:
    """The bits of filters A to D that a text, split into words, fails."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = (F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
    mask = F.lit(0)
    for k, fails in enumerate(failed):
        mask = mask + F.when(fails, 1 << k).otherwise(0)
    return mask


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition without their texts, marked as repeats of a smaller id, then one row of its ends.

    ``opens``: the row has the partition's first text, whose smaller ids may stand in partitions before.
    """
    names = ["doc_id", "source", "part", "mask", "opens", "first", "last", "first_id", "last_id"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    text = smallest = part = head = tail = head_id = None
    opening = True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, ids, prints = batch.column(2), batch.column(0).to_pylist(), batch.column(4)
        if part is None:
            part, head = batch.column(5)[0].as_py(), prints[0].as_py()
        again = [texts[0].as_py() == text, *pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_pylist()]
        masks, opens = batch.column(3).to_pylist(), [False] * n
        for k, same in enumerate(again):
            if not same:
                opening, smallest = text is None and k == 0, None
            opens[k] = opening
            if ids[k] is not None:
                if smallest is None:
                    smallest = ids[k]
                elif ids[k] > smallest:
                    masks[k] |= 1 << FILTERS.index("E")
            if opening:
                head_id = smallest
        text, tail = texts[n - 1].as_py(), prints[n - 1].as_py()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), pa.array(masks, pa.int32()), pa.array(opens), *(pa.nulls(n, kind) for kind in kinds[5:])], names=names)
    if part is not None:
        ends = [None, None, part, -1, None, head, tail, head_id, smallest]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(ends, kinds, strict=True)], names=names)


_RUNS = "doc_id long, source string, part int, mask int, opens boolean, first binary, last binary, first_id long, last_id long"


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mask) of every row: which filters it fails, duplicates included.

    E fails where a smaller id has the same text; a row without an id is no
    smaller and fails never.  A null text is an empty one.  Written to the
    shared folder, so that nothing is sorted twice.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the sample that sets the ranges has fingerprints and ids, never texts
    prints = texts.withColumn("print", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    ranged = prints.repartitionByRange(max(common.shuffle_partitions(spark), 2), "print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    judged = ranged.withColumn("_words", F.array_remove(F.split("text", _SPACE, -1), "")).withColumn("mask", failures(F.col("text"), F.col("_words")))
    with common.arrow_rows(spark, BATCH_ROWS):
        rows = common.materialise(judged.select("doc_id", "source", "text", "mask", "print", F.spark_partition_id().alias("part")).mapInArrow(common.trimmed(_sorted_runs), _RUNS), "masks")
    # one row of ends per partition
    ends = sorted((r["part"], bytes(r["first"]), bytes(r["last"]), r["first_id"], r["last_id"]) for r in rows.where("mask = -1").collect())
    before, carried, smallest = [], None, None
    for part, first, last, first_id, last_id in ends:
        if first != carried:
            smallest = None
        if smallest is not None:
            before.append((part, smallest))
        if last == first:  # one text fills the partition: an earlier partition's smaller id goes on
            smallest = first_id if smallest is None else smallest
        else:
            smallest = last_id
        carried = last
    table = rows.where("mask >= 0")
    if before:
        table = table.join(F.broadcast(spark.createDataFrame(before, "part int, smallest long")), "part", "left")
        late = F.col("opens") & (F.col("doc_id") > F.col("smallest"))
        table = table.withColumn("mask", F.when(late, F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E")))).otherwise(F.col("mask")))
    return table.select("doc_id", "source", "mask")


def audit_orders(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from (doc_id, source, mask) and the labels.

    A document labelled several times counts as good, or toxic, if any of its labels says so.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = marks.where("good or toxic")
    marked = common.small_join(masks, known, ["doc_id"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    counted = marked.groupBy(F.coalesce("source", F.lit("")).alias("part"), "mask").agg(F.count("*").alias("n"), F.sum(yes("good")).alias("good"), F.sum(yes("toxic")).alias("toxic"))
    # per part: rows (good, toxic ones) that pass all filters of each subset, and each filter's share over all orders
    passing = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(c))), F.lit(0)) for s in range(_ALL + 1)]).alias(f"_{c}") for c in ("n", "good", "toxic")]
    orders = 1
    for k in range(2, len(FILTERS) + 1):
        orders *= k
    share = F.expr(f"n * {orders} div bit_count(mask)")  # of the filters that a row fails, each comes first equally often
    shares = F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, share)), F.lit(0)) for k in range(len(FILTERS))]).alias("_share")
    by_part = counted.groupBy("part").agg(*passing, shares)
    steps = by_part.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))).select("*", F.posexplode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("_k", "step"))
    steps = steps.withColumn("_bit", F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)"))
    steps = steps.withColumn("_done", F.expr(f"aggregate(sequence(1, step), 0, (s, i) -> s | shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1))"))
    at = lambda c, s: F.get(F.col(f"_{c}"), s)
    had = F.col("_done") - F.col("_bit")
    removed = lambda c: at(c, had) - at(c, F.col("_done"))
    failing = at("n", F.lit(0)) - at("n", F.col("_bit"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("n", F.col("_done")).alias("kept"),
        removed("n").alias("removed"),
        (failing - removed("n")).alias("redundant"),
        (at("n", F.lit(_ALL) - F.col("_bit")) - at("n", F.lit(_ALL))).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.get("_share", F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1)) - 1")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source; a null one is the empty string), filter order and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.  Repeated rows count each; those that
    repeat an id with the same text are no duplicates of each other.  An empty
    table has no parts and gives no rows; extra columns are not read.
    """
    return audit_orders(failure_masks(docs), labels)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of five filters over all whole documents, as in ``filter_audit``."""
    return filter_audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(marks.toxic, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM words LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE w.l <> v.l AND x.l NOT IN (v.l, w.l) AND y.l NOT IN (v.l, w.l, x.l) AND z.l NOT IN (v.l, w.l, x.l, y.l)),
failed AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS f, count(*) AS n,
    count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM judged GROUP BY ALL),
steps AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(f, filter_order[step]) AS fails,
    length(translate(filter_order[1:step - 1], f, '')) < step - 1 AS earlier
  FROM failed, orders, (SELECT unnest(range(1, 6)) AS step)),
tallied AS (
  SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS l,
    coalesce(sum(n) FILTER (WHERE NOT earlier AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE NOT earlier AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE earlier AND fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE f = filter_order[step]), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT earlier AND fails), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT earlier AND fails), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM tallied
"""
