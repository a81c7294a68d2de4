"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common, mixing, ngram_join, packing, quality, toxicity


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train_quality(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    lexicon = toxicity.train_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, lexicon)


#: Ids and sources may be null or repeated, so a stage that leaves the rows and returns to them numbers them first.
ROW = "_row_of_stage"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a unique ``ROW``, written so that it stays the same."""
    return common.materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id, null being the last.

    Rows that repeat an id, or have none, are rows like others: equal ones are
    copies of each other.  Texts without words are linked with nothing and stay.
    """
    rows = numbered(docs)
    with common.scratch(spark) as keep:
        linked = ngram_join.ngram_jaccard_join(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("_group"))
        linked = common.materialise(linked, "linked")
        several = common.materialise(linked.groupBy("_group").agg(F.count("*").alias("n")).where("n > 1").select("_group"), "several")
        members = common.materialise(common.small_join(linked, several, ["_group"], "left_semi"), "members")
        place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", F.xxhash64("text").alias("h"), ROW)
        placed = common.small_join(rows.select(ROW, place.alias("_place")), members, [ROW], "inner")
        first = common.materialise(placed.groupBy("_group").agg(F.min("_place").alias("_place")).select(F.col("_place")[ROW].alias(ROW)), "first")
        gone = keep(common.materialise(common.small_join(members.select(ROW), first, [ROW], "left_anti"), "gone"))
    return common.small_join(rows, gone, [ROW], "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice.

    Rows that repeat an id, or have none, are taken each as often as the mix takes that row.
    """
    rows = numbered(docs)
    with common.scratch(spark) as keep:
        taken = mixing.mix_sources(rows, row=ROW).where("copies > 0").select(ROW, F.col("copies").alias("_times"))
        copies = keep(common.materialise(taken, "copies"))
    again = common.small_join(rows, copies, [ROW], "inner").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return again.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's pieces with their places in sequences of at most 4096 tokens."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", deduplicate),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: SQL cannot express the learned stages.  ``tests/llm/test_pipeline.py`` holds the rows that ``deduplicate`` and ``mix`` return against plain
#: Python; the whole pipeline, and the other stages as stages, are not held against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
