"""Ordered-sequence operations: summaries, runs, smoothing, sampling, latest-of-batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S
from fluxgrid.operators.scans import exact_percentiles
from fluxgrid.session import counted, written

SUMMARY = ("count", "mean", "stdev", "min", "p50", "p95", "p99", "max", "rate")


def summarize(rows: DataFrame, keys: list[str], value: str = "value", most_held: int | None = None) -> DataFrame:
    """Exact summary of the finite values per key: interpolated percentiles; the deviation of a single value is 0.

    Keys whose values are all missing keep a row with count 0 and nulls.  The
    aggregation holds the distinct values of a key; with ``most_held``, keys of
    more rows than that have their percentiles by refinement instead, exact too.
    """
    x = F.when(S.finite(F.col(value)), F.col(value).cast("double"))
    rest = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_s"), F.min(x).alias("min"), F.max(x).alias("max")]
    shares = [0.5, 0.95, 0.99]
    p = F.percentile(x, F.array(*map(F.lit, shares)))
    if most_held is None:
        g = rows.groupBy(*keys).agg(*rest, p.alias("_p"))
    else:
        base = written(rows.groupBy(*keys).agg(*rest), "summary")
        same = lambda a, b: reduce(lambda c, k: c & a[k].eqNullSafe(b[k]), keys, F.lit(True))
        large = counted(written(base.where(F.col("count") > most_held).select(*keys), "large"))
        few = rows.alias("r").join(large.alias("l"), same(rows, large), "left_anti").groupBy(*keys).agg(p.alias("_p"))
        many = exact_percentiles(rows.join(large, same(rows, large), "left_semi"), keys, value, shares).select(*keys, F.col("p").alias("_p"))
        both = few.unionByName(many)
        g = base.join(both, same(base, both)).select(*[base[c] for c in base.columns], "_p")
    sd = F.when(F.col("count") > 0, F.coalesce("_s", F.lit(0.0)))
    return g.select(*keys, "count", "mean", sd.alias("stdev"), "min", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "max", F.when(F.col("count") > 0, S.fps(F.col("mean"))).alias("rate"))


def summarize_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``summarize`` per metric column: one unpivot, one aggregation."""
    long = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")
    return summarize(long, [*keys, "metric"])


def summarize_stages(rows: DataFrame, keys: list[str], stages: str = "stage_ms") -> DataFrame:
    """``summarize`` per key of a sparse map; absent keys do not count as zero."""
    return summarize(rows.select(*keys, F.explode(stages).alias("stage", "value")), [*keys, "stage"])


def interval_summary(samples: DataFrame, windows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Summary of the samples within each (inclusive) window: an equi-join on ``keys`` with a range condition."""
    inside = windows.join(samples, keys).where("timestamp_ns between started_ns and finished_ns")
    return windows.join(summarize(inside, [*keys, "window_id"], value), [*keys, "window_id"], "left")


def transposed(columns: DataFrame, arrays: list[str]) -> DataFrame:
    """A row per index of equally long arrays; unequal lengths or a missing or unfit epoch are errors."""
    n = F.size(arrays[0])
    even = columns.withColumn(arrays[0], F.when(F.forall(F.array(*[F.size(a) for a in arrays]), lambda k: k == n), F.col(arrays[0])).otherwise(F.raise_error(F.lit("arrays differ in length"))))
    rest = [c for c in columns.columns if c not in arrays]
    rows = even.select(*rows_(rest), F.posexplode(F.arrays_zip(*arrays)).alias("row_idx", "_z")).select(*rest, "row_idx", *[F.col("_z")[a].alias(a) for a in arrays])
    if "epoch" in arrays:
        ok = (F.col("epoch") > 0) & (F.col("epoch") == F.floor("epoch"))
        rows = rows.withColumn("epoch", F.when(ok, F.col("epoch")).otherwise(F.raise_error(F.lit("epoch must be a positive whole number"))).cast("int"))
    return rows


def rows_(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def merge_history(rows: DataFrame, keys: list[str], metrics: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, duplicates, divergent) of rows with epoch, source, source_idx and row_idx.

    The last occurrence of an epoch is accepted; each earlier one is a duplicate;
    neighbours whose metrics differ are divergent.  Time and source are not compared.
    """
    w = W.partitionBy(*keys, "epoch").orderBy("source_idx", "row_idx")
    step = rows.withColumn("_n", F.lead("source").over(w)).withColumn("_p", F.lag(F.struct("source", *metrics)).over(w)).withColumn("_last", F.lead("epoch").over(w).isNull())
    same = F.lit(True)
    for m in metrics:
        a, b = F.col("_p")[m], F.col(m)
        same = same & F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(S.is_close(a, b))
    accepted = step.where("_last").drop("_n", "_p", "_last")
    duplicates = step.where("not _last").select(*keys, "epoch", F.col("source").alias("discarded_source"), F.col("_n").alias("accepted_source"))
    divergent = step.where(F.col("_p").isNotNull() & ~same).select(*keys, "epoch", F.col("_p")["source"].alias("previous_source"), "source")
    return accepted, duplicates, divergent


def missing_epochs(rows: DataFrame, keys: list[str], epoch: str = "epoch") -> DataFrame:
    """Epochs from 1 to a key's last that it lacks."""
    g = rows.groupBy(*keys).agg(F.max(epoch).alias("_m"), F.collect_set(epoch).alias("_s"))
    gaps = F.array_except(F.sequence(F.lit(1).cast(rows.schema[epoch].dataType), F.col("_m")), F.col("_s"))
    return g.select(*keys, F.explode(gaps).alias(f"missing_{epoch}"))


def failure_streaks(rows: DataFrame, keys: list[str], order: str, success: Column, limit: int | None = None) -> DataFrame:
    """Adds ``streak``: failures since the last success; and ``stopped``, from the first streak of ``limit`` on."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    tagged = rows.withColumn("_ok", success.cast("int")).withColumn("_island", F.sum("_ok").over(w))
    inner = W.partitionBy(*keys, "_island").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = tagged.withColumn("streak", F.sum(1 - F.col("_ok")).over(inner).cast("int"))
    if limit:
        out = out.withColumn("stopped", F.max(F.col("streak") >= limit).over(w))
    return out.drop("_ok", "_island")


def counter_deltas(rows: DataFrame, keys: list[str], order: str, counter: str) -> DataFrame:
    """Adds the growth of a counter since the row before, never negative."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn(f"{counter}_delta", F.greatest(F.lit(0), F.col(counter) - F.coalesce(F.lag(counter).over(w), F.lit(0))))


def after_warmup(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """Without the first ``k`` rows of each key; ``iteration`` numbers the rest from 1."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("iteration", F.row_number().over(w) - k).where("iteration > 0")


def repetitions(inputs: DataFrame, n: int) -> DataFrame:
    """Every input ``n`` times, with the repetition from 1: generated, not joined."""
    return inputs.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(n))))


def cyclic(inputs: DataFrame, reads: int, order: str) -> DataFrame:
    """Read ``n`` gets input n mod k of a short ordered list."""
    k = inputs.count()
    if not k:
        raise ValueError("no inputs")
    numbered = inputs.withColumn("_i", F.row_number().over(W.orderBy(order)) - 1)
    return inputs.sparkSession.range(reads).withColumnRenamed("id", "frame_id").withColumn("_i", F.pmod("frame_id", F.lit(k)).cast("int")).join(F.broadcast(numbered), "_i").drop("_i")


def even_sample(rows: DataFrame, keys: list[str], order: str, slots: int) -> DataFrame:
    """Per key the rows at floor(i * n / slots): all of them where there are no more than slots."""
    w = W.partitionBy(*keys)
    at = rows.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.col("_n") / F.lit(float(slots))
    picks = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.least(F.floor(i * step), F.col("_n") - 1))
    return at.where(F.array_contains(picks, F.col("_k").cast("bigint"))).drop("_k", "_n")


def conflate(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key and how many it displaced: a one-slot buffer read once per batch."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), order).alias("_r"), (F.count("*") - 1).alias("dropped"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in (order, *rest)], "dropped")
