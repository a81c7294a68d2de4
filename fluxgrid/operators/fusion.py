"""Range and vision fusion over bounded tables: last writer wins, freshness windows, hazard decisions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S

#: Stalenesses to a block of time; readings that a task decides at once; groups of blocks at least.
BLOCK, GROUP_ROWS, LEAST_GROUPS = 16, 30_000, 32


@dataclass(frozen=True)
class FusionConfig:
    warning_distance_m: float = 1.0
    critical_distance_m: float = 0.5
    sensor_stale_after_ms: float = 250.0
    vision_stale_after_ms: float = 500.0
    vision_confidence: float = 0.35

    def __post_init__(self) -> None:
        if not 0 < self.critical_distance_m < self.warning_distance_m:
            raise ValueError("0 < critical < warning is needed")
        if self.sensor_stale_after_ms <= 0 or self.vision_stale_after_ms <= 0:
            raise ValueError("staleness must be positive")
        if not 0 <= self.vision_confidence <= 1:
            raise ValueError("the confidence must be in [0, 1]")


def usable_range() -> Column:
    """Valid, of a ranging kind, with a finite positive distance; NaN is named, for it sorts above everything."""
    d = F.col("distance_m")
    return F.col("valid") & F.col("kind").isin("tof", "ultrasonic") & S.finite(d) & (d > 0)


def accepted_readings(readings: DataFrame, by: list[str]) -> DataFrame:
    """Readings that update their sensor's state: not older than any before them in arrival order."""
    w = W.partitionBy(*by, "sensor_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return readings.withColumn("_top", F.max("timestamp_ns").over(w)).where("timestamp_ns = _top").drop("_top")


def latest_reading(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key; of equal times, the later arrival."""
    rest = [c for c in readings.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("timestamp_ns", "seq")).alias("_r")
    return readings.groupBy(*keys).agg(best).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def order_violations(readings: DataFrame, by: list[str]) -> DataFrame:
    """Rows older than the one before them in arrival order."""
    w = W.partitionBy(*by).orderBy("seq")
    return readings.withColumn("previous_ns", F.lag("timestamp_ns").over(w)).where("timestamp_ns < previous_ns")


def _ranks(*columns: np.ndarray) -> list[np.ndarray]:
    """The columns with each value replaced by its rank among all of them."""
    ranks = np.unique(np.concatenate(columns), return_inverse=True)[1]
    return np.split(ranks, np.cumsum([len(c) for c in columns])[:-1])


def _least(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of ``values[first:end]`` for each range, none of them empty, from minima of runs of 2, 4, 8 ... values."""
    out, width = np.empty(len(first)), end - first
    level = np.frexp(width)[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            values = np.minimum(values[:-half], values[half:])
        at = level == k
        out[at] = np.minimum(values[first[at]], values[end[at] - (1 << k)])
    return out


def live_ranges(asked: tuple, state: tuple, stale: int, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least distance (NaN: none), number and marks (a row per decision, a column per mark) of the states that each decision meets.

    ``asked`` has group, seq and time of each decision; ``state`` has group, the
    seqs from which and before which it stands, time and distance.  ``marks``
    tell for each state what it is.  Decisions in order of group and seq form a
    line, on which a state covers a stretch: at most two blocks of each size
    1, 2, 4 ...  Within a block all states stand for all decisions, and those
    not stale are a range in order of time.  So work grows with n log2 n
    however many states are live at once.
    """
    group, seq, now = asked
    g, since, until, ts, d = state
    n = len(seq)
    near, count, marked = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros((n, len(marks)), bool)
    if not n or not len(ts):
        return near, count, marked
    seq, since, until = _ranks(seq, since, until)
    span = max(x.max() for x in (seq, since, until)) + 1
    line = group * span + seq
    order = np.argsort(line, kind="stable")
    line = line[order]
    left, right = np.searchsorted(line, g * span + since), np.searchsorted(line, g * span + until)
    times = np.unique(ts)
    moment, span = np.searchsorted(times, ts), len(times) + 1
    oldest, newest = np.searchsorted(times, now[order] - stale), np.searchsorted(times, now[order], side="right")
    place, level, states = np.arange(n), 0, np.arange(len(ts))
    best = np.full(n, np.inf)
    while len(states):
        odd, even = (left < right) & (left % 2 == 1), (left < right) & (right % 2 == 1)
        block, own = np.concatenate([left[odd], right[even] - 1]), np.concatenate([states[odd], states[even]])
        if len(own):
            key = block * span + moment[own]
            sort = np.argsort(key)
            key, own = key[sort], own[sort]
            first, end = (np.searchsorted(key, (place >> level) * span + x) for x in (oldest, newest))
            some = np.flatnonzero(first < end)
            first, end = first[some], end[some]
            best[some] = np.minimum(best[some], _least(d[own], first, end))
            count[order[some]] += end - first
            for k, mark in enumerate(marks):
                total = np.concatenate([[0], np.cumsum(mark[own])])
                marked[order[some], k] |= total[end] > total[first]
        left, right, level = (left + 1) >> 1, right >> 1, level + 1
        left, right, states = (x[left < right] for x in (left, right, states))
    near[order] = np.where(np.isinf(best), np.nan, best)
    return near, count, marked


def _sector_lists(marked: np.ndarray, names: list[str]) -> pa.ListArray:
    rows, columns = np.nonzero(marked)
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(marked)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()).take(pa.array(columns)))


def _nearest(by: list[str], config: FusionConfig):
    """The decisions among the rows of some blocks of time, with the states that they meet."""
    stale, limits = S.ms_to_ns(config.sensor_stale_after_ms), (config.critical_distance_m, config.warning_distance_m)

    def run(rows: pa.Table) -> pa.Table:
        group = rows.select([*by, "_block"]).to_pandas().groupby([*by, "_block"], dropna=False, sort=False).ngroup().to_numpy().astype(np.int64)
        own = rows["_own"].to_numpy()
        timed = pc.and_(rows["seq"].is_valid(), rows["timestamp_ns"].is_valid()).to_numpy()
        seq, ts = (rows[c].fill_null(0).to_numpy() for c in ("seq", "timestamp_ns"))
        d = rows["_d"].to_numpy()
        stands = timed & rows["_d"].is_valid().to_numpy()
        until = rows["_next"].fill_null(np.iinfo(np.int64).max).to_numpy()
        sector = rows["_sector"].combine_chunks()
        names = sorted(pc.unique(sector).drop_null().to_pylist())
        sector = pc.fill_null(pc.index_in(sector, pa.array(names, pa.string())), -1).to_numpy(zero_copy_only=False)
        marks = [(sector[stands] == k) & (d[stands] <= most) for most in limits for k in range(len(names))]
        at = own & timed
        asked, state = (group[at], seq[at], ts[at]), (group[stands], seq[stands], until[stands], ts[stands], d[stands])
        near, count, marked = np.full(len(own), np.nan), np.zeros(len(own), np.int32), np.zeros((len(own), len(marks)), bool)
        near[at], count[at], marked[at] = live_ranges(asked, state, stale, marks)
        near, count, marked = near[own], count[own], marked[own]
        out = rows.select([*by, "seq", "timestamp_ns"]).filter(pa.array(own))
        out = out.append_column("nearest_distance_m", pa.array(near, mask=np.isnan(near))).append_column("fresh_range_sensor_count", pa.array(count, pa.int32()))
        return out.append_column("_critical", _sector_lists(marked[:, : len(names)], names)).append_column("_warning", _sector_lists(marked[:, len(names) :], names))

    return run


def fuse_ranges(readings: DataFrame, config: FusionConfig, by: list[str] | None = None) -> DataFrame:
    """One decision per reading, at its own time, from the state after it.

    A reading stands from its arrival until its sensor's next accepted one.
    Decisions meet it by blocks of time, ``BLOCK`` stalenesses wide, so only a
    reading near the end of its block lies in two.  A task takes some blocks at
    once (see ``live_ranges``): no pair of a decision and a reading is ever a
    row.  Unusable readings hide older ones: they are left out only after the
    successor is known.
    """
    by = by or ["rig_id"]
    stale = S.ms_to_ns(config.sensor_stale_after_ms)
    w = W.partitionBy(*by, "sensor_id").orderBy("seq")
    top = F.max("timestamp_ns").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    usable = lambda c: F.when(usable_range(), F.col(c))
    narrow = readings.select(*by, "sensor_id", "seq", "timestamp_ns", usable("sector").alias("_sector"), usable("distance_m").cast("double").alias("_d"))
    state = narrow.withColumn("_taken", F.when(F.col("timestamp_ns") == top, F.col("seq")))
    keys = ", ".join(f"`{c}`" for c in (*by, "sensor_id"))
    state = state.withColumn("_next", F.expr(f"lead(_taken) ignore nulls over (partition by {keys} order by seq)"))
    stands = lambda c: F.when(F.col("_taken").isNotNull() & F.col("_d").isNotNull(), F.col(c)).alias(c)
    block = lambda t: t - F.pmod(t, F.lit(BLOCK * stale))
    ts = F.col("timestamp_ns")
    lies = F.when(F.col("_d").isNotNull(), F.array_distinct(F.array(block(ts), block(ts + stale)))).otherwise(F.array(block(ts)))
    state = state.select(*by, "seq", ts, stands("_next"), stands("_sector"), stands("_d"))
    rows = state.select("*", F.posexplode(lies).alias("_copy", "_block")).withColumn("_own", F.col("_copy") == 0).drop("_copy")
    groups = max(LEAST_GROUPS, readings.count() // GROUP_ROWS)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(*by, "_block"), F.lit(groups)))
    kinds = ", ".join(f"`{c}` {readings.schema[c].dataType.simpleString()}" for c in (*by, "seq", "timestamp_ns"))
    out = rows.groupBy("_group").applyInArrow(_nearest(by, config), f"{kinds}, nearest_distance_m double, fresh_range_sensor_count int, _critical array<string>, _warning array<string>")
    n = F.col("nearest_distance_m")
    level = F.when(n.isNull(), "sensor_fault").when(n <= config.critical_distance_m, "critical").when(n <= config.warning_distance_m, "warning").otherwise("clear")
    sectors = F.when(F.col("level") == "critical", F.col("_critical")).when(F.col("level") == "warning", F.col("_warning")).when(F.col("level") == "sensor_fault", F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("level", level).withColumn("sectors", sectors)
    return out.select(*by, "seq", "timestamp_ns", "level", "sectors", "nearest_distance_m", "fresh_range_sensor_count", F.col("level").isin("warning", "critical").alias("range_triggered"))


def attach_vision(decisions: DataFrame, frames: DataFrame, config: FusionConfig, by: list[str] | None = None) -> DataFrame:
    """Adds ``semantic_labels``: confident labels of the latest frame, if fresh, in the decision's sectors.

    Frames arrive by ``seq`` among the decisions; one older than the newest so
    far changes nothing.  The as-of join is a running last value over both;
    decisions go through it whole, so that they are made and shuffled once.
    At CLEAR every sector counts, at SENSOR_FAULT none does.
    """
    by = by or ["rig_id"]
    both = frames.select(*by, "seq", F.lit(0).alias("_o"), F.struct("model_finished_ns", "detections").alias("_f")).unionByName(decisions.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    run = W.partitionBy(*by).orderBy("seq", "_o").rowsBetween(W.unboundedPreceding, W.currentRow)
    finished = F.col("_f")["model_finished_ns"]
    seen = both.withColumn("_f", F.when(finished == F.max(finished).over(run), F.col("_f")))
    asof = seen.withColumn("_f", F.last("_f", ignorenulls=True).over(run)).where("_o = 1")
    age = F.col("timestamp_ns") - F.col("_f")["model_finished_ns"]
    fresh = age.between(0, S.ms_to_ns(config.vision_stale_after_ms)) & (F.col("level") != "sensor_fault")
    fits = F.filter(F.col("_f")["detections"], lambda d: (d["confidence"] >= config.vision_confidence) & ((F.size("sectors") == 0) | F.array_contains("sectors", d["sector"])))
    labels = F.array_sort(F.array_distinct(F.transform(fits, lambda d: d["class_name"])))
    return asof.select(*decisions.columns, F.when(fresh, labels).otherwise(F.array().cast("array<string>")).alias("semantic_labels"))


def reason_text(fixed) -> Column:
    """Why a decision was made; ``fixed`` formats the distance (see ``python_fixed``)."""
    labels = F.when(F.size("semantic_labels") > 0, F.concat(F.lit("; vision labels: "), F.array_join("semantic_labels", ", "))).otherwise("")
    return (
        F.when(F.col("level") == "sensor_fault", "no fresh valid range sensor reading")
        .when(F.col("level") == "clear", "all fresh range readings exceed warning distance")
        .otherwise(F.concat(F.lit("nearest range "), fixed(F.col("nearest_distance_m"), 3), F.lit(" m"), labels))
    )


def to_haptic(decisions: DataFrame) -> DataFrame:
    """Adds a decision's command: intensity, pulse period, and the sectors that vibrate."""
    by_level = {"critical": (1.0, 100), "warning": (0.65, 250), "sensor_fault": (0.35, 1000)}
    intensity, period = F.lit(0.0), F.lit(None).cast("int")
    for level, (i, p) in by_level.items():
        intensity, period = F.when(F.col("level") == level, i).otherwise(intensity), F.when(F.col("level") == level, p).otherwise(period)
    return decisions.withColumn("intensity", intensity).withColumn("pulse_period_ms", period)


def replay(readings: DataFrame, config: FusionConfig, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Decisions with commands for recorded readings.  Late ones change nothing, or, if ``strict``, stop the query, as in the file scan."""
    by = by or ["rig_id"]
    if strict:
        before = F.lag("timestamp_ns").over(W.partitionBy(*by).orderBy("seq"))
        fault = F.raise_error(F.concat(F.lit("reading "), F.col("seq").cast("string"), F.lit(": timestamps must not decrease"))).cast("bigint")
        readings = readings.withColumn("timestamp_ns", F.when(F.col("timestamp_ns") < before, fault).otherwise(F.col("timestamp_ns")))
    return to_haptic(fuse_ranges(readings, config, by))


def evaluate(readings: DataFrame, frames: DataFrame, config: FusionConfig, by: list[str] | None = None) -> DataFrame:
    """Whole decisions: range state, labels of the fresh frame, the reason in words, and the command."""
    decided = attach_vision(fuse_ranges(readings, config, by), frames, config, by)
    return to_haptic(decided.withColumn("reason", reason_text(S.python_fixed)))
