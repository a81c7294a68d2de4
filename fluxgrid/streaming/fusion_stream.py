"""Streaming fusion: keyed last-writer-wins state with a decision per arrival, and the conflating buffer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxgrid.functions.scalars import ms_to_ns
from fluxgrid.operators.fusion import FusionConfig

OUTPUT = "rig_id bigint, seq bigint, timestamp_ns bigint, level string, sectors array<string>, nearest_distance_m double, fresh_range_sensor_count int, range_triggered boolean"
_STATE = "sensors array<struct<sensor_id: string, timestamp_ns: bigint, sector: string, distance_m: double, usable: boolean>>"


def stream_fusion(readings: DataFrame, config: FusionConfig) -> DataFrame:
    """Decisions of a stream of readings with rig_id and seq, by the same rules as ``fuse_ranges``.

    State per rig: the latest reading of each of its sensors.  A reading older
    than its sensor's stored one changes nothing but still gets its decision.
    Within a batch rows are taken by ``seq``, as arrival order is not promised.
    """
    stale, critical, warning = ms_to_ns(config.sensor_stale_after_ms), config.critical_distance_m, config.warning_distance_m

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {s[0]: tuple(s) for s in state.get[0]} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            d = r.distance_m
            usable = bool(r.valid) and r.kind in ("tof", "ultrasonic") and d is not None and d == d and 0 < d < float("inf")
            if r.sensor_id not in held or r.timestamp_ns >= held[r.sensor_id][1]:
                held[r.sensor_id] = (r.sensor_id, int(r.timestamp_ns), r.sector, float(d) if d is not None and d == d else None, usable)
            live = [s for s in held.values() if s[4] and 0 <= r.timestamp_ns - s[1] <= stale]
            near = min((s[3] for s in live), default=None)
            level = "sensor_fault" if near is None else "critical" if near <= critical else "warning" if near <= warning else "clear"
            limit = {"critical": critical, "warning": warning}.get(level)
            sectors = ["unknown"] if near is None else sorted({s[2] for s in live if limit is not None and s[3] <= limit})
            out.append((key[0], int(r.seq), int(r.timestamp_ns), level, sectors, near, len(live), level in ("critical", "warning")))
        state.update(([list(s) for s in held.values()],))
        yield pd.DataFrame(out, columns=["rig_id", "seq", "timestamp_ns", "level", "sectors", "nearest_distance_m", "fresh_range_sensor_count", "range_triggered"])

    return readings.groupBy("rig_id").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def conflating_sink(deliver, keys: list[str], order: str):
    """A ``foreachBatch`` function that delivers only each key's newest row of the batch, with how many it displaced."""
    from fluxgrid.operators.sequences import conflate

    def sink(batch: DataFrame, epoch: int) -> None:
        deliver(conflate(batch, keys, order), epoch)

    return sink


def newer_than(rows: DataFrame, seen: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows strictly newer than the last one delivered for their key."""
    last = seen.groupBy(*keys).agg(F.max(order).alias("_last"))
    return rows.join(last, keys, "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")
