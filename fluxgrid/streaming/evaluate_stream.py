"""Whole decisions over two streams, ranges and vision frames: range state, labels, reason and command.

Decisions depend on the order of arrival (``seq``), which streams do not keep.
Rows are held until the watermark over their arrival time has passed them, and
then taken by ``seq``: so a shuffled, late or restarted stream decides as
``operators.fusion.evaluate`` does over the bounded tables.

One batch may bring a rig any number of rows (a backlog, a whole table): they
go to state in sorted runs of blocks and are merged from there, so a task holds
some blocks of them and no more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fluxgrid.functions import scalars as S
from fluxgrid.operators.fusion import FusionConfig, live_ranges, reason_text, to_haptic, usable_range

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buffers of all the state stores of an executor together have a bound; else each store has its own.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
}
#: Rows to a run that is sorted in memory, to a block of it in state, and decided at once; runs that are merged to one.
RUN, BLOCK, CHUNK, FAN = 1 << 18, 1 << 13, 1 << 16, 32
#: Labels as a JSON list of "sector|class"; a row that waits is one of an Arrow block.
_ROW = pa.schema([
    ("seq", pa.int64()), ("reading", pa.bool_()), ("arrived_ms", pa.int64()), ("at_ns", pa.int64()), ("sensor_id", pa.string()), ("sector", pa.string()),
    ("distance_m", pa.float64()), ("usable", pa.bool_()), ("labels", pa.string()),
])
_DECIDED = (
    "rig_id bigint, seq bigint, timestamp_ns bigint, level string, sectors array<string>, nearest_distance_m double, "
    "fresh_range_sensor_count int, range_triggered boolean, semantic_labels array<string>, nearest_text string"
)
LEVELS = ("sensor_fault", "clear", "warning", "critical")
_NEVER = np.iinfo(np.int64).min


def _table(rows: pd.DataFrame | list) -> pa.Table:
    frame = pd.DataFrame(rows, columns=_ROW.names)
    return pa.Table.from_pandas(frame, _ROW, preserve_index=False)


def _ordered(tables: list[pa.Table]) -> pa.Table:
    """By seq; a frame of the same seq comes before a reading."""
    rows = pa.concat_tables(tables).combine_chunks()
    return rows.take(np.lexsort((_values(rows, "reading"), _values(rows, "seq"))))


def _values(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy()


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Each value's place in the list of the different ones, null too."""
    found = pc.dictionary_encode(values, null_encoding="encode").combine_chunks()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def _lists(of: np.ndarray, lists: list[list]) -> np.ndarray:
    table = np.empty(len(lists), object)
    for k, one in enumerate(lists):
        table[k] = one
    return table[of]


class Held:
    """The newest reading of each sensor: columns that grow, read from state once for all that is decided."""

    def __init__(self, kept: Iterator[tuple]) -> None:
        kept = [(k[0], *v) for k, v in kept]
        self.names = [r[0] for r in kept]
        self.place, self.sectors = {name: k for k, name in enumerate(self.names)}, {}
        self.at, self.d = np.array([r[1] for r in kept], np.int64), np.array([r[3] for r in kept], float)
        self.sector, self.usable = self.sectors_of([r[2] for r in kept]), np.array([r[4] for r in kept], bool)
        self.changed: set[int] = set()

    def sectors_of(self, names: list) -> np.ndarray:
        """A number for each name, the same throughout; -1 for none."""
        return np.array([-1 if name is None else self.sectors.setdefault(name, len(self.sectors)) for name in names], np.int64)

    def places_of(self, names: list) -> np.ndarray:
        new = [name for name in names if name not in self.place]
        for name in new:
            self.place[name] = len(self.names)
            self.names.append(name)
        more = len(new)
        self.at, self.d = np.append(self.at, np.full(more, _NEVER)), np.append(self.d, np.full(more, np.nan))
        self.sector, self.usable = np.append(self.sector, np.full(more, -1)), np.append(self.usable, np.zeros(more, bool))
        return np.array([self.place[name] for name in names], np.int64)

    def put(self, places: np.ndarray, at: np.ndarray, sector: np.ndarray, d: np.ndarray, usable: np.ndarray) -> None:
        self.at[places], self.sector[places], self.d[places], self.usable[places] = at, sector, d, usable
        self.changed.update(places.tolist())

    def rows(self) -> Iterator[tuple]:
        """(key, value) of each changed sensor, for state."""
        names = [*self.sectors, None]
        for k in self.changed:
            d = float(self.d[k])
            yield (self.names[k],), (int(self.at[k]), names[self.sector[k]], None if d != d else d, bool(self.usable[k]))


class RigState(StatefulProcessor):
    """State of one rig: its sensors' newest readings, the newest frame, and the rows that wait for the watermark.

    The rows that wait lie in blocks, each in order of seq; ``index`` has each
    one's number, first seq, least and greatest arrival.  A timer at the least
    arrival lets them go when nothing else arrives.
    """

    def __init__(self, config: FusionConfig) -> None:
        self.config = config
        self.sensor_ns, self.vision_ns = S.ms_to_ns(config.sensor_stale_after_ms), S.ms_to_ns(config.vision_stale_after_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sensors = handle.getMapState("sensors", "sensor_id string", "timestamp_ns bigint, sector string, distance_m double, usable boolean")
        self.frame = handle.getValueState("frame", "model_finished_ns bigint, labels string")
        self.index = handle.getValueState("index", "blocks binary")
        self.waiting = handle.getMapState("waiting", "block bigint", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        blocks, runs, parts, size = self._blocks(), [[]], [], 0
        for batch in rows:
            parts.append(_table(batch))
            size += len(batch)
            if size >= RUN:
                runs[0].append(self._hold(blocks, [_ordered(parts)]))
                parts, size = [], 0
                self._merged(blocks, runs)
        rest = pa.concat_tables(parts) if parts else _table([])
        due = pc.less_equal(rest["arrived_ms"], passed)
        yield from self._decided(key[0], rest.filter(due), rest.filter(pc.invert(due)), passed, blocks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._decided(key[0], [], [], timerValues.getCurrentWatermarkInMs())

    def _blocks(self) -> dict[int, tuple]:
        """(first seq, least and greatest arrival) of the blocks that wait, by number."""
        kept = np.frombuffer(self.index.get()[0], np.int64).reshape(-1, 4).tolist() if self.index.exists() else []
        return {k: tuple(v) for k, *v in kept}

    def _hold(self, blocks: dict, tables) -> list[int]:
        """Puts rows in order of seq into new blocks of state, and says which."""
        made, number = [], max(blocks, default=-1) + 1
        for rows in tables:
            for start in range(0, len(rows), BLOCK):
                part = rows.slice(start, BLOCK)
                arrived, sink = _values(part, "arrived_ms"), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _ROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(part)
                self.waiting.updateValue((number,), (sink.getvalue().to_pybytes(),))
                blocks[number] = (part["seq"][0].as_py(), int(arrived.min()), int(arrived.max()))
                made.append(number)
                number += 1
        return made

    def _merged(self, blocks: dict, runs: list[list]) -> None:
        """As soon as there are FAN runs of a level, they become one of the next: so few blocks overlap however many rows come."""
        for level in range(len(runs)):
            if len(runs[level]) == FAN:
                numbers = [k for run in runs[level] for k in run]
                runs[level] = []
                if level + 1 == len(runs):
                    runs.append([])
                runs[level + 1].append(self._hold(blocks, self._taken(blocks, numbers)))

    def _taken(self, blocks: dict, numbers: list[int], passed: int | None = None, more: pa.Table | None = None) -> Iterator[pa.Table]:
        """Takes the rows of some blocks, with ``more``, in order of seq; rows that arrived after ``passed`` are held again."""
        numbers = sorted(numbers, key=lambda k: blocks[k][0])
        firsts = [blocks[k][0] for k in numbers]
        # numbers stay taken until the end: a new block must not have one that is still to be read
        pool, fresh, done = ([more] if more is not None and len(more) else []), 0, []
        for k, number in enumerate(numbers):
            rows = pa.ipc.open_stream(self.waiting.getValue((number,))[0]).read_all()
            self.waiting.removeKey((number,))
            done.append(number)
            if passed is not None and blocks[number][2] > passed:
                late = pc.greater(rows["arrived_ms"], passed)
                self._hold(blocks, [rows.filter(late)])
                rows = rows.filter(pc.invert(late))
            pool.append(rows)
            fresh += len(rows)
            if fresh >= CHUNK and k + 1 < len(numbers):
                rows = _ordered(pool)
                # blocks to come have no row before their first
                cut = int(np.searchsorted(_values(rows, "seq"), firsts[k + 1]))
                if cut:
                    yield rows.slice(0, cut)
                pool, fresh = [rows.slice(cut)], 0
        for number in done:
            del blocks[number]
        if pool and sum(map(len, pool)):
            yield _ordered(pool)

    def _decided(self, rig: int, now, later, passed: int, blocks: dict | None = None) -> Iterator[pd.DataFrame]:
        blocks = self._blocks() if blocks is None else blocks
        now, later = (x if isinstance(x, pa.Table) else _table(x) for x in (now, later))
        before = self.index.exists()
        if len(later):
            self._hold(blocks, [_ordered([later])])
        due = [k for k, (_, least, _) in blocks.items() if least <= passed]
        last = held = frame = None
        if due or len(now):
            held, frame = Held(self.sensors.iterator()), self.frame.get() if self.frame.exists() else None
            old = frame
            for rows in self._taken(blocks, due, passed, now):
                for start in range(0, len(rows), CHUNK):
                    if last is not None:
                        yield last
                    last, frame = self._chunk(rig, rows.slice(start, CHUNK), held, frame)
            for key, value in held.rows():
                self.sensors.updateValue(key, value)
            if frame is not old:
                self.frame.update(frame)
        if blocks:
            self.index.update((np.array([(k, *v) for k, v in blocks.items()], np.int64).tobytes(),))
            least = min(v[1] for v in blocks.values())
            if not any(passed < t <= least for t in list(self.handle.listTimers())):
                self.handle.registerTimer(least)
        elif before:
            self.index.clear()
        if last is not None:
            yield last

    def _chunk(self, rig: int, rows: pa.Table, held: Held, frame: tuple | None) -> tuple[pd.DataFrame | None, tuple | None]:
        """The decisions of rows in order, and the newest frame; ``held`` is then as they leave it."""
        reading, at = _values(rows, "reading"), _values(rows, "at_ns")
        # a frame that is taken stands until the next one; the held one is there before the first row
        f, r = np.flatnonzero(~reading), np.flatnonzero(reading)
        top = np.maximum.accumulate(np.append(frame[0] if frame else _NEVER, at[f]))
        f = f[at[f] >= top[:-1]]
        finished = np.append(frame[0] if frame else _NEVER, at[f])
        kind, kinds = _codes(pa.chunked_array([pa.array([frame[1] if frame else None], pa.string()), *rows["labels"].take(f).chunks]))
        decided = None
        if len(r):
            now = at[r]
            near, count, marked, names = self._met(rows.take(r), r, now, len(rows), held)
            level = np.select([np.isnan(near), near <= self.config.critical_distance_m, near <= self.config.warning_distance_m], [0, 3, 2], 1)
            k = np.searchsorted(f, r)
            seen = k > 0 if frame is None else np.ones(len(r), bool)
            age = np.where(seen, now - np.where(seen, finished[k], 0), -1)
            fresh = (level > 0) & (age >= 0) & (age <= self.vision_ns)
            sectors, labels = self._named(level, marked, names, np.where(fresh, kind[k] + 1, 0), kinds)
            text = np.full(len(r), None, object)
            distances, of = np.unique(near[level > 1], return_inverse=True)
            text[level > 1] = np.array([f"{d:.3f}" for d in distances], object)[of]
            columns = (np.full(len(r), rig), _values(rows, "seq")[r], now, np.array(LEVELS, object)[level], sectors, near, count.astype(np.int32), level > 1, labels, text)
            decided = pd.DataFrame(dict(zip((c.split()[0] for c in _DECIDED.split(", ")), columns, strict=True)))
        return decided, (int(finished[-1]), kinds[kind[-1]]) if len(f) else frame

    def _met(self, rows: pa.Table, place: np.ndarray, now: np.ndarray, n: int, held: Held) -> tuple:
        """(least distance, how many, critical and warning sectors by ``names``, names) of the fresh readings at each decision."""
        code, names = _codes(rows["sensor_id"])
        own = held.places_of(names)
        kind, names = _codes(rows["sector"])
        sector = held.sectors_of(names)[kind]
        others = np.ones(len(held.at), bool)
        others[own] = False
        # by sensor: the held reading, then the new ones; each that is accepted stands until the next
        cells = (np.arange(len(own)), np.full(len(own), -1), held.at[own], held.sector[own], held.d[own], held.usable[own])
        cells = [np.append(a, b) for a, b in zip(cells, (code, place, now, sector, _values(rows, "distance_m"), _values(rows, "usable")), strict=True)]
        order = np.lexsort((cells[1], cells[0]))
        rank = np.unique(cells[2], return_inverse=True)[1]
        line = (cells[0] * (len(rank) + 1) + rank)[order]
        sensor, since, at, sector, d, usable = (c[order[line == np.maximum.accumulate(line)]] for c in cells)
        newest = np.append(sensor[1:] != sensor[:-1], True)
        until = np.where(newest, n, np.append(since[1:], n))
        rest = np.count_nonzero(others)
        stood = [np.append(a, b) for a, b in zip((since, until, at, sector, d, usable), (np.full(rest, -1), np.full(rest, n), held.at[others], held.sector[others], held.d[others], held.usable[others]), strict=True)]
        live = stood[5] & (stood[2] <= now.max()) & (stood[2] >= now.min() - self.sensor_ns)
        put = newest & (since >= 0)
        held.put(own[sensor[put]], at[put], sector[put], d[put], usable[put])
        since, until, at, sector, d = (x[live] for x in stood[:5])
        found = sorted((name, k) for name, k in held.sectors.items() if np.any(sector == k))
        marks = [(sector == k) & (d <= most) for most in (self.config.critical_distance_m, self.config.warning_distance_m) for _, k in found]
        none = np.zeros(len(now), np.int64), np.zeros(len(at), np.int64)
        return *live_ranges((none[0], place, now), (none[1], since, until, at, d), self.sensor_ns, marks), [name for name, _ in found]

    def _named(self, level: np.ndarray, marked: np.ndarray, names: list, kind: np.ndarray, kinds: list) -> tuple[np.ndarray, np.ndarray]:
        """Sectors and labels of each decision; ``kind`` is 0 without a fresh frame, else 1 and its place in ``kinds``.  Each combination is made once."""
        hit = np.where((level == 3)[:, None], marked[:, : len(names)], marked[:, len(names) :] & (level == 2)[:, None])
        _, first, of = np.unique(np.column_stack([level.astype(np.uint8), np.packbits(hit, axis=1)]), axis=0, return_index=True, return_inverse=True)
        of = of.reshape(-1)
        sectors = [[names[j] for j in np.flatnonzero(hit[k])] if level[k] else ["unknown"] for k in first]
        pairs, pair = np.unique(of * (len(kinds) + 1) + kind, return_inverse=True)
        labels = []
        for both in pairs.tolist():
            at, k = divmod(both, len(kinds) + 1)
            named = [x.partition("|") for x in json.loads(kinds[k - 1] or "[]")] if k else []
            labels.append(sorted({name for sector, _, name in named if not sectors[at] or sector in sectors[at]}))
        return _lists(of, sectors), _lists(pair, labels)


def stream_evaluate(readings: DataFrame, frames: DataFrame, config: FusionConfig, delay: str = "10 seconds") -> DataFrame:
    """The decisions of ``evaluate`` for streams of readings and frames of one rig each.

    Both streams have rig_id, seq and ``arrived``, the time of arrival, which
    grows with ``seq``.  ``delay`` bounds how much later than others a row may
    come; rows beyond it are dropped by the watermark.  A frame of the same seq
    as a reading comes before it; one older than the newest changes nothing.
    A rig's state is its sensors, one frame and the rows of the last ``delay``;
    of those a task holds some runs' blocks at once, however many there are.
    """
    sure = F.transform(F.filter("detections", lambda d: d["confidence"] >= config.vision_confidence), lambda d: F.concat_ws("|", F.coalesce(d["sector"], F.lit("")), d["class_name"]))
    none = F.lit(None)
    # times are never null here: pandas would make floats of them, and lose nanoseconds
    ranged = readings.select("rig_id", "seq", "arrived", F.lit(True).alias("reading"), F.col("timestamp_ns").alias("at_ns"), F.col("sensor_id").cast("string").alias("sensor_id"), "sector", "distance_m", F.coalesce(usable_range(), F.lit(False)).alias("usable"), none.cast("string").alias("labels"))
    seen = frames.select(
        "rig_id", "seq", "arrived", F.lit(False).alias("reading"), F.col("model_finished_ns").alias("at_ns"), none.cast("string").alias("sensor_id"),
        none.cast("string").alias("sector"), none.cast("double").alias("distance_m"), F.lit(False).alias("usable"), F.to_json(sure).alias("labels"),
    )
    both = ranged.unionByName(seen).withWatermark("arrived", delay)
    # as the watermark has it: whole milliseconds
    both = both.withColumn("arrived_ms", F.unix_millis("arrived"))
    decided = both.groupBy("rig_id").transformWithStateInPandas(RigState(config), _DECIDED, "append", "EventTime")
    # the distance comes as text: formatting it here would take each task a second Python process
    return to_haptic(decided.withColumn("reason", reason_text(lambda *_: F.col("nearest_text"))).drop("nearest_text"))
