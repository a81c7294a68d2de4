"""A batch of any size is decided in bounded parts, with the results of a plain loop over the rows."""

import json
import random

import pandas as pd
import pytest

from fluxgrid.operators import fusion as U
from fluxgrid.streaming import evaluate_stream as E

MS = 1_000_000
NAMES = ("seq", "reading", "arrived_ms", "at_ns", "sensor_id", "sector", "distance_m", "usable", "labels")


class State(dict):
    """A state variable of any kind, in memory."""

    iterator = lambda self: iter(list(self.items()))
    getValue = lambda self, k: self.get(k)
    updateValue = lambda self, k, v: self.__setitem__(k, v)
    removeKey = lambda self, k: self.__delitem__(k)
    exists = lambda self: bool(self)
    clear = dict.clear
    update = lambda self, v: self.__setitem__("", v)

    def get(self, *key):
        return super().get(*key) if key else super().get("", ())

    def put(self, rows):
        self[""] = list(rows)

    def appendList(self, rows):
        self[""] = [*self.get(), *rows]


class Handle:
    def __init__(self):
        self.kept, self.timers = {}, set()

    def variable(self, name, *_):
        return self.kept.setdefault(name, State())

    getMapState = getValueState = getListState = variable
    listTimers = lambda self: iter(sorted(self.timers))
    registerTimer = lambda self, at: self.timers.add(at)


class Passed:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def drawn(seed, n):
    draw, rows, at = random.Random(seed), [], 1_000
    for seq in range(n):
        at += draw.choice([0, 0, 30, 90])
        late = draw.choice([0, 0, 0, 130, 400])
        if draw.random() < 0.4:
            labels = [f"{draw.choice(['left', 'right', ''])}|{draw.choice(['car', 'dog', 'a|b'])}" for _ in range(draw.randrange(3))]
            rows.append((seq, False, at, (at - late) * MS, None, None, None, False, draw.choice([labels, labels, None])))
        if draw.random() < 0.9:
            d = draw.choice([0.4, 0.5, 0.8, 1.0, 1.5, 2.0])
            rows.append((seq, True, at, (at - late) * MS, f"s{draw.randrange(7)}", draw.choice(["left", "center", "right", None]), d, draw.random() < 0.8, None))
    return rows


def looped(rows, config):
    """(seq, level, sectors, nearest, how many, labels) of each reading: all sensors are looked at for each."""
    sensors, frame, out = {}, None, []
    for seq, reading, _, at, sensor, sector, d, usable, labels in sorted(rows, key=lambda r: r[:2]):
        if not reading:
            frame = (at, labels or []) if frame is None or at >= frame[0] else frame
            continue
        if sensor not in sensors or at >= sensors[sensor][0]:
            sensors[sensor] = (at, sector, d, usable)
        live = [s for s in sensors.values() if s[3] and 0 <= at - s[0] <= config.sensor_stale_after_ms * MS]
        near = min((s[2] for s in live), default=None)
        if near is None:
            out.append((seq, "sensor_fault", ["unknown"], None, 0, []))
            continue
        level, most = ("critical", 0.5) if near <= 0.5 else ("warning", 1.0) if near <= 1.0 else ("clear", -1)
        sectors = sorted({s[1] for s in live if s[2] <= most and s[1] is not None})
        fresh = frame is not None and 0 <= at - frame[0] <= config.vision_stale_after_ms * MS
        named = [x.partition("|") for x in frame[1]] if fresh else []
        out.append((seq, level, sectors, near, len(live), sorted({x[2] for x in named if not sectors or x[0] in sectors})))
    return out


def shown(frames):
    names = ["seq", "level", "sectors", "nearest_distance_m", "fresh_range_sensor_count", "semantic_labels"]
    rows = [r for f in frames for r in f[names].itertuples(index=False)]
    return [(r.seq, r.level, list(r.sectors), None if pd.isna(r.nearest_distance_m) else r.nearest_distance_m, r.fresh_range_sensor_count, list(r.semantic_labels)) for r in rows]


def run(rows, watermarks, batch=150):
    """All rows in one batch, then timers as the watermark passes; frames by watermark, and the state."""
    handle, state = Handle(), E.RigState(U.FusionConfig())
    state.init(handle)
    as_json = isinstance(getattr(E, "STATE_SETTINGS", None), dict)
    rows = [(*r[:8], json.dumps(r[8]) if as_json and r[8] is not None else r[8]) for r in rows]
    parts = (pd.DataFrame(rows[k : k + batch], columns=NAMES) for k in range(0, len(rows), batch))
    out = [list(state.handleInputRows((5,), parts, Passed(watermarks[0])))]
    for at in watermarks[1:]:
        found = []
        for due in [t for t in handle.listTimers() if t <= at]:
            found += state.handleExpiredTimer((5,), Passed(at), None)
            handle.timers.discard(due)
        out.append(found)
    return out, handle


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, size in (("RUN", 300), ("BLOCK", 40), ("CHUNK", 200), ("FAN", 3)):
        monkeypatch.setattr(E, name, size, raising=False)


@pytest.mark.parametrize("order", ["shuffled", "sorted", "reversed"])
def test_backlog_is_decided_in_parts(order):
    rows = drawn(order, 4_000)
    want, last = looped(rows, U.FusionConfig()), rows[-1][2]
    if order != "sorted":
        random.Random(3).shuffle(rows) if order == "shuffled" else rows.reverse()
    out, handle = run(rows, [0, last // 3, last // 2, last])
    frames = [f for part in out for f in part]
    assert shown(frames) == want
    assert len(frames) > 15 and max(map(len, frames)) <= 200
    assert out[0] == [] and all(out[1:])  # each watermark lets go what it has passed
    assert not handle.kept["waiting"] and not handle.kept["index"]


def test_state_holds_bounded_blocks():
    rows = drawn(2, 4_000)
    random.Random(2).shuffle(rows)
    _, handle = run(rows, [0])
    waiting = handle.kept["waiting"]
    assert len(waiting) > len(rows) // 40 and max(len(v[0]) for v in waiting.values()) < 10_000
    assert len(handle.timers) == 1  # the least arrival, not one for each second


def test_rows_passed_on_arrival_are_decided_at_once():
    rows = drawn(4, 2_000)
    want, last = looped(rows, U.FusionConfig()), rows[-1][2]
    random.Random(4).shuffle(rows)
    out, handle = run(rows, [last // 2, last])
    assert out[0] and out[1] and shown([*out[0], *out[1]]) == want
    assert not handle.kept["waiting"]


def test_arrivals_at_one_moment():
    rows = [(*r[:2], 7, *r[3:]) for r in drawn(6, 1_500)]
    want = looped(rows, U.FusionConfig())
    random.Random(6).shuffle(rows)
    out, _ = run(rows, [0, 7])
    assert shown(out[1]) == want


def test_stores_do_not_grow_with_shuffle_partitions(spark, tmp_path, monkeypatch):
    from fluxgrid.plans import catalog

    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    monkeypatch.setattr(catalog, "shared_dir", lambda _: str(tmp_path))
    try:
        found = catalog.QUERIES["fusion_stream"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "61"
        assert found.count() == 1_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    (place,) = tmp_path.iterdir()
    assert len([x for x in (place / "state" / "state" / "0").iterdir() if x.name.isdigit()]) <= 24
