"""Fixtures of single operators, and randomised comparison with sequential restatements."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fluxgrid import schemas
from fluxgrid.functions import scalars as S
from fluxgrid.operators import dataset as D
from fluxgrid.operators import fusion as U
from fluxgrid.operators import reports as R
from fluxgrid.operators import sequences as Q
from fluxgrid.sources import readers, sinks

READING = "rig_id bigint, seq bigint, sensor_id string, kind string, timestamp_ns bigint, sector string, distance_m double, valid boolean"
MS = 1_000_000


def sequential(rows, config):
    """The fusion rules, one reading after another."""
    state, out = {}, []
    stale = int(config.sensor_stale_after_ms * MS)
    for rig, seq, sensor, kind, ts, sector, d, valid in rows:
        if (rig, sensor) not in state or ts >= state[rig, sensor][0]:
            state[rig, sensor] = (ts, kind, sector, d, valid)
        live = [(x[3], x[2]) for (r, _), x in state.items() if r == rig and 0 <= ts - x[0] <= stale and x[4] and x[1] in ("tof", "ultrasonic") and x[3] is not None and 0 < x[3] < float("inf")]
        near = min((x for x, _ in live), default=None)
        level = "sensor_fault" if near is None else "critical" if near <= config.critical_distance_m else "warning" if near <= config.warning_distance_m else "clear"
        limit = {"critical": config.critical_distance_m, "warning": config.warning_distance_m}.get(level, -1)
        sectors = ["unknown"] if near is None else sorted({s for x, s in live if x <= limit})
        out.append((seq, level, sectors, near, len(live)))
    return sorted(out)


def trace(seed, n, late):
    draw = random.Random(seed)
    now, rows = 0, []
    for seq in range(n):
        now += draw.choice([0, 0, 40, 90, 260]) * MS
        ts = max(0, now - (draw.choice([0, 0, 120, 300]) * MS if late else 0))
        d = draw.choice([None, 0.0, -1.0, float("nan"), float("inf"), 0.4, 0.5, 0.8, 1.0, 1.5, 2.0])
        rows.append((draw.randrange(2), seq, f"s{draw.randrange(4)}", draw.choice(["tof", "ultrasonic", "tof", "imu"]), ts, draw.choice(["left", "center", "right"]), d, draw.random() > 0.1))
    return rows


@pytest.mark.parametrize("late", [False, True])
def test_fusion_equals_sequential(spark, late):
    rows, config = trace(5 + late, 700, late), U.FusionConfig()
    got = U.fuse_ranges(spark.createDataFrame(rows, READING), config).collect()
    assert sorted((r.seq, r.level, list(r.sectors), r.nearest_distance_m, r.fresh_range_sensor_count) for r in got) == sequential(rows, config)


def test_sample_trace_and_sink(spark, tmp_path):
    lines = ["# trace", ""] + [json.dumps({"sensor_id": s, "kind": k, "timestamp_ns": t * MS, "sector": c, "distance_m": d}) for s, k, t, c, d in [("tof-left", "tof", 100, "left", 2.0), ("tof-center", "tof", 110, "center", 1.5), ("ultrasonic-right", "ultrasonic", 120, "right", 0.9), ("tof-center", "tof", 130, "center", 0.4)]]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    r = readers.read_sensor_trace(spark, str(tmp_path / "t.jsonl")).withColumn("rig_id", F.lit(0))
    out = U.replay(r, U.FusionConfig()).orderBy("seq").collect()
    assert [x.level for x in out] == ["clear", "clear", "warning", "critical"]
    assert (out[3].intensity, out[3].pulse_period_ms, list(out[3].sectors)) == (1.0, 100, ["center"])
    sinks.write_decisions(U.fuse_ranges(r, U.FusionConfig()), str(tmp_path / "out"))
    assert '"level":"critical"' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


@pytest.mark.parametrize("bad", ['{"sensor_id": "a"}', "[]", '{"sensor_id":"a","kind":"sonar","timestamp_ns":1,"sector":"left"}', '{"sensor_id":"a","kind":"tof","timestamp_ns":1,"sector":"up"}'])
def test_bad_lines_stop_the_scan(spark, tmp_path, bad):
    (tmp_path / "t.jsonl").write_text(bad)
    with pytest.raises(Exception, match="line 1"):
        readers.read_sensor_trace(spark, str(tmp_path / "t.jsonl")).collect()


def test_decreasing_times_stop_the_scan(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"sensor_id": "a", "kind": "tof", "timestamp_ns": t, "sector": "left"}) for t in (2, 1)))
    with pytest.raises(Exception, match="must not decrease"):
        readers.read_sensor_trace(spark, str(tmp_path / "t.jsonl")).collect()


def test_vision_labels(spark):
    config = U.FusionConfig()
    rows = [(0, 1, "a", "tof", 110 * MS, "center", 2.0, True), (0, 2, "a", "tof", 125 * MS, "center", 0.7, True), (0, 3, "a", "tof", 700 * MS, "center", 0.7, True)]
    frames = spark.createDataFrame([(0, 0, 100 * MS, [("person", 0.9, "center"), ("car", 0.9, "left"), ("dog", 0.2, "center")])], "rig_id bigint, seq bigint, model_finished_ns bigint, detections array<struct<class_name: string, confidence: double, sector: string>>")
    got = U.attach_vision(U.fuse_ranges(spark.createDataFrame(rows, READING), config), frames, config).orderBy("seq").collect()
    assert [list(r.semantic_labels) for r in got] == [["car", "person"], ["person"], []]


def test_conditional_claim(spark):
    rows = [("a", "test", "1", "h", True, 2, 0), ("a", "val", "2", "h", True, 2, 1), ("a", "train", "3", "h", True, 2, 2), ("a", "train", "4", "h", False, 0, 0), ("a", "train", "5", "g", True, 0, 0)]
    got = D.deduplicate_by_priority(spark.createDataFrame(rows, "source string, split string, path string, sha256 string, has_label boolean, lines int, kept_lines int"))
    assert {r.path: r.status for r in got.collect()} == {"1": "all_dropped", "2": "kept", "3": "duplicate", "4": "missing_label", "5": "kept"}


def test_label_lines(spark):
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(["0 0.5 0.5 0.2 0.4", "0 0.1 0.1 0.3 0.1 0.3 0.4 0.1 0.4", "1 x", "9 1 1 1 1", "0 1.0 0.5 0.2 0.2", "0.0 0 0 0 0", " ", "0 0.5 0.5 0.2"])], "source string, line_no int, text string")
    classes = spark.createDataFrame([("s", 0, "a", "person", True), ("s", 1, "b", None, True)], "source string, class_id int, source_class string, target_class string, mapped boolean")
    got = {r.line_no: r for r in D.parse_labels(lines, classes).collect()}
    assert [got[i].status for i in (0, 1, 2, 3, 4, 5, 7)] == ["kept", "kept", "dropped", "error", "error", "error", "error"]
    assert 6 not in got and abs(got[1].center_x - 0.2) < 1e-12 and abs(got[1].height - 0.3) < 1e-12


@pytest.mark.parametrize("threshold", [0, 3, 7])
def test_near_pairs_equal_brute_force(spark, threshold):
    draw = random.Random(threshold)
    base = [draw.getrandbits(64) for _ in range(12)] + [0, 1 << 63, (1 << 64) - 1]
    rows = []
    for k in range(160):
        h = draw.choice(base)
        for _ in range(draw.randint(0, threshold + 1)):
            h ^= 1 << draw.randrange(64)
        rows.append((draw.choice(["train", "val", "test"]), f"p{k:03d}", f"sha{draw.randrange(120)}", h - (1 << 64) if h >> 63 else h))
    rank = {"train": 0, "val": 1, "test": 2}
    want = set()
    for a in rows:
        for b in rows:
            d = bin((a[3] ^ b[3]) & (1 << 64) - 1).count("1")
            if (rank[a[0]], a[1]) < (rank[b[0]], b[1]) and a[0] != b[0] and a[2] != b[2] and d <= threshold:
                want.add((d, a[0], a[1], b[0], b[1]))
    got = D.near_pairs(spark.createDataFrame(rows, "split string, path string, sha256 string, dhash64 bigint"), threshold)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_removals_are_not_transitive(spark):
    pairs = spark.createDataFrame([(1, "train", "s__a", "val", "s__b"), (2, "val", "s__b", "test", "s__c"), (0, "train", "t__a", "val", "s__b")], schemas.NEAR_PAIRS)
    assert {r.removed_path: (list(r.kept_paths), r.min_distance) for r in D.removals(pairs).collect()} == {"s__a": (["s__b"], 1), "s__b": (["s__c"], 2)}


def test_history(spark):
    rows = spark.createDataFrame([("r", 0, 0, "first", 1, 0.5), ("r", 1, 0, "resume", 1, 0.5), ("r", 1, 1, "resume", 2, 0.6), ("q", 0, 0, "first", 1, float("nan")), ("q", 1, 0, "resume", 1, float("nan")), ("q", 1, 1, "resume", 3, 0.1)], "run string, source_idx int, row_idx int, source string, epoch int, m double")
    accepted, duplicates, divergent = Q.merge_history(rows, ["run"], ["m"])
    assert sorted((r.run, r.epoch, r.source) for r in accepted.collect()) == [("q", 1, "resume"), ("q", 3, "resume"), ("r", 1, "resume"), ("r", 2, "resume")]
    assert duplicates.count() == 2 and [r.run for r in divergent.collect()] == ["q"]
    assert [tuple(r) for r in Q.missing_epochs(rows, ["run"]).collect()] == [("q", 2)]


def test_summary_of_one_and_of_nothing(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", None), ("b", float("nan"))], "k string, value double")
    got = {r.k: r for r in Q.summarize(rows, ["k"]).collect()}
    assert (got["a"].stdev, got["a"].p95, got["a"].rate) == (0.0, 5.0, 200.0)
    assert got["b"]["count"] == 0 and got["b"].mean is None


def test_cover_sample(spark):
    rows = [(i, [["a"], ["a", "b"], [], ["c"], ["b", "c"], []][i % 6]) for i in range(60)]
    got = R.cover_sample(spark.createDataFrame(rows, "k int, classes array<string>"), "k", "classes", 10).orderBy("position").collect()
    assert len(got) == 10 and [r.k for r in got[:3]] == [1, 4, 10] and [r.k for r in got[3:6]] == [2, 5, 8]


def test_scalars(spark):
    row = spark.range(1).select(
        S.python_fixed(F.lit(0.0625), 3).alias("fixed"), S.lineage_key(F.lit("Frame_JPG.rf." + "a" * 32)).alias("key"), S.slug(F.lit("-My Set!")).alias("slug"), S.horizontal_sector(F.lit(100), F.lit(300)).alias("edge"),
        S.difference_hash(F.array(*[F.lit(9 - i % 9) for i in range(72)])).alias("dhash"), S.is_close(F.lit(float("nan")), F.lit(float("nan"))).alias("nan"),
    ).first()
    assert (row.fixed, row.key, row.slug, row.edge, row.dhash, row.nan) == ("0.062", "frame_jpg", "my-set", "center", -1, False)


def test_mount_profile(spark):
    good = ("p", "near_top_handle", "forward", 40.0, 80.0, 10.0, 5.0, 0.0, 5.0, True, True, True, False)
    rows = [good, good[:3] + (81.0,) + good[4:], good[:9] + (False,) + good[10:]]
    got = spark.createDataFrame(rows, schemas.MOUNT_PROFILE).select(R.mount_failure().alias("f")).collect()
    assert [r.f is None for r in got] == [True, False, False]


def test_mount_profile_without_a_field(spark):
    good = ("p", "near_top_handle", "forward", 40.0, 80.0, 10.0, 5.0, 0.0, 5.0, True, True, True, False)
    rows = [good[:k] + (None,) + good[k + 1 :] for k in range(12)]
    got = spark.createDataFrame(rows, schemas.MOUNT_PROFILE).select(R.mount_failure().alias("f")).collect()
    assert all(r.f is not None for r in got)


def test_white_space_lines_and_worth_of_valid(spark, tmp_path):
    base = '{"sensor_id":"a","kind":"tof","timestamp_ns":%d,"sector":"left","distance_m":1%s}'
    values = ["", ',"valid":null', ',"valid":"false"', ',"valid":false', ',"valid":true', ',"valid":0', ',"valid":0.5', ',"valid":""', ',"valid":[]', ',"valid":{"x":1}']
    lines = ["\t", " \t # note", *[base % (k, v) for k, v in enumerate(values)]]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = readers.read_sensor_trace(spark, str(tmp_path / "t.jsonl")).orderBy("seq").collect()
    assert [r.valid for r in got] == [True, False, True, False, True, False, True, False, False, True]


def test_number_spellings(spark):
    rows = [("1",), ("1.5e2",), (".5",), ("-3.",), ("inf",), ("1f",), ("1.0d",), ("0x1",), ("",), ("1 2",)]
    got = [r.f for r in spark.createDataFrame(rows, "t string").select(S.parse_float(F.col("t")).alias("f")).collect()]
    assert got == [1.0, 150.0, 0.5, -3.0, float("inf"), None, None, None, None, None]


def test_strict_replay_and_evaluate(spark):
    rows = [(0, 1, "a", "tof", 200 * MS, "center", 0.4, True), (0, 2, "a", "tof", 100 * MS, "center", 3.0, True)]
    readings = spark.createDataFrame(rows, READING)
    assert U.replay(readings, U.FusionConfig()).count() == 2
    with pytest.raises(Exception, match="must not decrease"):
        U.replay(readings, U.FusionConfig(), strict=True).collect()
    frames = spark.createDataFrame([(0, 0, 190 * MS, [("bicycle", 0.9, "center"), ("person", 0.9, "left")])], "rig_id bigint, seq bigint, model_finished_ns bigint, detections array<struct<class_name: string, confidence: double, sector: string>>")
    first = U.evaluate(readings, frames, U.FusionConfig()).orderBy("seq").first()
    assert (first.level, list(first.semantic_labels), first.intensity, first.pulse_period_ms) == ("critical", ["bicycle"], 1.0, 100)
    assert first.reason == "nearest range 0.400 m; vision labels: bicycle"


def test_trees_and_truncated_lists(spark, tmp_path):
    for name in ("train/b.jpg", "train/a.PNG", "val/c.jpg", "test/d.webp", "other/e.jpg"):
        (tmp_path / "images" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "images" / name).write_bytes(b"x")
    got = {(r.split, r.path.rpartition("/")[2], r.position) for r in readers.scan_processed_tree(spark, str(tmp_path)).collect()}
    assert got == {("train", "a.PNG", 0), ("train", "b.jpg", 1), ("val", "c.jpg", 0), ("test", "d.webp", 0)}
    for name in ("valid/images/a.JPG", "val/images/b.jpg", "train/images/c.txt", "train/images/d.jpeg"):
        (tmp_path / "raw" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / name).write_bytes(b"y")
    assert {(r.split, r.stem) for r in readers.scan_image_tree(spark, str(tmp_path / "raw"), "s").collect()} == {("val", "a"), ("train", "d")}
    rows, total, cut = R.truncated(spark.range(7), ["id"], 3)
    assert ([r.id for r in rows.collect()], total, cut) == ([0, 1, 2], 7, True)


def test_stream_equals_batch(spark, tmp_path):
    from fluxgrid.streaming.fusion_stream import stream_fusion

    rows, config = trace(11, 150, True), U.FusionConfig()
    spark.createDataFrame(rows, READING).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = stream_fusion(spark.readStream.schema(READING).parquet(str(tmp_path / "in")), config)
    q = out.writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("decisions").collect()
    assert sorted((r.seq, r.level, list(r.sectors), r.nearest_distance_m, r.fresh_range_sensor_count) for r in got) == sequential(rows, config)


def test_many_live_sensors_make_no_pairs(spark):
    """Every sensor is live at every decision: results are as counted by hand, and no join pairs decisions with readings."""
    n, config = 3_000, U.FusionConfig()
    rows = [(0, k, f"s{k}", "tof", k, "left" if k % 2 else "right", 0.3 if k == 2_000 else 0.8 if k == 1_001 else 2.0, True) for k in range(n)]
    out = U.fuse_ranges(spark.createDataFrame(rows, READING), config)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.seq: (r.level, list(r.sectors), r.fresh_range_sensor_count) for r in out.collect()}
    want = {k: ("clear", []) if k < 1_001 else ("warning", ["left"]) if k < 2_000 else ("critical", ["right"]) for k in range(n)}
    assert got == {k: (*v, k + 1) for k, v in want.items()}
    frames = spark.createDataFrame([(0, 5, 3, [])], "rig_id bigint, seq bigint, model_finished_ns bigint, detections array<struct<class_name: string, confidence: double, sector: string>>")
    assert "Join" not in U.attach_vision(out, frames, config)._jdf.queryExecution().optimizedPlan().toString()
