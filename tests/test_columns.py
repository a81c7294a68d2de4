"""Column builders and small joins against fixed values."""

import pytest
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S
from fluxgrid.operators import reports as R
from fluxgrid.operators import sequences as Q
from fluxgrid.sources import readers, sinks
from fluxgrid.streaming.fusion_stream import newer_than

BOX = "named_struct('x1', 10D, 'y1', 20D, 'x2', 40D, 'y2', 60D)"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_boxes_and_sectors(spark):
    box = F.expr(BOX)
    row = one(spark, c=S.box_center(box), a=S.box_area(box), s=S.assign_sectors(F.array(F.expr(f"named_struct('box', {BOX}, 'sector', 'unknown')"), F.expr(f"named_struct('box', {BOX}, 'sector', 'left')")), F.lit(50)), t=S.thumbnail_size(F.lit(1000), F.lit(10), 100), u=S.thumbnail_size(F.lit(30), F.lit(20), 100), v=S.thumbnail_size(F.lit(5000), F.lit(3), 100))
    assert (tuple(row.c), row.a, [d.sector for d in row.s]) == ((25.0, 40.0), 1200.0, ["center", "center"])
    assert (tuple(row.t), tuple(row.u), tuple(row.v)) == ((100, 1), (30, 20), (100, 1))


def test_times_and_numbers(spark):
    ns = lambda x: F.lit(x).cast("bigint")
    row = one(spark, ms=S.ms_between(ns(7_500_000), ns(5_000_000)), none=S.ms_between(ns(None), ns(1)), st=S.stage(F.create_map(F.lit("a"), F.lit(2.0)), "a"), no=S.stage(F.create_map(F.lit("a"), F.lit(2.0)), "b"), r=S.ratio(F.lit(1.0), F.lit(4.0)), z=S.ratio(F.lit(1.0), F.lit(0.0)), hot=S.celsius(F.lit(61_000.0)), cold=S.celsius(F.lit(61.0)))
    assert (row.ms, row.none, row.st, row.no, row.r, row.z, row.hot, row.cold) == (2.5, None, 2.0, 0.0, 0.25, 0.0, 61.0, 61.0)
    second = 1_000_000_000
    clock = [S.sane_capture_time(ns(s), ns(20 * second), ns(3)) for s in (19 * second, 21 * second, 9 * second, 10 * second, None)]
    assert list(one(spark, **{f"c{k}": c for k, c in enumerate(clock)})) == [19 * second, 3, 3, 10 * second, 3]


def test_names_and_paths(spark):
    names = {"a_ncnn_model/": "ncnn", "m_OPENVINO_model": "openvino", "x.onnx": "onnxruntime", "x.mnn": "mnn", "x.tflite": "litert", "x.PT": "pytorch", "x.bin": "unknown"}
    assert list(one(spark, **{f"n{k}": S.backend_name(F.lit(n)) for k, n in enumerate(names)})) == list(names.values())
    paths = {"a/b": False, "/a": True, "../a": True, "a/../b": True, "a\\b": True, "a..b": False, "..": True}
    assert list(one(spark, **{f"p{k}": S.unsafe_path(F.lit(p)) for k, p in enumerate(paths)})) == list(paths.values())
    row = one(spark, o=S.output_stem(F.lit("My Set"), F.lit("img"), F.lit("0123456789abcdef")), s=S.snapshot_name(F.lit("last"), F.lit(7), F.lit("0123456789abcdef")), e=S.completed_epoch(F.lit(4), F.array(F.lit(1))), h=S.completed_epoch(F.lit(-1), F.array(F.lit(1), F.lit(9))), n=S.completed_epoch(F.lit(-1), F.array().cast("array<int>")))
    assert tuple(row) == ("my-set__img__0123456789", "last-epoch-007-0123456789ab", 5, 9, None)


def test_rows_to_run(spark):
    matrix = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    done = spark.createDataFrame([("a", "complete"), ("b", "failed")], "id string, status string")
    assert sorted(r.id for r in R.selected_rows(matrix, ["a", "b"], done).collect()) == ["b"] and R.selected_rows(matrix, None).count() == 3
    with pytest.raises(ValueError, match=r"\['x'\]"):
        R.selected_rows(matrix, ["a", "x"])
    merged = R.merged_config({"threads": F.lit(2), "imgsz": F.lit(None).cast("int")}, {"threads": F.lit(0)}, {"threads": 4, "imgsz": 640, "precision": "fp32"})
    assert tuple(one(spark, **merged)) == (2, 640, "fp32")
    rows = R.rows_with_registry(spark.createDataFrame([("r1", "m"), ("r2", "none")], "id string, model_key string"), spark.createDataFrame([("m", "p")], "model_key string, path string"))
    assert {r.id: (r.path, r.status) for r in rows.collect()} == {"r1": ("p", "ready"), "r2": (None, "failed")}
    first = R.first_existing(spark.createDataFrame([("k", "x", 0), ("k", "y", 1), ("k", "z", 2), ("l", "x", 0)], "k string, path string, position int"), spark.createDataFrame([("z",), ("y",), ("y",)], "path string"), ["k"])
    assert {r.k: r.path for r in first.collect()} == {"k": "y", "l": None}
    assert [tuple(r) for r in R.split_counts_match(spark.createDataFrame([("train",), ("train",)], "split string"), {"train": 2, "val": 1}).orderBy("split").collect()] == [("train", 2, 2, True), ("val", 1, 0, False)]
    gated = spark.createDataFrame([("g", True), ("h", False)], "gate string, ok boolean")
    with pytest.raises(ValueError, match="h"):
        R.require(gated)
    R.require(gated.where("ok"))


def test_transposed_and_newer(spark):
    rows = Q.transposed(spark.createDataFrame([("r", [1, 2], [0.5, 0.6])], "run string, epoch array<int>, m array<double>"), ["epoch", "m"])
    assert sorted(map(tuple, rows.select("run", "row_idx", "epoch", "m").collect())) == [("r", 0, 1, 0.5), ("r", 1, 2, 0.6)]
    for bad in (("r", [1], [0.5, 0.6]), ("r", [0], [0.5])):
        with pytest.raises(Exception, match="length|positive"):
            Q.transposed(spark.createDataFrame([bad], "run string, epoch array<int>, m array<double>"), ["epoch", "m"]).collect()
    seen = spark.createDataFrame([("a", 3), ("a", 5)], "k string, n int")
    assert sorted(map(tuple, newer_than(spark.createDataFrame([("a", 5), ("a", 6), ("b", 1)], "k string, n int"), seen, ["k"], "n").collect())) == [("a", 6), ("b", 1)]


def test_files_and_tables(spark, tmp_path):
    files = spark.createDataFrame([("d/data.yaml",), ("d/images/train/a.jpg",), ("e/data.yaml",), ("f/images/train/b.jpg",)], "path string")
    assert [r.root for r in readers.dataset_roots(files).collect()] == ["d"]
    (tmp_path / "data.yaml").write_text("train: images/train\npath: old\n")
    (tmp_path / "bare.yaml").write_text("train: images/train\n")
    lines = readers.rewritten_root(readers.numbered_lines(spark, str(tmp_path)), "/new").collect()
    assert sorted((r.path.rpartition("/")[2], r.text) for r in lines if r.text.startswith("path:")) == [("bare.yaml", "path: /new"), ("data.yaml", "path: /new")]
    pairs = spark.createDataFrame([(2, "b"), (1, "c"), (1, "a"), (3, "d")], "hamming_distance int, left_path string").withColumn("right_path", F.lit("r"))
    assert [r.left_path for r in sinks.page(pairs, 1, 2).orderBy("hamming_distance").collect()] == ["c", "b"]
    sinks.write_atomic_json({"b": 1, "a": None}, str(tmp_path / "deep" / "r.json"))
    assert (tmp_path / "deep/r.json").read_text() == '{\n  "a": null,\n  "b": 1\n}\n' and [p.name for p in (tmp_path / "deep").iterdir()] == ["r.json"]
    assert sinks.markdown_table(spark.createDataFrame([("x", 1.234, None)], "a string, b double, c int")) == "| a | b | c |\n|---|---|---|\n| x | 1.23 | NA |\n"
