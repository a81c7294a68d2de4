"""Traces of one large file, read by many tasks."""

import json

import pytest
from pyspark.sql import functions as F

from fluxgrid.sources import readers

MS = 1_000_000


def line(k, at=None, **more):
    return json.dumps({"sensor_id": f"s{k % 5}", "kind": "tof", "timestamp_ns": (k if at is None else at) * MS, "sector": "left", "distance_m": k / 10} | more)


@pytest.fixture
def small_splits(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_one_file_is_read_by_many_tasks_with_exact_numbers(small_splits, tmp_path, end):
    spark, rows = small_splits, []
    for k in range(3_000):
        if k % 7 == 0:
            rows.append("# note" if k % 2 else "")
        rows.append(line(k, note="x" * (k % 50) + ("y" * 9_000 if k == 1_500 else "")))
    (tmp_path / "t.jsonl").write_bytes((end.join(rows) + end).encode())
    (tmp_path / "u.jsonl").write_bytes(f"\n{line(5)}\n\n{line(9)}".encode())
    (tmp_path / "v.jsonl").write_bytes(b"")
    assert spark.read.text(str(tmp_path / "t.jsonl")).rdd.getNumPartitions() > 50
    want = {(f"{name}", n, int(json.loads(x)["timestamp_ns"])) for name, xs in (("t", rows), ("u", ["", line(5), "", line(9)])) for n, x in enumerate(xs, 1) if x.startswith("{")}
    got = readers.read_sensor_trace(spark, str(tmp_path)).select(F.regexp_extract("path", r"(\w)\.jsonl$", 1), "seq", "timestamp_ns").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    numbered = readers.numbered_lines(spark, str(tmp_path / "t.jsonl")).orderBy("line_no").collect()
    assert [r.text for r in numbered] == rows and [r.line_no for r in numbered] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("fall", [1, 2, 700, 1_999])
def test_a_fall_of_time_is_found_within_and_across_splits(small_splits, tmp_path, fall):
    rows = [line(k, at=100 + k - (2 if k == fall else 0)) for k in range(2_000)]
    (tmp_path / "t.jsonl").write_text("\n".join(rows))
    with pytest.raises(Exception, match=f"line {fall + 1}: timestamps must not decrease"):
        readers.read_sensor_trace(small_splits, str(tmp_path / "t.jsonl")).collect()


def test_every_boundary_is_checked(small_splits, tmp_path):
    """The first reading of each split in turn falls; splits without a reading lie between."""
    rows = [line(k, at=100 + k) for k in range(400)]
    (tmp_path / "t.jsonl").write_text("\n".join(rows))
    splits = small_splits.read.text(str(tmp_path / "t.jsonl")).groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()
    at = 0
    for s in splits[:-1]:
        at += s["count"]
        bad = rows.copy()
        bad[at] = line(at, at=100 + at - 2)
        bad[at - 1 : at - 1] = ["# " + "-" * 6_000]
        (tmp_path / "t.jsonl").write_text("\n".join(bad))
        with pytest.raises(Exception, match=f"line {at + 2}: timestamps must not decrease"):
            readers.read_sensor_trace(small_splits, str(tmp_path / "t.jsonl")).collect()
