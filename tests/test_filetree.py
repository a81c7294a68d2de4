"""Trees are published whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fluxgrid.sources.filetree import SCHEMA, write_tree


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_links_copies_and_texts(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"picture")
    out = tmp_path / "out"
    rows = [("images/a.bin", str(tmp_path / "a.bin"), None), ("images/b.bin", f"file://{tmp_path}/a.bin", None), ("labels/a.txt", None, b"0 1\n"), ("labels/empty.txt", None, b"")]
    write_tree(frame(spark, rows), str(out), {"report.json": '{"n": 1}', "data.yaml": "path: .\n"}, "report.json", ["images/test"])
    got = tree(out)
    assert json.loads(got.pop("report.json")) == {"n": 1, "materialization": {"hardlink": 2, "written": 2}}
    assert got == {"images/a.bin": b"picture", "images/b.bin": b"picture", "labels/a.txt": b"0 1\n", "labels/empty.txt": b"", "data.yaml": b"path: .\n"}
    assert (out / "images/test").is_dir() and os.path.samefile(out / "images/a.bin", tmp_path / "a.bin") and not os.path.exists(f"{out}.tmp")


def test_existing_trees_are_refused_or_swapped(spark, tmp_path):
    out = str(tmp_path / "out")
    write_tree(frame(spark, [("x", None, b"old")]), out)
    with pytest.raises(Exception, match="refusing to overwrite"):
        write_tree(frame(spark, [("x", None, b"new")]), out)
    assert tree(out) == {"x": b"old"}
    write_tree(frame(spark, [("y", None, b"new")]), out, overwrite=True)
    assert tree(out) == {"y": b"new"} and os.listdir(tmp_path) == ["out"]
    os.mkdir(f"{out}.tmp")
    with pytest.raises(Exception, match="earlier run"):
        write_tree(frame(spark, [("z", None, b"new")]), out, overwrite=True)
    assert tree(out) == {"y": b"new"}


def test_a_failing_task_leaves_the_old_tree(spark, tmp_path):
    out = str(tmp_path / "out")
    write_tree(frame(spark, [("x", None, b"old")]), out)
    rows = [(f"n{k}", None, b"new") for k in range(50)] + [("gone", str(tmp_path / "no such file"), None)]
    with pytest.raises(Exception, match="no such file"):
        write_tree(frame(spark, rows), out, overwrite=True)
    assert tree(out) == {"x": b"old"} and os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="leaves the tree"):
        write_tree(frame(spark, [("../y", None, b"new")]), out, overwrite=True)
    with pytest.raises(ValueError, match="2 rows want to be x"):
        write_tree(frame(spark, [("x", None, b"1"), ("x", None, b"2")]), out, overwrite=True)
    bad = frame(spark, rows[:50]).withColumn("path", F.when(F.col("path") == "n7", F.raise_error(F.lit("broken row"))).otherwise(F.col("path")))
    with pytest.raises(Exception, match="broken row"):
        write_tree(bad, out, overwrite=True)
    assert tree(out) == {"x": b"old"} and os.listdir(tmp_path) == ["out"]


def test_a_failed_swap_is_rolled_back(tmp_path, monkeypatch):
    from fluxgrid.sources import filetree

    out = str(tmp_path / "out")
    os.makedirs(out)
    (tmp_path / "out/x").write_bytes(b"old")
    writer = filetree.FileTreeWriter({"path": out}, True)
    message = writer.write(iter([{"path": "y", "source": None, "content": b"new"}]))
    real = os.rename
    monkeypatch.setattr(filetree.os, "rename", lambda a, b: (_ for _ in ()).throw(OSError("disk")) if a.endswith(".tmp") else real(a, b))
    with pytest.raises(OSError, match="disk"):
        writer.commit([message])
    assert tree(out) == {"x": b"old"} and os.listdir(tmp_path) == ["out"]
