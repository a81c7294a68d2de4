"""Build, audit and decontamination of trees on disk."""

import json
import os
import random
import struct
import zlib

import numpy as np
import pytest

from fluxgrid.functions import images as I
from fluxgrid.operators import builds as B


def png(picture, kinds=(0,)):
    """An encoder with any line filters, to test decoding against."""
    h, w, n = picture.shape
    lines, before = [], np.zeros(w * n, np.int64)
    for y in range(h):
        line, kind = picture[y].reshape(-1).astype(np.int64), kinds[y % len(kinds)]
        left, corner = np.concatenate([np.zeros(n, np.int64), line[:-n]]), np.concatenate([np.zeros(n, np.int64), before[:-n]])
        p = left + before - corner
        pa, pb, pc = abs(p - left), abs(p - before), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, before, corner))
        guess = [0, left, before, (left + before) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def ppm(picture):
    h, w, n = picture.shape
    return f"P{5 if n == 1 else 6}\n# a comment\n{w} {h}\n255\n".encode() + picture.astype(np.uint8).tobytes()


def test_pictures_are_decoded_whatever_their_format():
    draw = np.random.default_rng(1)
    for n in (1, 3):
        picture = draw.integers(0, 256, (23, 31, n), dtype=np.uint8)
        for kinds in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)):
            assert (I.pixels(png(picture, kinds)) == picture).all()
        assert (I.pixels(ppm(picture)) == picture).all()
        assert I.difference_bits(png(picture, (4, 1))) == I.difference_bits(ppm(picture))
    for bad in (b"", b"GIF89a", ppm(picture)[:-1], png(picture)[:60]):
        with pytest.raises(Exception):  # noqa: B017  any fault is one
            I.pixels(bad)


def test_resizing_keeps_flat_and_linear_pictures():
    flat = np.full((50, 70), 93, np.uint8)
    assert (I.resized(flat, 9, 8) == 93).all() and I.difference_bits(ppm(flat[:, :, None])) == 0
    ramp = np.tile(np.arange(180, 0, -1, dtype=np.uint8), (40, 1))
    small = I.resized(ramp, 9, 8)
    assert small.shape == (8, 9) and (abs(np.diff(small.astype(int), axis=1)[:, 1:-1] + 20) <= 1).all()
    assert I.difference_bits(ppm(ramp[:, :, None])) == -1
    assert (I.resized(flat[:8, :9], 9, 8) == flat[:8, :9]).all()
    assert I.luma(np.array([[[255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[255, 76, 150, 29]]


def put(root, path, data):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "wb") as f:
        f.write(data)


def source(root, **more):
    return {"name": "fixture", "root": str(root), "names": ["human", "other"], "class_map": {"human": "person", "other": None}, "license": "fixture", "source_url": "https://example.test"} | more


LINE = b"0 0.5 0.5 0.2 0.2\n"


def test_build_removes_exact_copies_and_harmonises(spark, tmp_path):
    root, out = tmp_path / "source", tmp_path / "out"
    put(root, "train/images/a.jpg", b"same-image")
    put(root, "train/labels/a.txt", LINE)
    put(root, "valid/images/b.JPG", b"same-image")
    put(root, "valid/labels/b.txt", LINE + b"\n1 0.5 0.5 0.1 0.1\n")
    put(root, "val/images/hidden.jpg", b"hidden by valid")
    put(root, "val/labels/b.txt", LINE * 5)
    put(root, "train/images/only dropped.png", b"dropped")
    put(root, "train/labels/only dropped.txt", b"1 0.5 0.5 0.1 0.1")
    put(root, "train/images/negative.png", b"negative")
    put(root, "train/labels/negative.txt", b"")
    put(root, "test/images/unlabelled.png", b"unlabelled")
    report = B.build_dataset(spark, ["person"], [source(root)], str(out))
    assert report["statistics"] == {
        "ambiguous_cross_split_filename_keys": 0, "annotations_dropped_by_mapping": 2, "annotations_retained": 1, "duplicate_images_skipped": 1, "images_seen": 5,
        "images_skipped_after_all_labels_dropped": 1, "images_train": 1, "images_val": 1, "images_with_ambiguous_cross_split_filename_keys": 0, "missing_label_files": 1,
    }
    assert report["class_annotation_counts"] == {"person": 1} and report["source_image_counts"] == {"fixture": 2}
    assert report == json.loads((out / "build-report.json").read_text()) and report["materialization"]["written"] == 2
    (name,) = os.listdir(out / "images/val")
    assert name.startswith("fixture__b__") and name.endswith(".jpg") and (out / "images/val" / name).read_bytes() == b"same-image"
    assert (out / "labels/val" / name.replace(".jpg", ".txt")).read_text() == "0 0.50000000 0.50000000 0.20000000 0.20000000\n"
    assert [p.read_text() for p in (out / "labels/train").iterdir()] == [""] and os.listdir(out / "images/test") == []
    assert (out / "data.yaml").read_text() == "path: .\ntrain: images/train\nval: images/val\ntest: images/test\nnames:\n  0: person\n"
    with pytest.raises(Exception, match="refusing to overwrite"):
        B.build_dataset(spark, ["person"], [source(root)], str(out))


def test_build_reports_ambiguous_names_and_keeps_the_images(spark, tmp_path):
    for k, split in enumerate(("train", "valid", "test"), 1):
        stem = f"frame_10s_jpg.rf.{str(k) * 32}"
        put(tmp_path, f"in/{split}/images/{stem}.jpg", split.encode())
        put(tmp_path, f"in/{split}/labels/{stem}.txt", LINE)
    statistics = B.build_dataset(spark, ["person"], [source(tmp_path / "in")], str(tmp_path / "out"))["statistics"]
    assert statistics["ambiguous_cross_split_filename_keys"] == 1 and statistics["images_with_ambiguous_cross_split_filename_keys"] == 3
    assert [statistics[f"images_{s}"] for s in ("train", "val", "test")] == [1, 1, 1]


def test_a_build_with_a_fault_writes_nothing(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    put(root, "train/images/a.jpg", b"a")
    put(root, "train/labels/a.txt", LINE + b"0 1.0 0.5 0.2 0.2\n")
    with pytest.raises(ValueError, match="a.jpg: line 2: outside image width"):
        B.build_dataset(spark, ["person"], [source(root)], out)
    put(root, "test/images/b.jpg", b"a")
    put(root, "test/labels/b.txt", LINE)
    assert B.build_dataset(spark, ["person"], [source(root)], out)["statistics"]["duplicate_images_skipped"] == 1  # the bad line is not looked at
    for change, fault in ((dict(class_map={"human": "person"}), "missing"), (dict(class_map={"human": "cat", "other": None}), "unknown targets"), (dict(root=str(tmp_path / "out/labels")), "no train")):
        with pytest.raises(ValueError, match=fault):
            B.build_dataset(spark, ["person"], [source(root) | change], str(tmp_path / "other"))
    assert not os.path.exists(tmp_path / "other") and not os.path.exists(tmp_path / "other.tmp")


def tree(root, rows, names=("person",)):
    for split, name, data, label in rows:
        put(root, f"images/{split}/{name}", data)
        if label is not None:
            put(root, f"labels/{split}/{name.rpartition('.')[0]}.txt", label)
    put(root, "build-report.json", json.dumps({"target_names": list(names)}).encode())


def noisy(seed):
    return np.random.default_rng(seed).integers(0, 256, (16, 16, 3), dtype=np.uint8)


def test_audit_of_a_clean_tree(spark, tmp_path):
    tree(tmp_path, [("train", "source-a__one.png", png(noisy(1)), LINE), ("val", "source-b__two.png", png(noisy(2)), LINE)])
    report = B.audit_dataset(spark, str(tmp_path), 0)
    assert report["quality_gate"] == {"hard_error_count": 0, "structural_and_exact_gate_passed": True, "visual_review_required": False}
    assert report["annotation_counts_by_class"] == {"person": 2} and report["image_counts_by_source"] == {"source-a": 1, "source-b": 1}
    B.require_clean(report)


def test_audit_finds_each_fault_and_decontamination_drops_near_copies(spark, tmp_path):
    root = tmp_path / "tree"
    near = noisy(5).copy()
    near[3, 3] = near[3, 3] ^ 1
    rows = [
        ("train", "source-a__one.png", png(noisy(1)), LINE), ("test", "source-a__copy.png", png(noisy(1)), LINE), ("train", "source-a__bare.png", png(noisy(3)), None),
        ("val", "source-a__bad.png", png(noisy(4)), LINE + b"7 0 0 1 1\nx 1 1 1 1\n0 1\n\n0 2 0 1 1\n0 0 0 0 1\n"), ("val", "source-b__broken.png", b"no picture", LINE),
        ("train", "source-c__near.png", png(noisy(5)), LINE), ("val", "source-c__near2.png", png(near), LINE), ("test", "source-d__near3.png", png(near, (1,)), LINE),
    ]
    tree(root, rows)
    put(root, "labels/val/orphan.txt", LINE)
    put(root, "images/val/readme.md", b"no image")
    report = B.audit_dataset(spark, str(root), 4)
    s = report["structural"]
    assert s["missing_labels"] == ["images/train/source-a__bare.png"] and s["orphan_labels"] == ["labels/val/orphan.txt"]
    assert s["invalid_label_files"] == [{"path": "labels/val/source-a__bad.txt", "errors": ["line 2: class 7 outside [0,1)", "line 3: non-numeric field", "line 4: expected 5 tokens, found 2", "line 6: center outside normalized bounds", "line 7: box size outside normalized bounds"]}]
    assert [u["path"] for u in s["unreadable_images"]] == ["images/val/source-b__broken.png"]
    assert report["exact_duplicates"]["cross_split_group_count"] == 1 and report["quality_gate"]["hard_error_count"] == 5
    with pytest.raises(ValueError, match="5 hard errors"):
        B.require_clean(report)
    pairs = {(p["left_path"][7:], p["right_path"][7:]) for p in report["perceptual_candidates"]["pairs"]}
    assert pairs == {("train/source-c__near.png", "val/source-c__near2.png"), ("train/source-c__near.png", "test/source-d__near3.png"), ("val/source-c__near2.png", "test/source-d__near3.png")}
    out = str(tmp_path / "clean")
    done = B.decontaminate_dataset(spark, str(root), out, report)
    assert done["removed_image_count"] == 1 and done["removals"][0]["removed_path"] == "images/train/source-c__near.png" and done["cross_source_candidate_pairs_ignored"] == 2
    assert not os.path.exists(f"{out}/images/train/source-c__near.png") and not os.path.exists(f"{out}/labels/train/source-c__near.txt")
    assert os.path.samefile(f"{out}/images/val/source-c__near2.png", root / "images/val/source-c__near2.png")
    assert done["retained_image_counts_by_split"] == {"train": 2, "val": 3, "test": 2} and sum(done["materialization"].values()) == 13
    assert (root / "images/train/source-c__near.png").exists() and not os.path.exists(f"{out}/labels/val/orphan.txt")
    with pytest.raises(Exception, match="refusing to overwrite"):
        B.decontaminate_dataset(spark, str(root), out, report)
    with pytest.raises(ValueError, match="another dataset"):
        B.decontaminate_dataset(spark, str(tmp_path), out + "2", report)
    short = B.audit_dataset(spark, str(root), 4, most_pairs=1)["perceptual_candidates"]
    assert (short["reported_count"], short["truncated"], short["cross_split_candidate_count"]) == (1, True, 3)


def test_history_is_consolidated(spark, tmp_path):
    draw = random.Random(1)
    rows = [(e, f"c{c}", c, e - 1, 0.1 * e + (0.5 if (e, c) == (9, 1) else 0.0), draw.random()) for c, (a, b) in enumerate(((1, 10), (8, 20), (21, 30))) for e in range(a, b + 1)]
    table = spark.createDataFrame(rows, "epoch int, source string, source_idx int, row_idx int, map50 double, time double").repartition(3)
    points = spark.createDataFrame([(f"c{c}", e, f"{c:064x}", ["person"]) for c, e in enumerate((10, 20, 30))], "path string, completed_epoch int, sha256 string, names array<string>")
    out, manifest = str(tmp_path / "history"), tmp_path / "history.json"
    report = B.consolidate_history(table, points, ["map50"], ["epoch", "map50", "time"], out, str(manifest))
    assert (report["accepted_epoch_start"], report["accepted_epoch_end"], report["accepted_epoch_count"], report["deduplicated_replay_count"]) == (1, 30, 30, 3)
    assert [r["epoch"] for r in report["deduplicated_replays"]] == [8, 9, 10] and [(r["epoch"], r["source"]) for r in report["divergent_replays"]] == [(9, "c1")]
    saved = spark.read.option("header", "true").csv(out).selectExpr("int(epoch) AS e", "source_checkpoint AS s").orderBy("e").collect()
    assert [(r.e, r.s) for r in saved] == [(e, "c0" if e < 8 else "c1" if e < 21 else "c2") for e in range(1, 31)] and json.loads(manifest.read_text()) == report
    with pytest.raises(ValueError, match=r"missing epochs: \[5, 12\]"):
        B.consolidate_history(table.where("epoch not in (5, 12)"), points, ["map50"], ["epoch"], out + "2", str(manifest))
    with pytest.raises(ValueError, match="taxonomy"):
        B.consolidate_history(table, points.union(points.limit(1).selectExpr("'x'", "1", "''", "array('cat')")), ["map50"], ["epoch"], out + "2", str(manifest))
    assert not os.path.exists(out + "2")
