"""The conflating frame source as a stream."""

import os

import pytest

from fluxgrid.streaming.frame_source import FrameFolder, read_frames


def test_newest_frames_drops_close_and_fault(spark, tmp_path):
    root, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    left, right = FrameFolder(f"{root}/left"), FrameFolder(f"{root}/right")
    start = lambda: read_frames(spark, root, keep=False).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    rows = lambda: sorted((r.camera, r.frame_id, r.captured_ns, bytes(r.payload), r.dropped_since_last) for r in spark.read.parquet(out).collect())
    left.publish(1, 10, b"old")
    left.publish(2, 20, b"new")
    query = start()
    query.processAllAvailable()
    assert rows() == [("left", 2, 20, b"new", 1)]
    for k in range(3, 7):
        left.publish(k, k * 10, f"frame {k}".encode())
    right.publish(1, 11, b"other")
    query.processAllAvailable()
    later = rows()
    assert later[-1] == ("right", 1, 11, b"other", 0) and max(r[1] for r in later if r[0] == "left") == 6
    # every frame was delivered or counted as displaced
    assert sum(1 + r[4] for r in later if r[0] == "left") == 6
    query.processAllAvailable()
    assert rows() == later
    query.stop()
    # a frame that is not read yet can be after the camera has closed, and after a restart
    right.publish(2, 12, b"last")
    right.close()
    with pytest.raises(RuntimeError, match="closed"):
        right.publish(3, 13, b"late")
    query = start()
    query.processAllAvailable()
    assert rows() == sorted([*later, ("right", 2, 12, b"last", 0)]) and not os.path.exists(f"{root}/left/frame-{1:020d}-{10:020d}.bin")
    left.fail("no sensor")
    with pytest.raises(Exception, match="camera left failed: no sensor"):
        query.processAllAvailable()
        query.awaitTermination(30)
    query.stop()
