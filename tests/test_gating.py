"""Gates with prerequisites, the rules of returned runs, and notebooks."""

import json

import pytest
from pyspark.sql import functions as F

from fluxgrid.operators import gating as G


def test_levels():
    rule = lambda gate, *after: G.Rule(gate, [], after)
    assert G.levels([rule("d", "b", "c"), rule("b", "a"), rule("c"), rule("a")]) == {"c": 0, "a": 0, "b": 1, "d": 2}
    for bad, fault in (([rule("a", "b"), rule("b", "a")], "wait for each other"), ([rule("a", "x")], "unknown"), ([rule("a"), rule("a")], "twice")):
        with pytest.raises(ValueError, match=fault):
            G.levels(bad)


FACTS = "run string, receipt_status string, archive_sha256 string, receipt_archive_sha256 string, models map<string, struct<expected: string, found: string>>, epoch_start int, epoch_end int, epoch_count int, final_epoch int, split string, fraction double, imgsz int, image_count int, baseline_sha256 string, expected_baseline_sha256 string, tuned_sha256 string, expected_tuned_sha256 string"


def test_returned_runs(spark):
    good = {"run": "good", "receipt_status": "accepted", "archive_sha256": "a", "receipt_archive_sha256": "a", "models": {"best": ("x", "x"), "last": ("y", "y")}, "epoch_start": 1, "epoch_end": 30, "epoch_count": 30, "final_epoch": 30, "split": "test", "fraction": 1.0, "imgsz": 640, "image_count": 1515, "baseline_sha256": "b", "expected_baseline_sha256": "b", "tuned_sha256": "t", "expected_tuned_sha256": "t"}
    change = {
        "short": {"epoch_end": 29, "epoch_count": 29}, "gaps": {"epoch_count": 28}, "late": {"epoch_start": 2}, "model": {"models": {"best": ("x", "z"), "last": ("y", None)}}, "archive": {"archive_sha256": "other"},
        "images": {"image_count": 1514}, "part": {"fraction": 0.5}, "hash": {"tuned_sha256": "u"}, "none": {"baseline_sha256": None, "epoch_start": None},
    }
    rows = [good] + [good | {"run": k} | v for k, v in change.items()]
    table = spark.createDataFrame([tuple(r[c.split()[0]] for c in FACTS.split(", ") if c.split()[0] in r) for r in rows], FACTS)
    release = G.Rule("release", [(F.lit(False), "never")], ("history", "comparison"))
    gated = G.judged(table, ["run"], [release, G.comparison_rule(1515, 640), G.history_rule(), G.import_rule()])
    first = {r.run: (r.gate, r.reason) for r in G.first_failure(gated, ["run"]).collect()}
    assert first == {
        "short": ("history", "does not end at the final epoch"), "gaps": ("history", "is not contiguous"), "late": ("history", "does not start at epoch 1"), "model": ("import", "checksum changed: best, last"),
        "archive": ("import", "archive differs from the imported one"), "images": ("comparison", "not exactly 1515 images"), "part": ("comparison", "not the complete test split"),
        "hash": ("comparison", "fine-tuned hash mismatch"), "none": ("comparison", "baseline hash mismatch"),
    }
    got = {(r.run, r.gate): (r.level, r.status, r.blocked_by) for r in gated.collect()}
    assert len(got) == 40 and got["good", "release"] == (2, "complete", None) and got["model", "history"] == (1, "blocked", "import") and got["model", "release"] == (2, "blocked", "import")
    assert got["short", "release"] == (2, "blocked", "history") and got["short", "comparison"] == (1, "complete", None) and got["none", "release"][2] == "comparison"


def notebook(*cells):
    return json.dumps({"nbformat": 4, "cells": list(cells)})


def cell(number, *outputs, kind="code"):
    return {"cell_type": kind, "execution_count": number, "outputs": list(outputs), "source": []} if kind == "code" else {"cell_type": kind, "source": ["# text"]}


def test_notebooks(spark):
    text, error = {"output_type": "stream", "text": ["x"]}, {"output_type": "error", "ename": "ValueError", "evalue": "bad", "traceback": []}
    books = {
        "good": notebook(cell(0, kind="markdown"), cell(1, text), cell(2)), "error": notebook(cell(1, text), cell(0, kind="markdown"), cell(2, text, error)), "mixed": notebook(cell(1), cell(None, text), cell(3)),
        "bare": notebook(cell(None), cell(None), cell(None, text)), "silent": notebook(cell(None), cell(None), cell(None), cell(None, text)), "empty": notebook(), "broken": "{", "no cells": "{}", "null": None, "no list": '{"cells": 3}',
    }
    got = {r.path: r for r in G.notebook_report(spark.createDataFrame(list(books.items()), "path string, text string")).collect()}
    assert {k for k, r in got.items() if r.valid} == {"good", "bare", "empty"} and set(got) == set(books)
    assert [tuple(e) for e in got["error"].errors] == [(1, 1, "ValueError", "bad")] and got["mixed"].unexecuted == [1] and got["silent"].missing_output == [2]
    assert got["good"].code_cells == 2 and got["bare"].unexecuted == [0, 1, 2]
