"""Sinks: decision logs, tables, reports, harmonised and decontaminated datasets."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S


def write_decisions(decisions: DataFrame, out: str, order: str = "seq") -> None:
    """JSON lines with sorted keys and explicit nulls, in order."""
    names = sorted(c for c in decisions.columns if c != order)
    decisions.orderBy(order).select(*names).write.option("ignoreNullFields", "false").json(out)


def write_atomic_json(value: dict, path: str) -> None:
    """A small report from the driver: a temporary file in the same folder, then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(temporary, path)


def markdown_table(table: DataFrame) -> str:
    """A report table as Markdown: two decimals, NA for what is missing.  For tables of a page, not for data."""
    show = lambda v: "NA" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, row)) + " |" for row in table.toLocalIterator()]) + "\n"


def write_table(table: DataFrame, out: str) -> None:
    """CSV with a header, empty where a value is missing."""
    table.write.option("header", "true").option("nullValue", "").csv(out)


def label_text(target_id: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """One label line; eight decimals, rounded as the binary value is."""
    return F.concat_ws(" ", target_id.cast("string"), *[S.python_fixed(v, 8) for v in (x, y, w, h)])


def write_dataset(images: DataFrame, out: str, mode: str = "errorifexists") -> None:
    """Images with labels as Parquet by split; refuses to overwrite, and publishes all or nothing."""
    images.write.mode(mode).partitionBy("split").parquet(out)


def write_history(accepted: DataFrame, out: str, columns: list[str]) -> None:
    """CSV parts in order of epoch, each with a header; refuses to overwrite."""
    accepted.select(*columns, F.col("source").alias("source_checkpoint")).orderBy("epoch").write.option("header", "true").csv(out)


def page(pairs: DataFrame, start: int, most: int) -> DataFrame:
    """Pairs ``start`` to ``start + most`` in report order."""
    return pairs.orderBy("hamming_distance", "left_path", "right_path").offset(start).limit(most)
