"""Column builders: geometry, time, numbers, text, hashes, sectors.  All stay in the JVM but ``python_fixed``."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- geometry and sectors ---------------------------------------------------------------------------------------


def box_center(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def box_area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def horizontal_sector(center_x: Column, width: Column, center_fraction: float = 1 / 3) -> Column:
    """left, center or right; the band's edges belong to the center, with a tolerance for binary fractions."""
    if not 0 < center_fraction < 1:
        raise ValueError("center_fraction must be between 0 and 1")
    low, epsilon = (1 - center_fraction) / 2, 1e-12
    x = center_x / F.when(width > 0, width).otherwise(F.raise_error(F.lit("width must be positive")))
    return F.when(x < low - epsilon, "left").when(x > 1 - low + epsilon, "right").otherwise("center")


def assign_sectors(detections: Column, width: Column, center_fraction: float = 1 / 3) -> Column:
    """The detections with each one's sector from the centre of its box."""
    return F.transform(detections, lambda d: d.withField("sector", horizontal_sector((d["box"]["x1"] + d["box"]["x2"]) / 2, width, center_fraction)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, 0 where they do not meet."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return F.coalesce(F.try_divide(inter, box_area(a) + box_area(b) - inter), F.lit(0.0))


def thumbnail_size(width: Column, height: Column, longest: int) -> Column:
    """(width, height) with the long side at most ``longest``, never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.round(width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(height * scale).cast("int")).alias("height"))


# --- time and numbers -------------------------------------------------------------------------------------------


def ms_between(later: Column, earlier: Column) -> Column:
    """Milliseconds between two nanosecond times; null if either is."""
    return (later - earlier) / 1e6


def ms_to_ns(ms: float) -> int:
    return int(ms * 1_000_000)


def stage(stage_ms: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(stage_ms, F.lit(name)), F.lit(0.0))


def fps(mean_ms: Column) -> Column:
    return F.when(mean_ms > 0, F.lit(1000.0) / F.when(mean_ms > 0, mean_ms)).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def percent_or_null(x: Column) -> Column:
    return x * 100


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    """As floats compare in a tolerance; a NaN is close to nothing, equal infinities are close."""
    gap = F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).when(a == b, F.lit(True)).when((F.abs(a) == float("inf")) | (F.abs(b) == float("inf")), F.lit(False)).otherwise(gap)


def sane_capture_time(sensor_ns: Column, available_ns: Column, started_ns: Column, most_ns: int = 10_000_000_000) -> Column:
    """The sensor's clock unless it lies in the future or more than ten seconds back."""
    age = available_ns - sensor_ns
    return F.when(sensor_ns.isNull() | (age < 0) | (age > most_ns), started_ns).otherwise(sensor_ns)


def celsius(x: Column) -> Column:
    return F.when(x > 1000, x / 1000.0).otherwise(x)


# --- text -------------------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def parse_int(token: Column) -> Column:
    """The integer that the token spells, null for anything else (no fractions)."""
    return F.when(token.rlike(r"^[+-]?\d+$"), token).try_cast("bigint")


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_float(token: Column) -> Column:
    """The number that the token spells, null for anything else (no type suffixes)."""
    return F.when(token.rlike(r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)\s*$"), token).try_cast("double")


def source_prefix(name: Column) -> Column:
    return F.when(F.instr(name, "__") > 0, F.substring_index(name, "__", 1)).otherwise("unknown")


def lineage_key(stem: Column) -> Column:
    """The stem without an export suffix, lower-cased: frames of one origin share it."""
    return F.lower(F.regexp_replace(stem, r"(?i)\.rf\.[0-9a-f]{16,64}$", ""))


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]", "-"), "^-+|-+$", ""))


def output_stem(source: Column, stem: Column, sha256: Column) -> Column:
    return F.concat_ws("__", slug(source), stem, F.substring(sha256, 1, 10))


def unsafe_path(path: Column) -> Column:
    return path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | path.contains("\\")


def snapshot_name(label: Column, epoch: Column, sha256: Column) -> Column:
    return F.format_string("%s-epoch-%03d-%s", label, epoch, F.substring(sha256, 1, 12))


def completed_epoch(epoch: Column, history: Column) -> Column:
    """epoch + 1, or the last epoch of the history where the checkpoint was stripped of it."""
    return F.when(epoch >= 0, epoch + 1).otherwise(F.try_element_at(history, F.lit(-1)))


def backend_name(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.endswith("_ncnn_model") | low.endswith("_ncnn_model/"), "ncnn")
        .when(low.endswith("_openvino_model") | low.endswith("_openvino_model/"), "openvino")
        .when(low.endswith(".onnx"), "onnxruntime")
        .when(low.endswith(".mnn"), "mnn")
        .when(low.endswith(".tflite"), "litert")
        .when(low.endswith(".pt"), "pytorch")
        .otherwise("unknown")
    )


def _fixed(value: pd.Series, digits: pd.Series) -> pd.Series:
    return value.combine(digits, lambda v, d: None if v != v else f"{v:.{int(d)}f}")


def python_fixed(value: Column, digits: int) -> Column:
    """Half-even on the binary value, unlike ``format_string``; for text sinks only (Arrow batches)."""
    return F.pandas_udf(_fixed, T.StringType())(value, F.lit(digits))


# --- hashes -----------------------------------------------------------------------------------------------------


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def slice_layout(threshold: int) -> list[tuple[int, int]]:
    """(offset, width) of threshold + 1 slices of 64 bits, the wider first: hashes so near share one."""
    if not 0 <= threshold < 64:
        raise ValueError("the threshold must be in [0, 63]")
    width, rest = divmod(64, threshold + 1)
    out, at = [], 0
    for k in range(threshold + 1):
        w = width + (k < rest)
        out.append((at, w))
        at += w
    return out


def bit_slice(h: Column, offset: int, width: int) -> Column:
    mask = (1 << width) - 1
    return F.shiftrightunsigned(h, offset).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("bigint"))


def difference_hash(grid: Column) -> Column:
    """64 bits of an 8 x 9 luminance grid, row by row, highest first: whether a cell is brighter than its right one."""
    steps = F.array(*[F.lit(9 * (k // 8) + k % 8) for k in range(64)])
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(F.when(F.get(grid, i) > F.get(grid, i + 1), F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def first_failure(checks: list[tuple[Column, str | Column]]) -> Column:
    """The message of the first condition that holds, else null."""
    return reduce(lambda rest, c: F.when(c[0], F.lit(c[1]) if isinstance(c[1], str) else c[1]).otherwise(rest), reversed(checks), F.lit(None).cast("string"))
