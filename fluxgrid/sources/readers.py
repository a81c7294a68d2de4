"""Scans: sensor traces, label trees, configs, manifests, power logs, result rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgrid import schemas
from fluxgrid.functions import scalars as S
from fluxgrid.session import counted, written
from fluxgrid.sources.filetree import list_files

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as splits hold them: path, where the split starts, a number that counts up within a task, and the text."""
    m = F.col("_metadata")
    return spark.read.text(path).select(m["file_path"].alias("path"), m["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text"))


def _numbered(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(path, line_no, _place in the split from 0, text, and what ``splits`` has besides) of lines whose splits are known: (path, _start, _first, _lines, ...)."""
    before = W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    table = counted(written(splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))), "splits"))
    more = [c for c in splits.columns if c not in ("path", "_start", "_first", "_lines")]
    place = F.col("_at") - F.col("_first")
    return lines.join(table, ["path", "_start"]).select("path", (F.col("_before") + place + 1).alias("line_no"), place.alias("_place"), "text", *more)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, text) of text files of any size, read by as many tasks as there are splits.

    A first pass counts the lines of each split; numbers follow from the sums
    of the splits before, a row each, and the line's place in its split.  Both
    passes read the same splits, which depend on the files and settings alone.
    Lines end with CR, LF or both; empty files have none.
    """
    lines = _split_lines(spark, path)
    return _numbered(lines, lines.groupBy("path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"))).drop("_place")


def small_file_lines(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, line_no, text) of all small text files below a folder; an empty file is one line without text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    lines = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r\n|\n|\r")).alias("i", "text"))
    empty = list_files(spark, root).where((F.col("bytes") == 0) & F.col("path").endswith(suffix)).select("path", F.lit(1).alias("line_no"), F.lit("").alias("text"))
    return lines.select("path", (F.col("i") + 1).alias("line_no"), "text").unionByName(empty)


def decode_readings(lines: DataFrame) -> DataFrame:
    """Sensor readings of (path, line_no, text) rows; blank and ``#`` lines are skipped.

    ``valid`` is what its value is worth: true if there is none, false for null,
    zero and empty ones.  A line that is no JSON object, lacks a required key, or has an unknown kind or
    sector stops the query with its number, when an action reads it.
    """
    bare = S.stripped(F.col("text"))
    body = lines.where((bare != "") & ~bare.startswith("#"))
    kinds = T.StructType([T.StructField(n, T.StringType()) for n in ("sensor_id", "kind", "timestamp_ns", "sector", "distance_m", "valid")])
    r = body.withColumn("_r", F.from_json("text", kinds))
    need = F.array_sort(F.array_compact(F.array(*[F.when(F.col("_r")[n].isNull(), F.lit(n)) for n in ("sensor_id", "kind", "timestamp_ns", "sector")])))
    fault = S.first_failure(
        [
            (F.col("_r").isNull() | ~bare.startswith("{"), "not a JSON object"),
            (F.size(need) > 0, F.concat(F.lit("missing "), F.array_join(need, ", "))),
            (~F.col("_r")["kind"].isin(*schemas.SENSOR_KINDS), "unknown kind"),
            (~F.col("_r")["sector"].isin(*schemas.SECTORS), "unknown sector"),
            (S.parse_int(F.col("_r")["timestamp_ns"]).isNull(), "timestamp_ns is no integer"),
        ]
    )
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), fault)).cast("string")).otherwise(F.col("_r")["sensor_id"])
    item = F.try_variant_get(F.try_parse_json("text"), "$.valid", "variant")
    kind, valid = F.schema_of_variant(item), F.col("_r")["valid"]
    truthy = (
        F.when(item.isNull(), True)
        .when(kind == "VOID", False)
        .when(kind == "BOOLEAN", valid == "true")
        .when(kind == "STRING", valid != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(item).isin("[]", "{}"))
        .otherwise(valid.try_cast("double") != 0)
    )
    return r.select(
        "path", F.col("line_no").alias("seq"), checked.alias("sensor_id"), F.col("_r")["kind"].alias("kind"), S.parse_int(F.col("_r")["timestamp_ns"]).alias("timestamp_ns"),
        F.col("_r")["sector"].alias("sector"), S.parse_float(F.col("_r")["distance_m"]).alias("distance_m"), truthy.alias("valid"),
    )


_SPLIT = "path string, _start bigint, _first bigint, _lines bigint, first_ns bigint, last_ns bigint, first_at bigint, falls bigint"


def _split_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split: its lines, its first and last time, and its first line (from 0) whose time is before the one above."""
    now: dict | None = None
    row = lambda s: pa.RecordBatch.from_pylist([s], schema=schema)
    schema = pa.schema([(c.split()[0], pa.string() if c.startswith("path") else pa.int64()) for c in _SPLIT.split(", ")])
    for batch in batches:
        starts = batch.column("_start").to_numpy(zero_copy_only=False)
        paths = batch.column("path")
        cuts = np.flatnonzero((np.diff(starts) != 0) | pc.not_equal(paths.slice(1), paths.slice(0, max(len(paths) - 1, 0))).to_numpy(zero_copy_only=False)) + 1 if len(starts) > 1 else np.empty(0, np.int64)
        edges = [0, *cuts.tolist(), len(starts)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            key = (paths[a].as_py(), int(starts[a]))
            if now is None or (now["path"], now["_start"]) != key:
                if now is not None:
                    yield row(now)
                now = {"path": key[0], "_start": key[1], "_first": batch.column("_at")[a].as_py(), "_lines": 0, "first_ns": None, "last_ns": None, "first_at": None, "falls": None}
            times = batch.column("ns").slice(a, b - a)
            places = np.flatnonzero(pc.is_valid(times).to_numpy(zero_copy_only=False))
            known = pc.drop_null(times).to_numpy(zero_copy_only=False)
            if len(known):
                drop = np.flatnonzero(np.diff(known, prepend=known[0] if now["last_ns"] is None else now["last_ns"]) < 0)
                if len(drop) and now["falls"] is None:
                    now["falls"] = now["_lines"] + int(places[drop[0]])
                if now["first_ns"] is None:
                    now["first_ns"], now["first_at"] = int(known[0]), now["_lines"] + int(places[0])
                now["last_ns"] = int(known[-1])
            now["_lines"] += b - a
    if now is not None:
        yield row(now)


def read_sensor_trace(spark: SparkSession, path: str) -> DataFrame:
    """Readings of JSONL traces of any size; within a file times must not decrease (checked when read).

    The pass that counts lines also takes each split's first and last time and
    its first fall, so that the order is checked within splits and, from the
    table of splits, across their boundaries; no file is sorted.
    """
    lines = _split_lines(spark, path)
    bare = S.stripped(F.col("text"))
    at = F.when((bare != "") & ~bare.startswith("#"), S.parse_int(F.get_json_object("text", "$.timestamp_ns")))
    splits = lines.select("path", "_start", "_at", at.alias("ns")).mapInArrow(_split_times, _SPLIT)
    before = W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    across = F.col("first_ns") < F.last("last_ns", ignorenulls=True).over(before)
    faults = splits.select("path", "_start", "_first", "_lines", F.when(across, F.col("first_at")).otherwise(F.col("falls")).alias("_fault"))
    number = F.col("line_no").cast("string")
    fault = F.raise_error(F.concat(F.lit("line "), number, F.lit(": timestamps must not decrease"))).cast("string")
    numbered = _numbered(lines, faults)
    return decode_readings(numbered.withColumn("text", F.when(F.col("_place") == F.col("_fault"), fault).otherwise(F.col("text"))).drop("_place", "_fault"))


def _parts(path: Column) -> tuple[Column, Column]:
    name = F.element_at(F.split(path, "/"), -1)
    return name, F.regexp_replace(name, r"\.[^.]*$", "")


def scan_image_tree(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(source, split, path, stem, content) under <root>/<split>/images; ``valid`` is val and hides a ``val`` beside it."""
    names = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in IMAGE_SUFFIXES) + "}"  # other files are not opened
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    folder = F.regexp_extract("path", r"/(train|valid|val|test)/images/", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = files.select("path", "content", folder.alias("_f")).where((folder != "") & suffix.isin(*IMAGE_SUFFIXES))
    hides = found.where("_f = 'valid'").select(F.lit("val").alias("_f")).distinct()
    _, stem = _parts(F.col("path"))
    return found.join(F.broadcast(hides), "_f", "left_anti").select(F.lit(source).alias("source"), F.when(F.col("_f") == "valid", "val").otherwise(F.col("_f")).alias("split"), "path", stem.alias("stem"), "content")


def scan_label_tree(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(source, split, stem, line_no, text) of the label files under <root>/<split>/labels; where images lie under ``valid``, ``val`` is hidden.

    An empty file is one line without text.
    """
    lines = small_file_lines(spark, root, ".txt")
    _, stem = _parts(F.col("path"))
    folder = F.regexp_extract("path", r"/(train|valid|val|test)/labels/[^/]+$", 1)
    images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(r"/valid/images/"))
    hides = images.select(F.lit("val").alias("_f")).distinct()
    found = lines.withColumn("_f", folder).where("_f <> ''").join(F.broadcast(hides), "_f", "left_anti")
    return found.select(F.lit(source).alias("source"), F.when(F.col("_f") == "valid", "val").otherwise(F.col("_f")).alias("split"), stem.alias("stem"), "line_no", "text")


def scan_processed_tree(spark: SparkSession, root: str) -> DataFrame:
    """(split, path, content, position) of images/<split>/*, one level; ``position`` counts within a split, in path order.

    The tree's order is train, val, test, then position.
    """
    from pyspark.sql import Window as W

    files = spark.read.format("binaryFile").load(f"{root}/images/*")
    split = F.regexp_extract("path", r"/images/([^/]+)/[^/]+$", 1)
    found = files.select(split.alias("split"), "path").where(F.col("split").isin("train", "val", "test"))
    placed = found.withColumn("position", F.row_number().over(W.partitionBy("split").orderBy("path")) - 1)
    return placed.join(files.select("path", "content"), "path").select("split", "path", "content", "position")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def class_map_rows(sources: DataFrame) -> DataFrame:
    """(source, class_id, source_class, target_class, mapped) of rows with name, names and a class_map."""
    rows = sources.select(F.col("name").alias("source"), F.posexplode("names").alias("class_id", "source_class"), "class_map")
    return rows.select("source", "class_id", "source_class", F.try_element_at("class_map", F.col("source_class")).alias("target_class"), F.map_contains_key("class_map", F.col("source_class")).alias("mapped"))


def target_names(report: DataFrame) -> DataFrame:
    return report.select(F.posexplode("target_names").alias("target_id", "target_class"))


def read_power(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POWER_SAMPLES).json(path).where("timestamp_ns is not null")


def read_result_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/*.json", multiLine=True)


def verified_inputs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries whose file has the stated sha256; any other stops the query."""
    got = files.select("path", F.sha2("content", 256).alias("_s"))
    j = manifest.join(got, "path", "left")
    ok = F.coalesce(F.col("_s") == F.col("sha256"), F.lit(False))
    return j.withColumn("sha256", F.when(ok, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("missing or changed: "), F.col("path"))).cast("string"))).drop("_s")


def archive_problems(members: DataFrame, required: DataFrame) -> DataFrame:
    """(name, problem) of unsafe members and of required ones that are absent."""
    bad = members.where(S.unsafe_path(F.col("name")) | F.coalesce("is_link", F.lit(False))).select("name", F.lit("unsafe").alias("problem"))
    gone = required.join(members, "name", "left_anti").select("name", F.lit("missing").alias("problem"))
    return bad.unionByName(gone)


def dataset_roots(files: DataFrame) -> DataFrame:
    """Folders that hold a ``data.yaml`` and images under images/train."""
    roots = files.where(F.col("path").endswith("/data.yaml")).select(F.regexp_replace("path", "/data.yaml$", "").alias("root"))
    trained = files.select(F.regexp_extract("path", r"^(.*)/images/train/[^/]+$", 1).alias("root")).where("root <> ''").distinct()
    return roots.join(trained, "root", "left_semi")


def rewritten_root(lines: DataFrame, root: str) -> DataFrame:
    """A YAML file's lines with its ``path:`` set to ``root``, inserted first where it has none."""
    changed = lines.withColumn("text", F.when(F.col("text").startswith("path:"), F.lit(f"path: {root}")).otherwise(F.col("text")))
    without = lines.groupBy("path").agg(F.bool_or(F.col("text").startswith("path:")).alias("has")).where("not has")
    return changed.unionByName(without.select("path", F.lit(0).alias("line_no"), F.lit(f"path: {root}").alias("text")))
