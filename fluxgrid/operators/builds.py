"""Whole dataset operations: harmonise and build, audit, decontaminate.  Reports are driver values as large as their lists may be; all rows stay in Spark."""

from __future__ import annotations

import json
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S
from fluxgrid.functions.images import picture_hashes
from fluxgrid.operators import dataset as D
from fluxgrid.operators import sequences as Q
from fluxgrid.sources import readers
from fluxgrid.sources.filetree import list_files, local, write_tree
from fluxgrid.sources.sinks import label_text, write_atomic_json, write_history

SPLITS = ("train", "val", "test")
#: Entries of a long list that a report shows.
SHOWN = 1_000
FOLDERS = [f"{kind}/{split}" for kind in ("images", "labels") for split in SPLITS]


def checked_sources(target_names: list[str], sources: list[dict]) -> None:
    """The configuration's own rules: unique targets, no unknown target, every class mapped and no other."""
    if not target_names or len(set(target_names)) != len(target_names):
        raise ValueError("target_names must be non-empty and unique")
    for source in sources:
        mapped, names = source["class_map"], set(source["names"])
        if unknown := sorted({t for t in mapped.values() if t is not None} - set(target_names)):
            raise ValueError(f"source {source['name']} maps to unknown targets: {unknown}")
        if names != set(mapped):
            raise ValueError(f"source {source['name']}: missing {sorted(names - set(mapped))}, extra {sorted(set(mapped) - names)}")


def judged_build(images: DataFrame, labels: DataFrame, class_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with status and output stem, parsed label lines).

    ``images`` has source, split, path, stem, suffix and sha256; ``labels``
    source, split, stem, line_no and text.  An image with a bad line counts as
    one that claims its hash; ``bad_lines`` says how many it has.
    """
    key = ["source", "split", "stem"]
    parsed = D.parse_labels(labels, class_map)
    tally = parsed.groupBy(*key).agg(F.count("*").alias("lines"), F.count_if(F.col("status") == "kept").alias("kept_lines"), F.count_if(F.col("status") == "error").alias("bad_lines"))
    have = labels.select(*key).distinct().withColumn("has_label", F.lit(True))
    j = images.join(have, key, "left").join(tally, key, "left")
    j = j.withColumn("has_label", F.coalesce("has_label", F.lit(False))).na.fill(0, ["lines", "kept_lines", "bad_lines"])
    claims = j.withColumn("kept_lines", F.when(F.col("bad_lines") > 0, F.col("lines")).otherwise(F.col("kept_lines")))
    judged = D.deduplicate_by_priority(claims)
    return judged.withColumn("output_stem", S.output_stem(F.col("source"), F.col("stem"), F.col("sha256"))), parsed


def label_files(judged: DataFrame, parsed: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, output_stem, text) of every kept image: its kept lines in order, nothing for an image without any."""
    key = ["source", "split", "stem"]
    lines = parsed.where("status = 'kept'").join(F.broadcast(targets), "target_class")
    text = label_text(F.col("target_id"), *[F.col(c) for c in ("center_x", "center_y", "width", "height")])
    per = lines.select(*key, "line_no", text.alias("t")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_no", "t"))).alias("_l"))
    per = per.select(*key, F.concat(F.array_join(F.transform("_l", lambda x: x["t"]), "\n"), F.lit("\n")).alias("text"))
    return judged.where("status = 'kept'").select(*key, "output_stem").join(per, key, "left").select("split", "output_stem", F.coalesce("text", F.lit("")).alias("text"))


def build_report(judged: DataFrame, parsed: DataFrame) -> dict:
    """Statistics, annotations by class and images by source of a build; counters that nothing touched are left out."""
    counts = D.build_statistics(judged).first().asDict()
    lineage = D.ambiguous_lineages(judged.withColumn("stem", F.concat("source", F.lit(":"), "stem"))).agg(F.count("*").alias("k"), F.coalesce(F.sum("images"), F.lit(0)).alias("n")).first()
    statistics = {k: v for k, v in counts.items() if v or k == "annotations_dropped_by_mapping"}
    statistics |= {"ambiguous_cross_split_filename_keys": lineage.k, "images_with_ambiguous_cross_split_filename_keys": lineage.n}
    kept = judged.where("status = 'kept'")
    classes = parsed.where("status = 'kept'").join(kept.select("source", "split", "stem"), ["source", "split", "stem"]).groupBy("target_class").count()
    return {
        "schema_version": 1,
        "statistics": dict(sorted(statistics.items())),
        "class_annotation_counts": dict(sorted((r[0], r[1]) for r in classes.collect())),  # as many as target classes
        "source_image_counts": dict(sorted((r[0], r[1]) for r in kept.groupBy("source").count().collect())),  # as many as sources
    }


def build_dataset(spark: SparkSession, target_names: list[str], sources: list[dict], out: str) -> dict:
    """Harmonises sources into one tree: images, labels, ``data.yaml`` and ``build-report.json``; returns the report.

    A source is a dict of name, root, names, class_map, license and source_url.
    Images of equal bytes are kept once, in test before val before train; a bad
    label line of an image that is looked at stops the build, and then nothing
    is written.  The tree appears whole or not at all; an existing one is refused.
    """
    checked_sources(target_names, sources)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    trees = [readers.scan_image_tree(spark, s["root"], s["name"]).select("source", "split", "path", "stem", suffix.alias("suffix"), F.sha2("content", 256).alias("sha256")) for s in sources]
    images = reduce(DataFrame.unionByName, trees)
    labels = reduce(DataFrame.unionByName, [readers.scan_label_tree(spark, s["root"], s["name"]) for s in sources])
    classes = [(s["name"], k, c, s["class_map"][c], True) for s in sources for k, c in enumerate(s["names"])]
    class_map = spark.createDataFrame(classes, "source string, class_id int, source_class string, target_class string, mapped boolean")
    judged, parsed = judged_build(images, labels, class_map)
    judged, parsed = judged.persist(StorageLevel.DISK_ONLY), parsed.persist(StorageLevel.DISK_ONLY)
    try:
        seen = {r[0] for r in judged.select("source").distinct().collect()}  # as many as sources
        if empty := [s["name"] for s in sources if s["name"] not in seen]:
            raise ValueError(f"source {empty[0]} has no train/valid/val/test images")
        looked_at = judged.where("status in ('kept', 'all_dropped') and bad_lines > 0")
        rank = (-D.split_rank(F.col("split"))).alias("p")
        if first := looked_at.select(rank, "source", "split", "stem", "path").orderBy("p", "source", "path").first():
            line = parsed.where((F.col("source") == first.source) & (F.col("split") == first.split) & (F.col("stem") == first.stem) & (F.col("status") == "error")).orderBy("line_no").first()
            raise ValueError(f"{first.path}: line {line.line_no}: {line.error}")
        targets = spark.createDataFrame(list(enumerate(target_names)), "target_id int, target_class string")
        report = build_report(judged, parsed) | {"target_names": list(target_names), "source_provenance": [{"name": s["name"], "license": s.get("license"), "source_url": s.get("source_url")} for s in sources]}
        kept = judged.where("status = 'kept'")
        pictures = kept.select(F.concat(F.lit("images/"), "split", F.lit("/"), "output_stem", "suffix").alias("path"), F.col("path").alias("source"), F.lit(None).cast("binary").alias("content"))
        texts = label_files(judged, parsed, targets).select(F.concat(F.lit("labels/"), "split", F.lit("/"), "output_stem", F.lit(".txt")).alias("path"), F.lit(None).cast("string").alias("source"), F.col("text").cast("binary").alias("content"))
        yaml = "path: .\ntrain: images/train\nval: images/val\ntest: images/test\nnames:\n" + "".join(f"  {k}: {n}\n" for k, n in enumerate(target_names))
        write_tree(pictures.unionByName(texts), out, {"data.yaml": yaml, "build-report.json": json.dumps(report)}, "build-report.json", FOLDERS)
        with open(f"{local(out)}/build-report.json", encoding="utf-8") as f:
            return json.load(f)
    finally:
        judged.unpersist()
        parsed.unpersist()


def audit_tables(images: DataFrame, labels: DataFrame, class_count: int, threshold: int) -> dict[str, DataFrame]:
    """The audit's findings as tables, by name.

    ``images`` has split, path, stem, sha256, dhash64 and fault (null where a
    picture is readable); ``labels`` split, stem, line_no and text.
    """
    key = ["split", "stem"]
    present = labels.select(*key).distinct()
    paired = labels.join(images.select(*key).distinct(), key, "left_semi")
    lines = D.audit_lines(paired, class_count)
    records = images.where("fault is null").select("split", "path", "sha256", "dhash64")
    return {
        "missing_labels": images.join(present, key, "left_anti").select("path"),
        "invalid_label_files": D.errors_by_key(lines, key),
        "unreadable_images": images.where("fault is not null").select("path", F.col("fault").alias("error")),
        "orphan_labels": present.join(images.select(*key).distinct(), key, "left_anti"),
        "cross_split_groups": D.exact_groups(records).where("cross_split").select("sha256", "splits", "paths"),
        "exact_groups": D.exact_groups(records).select("sha256"),
        "pairs": D.near_pairs(records, threshold),
        "annotations": lines.where("error is null").groupBy("class_id").count(),
    }


HARD = ("missing_labels", "invalid_label_files", "unreadable_images", "orphan_labels", "cross_split_groups")


def audit_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many findings of each kind, the hard errors, and the gates."""
    counts = [tables[name].select(F.lit(name).alias("kind")) for name in (*HARD, "exact_groups", "pairs")]
    by = reduce(DataFrame.unionByName, counts).groupBy().agg(*[F.count_if(F.col("kind") == name).alias(name) for name in (*HARD, "exact_groups", "pairs")])
    hard = sum((F.col(c) for c in HARD), F.lit(0)).cast("bigint")
    return by.withColumn("hard_error_count", hard).withColumn("gate_passed", F.col("hard_error_count") == 0).withColumn("visual_review_required", F.col("pairs") > 0)


def audit_dataset(spark: SparkSession, root: str, threshold: int = 4, most_pairs: int = SHOWN, class_names: list[str] | None = None) -> dict:
    """Structural, exact and perceptual audit of a built tree, read only; the report as a dict.

    Class names come from the tree's ``build-report.json`` unless given.  Lists
    show their first thousand entries and say how many there are.
    """
    root = local(root).rstrip("/")
    if class_names is None:
        class_names = [r.target_class for r in readers.target_names(readers.read_config(spark, f"{root}/build-report.json")).orderBy("target_id").collect()]  # as many as classes
    files = readers.scan_processed_tree(spark, root)
    name = F.element_at(F.split("path", "/"), -1)
    shown = F.concat(F.lit("images/"), "split", F.lit("/"), name)
    pictures = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*readers.IMAGE_SUFFIXES))
    hashed = pictures.select("split", shown.alias("path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), picture_hashes(F.col("content")).alias("_h"))
    images = hashed.select("split", "path", "stem", "_h.*").persist(StorageLevel.DISK_ONLY)
    label_path = F.col("path")
    lines = readers.small_file_lines(spark, f"{root}/labels", ".txt")
    labels = lines.select(F.regexp_extract(label_path, r"/labels/([^/]+)/[^/]+$", 1).alias("split"), F.regexp_extract(label_path, r"/([^/]+)\.txt$", 1).alias("stem"), "line_no", "text").where(F.col("split").isin(*SPLITS)).persist(StorageLevel.DISK_ONLY)
    try:
        tables = audit_tables(images, labels, len(class_names), threshold)
        tables["pairs"] = tables["pairs"].persist(StorageLevel.DISK_ONLY)
        total = audit_summary(tables).first()
        counted = lambda df, key: {r[0]: r[1] for r in df.groupBy(key).count().collect()}  # noqa: E731  as many as splits or sources
        label = F.concat(F.lit("labels/"), "split", F.lit("/"), "stem", F.lit(".txt")).alias("path")

        def first(table: DataFrame, order: list[str], most: int = SHOWN) -> list[dict]:
            return [r.asDict() for r in table.orderBy(*order).limit(most).collect()]

        by_split, by_class = counted(images, "split"), {r[0]: r[1] for r in tables["annotations"].collect()}
        return {
            "schema_version": 1,
            "dataset_root": root,
            "class_names": class_names,
            "image_counts_by_split": {s: by_split.get(s, 0) for s in SPLITS},
            "image_counts_by_source": dict(sorted(counted(images.select(S.source_prefix(F.element_at(F.split("path", "/"), -1)).alias("s")), "s").items())),
            "annotation_counts_by_class": {n: by_class.get(k, 0) for k, n in enumerate(class_names)},
            "structural": {
                "missing_label_count": total.missing_labels,
                "missing_labels": [r["path"] for r in first(tables["missing_labels"], ["path"])],
                "invalid_label_file_count": total.invalid_label_files,
                "invalid_label_files": first(tables["invalid_label_files"].select(label, "errors"), ["path"]),
                "orphan_label_count": total.orphan_labels,
                "orphan_labels": [r["path"] for r in first(tables["orphan_labels"].select(label), ["path"])],
                "unreadable_image_count": total.unreadable_images,
                "unreadable_images": first(tables["unreadable_images"], ["path"]),
            },
            "exact_duplicates": {"group_count": total.exact_groups, "cross_split_group_count": total.cross_split_groups, "cross_split_groups": first(tables["cross_split_groups"], ["sha256"])},
            "perceptual_candidates": {
                "method": "64-bit difference hash (dHash)",
                "hamming_threshold": threshold,
                "cross_split_candidate_count": total.pairs,
                "reported_count": min(total.pairs, most_pairs),
                "truncated": total.pairs > most_pairs,
                "pairs": first(tables["pairs"], ["hamming_distance", "left_path", "right_path"], most_pairs),
            },
            "quality_gate": {"hard_error_count": total.hard_error_count, "structural_and_exact_gate_passed": total.gate_passed, "visual_review_required": total.visual_review_required},
        }
    finally:
        for table in (images, labels):
            table.unpersist()


def decontaminate_dataset(spark: SparkSession, source_root: str, out: str, audit: dict) -> dict:
    """The tree without images that nearly equal one of a higher split of the same source, as the audit's pairs say; returns the report.

    Files are linked where the file system allows it.  Refuses a report of
    another tree and an existing output; the source stays as it is.
    """
    root = local(source_root).rstrip("/")
    if local(audit["dataset_root"]).rstrip("/") != root:
        raise ValueError("the audit is of another dataset")
    found = audit["perceptual_candidates"]
    columns = "hamming_distance int, left_split string, left_path string, right_split string, right_path string"
    pairs = spark.createDataFrame([tuple(p[c.split()[0]] for c in columns.split(", ")) for p in found["pairs"]], columns)
    base = lambda c: S.source_prefix(F.element_at(F.split(c, "/"), -1))
    gone = D.removals(pairs, base)
    ignored = pairs.where(base(F.col("left_path")) != base(F.col("right_path"))).count()
    listed = [{"removed_path": r.removed_path, "kept_higher_priority_paths": list(r.kept_paths), "minimum_dhash_distance": r.min_distance} for r in gone.orderBy("removed_path").collect()]  # no more than the report's pairs
    every = list_files(spark, root)
    inside = F.regexp_extract("path", r"/((?:images|labels)/(?:train|val|test)/[^/]+)$", 1)
    files = every.select(F.col("path").alias("source"), inside.alias("path")).where("path <> ''")
    pictures = files.where(F.col("path").startswith("images/") & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*readers.IMAGE_SUFFIXES))
    kept = pictures.join(gone.select(F.col("removed_path").alias("path")), "path", "left_anti")
    label = F.concat(F.lit("labels/"), F.regexp_extract("path", r"^images/(.*)\.[^.]*$", 1), F.lit(".txt"))
    texts = files.join(kept.select(label.alias("path")).distinct(), "path", "left_semi")
    by_split = {r[0]: r[1] for r in kept.groupBy(F.split("path", "/")[1].alias("split")).count().collect()}  # as many as splits
    notes = {}
    for name in ("data.yaml", "build-report.json", "resize-report.json"):
        try:
            with open(f"{root}/{name}", encoding="utf-8") as f:
                notes[name] = f.read()
        except FileNotFoundError:
            continue
    report = {
        "schema_version": 1,
        "source_dataset": root,
        "output_dataset": local(out).rstrip("/"),
        "policy": "same-source cross-split dHash candidate; retain test > val > train",
        "perceptual_method": found["method"],
        "hamming_threshold": found["hamming_threshold"],
        "removed_image_count": len(listed),
        "retained_image_counts_by_split": {s: by_split.get(s, 0) for s in SPLITS},
        "cross_source_candidate_pairs_ignored": ignored,
        "removals": listed,
    }
    rows = kept.unionByName(texts).withColumn("content", F.lit(None).cast("binary"))
    write_tree(rows, out, notes | {"decontamination-report.json": json.dumps(report)}, "decontamination-report.json", FOLDERS)
    with open(f"{local(out)}/decontamination-report.json", encoding="utf-8") as f:
        return json.load(f)


def require_clean(report: dict) -> None:
    """Raises if the audit's structural and exact gate does not hold."""
    if not report["quality_gate"]["structural_and_exact_gate_passed"]:
        raise ValueError(f"{report['quality_gate']['hard_error_count']} hard errors")


def consolidate_history(rows: DataFrame, checkpoints: DataFrame, metrics: list[str], columns: list[str], out: str, manifest: str) -> dict:
    """One contiguous training history of overlapping checkpoints: CSV parts under ``out`` and a manifest, which is written last and returned.

    ``rows`` has epoch, source, source_idx, row_idx and ``columns``; the last
    source of an epoch is accepted, earlier ones are listed as replays, and
    those whose metrics differ by name.  ``checkpoints`` has path, completed_epoch,
    sha256 and names; different taxonomies or a missing epoch stop it before
    anything is written.
    """
    spark = rows.sparkSession
    if checkpoints.select("names").distinct().count() > 1:
        raise ValueError("checkpoint taxonomy mismatch")
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        accepted, replays, divergent = Q.merge_history(rows, [], metrics)
        total = accepted.agg(F.min("epoch").alias("a"), F.max("epoch").alias("b"), F.count("*").alias("n")).first()
        if not total.n:
            raise ValueError("no epochs")
        if total.n != total.b:
            gaps = [r[0] for r in Q.missing_epochs(accepted.select(F.lit(0).alias("_k"), "epoch"), ["_k"]).select("missing_epoch").orderBy("missing_epoch").limit(SHOWN).collect()]
            raise ValueError(f"training history is not contiguous; missing epochs: {gaps}")
        write_history(accepted, out, columns)
        parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        listed = lambda df, *order: [r.asDict() for r in df.orderBy(*order).limit(SHOWN).collect()]
        report = {
            "schema_version": 1,
            "purpose": "accepted contiguous training trajectory reconstructed from immutable checkpoints",
            "accepted_epoch_start": total.a,
            "accepted_epoch_end": total.b,
            "accepted_epoch_count": total.n,
            "output": [r.asDict() for r in parts.orderBy("path").collect()],  # as many as parts
            "checkpoint_sources": [r.asDict() for r in checkpoints.orderBy("path").collect()],  # as many as checkpoints
            "deduplicated_replay_count": replays.count(),
            "deduplicated_replays": listed(replays, "epoch", "discarded_source"),
            "divergent_replays": listed(divergent, "epoch", "source"),
        }
        write_atomic_json(report, local(manifest))
        return report
    finally:
        rows.unpersist()
