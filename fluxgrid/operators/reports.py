"""Joins of configuration, results and registry; manifests, selection, set differences and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S
from fluxgrid.operators.scans import sorted_digest
from fluxgrid.session import shared_dir

METRICS = ("mean", "p50", "p95", "p99", "max")


def merged_config(row: dict[str, Column], cli: dict[str, Column], defaults: dict) -> dict[str, Column]:
    """Command line over row over default; a thread count of 0 counts as absent."""
    out = {}
    for name, default in defaults.items():
        given = cli.get(name, F.lit(None))
        given = F.when(given != 0, given) if name == "threads" else given
        out[name] = F.coalesce(given, row.get(name, F.lit(None)), F.lit(default))
    return out


def selected_rows(matrix: DataFrame, ids: list[str] | None, done: DataFrame | None = None) -> DataFrame:
    """Rows of the wanted ids (an unknown one is an error) without those that are complete."""
    out = matrix
    if ids is not None:
        known = {r[0] for r in matrix.where(F.col("id").isin(ids)).select("id").collect()}  # at most as many as asked for
        if unknown := sorted(set(ids) - known):
            raise ValueError(f"unknown row ids: {unknown}")
        out = out.where(F.col("id").isin(ids))
    return out if done is None else out.join(done.where("status = 'complete'").select("id"), "id", "left_anti")


def report_table(matrix: DataFrame, reports: DataFrame, registry: DataFrame, shown: list[str], metrics: list[str]) -> DataFrame:
    """A row per experiment: settings (the report's own before the matrix's), metrics of complete reports, quality in percent.

    No report is 'pending'; a failed one keeps its status and has no metrics.
    """
    r = reports.select("id", *[F.col(c).alias(f"_r_{c}") for c in shown if c in reports.columns], *metrics, F.col("status").alias("_status"))
    j = matrix.join(r, "id", "left")
    for c in shown:
        if f"_r_{c}" in j.columns:
            j = j.withColumn(c, F.coalesce(f"_r_{c}", c))
    j = j.join(registry.select("model_key", "map50", "map50_95", "recall"), "model_key", "left")
    done = F.col("_status") == "complete"
    return j.select(
        "id", *shown, *[F.when(done, F.col(m)).alias(m) for m in metrics], *[S.percent_or_null(F.col(q)).alias(f"{q}_percent") for q in ("map50", "map50_95", "recall")], F.coalesce("_status", F.lit("pending")).alias("status")
    )


def union_matrix(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rows_with_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds the artifact; rows without one are failed, not lost."""
    j = rows.join(registry.withColumn("_has", F.lit(True)), "model_key", "left")
    return j.withColumn("status", F.when(F.col("_has"), "ready").otherwise("failed")).drop("_has")


def tree_hash(files: DataFrame, keys: list[str], path: str = "path", sha: str = "sha256") -> DataFrame:
    """Per key the sha256 over (path, NUL, sha, LF) in order of path parts, cache files left out."""
    clean = files.where(~F.col(path).rlike(r"(^|/)(__pycache__/.*|[^/]*\.pyc|\.DS_Store)$"))
    line = F.concat(F.col(path), F.lit("\0"), F.col(sha), F.lit("\n"))
    return sorted_digest(clean, keys, [F.split(path, "/"), line], line, "tree_sha256", "files")


def inventory(files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of binary files."""
    return files.select("path", F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def consistency(left: DataFrame, right: DataFrame, key: str, checks: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, check, ok) for each named pair of columns; a row missing on one side fails."""
    j = left.select(key, *[F.col(a).alias(f"_l{i}") for i, (a, _) in enumerate(checks.values())]).join(right.select(key, *[F.col(b).alias(f"_r{i}") for i, (_, b) in enumerate(checks.values())]), key, "full")
    each = [F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"_l{i}") == F.col(f"_r{i}"), F.lit(False)).alias("ok")) for i, n in enumerate(checks)]
    return j.select(key, F.inline(F.array(*each)))


def first_existing(candidates: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the first candidate path (by position) that exists, null if none does."""
    found = candidates.join(present.select("path").distinct().withColumn("_e", F.lit(True)), "path", "left")
    return found.groupBy(*keys).agg(F.min_by(F.when(F.col("_e"), F.col("path")), F.when(F.col("_e"), F.col("position"))).alias("path"))


def status_of(required: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The status of everything required; what has none is 'missing'."""
    return required.join(results.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def all_complete(statuses: DataFrame) -> DataFrame:
    return statuses.agg(F.coalesce(F.bool_and(F.col("status") == "complete"), F.lit(False)).alias("all_complete"))


def missing_members(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.select(key).exceptAll(present.select(key).distinct())


def judged_checkpoints(checkpoints: DataFrame, names: Column) -> DataFrame:
    """Adds ``reject_reason``, null for one to resume from."""
    reason = S.first_failure([(F.coalesce(F.col("completed_epoch"), F.lit(0)) <= 0, "no resumable epoch"), (~F.coalesce("optimizer_present", F.lit(False)), "no optimizer state"), (~F.coalesce(F.col("names") == names, F.lit(False)), "taxonomy mismatch")])
    return checkpoints.withColumn("reject_reason", reason)


def best_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` columns."""
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def preferred(rows: DataFrame, keys: list[str], prefer: Column, order: str) -> DataFrame:
    """Per key the first preferred row, else the last one."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.when(prefer, F.struct(F.lit(1).alias("p"), (-F.col(order)).alias("o"))).otherwise(F.struct(F.lit(0).alias("p"), F.col(order).alias("o")))
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def cover_sample(records: DataFrame, key: str, classes: str, count: int, empties: int = 3) -> DataFrame:
    """``count`` records: one for each class in turn (most classes, then earliest), a few empty ones, then evenly spaced ones.

    A step of the greedy choice takes away at most one record, so with c classes
    each needs its c best records at most: one aggregation makes these lists,
    and the choice is made among them.  What comes to the driver is bounded by
    the classes and ``count``.
    """
    rows = records.select(key, F.array_sort(F.array_distinct(classes)).alias("_c"))
    each = rows.select(key, F.explode("_c").alias("v"), F.size("_c").alias("size"))
    many = each.select("v").distinct().count()
    best = W.partitionBy("v").orderBy(F.col("size").desc(), key)
    lists: dict = {}
    for r in each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= many).orderBy("v", "place").collect():
        lists.setdefault(r["v"], []).append(r[key])
    chosen: list = []
    for candidates in lists.values():
        chosen += [k for k in candidates if k not in chosen][:1]
    chosen += [r[0] for r in rows.where("size(_c) = 0").orderBy(key).select(key).limit(min(empties, max(0, count - len(chosen)))).collect()]
    shared_dir(records.sparkSession)
    rest = (rows.where(~F.col(key).isin(chosen)) if chosen else rows).select(key).orderBy(key).checkpoint()
    sizes = dict(rest.groupBy(F.spark_partition_id()).count().collect())  # one per partition
    n, slots = sum(sizes.values()), max(0, count - len(chosen))
    if slots and n:
        # a sorted row's place is its number in its partition, and those of the partitions before
        picks = sorted({min(int(i * (n / slots)), n - 1) for i in range(slots)})
        ids, before = [], 0
        for part in sorted(sizes):
            ids += [(part << 33) + k - before for k in picks if before <= k < before + sizes[part]]
            before += sizes[part]
        chosen += [r[0] for r in rest.where(F.monotonically_increasing_id().isin(ids)).orderBy(key).collect()]
    chosen = chosen[:count]
    if len(chosen) != count:
        raise RuntimeError(f"selected {len(chosen)} records, expected {count}")
    order = records.sparkSession.createDataFrame([(k, i) for i, k in enumerate(chosen)], f"{key} {records.schema[key].dataType.simpleString()}, position int")
    return records.join(F.broadcast(order), key)  # ``count`` rows


def set_difference(left: Column, right: Column) -> Column:
    """What each side has that the other lacks, sorted."""
    return F.struct(F.array_sort(F.array_except(left, right)).alias("missing"), F.array_sort(F.array_except(right, left)).alias("extra"))


def gate(name: str, ok: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("ok"))


def gates(row: DataFrame, *checks: Column) -> DataFrame:
    """(gate, ok) rows of one row of figures."""
    return row.select(F.inline(F.array(*checks)))


def require(gated: DataFrame) -> None:
    """Raise if a gate does not hold."""
    failed = [r[0] for r in gated.where("not ok").select("gate").collect()]  # as many as gates
    if failed:
        raise ValueError("gates failed: " + ", ".join(sorted(failed)))


def mount_failure() -> Column:
    """The first rule that a camera mount profile breaks, else null.  A missing field breaks its rule."""
    c = F.col
    rules = [
        (F.trim("profile_id") == "", "profile_id must be non-empty"),
        (c("mount_zone") != "near_top_handle", "mount_zone must be near_top_handle"),
        (c("optical_axis") != "forward", "optical_axis must be forward"),
        (~c("distance_below_handle_mm").between(0, c("max_distance_below_handle_mm")), "distance_below_handle_mm outside the declared zone"),
        (~((c("max_distance_below_handle_mm") > 0) & (c("max_distance_below_handle_mm") <= 80)), "max_distance_below_handle_mm outside (0, 80]"),
        (~c("nominal_pitch_down_deg").between(0, 30), "nominal_pitch_down_deg outside [0, 30]"),
        (~((c("pitch_tolerance_deg") > 0) & (c("pitch_tolerance_deg") <= 10)), "pitch_tolerance_deg outside (0, 10]"),
        (F.abs("nominal_roll_deg") > 10, "nominal_roll_deg above 10"),
        (~((c("roll_tolerance_deg") > 0) & (c("roll_tolerance_deg") <= 10)), "roll_tolerance_deg outside (0, 10]"),
        (~c("hand_occlusion_check_required"), "hand-occlusion check is required"),
        (~c("intrinsic_calibration_required"), "intrinsic calibration is required"),
        (~c("extrinsic_calibration_required"), "extrinsic calibration is required"),
    ]
    return S.first_failure([(F.coalesce(broken, F.lit(True)), name) for broken, name in rules])


def split_counts_match(rows: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(split, expected, actual, ok) for every expected split."""
    want = rows.sparkSession.createDataFrame(sorted(expected.items()), "split string, expected bigint")
    got = rows.groupBy("split").agg(F.count("*").alias("actual"))
    return want.join(got, "split", "left").select("split", "expected", F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("ok", F.col("expected") == F.col("actual"))


def truncated(rows: DataFrame, order: list[str], most: int) -> tuple[DataFrame, int, bool]:
    """(the first ``most`` rows in order, rows in all, whether some are left out), as reports show long lists."""
    total = rows.count()
    return rows.orderBy(*order).limit(most), total, total > most
