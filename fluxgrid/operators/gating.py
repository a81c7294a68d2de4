"""Gates that depend on each other: rules with prerequisites, judged in one plan, and the rules of returned training runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S

GATED = "array<struct<gate: string, level: int, status: string, reason: string, blocked_by: string>>"


@dataclass(frozen=True)
class Rule:
    """A gate: the gates that must hold before it, and (what is wrong, what is then said) in order."""

    gate: str
    checks: list[tuple[Column, str | Column]]
    after: tuple[str, ...] = field(default=())


def levels(rules: list[Rule]) -> dict[str, int]:
    """How many gates in a row come before each; an unknown prerequisite, a double gate or a circle is an error."""
    by = {r.gate: r for r in rules}
    if len(by) < len(rules):
        raise ValueError("a gate is defined twice")
    if unknown := sorted({a for r in rules for a in r.after} - set(by)):
        raise ValueError(f"unknown prerequisites: {unknown}")
    out: dict[str, int] = {}
    while len(out) < len(rules):
        ready = [r for r in rules if r.gate not in out and all(a in out for a in r.after)]
        if not ready:
            raise ValueError(f"gates wait for each other: {sorted(set(by) - set(out))}")
        out |= {r.gate: 1 + max((out[a] for a in r.after), default=-1) for r in ready}
    return out


def judged(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(keys, gate, level, status, reason, blocked_by), a row per row of ``rows`` and rule.

    A gate is complete, failed with the first thing that is wrong, or blocked by
    the first failed gate before it, by level and name.  A check that is null
    counts as wrong.  All rules are columns of one projection.
    """
    level = levels(rules)
    by = {r.gate: r for r in rules}

    def before(gate: str) -> set[str]:
        return set(by[gate].after) | {b for a in by[gate].after for b in before(a)}

    own = {r.gate: S.first_failure([(F.coalesce(wrong, F.lit(True)), said) for wrong, said in r.checks]) for r in rules}
    table = rows.select(*keys, *[reason.alias(f"_{gate}") for gate, reason in own.items()])
    shown = []
    # what fails before itself is only blocked, so the first failure by level is a cause
    for gate in sorted(level, key=lambda g: (level[g], g)):
        earlier = sorted(before(gate), key=lambda g: (level[g], g))
        blocker = F.coalesce(*[F.when(F.col(f"_{b}").isNotNull(), F.lit(b)) for b in earlier], F.lit(None).cast("string")) if earlier else F.lit(None).cast("string")
        reason = F.when(blocker.isNull(), F.col(f"_{gate}"))
        status = F.when(blocker.isNotNull(), "blocked").when(reason.isNotNull(), "failed").otherwise("complete")
        shown.append(F.struct(F.lit(gate).alias("gate"), F.lit(level[gate]).alias("level"), status.alias("status"), reason.alias("reason"), blocker.alias("blocked_by")))
    return table.select(*keys, F.inline(F.array(*shown).cast(GATED)))


def first_failure(gated: DataFrame, keys: list[str]) -> DataFrame:
    """Per subject the first gate that failed, by level and name, and why; subjects without one are left out."""
    return gated.where("status = 'failed'").groupBy(*keys).agg(F.min_by(F.struct("gate", "reason"), F.struct("level", "gate")).alias("_f")).select(*keys, "_f.*")


def import_rule(after: tuple[str, ...] = ()) -> Rule:
    """The accepted package: status, the archive it came from, and each model's recorded hash (``archive_sha256``, ``models`` by name: expected and found)."""
    c = F.col
    changed = F.filter(F.map_keys("models"), lambda k: ~F.coalesce(F.try_element_at("models", k)["expected"] == F.try_element_at("models", k)["found"], F.lit(False)))
    checks = [
        (c("receipt_status") != "accepted", "import receipt is not accepted"),
        (c("archive_sha256") != c("receipt_archive_sha256"), "archive differs from the imported one"),
        (F.size(changed) > 0, F.concat(F.lit("checksum changed: "), F.array_join(F.array_sort(changed), ", "))),
    ]
    return Rule("import", checks, after)


def history_rule(after: tuple[str, ...] = ("import",)) -> Rule:
    """Consolidated epochs: from the first to the protected one, none missing."""
    c = F.col
    checks = [(c("epoch_start") != 1, "does not start at epoch 1"), (c("epoch_end") != c("final_epoch"), "does not end at the final epoch"), (c("epoch_count") != c("final_epoch"), "is not contiguous")]
    return Rule("history", checks, after)


def comparison_rule(images: int, size: int, after: tuple[str, ...] = ("import",)) -> Rule:
    """Both models, each by its hash, on the whole test split at one size."""
    c = F.col
    checks = [
        ((c("split") != "test") | (c("fraction") != 1.0), "not the complete test split"),
        (c("imgsz") != size, f"not at image size {size}"),
        (c("image_count") != images, f"not exactly {images} images"),
        (c("baseline_sha256") != c("expected_baseline_sha256"), "baseline hash mismatch"),
        (c("tuned_sha256") != c("expected_tuned_sha256"), "fine-tuned hash mismatch"),
    ]
    return Rule("comparison", checks, after)


def notebook_report(notebooks: DataFrame) -> DataFrame:
    """Per (path, text) of a notebook: code_cells, unexecuted, errors, missing_output and valid.

    Cells and outputs are exploded as VARIANT, so notebooks of any shape are
    read without a schema; one that is no JSON object with a list of cells is
    not valid.  Where no code cell has a number, every cell from the third on
    must have outputs instead.
    """
    spark: SparkSession = notebooks.sparkSession
    parsed = notebooks.select("path", F.try_parse_json("text").alias("_v")).withColumn("_cells", F.try_variant_get("_v", "$.cells", "variant"))
    sound = F.coalesce(F.schema_of_variant("_cells").startswith("ARRAY"), F.lit(False))
    parsed = parsed.withColumn("_sound", sound)
    cells = parsed.where("_sound").lateralJoin(spark.tvf.variant_explode(F.col("_cells").outer())).select("path", "pos", F.col("value").alias("_cell"))
    get = lambda path, kind: F.try_variant_get("_cell", path, kind)
    code = cells.where(get("$.cell_type", "string") == "code").select("path", (F.row_number().over(W.partitionBy("path").orderBy("pos")) - 1).alias("index"), get("$.execution_count", "int").alias("number"), get("$.outputs", "variant").alias("_outputs"))
    code = code.withColumn("_some", F.coalesce(F.schema_of_variant("_outputs").startswith("ARRAY") & (F.to_json("_outputs") != "[]"), F.lit(False)))
    outputs = code.where("_some").lateralJoin(spark.tvf.variant_explode(F.col("_outputs").outer())).select("path", "index", F.col("pos").alias("_at"), F.col("value").alias("_out"))
    out = lambda path: F.try_variant_get("_out", path, "string")
    failed = outputs.where(out("$.output_type") == "error").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("index", F.col("_at").alias("output"), out("$.ename").alias("ename"), out("$.evalue").alias("evalue")))).alias("errors"))
    g = code.groupBy("path").agg(
        F.count("*").alias("code_cells"),
        F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.col("index")))).alias("unexecuted"),
        F.array_sort(F.collect_list(F.when((F.col("index") >= 2) & ~F.col("_some"), F.col("index")))).alias("_silent"),
    )
    j = parsed.select("path", "_sound").join(g, "path", "left").join(failed, "path", "left")
    none = F.array().cast("array<int>")
    cells_, bare = F.coalesce("code_cells", F.lit(0)), F.coalesce("unexecuted", none)
    all_bare = F.size(bare) == cells_
    j = j.select("path", "_sound", cells_.alias("code_cells"), bare.alias("unexecuted"), F.coalesce("errors", F.array().cast("array<struct<index: int, output: int, ename: string, evalue: string>>")).alias("errors"), F.when(all_bare, F.coalesce("_silent", none)).otherwise(none).alias("missing_output"))
    fine = F.col("_sound") & (F.size("errors") == 0) & ((F.size("unexecuted") == 0) | (F.size("unexecuted") == F.col("code_cells"))) & (F.size("missing_output") == 0)
    return j.withColumn("valid", fine).drop("_sound")
