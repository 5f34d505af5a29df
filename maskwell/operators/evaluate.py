"""Coverage metrics of pages, cohort summaries and the gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import regions

EVALUABLE = ("completed_unassessed", "no_detections_unverified")
REVIEWABLE = (*EVALUABLE, "pending_human_review")


@dataclass(frozen=True)
class Gate:
    """Thresholds; both rates must be above theirs, not at them."""

    version: int = 2
    minimum_records: int = 10
    overall_min: float = 0.80
    correct_min: float = 0.80


def entity_metrics(truth: DataFrame, applied: DataFrame, ink: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, id, label, ink_pixels, covered_pixels, coverage, fully_covered, correct_label_fully_covered.

    truth: key, id, label, runs; applied: key, label, runs; ink: key, runs (disjoint). Runs are y, x0, x1 and, if they come
    from regions.slabs, h."""
    own = [key, "id", "label"]
    target = regions.intersect(regions.union(truth, own), ink, [key]).select(*own, "y", "h", "x0", "x1")
    covered = regions.intersect(target, regions.union(applied, [key]), [key])
    right = regions.intersect(target, regions.union(applied, [key, "label"]), [key, "label"])
    rows = truth.select(*own).distinct()
    for df, name in ((target, "ink_pixels"), (covered, "covered_pixels"), (right, "right_pixels")):
        rows = rows.join(regions.area(df, own, name), own, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    some = F.col("ink_pixels") > 0
    return rows.select(
        *own,
        "ink_pixels",
        "covered_pixels",
        F.when(some, F.col("covered_pixels") / F.col("ink_pixels")).otherwise(0.0).alias("coverage"),
        (some & (F.col("covered_pixels") == F.col("ink_pixels"))).alias("fully_covered"),
        (some & (F.col("right_pixels") == F.col("ink_pixels"))).alias("correct_label_fully_covered"),
    )


def ink_metrics(truth: DataFrame, applied: DataFrame, ink: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sensitive_coverage, nonpii_ink_mask of each page with ink: the masked shares of the ink under the truth and of
    all other ink; null where there is none of it.

    truth, applied: key, runs; ink: key, runs (disjoint, all of the page)."""
    sensitive = regions.intersect(regions.union(truth, [key]), ink, [key])
    mask = regions.union(applied, [key])
    rows = ink.select(key).distinct()
    for df, name in ((ink, "_ink"), (sensitive, "_s"), (regions.intersect(ink, mask, [key]), "_masked"), (regions.intersect(sensitive, mask, [key]), "_s_masked")):
        rows = rows.join(regions.area(df, [key], name), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.select(key, F.try_divide("_s_masked", "_s").alias("sensitive_coverage"), F.try_divide(F.col("_masked") - F.col("_s_masked"), F.col("_ink") - F.col("_s")).alias("nonpii_ink_mask"))


def false_positives(detections: DataFrame, truth: DataFrame, ink: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, det: detections (key, det, runs) that touch no sensitive ink."""
    sensitive = regions.intersect(regions.union(truth, [key]), ink, [key])
    hit = regions.intersect(detections, sensitive, [key]).select(key, "det").distinct()
    return detections.select(key, "det").distinct().join(hit, [key, "det"], "left_anti")


def with_failures(metrics: DataFrame, truth_entities: DataFrame, runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A failed or missing run counts each entity of the truth as missed."""
    ok = runs.where(F.col("status").isin(*EVALUABLE)).select(key).distinct().withColumn("_ok", F.lit(True))
    rows = truth_entities.select(key, "id", "label").join(ok, key, "left").join(metrics.select(key, "id", "fully_covered", "correct_label_fully_covered"), [key, "id"], "left")
    good = F.coalesce("_ok", F.lit(False))
    return rows.select(key, "id", "label", (good & F.coalesce("fully_covered", F.lit(False))).alias("fully_covered"), (good & F.coalesce("correct_label_fully_covered", F.lit(False))).alias("correct_label_fully_covered"), (~good).alias("failed"))


def per_label(entities: DataFrame) -> DataFrame:
    return entities.groupBy("label").agg(F.count("*").alias("n"), F.count_if("fully_covered").alias("full"), F.count_if("correct_label_fully_covered").alias("correct"))


def summary(images: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """One row from images (n_entities, n_full, n_correct, fraction, failed); all 0, max 1 and not passed without any."""
    n, e = F.count("*"), F.coalesce(F.sum("n_entities"), F.lit(0))
    sums = images.agg(
        n.alias("n"),
        e.cast("long").alias("entity_count"),
        F.coalesce(F.sum("n_full") / F.nullif(F.sum("n_entities"), F.lit(0)), F.lit(0.0)).alias("overall"),
        F.coalesce(F.sum("n_correct") / F.nullif(F.sum("n_entities"), F.lit(0)), F.lit(0.0)).alias("correct_label"),
        F.coalesce(F.count_if((F.col("n_entities") > 0) & (F.col("n_full") == F.col("n_entities"))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("zero_missed_images"),
        F.coalesce(F.max("fraction"), F.lit(1.0)).alias("max_nonpii_ink_mask"),
        F.count_if("failed").alias("n_failed"),
    )
    return sums.withColumn("gate_passed", passed(gate)).withColumn("gate_version", F.lit(gate.version))


def passed(gate: Gate):
    return (F.col("n") >= gate.minimum_records) & (F.col("entity_count") > 0) & (F.col("n_failed") == 0) & (F.col("overall") > gate.overall_min) & (F.col("correct_label") > gate.correct_min)


def prefix_summaries(images: DataFrame, order: str, group: list[str], gate: Gate = Gate()) -> DataFrame:
    """The summary after each image, of all up to it, in one pass: running sums over a group's images in order."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("n_entities").over(w)
    rows = images.select(
        *group,
        order,
        F.count("*").over(w).alias("n"),
        total.cast("long").alias("entity_count"),
        F.coalesce(F.sum("n_full").over(w) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("overall"),
        F.coalesce(F.sum("n_correct").over(w) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("correct_label"),
        (F.sum(((F.col("n_entities") > 0) & (F.col("n_full") == F.col("n_entities"))).cast("int")).over(w) / F.count("*").over(w)).alias("zero_missed_images"),
        F.max("fraction").over(w).alias("max_nonpii_ink_mask"),
        F.sum(F.col("failed").cast("int")).over(w).alias("n_failed"),
    )
    return rows.withColumn("gate_passed", passed(gate))


def until_first_failure(items: DataFrame, order: str, group: list[str], failed: str = "failed") -> DataFrame:
    """Items up to and with the first that failed; those after it are not run."""
    first = F.min(F.when(F.col(failed), F.col(order))).over(W.partitionBy(*group))
    return items.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).drop("_first")
