"""Versions of runs: integrity checks, lineage, manual detections, new revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid_box
from ..storage import settle
from .evaluate import REVIEWABLE
from .redact import redact_images

MAX_BOXES = 128


def manifest_checks(listed: DataFrame, have: DataFrame) -> DataFrame:
    """doc_id, check_result: ok, or the first thing that is wrong. listed: doc_id, m_sha256, m_uid, m_revision; have:
    doc_id, sha256, uid, revision."""
    rows = listed.join(have, "doc_id", "left")
    result = F.when(F.col("sha256").isNull(), "missing")
    for c, name in (("sha256", "hash"), ("uid", "uid"), ("revision", "revision")):
        result = result.when(~F.col(f"m_{c}").eqNullSafe(F.col(c)), name)
    return rows.select("doc_id", result.otherwise("ok").alias("check_result"))


def openable(runs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Runs that may be reviewed: their status is reviewable, and input and output have the recorded hashes.
    inputs, outputs: run, sha256."""
    rows = runs.where(F.col("status").isin(*REVIEWABLE))
    for df, c in ((inputs, "input_sha256"), (outputs, "output_sha256")):
        rows = rows.join(df.select("run", F.col("sha256").alias(c)), ["run", c], "left_semi")
    return rows


def state(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row for each run with its metrics, if it has any."""
    rows = runs.join(metrics, "run", "left")
    status = F.when(F.col("parent_run").isNotNull(), "manual").when(F.col("entity_count").isNotNull(), "evaluated").otherwise("unannotated")
    return rows.withColumn("evaluation", status)


def lineage(runs: DataFrame) -> DataFrame:
    """run, depth, from the roots (no parent) to the leaves. Pointer doubling: rounds grow with the logarithm of the
    longest chain, and each row keeps one ancestor, so no path is held. Runs whose root is missing and those that lead to a
    cycle are left out: a chain cannot have more rounds than the logarithm of the runs. Of rows with one run id the least
    parent counts."""
    once = runs.groupBy("run").agg(F.min("parent_run").alias("up"))
    rows = settle(once.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    for _ in range(max(1, rows.count()).bit_length() + 1):
        open_ = rows.where("up is not null")
        if not open_.limit(1).count():
            break
        above = rows.select(F.col("run").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        rows = settle(rows.where("up is null").unionByName(open_.join(above, "up").select("run", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))))
    return rows.where("up is null").select("run", "depth")


def append_manual(detections: DataFrame, drawn: DataFrame) -> DataFrame:
    """The detections of a version and what was drawn on it (doc_id, x0, y0, x1, y1), labelled manual."""
    return detections.unionByName(drawn.withColumn("label", F.lit("manual")))


def check_boxes(drawn: DataFrame, key: str = "run", cap: int = MAX_BOXES) -> DataFrame:
    """key, ok: whether a save has 1 to cap boxes (key, b, width, height), all valid."""
    return drawn.groupBy(key).agg((F.count("*").between(1, cap) & F.bool_and(valid_box(F.col("b"), F.col("width"), F.col("height")))).alias("ok"))


#: Codes of errors that records may name; anything else could hold text of a document.
SAFE_CODES = ("ValueError", "RuntimeError", "OutOfMemoryError", "OSError", "TypeError")


def error_code(code):
    return F.when(code.isin(*SAFE_CODES), code).otherwise("InferenceError")


def run_id(*columns):
    """An id of 16 hex digits that follows from the columns, so that a task that runs twice names its run alike."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *columns), 256), 1, 16)


def totals(runs: DataFrame) -> DataFrame:
    """n, n_detections, n_unmapped, seconds (rounded half to even): one row from runs (detections and geometry_unmapped:
    arrays or null, elapsed_seconds)."""
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)), F.lit(0)).cast("long")
    return runs.agg(F.count("*").alias("n"), size("detections").alias("n_detections"), size("geometry_unmapped").alias("n_unmapped"), F.bround(F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)), 3).alias("seconds"))


def save(current: DataFrame, drawn: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new run rows, their images) of boxes drawn on current versions: drawn has run, new_run, b, width, height; outputs
    run, content. A save counts if its boxes are 1 to 128 and valid, the stored image has the recorded hash, the version is
    a leaf, and the painted image is verified, with all that was black before still black."""
    ok = check_boxes(drawn).where("ok").select("run")
    boxes = drawn.join(ok, "run", "left_semi").groupBy("run").agg(F.min("new_run").alias("new_run"), F.collect_list("b").alias("boxes"))
    stored = outputs.join(current.select("run", F.col("output_sha256").alias("_known")), "run").where(F.sha2("content", 256) == F.col("_known"))
    painted = settle(redact_images(boxes.join(stored.select("run", "content"), "run"), key="run").where("status <> 'failed'").join(boxes.select("run", "new_run"), "run"))
    rows = revise(current, painted.select("run", "new_run", "output_sha256"))
    images = painted.select(F.col("new_run").alias("run"), F.col("output").alias("content"), "output_sha256").join(rows.select("run"), "run", "left_semi")
    return rows, images


def revise(current: DataFrame, saves: DataFrame) -> DataFrame:
    """New run rows: saves (run, new_run, output_sha256) on the current version; stale ones (not a leaf) are left out, and of
    several on one leaf the first by new_run is taken, as the others are stale then.
    A revision is not approved, waits for review, and carries its parent's run and record hash."""
    parents = current.where("parent_run is not null").select(F.col("parent_run").alias("run")).distinct()
    leaves = current.join(parents, "run", "left_anti")
    record = F.sha2(F.to_json(F.struct(*sorted(current.columns))), 256)
    first = saves.groupBy("run").agg(F.min(F.struct("new_run", F.col("output_sha256").alias("_output"))).alias("_save")).select("run", "_save.*")
    rows = leaves.withColumn("_record", record).join(first, "run")
    changed = {"parent_run": F.col("run"), "parent_audit_sha256": F.col("_record"), "output_sha256": F.col("_output"), "status": F.lit("pending_human_review"), "approved": F.lit(False)}
    return rows.withColumns(changed).withColumn("run", F.col("new_run")).drop("new_run", "_record", "_output")
