"""A virtual page for texts without an image: a monospace grid of 72 columns. It stands in for rendered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CELL_H, CELL_W, COLUMNS, PITCH, STRIDE, X0, Y0, matches_with_offsets, with_starts

INK = r"[^\s\p{Z}]+"
MARGIN = 40


def page_width():
    return F.lit(X0 + STRIDE * (COLUMNS - 1) + CELL_W + MARGIN)


def page_height(n_chars):
    return (F.lit(Y0 + MARGIN) + PITCH * (F.floor(F.greatest(n_chars - 1, F.lit(0)) / COLUMNS) + 1)).cast("int")


def on_lines(rows: DataFrame, keep: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keep..., line, x0, x1, y0, y1: the cells of character ranges, one row for each line that a range touches."""
    lines = F.sequence(F.floor(F.col(start) / COLUMNS).cast("int"), F.floor((F.col(end) - 1) / COLUMNS).cast("int"))
    rows = rows.where(F.col(start) < F.col(end)).select(*keep, start, end, F.explode(lines).alias("line"))
    first = F.greatest(F.col(start), F.col("line") * COLUMNS) - F.col("line") * COLUMNS
    last = F.least(F.col(end), (F.col("line") + 1) * COLUMNS) - F.col("line") * COLUMNS - 1
    y0 = F.lit(Y0) + PITCH * F.col("line")
    return rows.select(*keep, "line", (X0 + STRIDE * first).cast("int").alias("x0"), (X0 + STRIDE * last + CELL_W).cast("int").alias("x1"), y0.cast("int").alias("y0"), (y0 + CELL_H).cast("int").alias("y1"))


def ink_runs(docs: DataFrame) -> DataFrame:
    """doc_id, line, x0, x1, y0, y1: disjoint runs of visible characters."""
    found = with_starts(matches_with_offsets(docs, "text", INK, ["doc_id"]))
    return on_lines(found, ["doc_id"])
