"""Boxes: half-open [x0, y0, x1, y1] in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD_BEFORE, PAD_AFTER = 4, 5
BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def padded_box(xs: Column, ys: Column, width: Column, height: Column) -> Column:
    """The box around points, padded and kept inside the page."""
    return F.struct(
        F.greatest(F.lit(0), F.floor(F.array_min(xs)).cast("int") - PAD_BEFORE).alias("x0"),
        F.greatest(F.lit(0), F.floor(F.array_min(ys)).cast("int") - PAD_BEFORE).alias("y0"),
        F.least(width, F.ceil(F.array_max(xs)).cast("int") + PAD_AFTER).cast("int").alias("x1"),
        F.least(height, F.ceil(F.array_max(ys)).cast("int") + PAD_AFTER).cast("int").alias("y1"),
    )


def from_drag(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    """The box between two points, in any order."""
    return F.struct(F.least(xa, xb).alias("x0"), F.least(ya, yb).alias("y0"), F.greatest(xa, xb).alias("x1"), F.greatest(ya, yb).alias("y1"))


def valid_box(box: Column, width: Column, height: Column) -> Column:
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    return F.coalesce((x0 >= 0) & (x0 < x1) & (x1 <= width) & (y0 >= 0) & (y0 < y1) & (y1 <= height), F.lit(False))
