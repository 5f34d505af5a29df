"""Region algebra on runs: a mask is a set of rows (key, y, x0, x1), half-open, and h, the number of equal scanlines from y
on (1 where the column is missing). No pixel is ever a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs_of_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1 for each scanline of boxes (keys, x0, y0, x1, y1). Empty and inverted boxes have none."""
    rows = boxes.where("x0 < x1 and y0 < y1")
    return rows.select(*keys, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1")


def slabs(key: str, *frames: tuple[DataFrame, list[str]]) -> list[DataFrame]:
    """Of each (boxes, keys) the runs keys, y, h, x0, x1, cut at the upper and lower edges of all frames' boxes of a page,
    so that runs of different frames either have the same scanlines or share none. A page has as many cuts as different
    edges, not scanlines. Empty and inverted boxes have no runs."""
    frames = [(df.where("x0 < x1 and y0 < y1"), keys) for df, keys in frames]
    edges = None
    for df, _ in frames:
        own = df.select(F.col(key).alias("_page"), F.explode(F.array("y0", "y1")).alias("_y")).distinct()
        edges = own if edges is None else edges.unionByName(own)
    pages = edges.groupBy("_page").agg(F.sort_array(F.collect_set("_y")).alias("_edges"))
    out = []
    for df, keys in frames:
        # a box's own edges are among those of its page, so the cuts between them are a slice
        i, n = "array_position(_edges, y0)", "array_position(_edges, y1) - array_position(_edges, y0)"
        cut = F.expr(f"zip_with(slice(_edges, {i}, {n}), slice(_edges, {i} + 1, {n}), (a, b) -> struct(a AS y, b - a AS h))")
        rows = df.join(pages, F.col(key) == F.col("_page")).select(*keys, "x0", "x1", F.explode(cut).alias("_s"))
        out.append(rows.select(*keys, "_s.y", "_s.h", "x0", "x1"))
    return out


def weighted(runs: DataFrame) -> DataFrame:
    return runs if "h" in runs.columns else runs.withColumn("h", F.lit(1))


def union(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint runs of the union: runs that touch or overlap on a scanline become one (gaps and islands)."""
    line = W.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1))
    marked = weighted(runs).select(*keys, "y", "h", "x0", "x1", F.when(F.col("x0") > reach, 1).otherwise(0).alias("_new"))
    islands = marked.withColumn("_island", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "y", "_island").agg(F.min("h").alias("h"), F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of both masks: an equi-join on the scanline with the overlap as its residue. Disjoint inputs give disjoint runs."""
    x, y = weighted(a).alias("a"), b.alias("b")
    same = F.lit(True)
    for k in [*keys, "y"]:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    hit = same & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    return x.join(y, hit).select(*[F.col(f"a.{c}").alias(c) for c in weighted(a).columns if c not in ("x0", "x1")], F.greatest("a.x0", "b.x0").alias("x0"), F.least("a.x1", "b.x1").alias("x1"))


def area(runs: DataFrame, keys: list[str], name: str = "area") -> DataFrame:
    """keys, area: pixels of disjoint runs."""
    return weighted(runs).groupBy(*keys).agg(F.sum(((F.col("x1") - F.col("x0")) * F.col("h")).cast("long")).alias(name))


def bands(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, band, y0, y1: scanlines with ink, split where a scanline is missing."""
    order = W.partitionBy(*keys).orderBy("y")
    lines = weighted(runs).groupBy(*keys, "y").agg(F.max("h").alias("h"))
    reach = F.max(F.col("y") + F.col("h")).over(order.rowsBetween(W.unboundedPreceding, -1))
    found = lines.withColumn("_new", F.when(F.col("y") > reach, 1).otherwise(0)).withColumn("_i", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return found.groupBy(*keys, F.col("_i").alias("band")).agg(F.min("y").alias("y0"), F.max(F.col("y") + F.col("h")).alias("y1"))


def segments(runs: DataFrame, found: DataFrame, keys: list[str], share: float = 0.45) -> DataFrame:
    """keys, band, y0, y1, word, x0, x1: the words of each band, split where more than share of its height is blank."""
    b = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "band", "y0", "y1")
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    for k in keys:
        inside = inside & (F.col(k) == F.col(f"_{k}"))
    cols = runs.join(b, inside).select(*keys, "band", "y0", "y1", "x0", "x1").distinct()
    order = W.partitionBy(*keys, "band").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("x0") - (reach - 1) > (F.col("y1") - F.col("y0")) * F.lit(share), 1).otherwise(0)
    marked = cols.withColumn("_new", new).withColumn("word", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(*keys, "band", "y0", "y1", "word").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def difference_is_empty(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lost: pixels of the old mask that the new one lacks; a mask that only grows has none."""
    o, n = union(old, keys), union(new, keys)
    kept = area(intersect(o, n, keys), keys, "kept")
    return area(o, keys, "was").join(kept, keys, "left").select(*keys, (F.col("was") - F.coalesce("kept", F.lit(0))).alias("lost"))
