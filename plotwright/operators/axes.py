"""Axis detection over tables of pixels: straight dark runs, the pair of axes, and the plot's box.

Axes are taken to lie along rows and columns of pixels, so lines are found as runs in them, exactly and
without sampling; tilted ones, where asked for, as runs along lines of whole degrees. All steps are grouped by image and line; an image's own pixels are the most that one
group holds. Pixels are shuffled once for each direction, summed up to runs, and meet their image's axis in windows, so no table of them is joined. What is joined is hinted to merge:
Spark takes a drawn table for as small as the one that it is drawn from, and would send it whole to the driver and to all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The share of a side that a line must span, of the longest line, and the refinement's reach.
LEAST, LONG, REACH = 0.35, 0.65, 8


def dark(pixels: DataFrame, threshold: float = 100.0) -> DataFrame:
    """``(image_id, x, y)`` of pixels whose rounded luma is at most ``threshold``, repeated ones as given; null channels aren't dark."""
    luma = F.bround(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    return pixels.where(luma <= threshold).select("image_id", "x", "y")


def otsu(gray: DataFrame) -> DataFrame:
    """``(image_id, threshold)``: the level that parts an image's ``gray(image_id, gray, n)`` counts into two classes of the largest variance between them, the first of equals."""
    up, every = Window.partitionBy("image_id").orderBy("gray").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("image_id")
    c = F.col
    rows = gray.withColumns({"w": F.sum("n").over(up), "s": F.sum(c("n") * c("gray")).over(up), "wt": F.sum("n").over(every), "st": F.sum(c("n") * c("gray")).over(every)})
    low, high = c("s") / c("w"), (c("st") - c("s")) / (c("wt") - c("w"))
    rows = rows.withColumn("between", F.when(c("wt") == c("w"), 0.0).otherwise(c("w") * (c("wt") - c("w")) * (low - high) * (low - high)))
    return rows.groupBy("image_id").agg(F.max_by("gray", F.struct("between", (-c("gray")).alias("first"))).alias("threshold"))


def dark_by_channel(images: DataFrame, pixels: DataFrame) -> DataFrame:
    """``(image_id, x, y)`` of pixels whose least channel is at most its image's Otsu level; pixels that ``images(image_id, width, height)`` has beyond those given are white."""
    least = pixels.select("image_id", "x", "y", F.least("r", "g", "b").cast("int").alias("gray")).dropDuplicates(["image_id", "x", "y"])
    counts = least.groupBy("image_id", "gray").agg(F.count("*").alias("n"))
    white = images.select("image_id", (F.col("width").cast("long") * F.col("height")).alias("all")).join(counts.groupBy("image_id").agg(F.sum("n").alias("given")), "image_id")
    white = white.select("image_id", F.lit(255).alias("gray"), (F.col("all") - F.col("given")).alias("n")).where("n > 0")
    counts = counts.unionByName(white).groupBy("image_id", "gray").agg(F.sum("n").alias("n"))
    return least.hint("merge").join(otsu(counts), "image_id").where("gray <= threshold").select("image_id", "x", "y")


def closed(dark: DataFrame) -> DataFrame:
    """``dark`` grown by one pixel all around and shrunk again: small holes and gaps are filled. Pixels beyond the image don't count as holes, so this may add a pixel beyond none."""
    around = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("p")
    grown = dark.select("image_id", around).select("image_id", "p.x", "p.y").distinct()
    return grown.select("image_id", around).select("image_id", "p.x", "p.y").groupBy("image_id", "x", "y").agg(F.count("*").alias("n")).where("n = 9").drop("n")


def tilted_runs(dark: DataFrame, along: str, across: str, most: int = 4, max_gap: int = 2) -> DataFrame:
    """``runs`` along lines that rise by up to ``most`` degrees either way, in whole degrees: ``(image_id, angle, pos, lo, hi)`` with the place in the line's middle. A pixel belongs to the two lines beside it, for each angle."""
    c = F.col
    slopes = F.explode(F.array(*[F.struct(F.lit(k).alias("angle"), F.lit(math.tan(math.radians(k))).alias("slope")) for k in range(-most, most + 1)])).alias("a")
    rows = dark.select("image_id", c(along).alias("t"), c(across).alias("v"), slopes).select("image_id", "a.angle", "a.slope", "t", F.explode(F.array(*[F.floor(c("v") - c("a.slope") * c("t")) + d for d in (0, 1)])).alias("line")).distinct()
    w = Window.partitionBy("image_id", "angle", "line").orderBy("t")
    rows = rows.withColumn("starts", F.coalesce((c("t") - F.lag("t").over(w) > max_gap).cast("int"), F.lit(1))).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("image_id", "angle", "slope", "line", "run").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return out.select("image_id", "angle", (c("line") + c("slope") * (c("lo") + c("hi")) / 2).alias("pos"), "lo", "hi")


def _joined(rows: DataFrame, lo: str, hi: str, max_gap: int) -> DataFrame:
    """``rows(image_id, pos, ...)`` from ``lo`` to ``hi``, none within another, grouped by ``run``: each is in the one before's if at most ``max_gap`` after it."""
    line = Window.partitionBy("image_id", "pos").orderBy(lo)
    starts = F.coalesce((F.col(lo) - F.lag(hi).over(line) > max_gap).cast("int"), F.lit(1))
    return rows.withColumn("starts", starts).withColumn("run", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy("image_id", "pos", "run")


def runs(dark: DataFrame, along: str, across: str, max_gap: int = 2) -> DataFrame:
    """``(image_id, pos, lo, hi, strokes)``: runs of dark pixels in each line, steps of up to ``max_gap`` pixels included, and their parts ``(start, end)`` without a gap. Repeated pixels count once."""
    rows = dark.select("image_id", F.col(across).alias("pos"), along)
    strokes = _joined(rows, along, along, 1).agg(F.min(along).alias("start"), F.max(along).alias("end")).drop("run")
    return _joined(strokes, "start", "end", max_gap).agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.collect_list(F.struct("start", "end")).alias("strokes")).drop("run")


def main_axis(images: DataFrame, dark: DataFrame, along: str, across: str, side: str, last: bool, tilt: int = 0) -> DataFrame:
    """``(image_id, pos, lo, hi, score, final)``: one line an image, of those that span the least share of their side.

    Among those not much shorter than the longest it is the lowest (``last``) or leftmost, then the longest, then the first.
    ``final`` is the line near it with most dark pixels in its extent, the first of equals. With ``tilt`` lines also
    count that rise by up to so many degrees.
    """
    c, image = F.col, Window.partitionBy("image_id")
    rows = runs(dark, along, across)
    if tilt:
        rows = rows.unionByName(tilted_runs(dark, along, across, tilt).where("angle <> 0").select("image_id", F.bround("pos").cast(rows.schema["pos"].dataType).alias("pos"), "lo", "hi"), allowMissingColumns=True)
    # an image's side comes as one more row of it
    rows = rows.unionByName(images.select("image_id", c(side).alias("side")), allowMissingColumns=True).withColumn("length", c("hi") - c("lo"))
    rows = rows.withColumns({"side": F.max("side").over(image), "longest": F.max("length").over(image)})
    fits = (c("length") > 0) & (c("length") >= LEAST * c("side")) & (c("length") >= LONG * c("longest"))
    rank = F.struct((-c("pos") if last else c("pos")).alias("first"), (-c("length")).alias("second"), c("lo"), c("hi"), c("pos"), F.least(F.lit(1.0), c("length") / F.greatest("side", F.lit(1))).alias("score"))
    near = rows.withColumn("axis", F.min(F.when(fits, rank)).over(image)).where(F.abs(c("pos") - c("axis.pos")) <= REACH)
    within = F.aggregate("strokes", F.lit(0).cast("long"), lambda n, s: n + F.greatest(F.lit(0), F.least(s["end"] + 1, c("axis.hi")) - F.greatest(s["start"], c("axis.lo"))))
    counted = near.groupBy("image_id", "pos").agg(F.sum(within).alias("n"), F.first("axis").alias("axis"))
    best = F.min(F.when(c("n") > 0, F.struct((-c("n")).alias("n"), c("pos").alias("at"))))
    return counted.groupBy("image_id").agg(F.first("axis").alias("axis"), best.alias("best")).select("image_id", *[c(f"axis.{k}").alias(k) for k in ("pos", "lo", "hi", "score")], F.coalesce("best.at", "axis.pos").alias("final"))


def detect_axes(images: DataFrame, pixels: DataFrame, threshold: float = 100.0, by_channel: bool = False, close: bool = False, tilt: int = 0) -> DataFrame:
    """One row for each of ``images(image_id, width, height)``: success, error, the plot's box, the axes' scores and confidence.

    Without a pair of axes success is false and the box null. ``pixels(image_id, x, y, r, g, b)`` needs only
    the dark ones. ``by_channel`` takes the least channel and Otsu's level in place of the threshold, ``close``
    fills small gaps first, and ``tilt`` allows for lines that rise by up to so many degrees.
    """
    spots = dark_by_channel(images, pixels) if by_channel else dark(pixels, threshold)
    spots = closed(spots) if close else spots
    h = main_axis(images, spots, "x", "y", "width", True, tilt)
    v = main_axis(images, spots, "y", "x", "height", False, tilt)
    rows = images.select("image_id", "width", "height")
    rows = rows.join(h.hint("merge").select("image_id", F.col("hi").alias("x_max"), F.col("final").alias("y_max"), F.col("score").alias("h_score")), "image_id", "left")
    rows = rows.join(v.hint("merge").select("image_id", F.col("final").alias("x_min"), F.col("lo").alias("y_min"), F.col("score").alias("v_score")), "image_id", "left")
    found = F.col("h_score").isNotNull() & F.col("v_score").isNotNull()
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min")) / F.greatest(F.col("width") * F.col("height"), F.lit(1))
    score = 0.75 * (F.col("h_score") + F.col("v_score")) / 2 + 0.25 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), area))
    shown = [F.when(found, F.col(c)).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")]
    return rows.select("image_id", found.alias("success"), F.when(~found, "No valid axis pair found").alias("error"), *shown, "h_score", "v_score", F.when(found, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("confidence"))
