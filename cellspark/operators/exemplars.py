"""Example boxes for prompting a segmentation model: around stain peaks (label 1) and in pale places (label 0).

Images are rows (id, y, x, h). Blurs and neighbourhood maxima are separable, so each is two passes of window frames along
the rows and the columns of an image; edges are mirrored by rows that stand for them. Peaks are thinned by the shared
greedy operators of ``graph``; of the pale places only a few are wanted, each chosen in a round of its own.

Flat images (standard deviation under FLAT) and images without a peak have no boxes. Ties go to the upper, then to the
left pixel."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ring import iou
from . import choice
from .checkpoints import cut

#: Of peaks and boxes.
FLAT, PEAK_SIGMA, PALE_SIGMA = 0.02, 1.0, 2.0
PEAK_SHARE, PALE_SHARE = 0.70, 0.25
LEAST_APART, APART_OF_HALF = 5, 0.45
FAR_OF_HALF, LEAST_FAR = 2.5, 12.0
MOST_OVERLAP, MOST_PALE_OVERLAP, LEAST_SIDE = 0.3, 0.2, 4
MOST_PEAKS, MOST_PALE, HALF = 80, 4, 14


def _along(pixels: DataFrame, axis: str, value: str, sigma: float) -> DataFrame:
    """One pass of a Gaussian blur along an axis, edges mirrored."""
    other, reach = ("y" if axis == "x" else "x"), int(4 * sigma + 0.5)
    weight = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    last = F.max(axis).over(Window.partitionBy("id"))
    at = F.col(axis)
    places = F.array(at, F.when(at < reach, -1 - at), F.when(F.col("_last") - at < reach, 2 * F.col("_last") + 1 - at))
    wide = pixels.withColumn("_last", last).withColumn("_at", F.explode(F.array_compact(places)))
    line = Window.partitionBy("id", other).orderBy("_at")
    shifted = [F.lag(value, -k).over(line) if k < 0 else F.lead(value, k).over(line) for k in range(-reach, reach + 1)]
    # an image narrower than the reach has no mirrored pixel so far out; what is there is weighed alone
    total = sum(F.coalesce(w * v, F.lit(0.0)) for w, v in zip(weight, shifted, strict=True))
    share = sum(F.when(v.isNull(), 0.0).otherwise(w) for w, v in zip(weight, shifted, strict=True))
    return wide.withColumn(value, total / share).where(F.col("_at") == at).drop("_at", "_last")


def blurred(pixels: DataFrame, value: str, sigma: float) -> DataFrame:
    """``pixels`` with ``value`` blurred."""
    return reduce(lambda p, axis: _along(p, axis, value, sigma), ("x", "y"), pixels)


def peaks(pixels: DataFrame, apart: int, share: float = PEAK_SHARE) -> DataFrame:
    """id, x, y, v: local maxima of the blurred map at or above a percentile, the highest first, ``apart`` from others."""
    b = cut(blurred(pixels.select("id", "y", "x", F.col("h").alias("v")), "v", PEAK_SIGMA))
    size = max(3, 2 * apart + 1) // 2
    row, column = (Window.partitionBy("id", p).orderBy(o).rangeBetween(-size, size) for p, o in (("y", "x"), ("x", "y")))
    tops = b.withColumn("_m", F.max("v").over(row)).withColumn("_m", F.max("_m").over(column))
    level = b.groupBy("id").agg(F.percentile("v", share).alias("_level"))
    found = tops.join(level, "id").where((F.col("v") >= F.col("_level")) & (F.col("v") == F.col("_m")))
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("v"), "y", "x"))  # of the maxima of one image
    cells = found.select(F.col("id").cast("string").alias("slide_id"), order.cast("long").alias("cell_id"), "id", "v", F.col("x").cast("double").alias("centroid_x"), F.col("y").cast("double").alias("centroid_y"))
    cells = cut(cells.withColumn("area", -F.col("cell_id").cast("double")))
    kept = choice.dedupe_by_distance(cells, float(apart))
    return cells.join(kept, ["slide_id", "cell_id"], "left_semi").select("id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), "v", F.col("cell_id").alias("order"))


def _boxed(points: DataFrame, sizes: DataFrame, half: float) -> DataFrame:
    """``points`` with the box around each, inside the image."""
    p, end = points.join(sizes, "id"), lambda c, last: F.least(F.col(last).cast("double"), F.col(c) + half)
    return p.withColumns({"x0": F.greatest(F.lit(0.0), F.col("x") - half), "y0": F.greatest(F.lit(0.0), F.col("y") - half), "x1": end("x", "_x"), "y1": end("y", "_y")}).drop("_x", "_y")


def boxes(pixels: DataFrame, half: float = HALF, most: int = MOST_PEAKS, pale: int = MOST_PALE, overlap: float = MOST_OVERLAP) -> DataFrame:
    """id, x0, y0, x1, y1, label of each image of ``pixels`` (id, y, x, h)."""
    stats = pixels.groupBy("id").agg(F.stddev_pop("h").alias("_s"), F.max("x").alias("_x"), F.max("y").alias("_y"))
    sizes = cut(stats.where(F.col("_s") >= FLAT).select("id", "_x", "_y"))  # one row an image
    pixels = pixels.join(sizes.select("id"), "id", "left_semi")
    corners = ["x0", "y0", "x1", "y1"]
    around = cut(_boxed(peaks(pixels, max(LEAST_APART, int(half * APART_OF_HALF))), sizes, half))
    kept = choice.suppress(around.select(F.col("id").cast("string").alias("group"), F.col("order").alias("id"), *corners, F.col("v").alias("score")), overlap)
    best = around.withColumn("group", F.col("id").cast("string")).join(kept.withColumnRenamed("id", "order"), ["group", "order"], "left_semi").drop("group")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("order"))
    good = cut(best.withColumn("_i", rank).where(F.col("_i") <= most).select("id", "x", "y", *corners))  # ``most`` an image

    low = blurred(pixels.select("id", "y", "x", F.col("h").alias("v")), "v", PALE_SIGMA)
    low = low.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    low = cut(low)
    level = low.groupBy("id").agg(F.percentile("v", PALE_SHARE).alias("_level"))
    places = low.join(level, "id").where(F.col("v") <= F.col("_level")).join(good.select("id").distinct(), "id", "left_semi")
    far = max(half * FAR_OF_HALF, LEAST_FAR) ** 2
    centres = good.select("id", F.col("x").alias("_cx"), F.col("y").alias("_cy"))
    near = (F.col("x") - F.col("_cx")) ** 2 + (F.col("y") - F.col("_cy")) ** 2 < far
    apart = places.join(centres.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & near, "left_anti")
    open_ = _boxed(apart, sizes, half).where((F.col("x1") - F.col("x0") >= LEAST_SIDE) & (F.col("y1") - F.col("y0") >= LEAST_SIDE))
    open_ = cut(open_.select("id", "v", "y", "x", F.struct(*corners).alias("box")))
    chosen = []
    for _ in range(pale):
        best = open_.groupBy("id").agg(F.min(F.struct("v", "y", "x", "box")).alias("m")).select("id", F.col("m.box").alias("taken"))
        chosen.append(cut(best))
        open_ = cut(open_.join(chosen[-1], "id").where(iou("box", "taken") <= MOST_PALE_OVERLAP).drop("taken"))
    out = good.select("id", *corners, F.lit(1).alias("label"))
    return reduce(DataFrame.union, [c.select("id", "taken.*", F.lit(0).alias("label")) for c in chosen], out)
