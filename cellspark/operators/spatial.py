"""Spatial joins within slides.

Neighbours are found over leaves that follow the cells' density (neighbours.py). Gaussian fields meet in squares of REACH sigma: what lies further away adds less than the last bit of
one term (exp(-REACH**2 / 2) is under 1e-16). Squares of few places meet place by place, those of more than DENSE by
their moments (dense.py), so the cost grows with the cells, not with their pairs, however wide sigma is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dense, neighbours
from .checkpoints import cut

K = 8
REACH = 8.7
DENSE = 1024


def _points(cells: DataFrame) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return cells.select("slide_id", "cell_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")).where(ok("centroid_x") & ok("centroid_y"))


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        a.select("slide_id", F.col("cell_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), *[c for c in a.columns if c.startswith("_")]),
        b.select("slide_id", F.col("cell_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), *[c for c in b.columns if c.startswith("_")]),
    )


def _d2() -> Column:
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return dx * dx + dy * dy


def knn(cells: DataFrame, k: int = K, leaf: int = neighbours.LEAF) -> DataFrame:
    """Directed edges (slide_id, src, dst, rank, d) to the min(k, n - 1) nearest other cells of the slide.

    ``cells`` has slide_id, cell_id, centroid_x, centroid_y; rows without finite centroids take no part. ``leaf`` is the
    most cells that one kernel compares with each other."""
    found = neighbours.nearest_neighbours(_points(cells), k, leaf)
    return found.select("slide_id", "src", "dst", F.col("rank").cast("int").alias("rank"), F.sqrt("d2").alias("d"))


def knn_density(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """``cells`` with knn_density: mean distance to the neighbours, 0 without any."""
    mean = edges.groupBy("slide_id", F.col("src").alias("cell_id")).agg(F.avg("d").alias("knn_density"))
    return cells.hint("merge").join(mean, ["slide_id", "cell_id"], "left").withColumn("knn_density", F.coalesce("knn_density", F.lit(0.0)))


def _squares(p: DataFrame, x: str, y: str, side: str, around: int) -> DataFrame:
    """``p`` with the square (_gx, _gy) of each point, or all within ``around`` squares of it."""
    at = lambda c: F.floor(F.col(c) / F.col(side))
    if not around:
        return p.withColumns({"_gx": at(x), "_gy": at(y)})
    spread = lambda c: F.explode(F.sequence(at(c) - around, at(c) + around))
    return p.withColumn("_gx", spread(x)).withColumn("_gy", spread(y))


def _short(side: Column) -> Column:
    """``side`` rounded up to 21 binary digits, so that its multiples are exact."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(side)) - 20)
    return F.when(side < 1e300, F.ceil(side / unit) * unit).otherwise(side)


def rbf_field(cells: DataFrame, sigma: DataFrame | float, first: int | None = None, most: int = DENSE) -> DataFrame:
    """slide_id, cell_id, rbf: sum over the other cells of exp(-d2 / (2 sigma^2)), sigma at least 1e-12.

    ``sigma`` is one number or (slide_id, sigma); ``first`` limits the sources to so many cells of each
    slide, by id; a task passes on no more of a slide than that. Places meet, with the number of their cells as weight, so
    cells in one place cost no more than one; squares of more than ``most`` places act by their moments (dense.py)."""
    p, place = _points(cells), ["slide_id", "x", "y"]
    weights, last = p.groupBy(place).agg(F.count("*").alias("_n")), None
    if first is not None:
        rank = F.row_number().over(Window.partitionBy("slide_id").orderBy("cell_id"))
        sources = p.withColumn("_rank", rank).where(F.col("_rank") <= first).drop("_rank")
        last = sources.groupBy("slide_id").agg(F.max("cell_id").alias("_last"))
        weights = weights.drop("_n").join(sources.groupBy(place).agg(F.count("*").alias("_n")), place, "left")

    t = weights.withColumn("sigma", F.lit(sigma)) if isinstance(sigma, float) else weights.join(sigma, "slide_id")
    t = t.withColumn("_sigma", F.greatest("sigma", F.lit(1e-12))).withColumn("_side", _short(F.col("_sigma") * REACH))
    held = cut(_squares(t, "x", "y", "_side", 0).select(*place, "_n", "_sigma", "_side", "_gx", "_gy"))  # read by all plans below
    square, sources = ["slide_id", "_gx", "_gy"], held.where("_n > 0")
    exact = (F.col("_side") < 1e300) & (F.abs("_gx") < 1 << 32) & (F.abs("_gy") < 1 << 32)
    full = sources.where(exact).groupBy(square).count().where(F.col("count") > most).select(square)
    far = None
    if full.head(1):
        full = cut(full)
        far = dense.sums(sources.join(full, square, "left_semi"), held).select(*place, F.col("value").alias("_far"), F.lit(0).cast("long").alias("_here"))
        sources = sources.join(full, square, "left_anti")

    a = held.select("slide_id", F.col("x").alias("ax"), F.col("y").alias("ay"), "_sigma", "_gx", "_gy")
    b = _squares(sources, "x", "y", "_side", 1).select("slide_id", F.col("x").alias("bx"), F.col("y").alias("by"), "_n", "_gx", "_gy")
    same = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
    term = F.when(~same, F.col("_n") * F.exp(-_d2() / (2 * F.col("_sigma") * F.col("_sigma")))).otherwise(0.0)
    sums = a.join(b, ["slide_id", "_gx", "_gy"]).groupBy("slide_id", F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.sum(term).alias("_far"), F.sum(F.when(same, F.col("_n")).otherwise(0)).alias("_here"))
    if far is not None:
        sums = sums.unionByName(far).groupBy(place).agg(F.sum("_far").alias("_far"), F.sum("_here").alias("_here"))
    own = cells.select("slide_id", "cell_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")).hint("merge").join(sums, place, "left")
    itself = F.lit(1)
    if last is not None:
        own, itself = own.join(last, "slide_id", "left"), (F.col("cell_id") <= F.col("_last")).cast("int")
    value = F.col("_far") + (F.col("_here") - itself)
    return own.select("slide_id", "cell_id", F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)).alias("rbf"))


def surface(cells: DataFrame, resolution: int, sigma: float = 1.0) -> DataFrame:
    """Field at the centres of a resolution x resolution grid over each slide's bounding box: slide_id, i, j, value."""
    p = _points(cells).withColumn("_side", F.lit(sigma * REACH))
    box = p.groupBy("slide_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    axis = F.sequence(F.lit(0), F.lit(resolution - 1))
    grid = box.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis)).withColumn("_side", F.lit(sigma * REACH))
    grid = grid.withColumns({"gx": F.col("x0") + (F.col("i") + 0.5) * (F.col("x1") - F.col("x0")) / resolution, "gy": F.col("y0") + (F.col("j") + 0.5) * (F.col("y1") - F.col("y0")) / resolution})
    dx, dy = F.col("gx") - F.col("x"), F.col("gy") - F.col("y")
    near = _squares(grid, "gx", "gy", "_side", 1).join(_squares(p, "x", "y", "_side", 0).drop("_side"), ["slide_id", "_gx", "_gy"])
    sums = near.groupBy("slide_id", "i", "j").agg(F.sum(F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))).alias("value"))
    return grid.select("slide_id", "i", "j").join(sums, ["slide_id", "i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def density_ratios(cells: DataFrame, edges: DataFrame, value: str = "area") -> DataFrame:
    """Edges with ratio, log_ratio and alignment of max(value, 1e-12) at both ends; ratios that are not positive go."""
    from ..functions.score import alignment

    v = cells.select("slide_id", "cell_id", F.greatest(F.col(value), F.lit(1e-12)).alias("v"))
    a, b = v.toDF("slide_id", "src", "va"), v.toDF("slide_id", "dst", "vb")
    out = edges.join(a, ["slide_id", "src"]).join(b, ["slide_id", "dst"]).withColumn("ratio", F.col("va") / F.nullif(F.col("vb"), F.lit(0.0)))
    out = out.where((F.col("ratio") > 0) & (F.col("ratio") < float("inf")))
    return out.select("slide_id", "src", "dst", "ratio", F.ln("ratio").alias("log_ratio"), alignment(F.col("ratio")).alias("alignment"))


def ratio_summary(edges: DataFrame) -> DataFrame:
    """Count, mean, deviation and shares of the alignments, by slide."""
    n = lambda name: F.count_if(F.col("alignment") == name)
    return edges.groupBy("slide_id").agg(
        F.count("*").alias("n_edges"), F.avg("ratio").alias("mean_ratio"), F.stddev_pop("ratio").alias("std_ratio"), n("PhiLike").alias("phi_like"), n("PiLike").alias("pi_like"),
        n("Balanced").alias("balanced"), (F.count_if(F.col("alignment") != "None") / F.count("*")).alias("alignment_fraction"),
    )


def project(cells: DataFrame, instances: DataFrame, most: float = 64.0, least_iou: float = 0.05) -> DataFrame:
    """Labels of instances on cells: each instance goes to the nearest centroid within ``most``, else to the box with
    the best overlap of at least ``least_iou``; a cell takes its most confident instance, later ones first.

    ``cells``: slide_id, cell_id, centroid_x, centroid_y, box. ``instances``: slide_id, inst_id, x, y, box, label,
    confidence. The distance join meets in squares of side ``most``, and so does the box join of what is left, in all
    squares that a box touches. Only different places and different boxes meet."""
    from ..functions.ring import iou

    square = lambda x, y: (F.floor(F.col(x) / most), F.floor(F.col(y) / most))
    # Cells in one place compare alike: the one of the least id stands for them. So do instances.
    gx, gy = square("x", "y")
    spots = instances.select("slide_id", "x", "y").distinct()
    wide = spots.withColumn("_gx", F.explode(F.sequence(gx - 1, gx + 1))).withColumn("_gy", F.explode(F.sequence(gy - 1, gy + 1)))
    gx, gy = square("centroid_x", "centroid_y")
    c1 = cells.groupBy("slide_id", "centroid_x", "centroid_y").agg(F.min("cell_id").alias("cell_id")).withColumns({"_gx": gx, "_gy": gy})
    d2 = (F.col("x") - F.col("centroid_x")) ** 2 + (F.col("y") - F.col("centroid_y")) ** 2
    near = wide.join(c1, ["slide_id", "_gx", "_gy"]).withColumn("d2", d2).where(F.col("d2") <= most * most).groupBy("slide_id", "x", "y").agg(F.min(F.struct("d2", "cell_id")).alias("m")).select("slide_id", "x", "y", F.col("m.cell_id").alias("cell_id"))
    near = instances.hint("merge").join(near, ["slide_id", "x", "y"], "left")

    edges = [f"box.{c}" for c in ("x0", "y0", "x1", "y1")]
    flat = lambda t, p: t.select("*", *[F.col(f"{p}.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    corners, box = ["_x0", "_y0", "_x1", "_y1"], lambda: F.struct(*[F.col(f"_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    span = lambda b, lo, hi: F.explode(F.sequence(F.floor(F.col(f"{b}.{lo}") / most), F.floor(F.col(f"{b}.{hi}") / most)))
    touched = lambda t, b: t.withColumn("_gx", span(b, "x0", "x1")).withColumn("_gy", span(b, "y0", "y1"))
    left = flat(near.where("cell_id IS NULL").drop("cell_id"), "box")
    asked = left.groupBy("slide_id", *corners).agg(F.lit(1).alias("_one")).select("slide_id", box().alias("box"))
    held = flat(cells, "box").groupBy("slide_id", *corners).agg(F.min("cell_id").alias("cell_id")).select("slide_id", "cell_id", box().alias("cell_box"))
    over = touched(asked, "box").join(touched(held, "cell_box"), ["slide_id", "_gx", "_gy"]).withColumn("iou", iou("box", "cell_box")).where(F.col("iou") >= least_iou)
    over = over.groupBy("slide_id", *[F.col(e).alias(c) for e, c in zip(edges, corners, strict=True)]).agg(F.max(F.struct("iou", -F.col("cell_id"), "cell_id")).alias("m")).select("slide_id", *corners, F.col("m.cell_id").alias("cell_id"))
    columns = ["slide_id", "cell_id", "confidence", "inst_id", "label"]
    hit = near.where("cell_id IS NOT NULL").select(columns).union(left.hint("merge").join(over, ["slide_id", *corners]).select(columns))
    best = hit.groupBy("slide_id", "cell_id").agg(F.max(F.struct("confidence", "inst_id", "label")).alias("m")).select("slide_id", "cell_id", F.col("m.label").alias("label"), F.col("m.confidence").alias("confidence"))
    return cells.select("slide_id", "cell_id").hint("merge").join(best, ["slide_id", "cell_id"], "left").select("slide_id", "cell_id", F.coalesce("label", F.lit("Stromal")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
