"""The flagship plan: rings to shape, neighbours, field, score, hull and label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, ring, score
from ..operators import spatial
from ..operators.checkpoints import cut


def shape(cells: DataFrame) -> DataFrame:
    """``cells`` (slide_id, cell_id, ring) with area, perimeter, circularity, centroid, eigenvalues and eccentricity."""
    out = cells.withColumns({"area": ring.area(), "perimeter": ring.perimeter()})
    cx, cy = ring.centroid()
    xx, yy, xy = ring.covariance()
    out = out.withColumns({"circularity": ring.circularity(F.col("area"), F.col("perimeter")), "centroid_x": cx, "centroid_y": cy, "_xx": xx, "_yy": yy, "_xy": xy})
    l1, l2 = ring.eigenvalues(F.col("_xx"), F.col("_yy"), F.col("_xy"))
    out = out.withColumns({"l1": l1, "l2": l2}).drop("_xx", "_yy", "_xy")
    return out.withColumn("eccentricity", ring.eccentricity(F.col("l1"), F.col("l2")))


def nodes(cells: DataFrame) -> DataFrame:
    """``shape`` with aspect ratio, Hu moments, solidity and convexity."""
    out = shape(cells).withColumns({"aspect_ratio": ring.aspect_ratio(F.col("l1"), F.col("l2")), "hu_moments": ring.hu_moments(), "_hull": kernels.hull_size_udf("ring")})
    solid = F.when(F.col("_hull.area") > 1e-18, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("area") / F.nullif(F.col("_hull.area"), F.lit(0.0))))).otherwise(0.0)
    convex = F.when(F.col("perimeter") > 1e-18, F.least(F.lit(1.0), F.col("_hull.perimeter") / F.nullif(F.col("perimeter"), F.lit(0.0)))).otherwise(0.0)
    return out.withColumns({"solidity": solid, "convexity": convex}).drop("_hull")


def medians(cells: DataFrame) -> DataFrame:
    """slide_id, n, med_area, med_knn and sigma: exact medians over finite values, sigma over positive ones."""
    area, knn = F.col("area"), F.col("knn_density")
    mid = lambda v, ok: F.percentile(F.when(ok, v), F.lit(0.5))
    return cells.groupBy("slide_id").agg(
        F.count("*").alias("n"), F.coalesce(mid(area, score.finite(area)), F.lit(0.0)).alias("med_area"), F.coalesce(mid(knn, score.finite(knn)), F.lit(0.0)).alias("med_knn"),
        F.greatest(F.coalesce(mid(knn, score.finite(knn) & (knn > 0)), F.lit(1.0)), F.lit(1e-9)).alias("sigma"),
    )


def scored(cells: DataFrame, k: int = spatial.K) -> DataFrame:
    """``shape`` with knn_density, the normalised field, score, area gate and label."""
    own = cut(shape(cells).drop("ring"))  # read by three plans below
    own = cut(spatial.knn_density(own, spatial.knn(own, k)))
    mids = medians(own)
    field = spatial.rbf_field(own, mids.select("slide_id", "sigma"))
    out = own.join(field, ["slide_id", "cell_id"]).join(mids, "slide_id")
    out = out.withColumn("rbf_risk_score", F.col("rbf") / F.greatest(F.col("n") - 1, F.lit(1)))
    out = out.withColumns({"area_ratio": score.ratio_to(F.col("area"), F.col("med_area")), "knn_ratio": score.ratio_to(F.col("knn_density"), F.col("med_knn"))})
    out = out.withColumn("score", score.malignancy(F.col("area_ratio"), F.col("circularity"), F.col("rbf_risk_score"), F.col("knn_ratio"), F.col("eccentricity")))
    gate = score.area_gate(F.col("area"), F.col("med_area"))
    return out.withColumn("area_gate", gate).withColumn("clinical", score.label((F.col("score") > score.THRESHOLD) | gate))


def hulls(points: DataFrame, parts: int = 32) -> DataFrame:
    """slide_id and the hull of its points (slide_id, x, y). Hulls of parts of a slide are taken first, then the hull of
    their corners: no task sees more than a part and the corners of the others."""

    def local(batches):
        held: dict = {}
        for batch in batches:
            slides = np.array(batch.column("slide_id").to_pylist(), object)
            xy = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
            for s in dict.fromkeys(slides.tolist()):
                own = xy[slides == s]
                held[s] = kernels.convex_hull(np.vstack((held[s], own)) if s in held else own)
        for s, h in held.items():
            yield pa.RecordBatch.from_pydict({"slide_id": pa.array([s] * len(h), pa.string()), "x": pa.array(h[:, 0]), "y": pa.array(h[:, 1])})

    schema = "slide_id string, x double, y double"
    some = points.select("slide_id", "x", "y").mapInArrow(local, schema)
    corners = some.repartition("slide_id").mapInArrow(local, schema)
    ordered = corners.groupBy("slide_id").agg(F.collect_list(F.struct("x", "y")).alias("hull"))  # corners only
    return ordered.withColumn("hull", kernels.hull_udf("hull"))


def enrich(cells: DataFrame, k: int = spatial.K) -> DataFrame:
    """``scored`` with distance_to_tumor_edge: the distance to the hull of the slide's malignant centroids, else 0."""
    out = scored(cells, k)
    bad = out.where("clinical = 'Malignant'").select("slide_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    out = out.join(hulls(bad), "slide_id", "left")
    d = ring.distance_to_polygon("centroid_x", "centroid_y")
    return out.withColumn("distance_to_tumor_edge", F.when(score.finite(d), d).otherwise(0.0)).drop("hull")
