"""The fusion classifier: shape, neighbours and the segmentation model's probability, scored by a tree ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score
from ..operators import ensemble, spatial
from ..operators.checkpoints import cut
from . import enrich

#: The features in their order.
NAMES = (
    "area_ratio", "circularity", "rbf_risk_score", "knn_ratio", "eccentricity", "solidity", "convexity", "aspect_ratio",
    "hu1", "hu2", "hu3", "hu4", "hu5", "hu6", "hu7", "neoplastic",
)


def fusion_features(cells: DataFrame, k: int = spatial.K) -> DataFrame:
    """slide_id, cell_id, centroid_x, centroid_y and the 16 features of ``cells`` (slide_id, cell_id, ring, neoplastic:
    the segmentation model's probability of a neoplastic cell at its centre)."""
    own = cut(enrich.nodes(cells))
    own = cut(spatial.knn_density(own, spatial.knn(own, k)))
    mids = enrich.medians(own)
    field = spatial.rbf_field(own, mids.select("slide_id", "sigma"))
    out = own.join(field, ["slide_id", "cell_id"]).join(mids, "slide_id")
    out = out.withColumns({
        "rbf_risk_score": F.col("rbf") / F.greatest(F.col("n") - 1, F.lit(1)), "area_ratio": score.ratio_to(F.col("area"), F.col("med_area")), "knn_ratio": score.ratio_to(F.col("knn_density"), F.col("med_knn")),
        **{f"hu{i + 1}": F.col("hu_moments")[i] for i in range(7)},
    })
    return out.select("slide_id", "cell_id", "centroid_x", "centroid_y", *NAMES)


def fusion(cells: DataFrame, trees: DataFrame, base: float = 0.0, rate: float = 1.0, over: float = 0.5) -> DataFrame:
    """slide_id, cell_id, cx, cy, probability and malignant of each cell, by a model over NAMES."""
    found = ensemble.classify(fusion_features(cells), list(NAMES), trees, base, rate, over)
    return found.select("slide_id", "cell_id", F.col("centroid_x").alias("cx"), F.col("centroid_y").alias("cy"), "probability", F.col("positive").alias("malignant"))
