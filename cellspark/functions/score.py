"""Scores, labels and mappings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above them a cell is malignant.
THRESHOLD, GATE = 0.35, 1.5
#: The weights of the score.
WEIGHTS = {"area": 0.17, "circularity": 0.21, "rbf": 0.21, "packing": 0.17, "eccentricity": 0.24}


def finite(v: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def clamp01(v: Column) -> Column:
    """Into [0, 1]; 0 where not finite."""
    return F.when(finite(v), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).otherwise(0.0)


def area_component(ratio: Column) -> Column:
    """0 up to 1.08, then linear to 1 at 1.75."""
    return F.when(ratio <= 1.08, 0.0).otherwise(clamp01((ratio - 1.08) / (1.75 - 1.08)))


def circularity_component(c: Column) -> Column:
    """(0.75 - c) / 0.75 below 0.75."""
    return F.when(c >= 0.75, 0.0).otherwise(clamp01((F.lit(0.75) - c) / 0.75))


def rbf_component(v: Column) -> Column:
    """2.8 times the normalised field."""
    return clamp01(v * 2.8)


def packing_component(ratio: Column) -> Column:
    """1.15 (1 - ratio) below 1."""
    return F.when(ratio >= 1, 0.0).otherwise(clamp01((1 - ratio) * 1.15))


def malignancy(area_ratio: Column, circ: Column, rbf: Column, packing: Column, ecc: Column) -> Column:
    """The weighted score in [0, 1]."""
    w = WEIGHTS
    return clamp01(w["area"] * area_component(area_ratio) + w["circularity"] * circularity_component(circ) + w["rbf"] * rbf_component(rbf) + w["packing"] * packing_component(packing) + w["eccentricity"] * clamp01(ecc))


def label(flag: Column) -> Column:
    """Malignant or Normal."""
    return F.when(flag, "Malignant").otherwise("Normal")


def ratio_to(v: Column, median: Column) -> Column:
    """v over a slide median, 1 where the median is tiny."""
    return F.when(median > 1e-18, v / F.nullif(median, F.lit(0.0))).otherwise(1.0)


def area_gate(a: Column, median: Column) -> Column:
    """Single-precision test: area over 1.5 times a median that is not tiny."""
    return (median.cast("float") > F.lit(1e-6).cast("float")) & (a.cast("float") > F.lit(GATE).cast("float") * median.cast("float"))


def buckets(v: Column, edges: list[float], names: list[str]) -> Column:
    """The name of the first edge that v is below, else the last name."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(v < edge, name).otherwise(out)
    return out


def alignment(ratio: Column) -> Column:
    """Balanced within 0.02 of 1, else PhiLike or PiLike within 0.05, absolute or relative, else None."""
    near = lambda c: (F.abs(ratio - c) < 0.05) | (F.abs(ratio / c - 1) < 0.05)
    return F.when(F.abs(ratio - 1) < 0.02, "Balanced").when(near(1.618033988749895), "PhiLike").when(near(3.141592653589793), "PiLike").otherwise("None")


def quaternion(ecc: Column, circ: Column, kappa: Column, area: Column) -> Column:
    """Unit quaternion of a cell's shape."""
    e, c = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) for v in (ecc, circ))
    angle = 2 * F.pi() * kappa.cast("double")
    parts = {"w": (1 - e) * c, "x": F.cos(angle) * e, "y": F.sin(angle) * e, "z": F.least(F.lit(1.0), F.greatest(F.lit(-1.0), area / 10))}
    norm = F.greatest(F.sqrt(sum(v * v for v in parts.values())), F.lit(1e-18))
    return F.struct(*[(v / norm).alias(k) for k, v in parts.items()])


def geodesic(a: str, b: str) -> Column:
    """arccos |a . b| of two quaternions."""
    return F.expr(f"acos(least(1D, abs({a}.w * {b}.w + {a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z)))")
