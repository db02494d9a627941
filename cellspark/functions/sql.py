"""The row-local functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import ring

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"


def _area(r: str) -> str:
    return f"CASE WHEN size({r}) < 3 THEN 0D ELSE abs(0.5D * {ring.edges(r, 'a.x * b.y - b.x * a.y')}) END"


def _perimeter(r: str) -> str:
    return f"CASE WHEN size({r}) < 2 THEN 0D ELSE {ring.edges(r, 'sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))')} END"


def register(spark: SparkSession) -> list[str]:
    """Make ring_area, ring_perimeter, ring_circularity, ring_mean, ring_circle, clamp01 and malignancy_label functions
    of the session; they are SQL expressions, so plans stay in generated code."""
    functions = {
        "ring_area(ring " + RING + ") RETURNS DOUBLE": _area("ring"),
        "ring_perimeter(ring " + RING + ") RETURNS DOUBLE": _perimeter("ring"),
        "ring_circularity(area DOUBLE, perimeter DOUBLE) RETURNS DOUBLE": "CASE WHEN perimeter <= 1e-18D THEN 0D ELSE least(1D, 4 * pi() * area / (perimeter * perimeter)) END",
        "ring_mean(ring " + RING + ") RETURNS STRUCT<x: DOUBLE, y: DOUBLE>": "CASE WHEN size(ring) > 0 THEN " + "struct(" + ", ".join(f"{ring.total(f'transform(ring, p -> p.{c})')} / size(ring) AS {c}" for c in "xy") + ") END",
        "ring_circle(cx DOUBLE, cy DOUBLE, r DOUBLE) RETURNS " + RING: "transform(sequence(0, 127), i -> struct(cx + r * cos(2 * pi() * i / 128) AS x, cy + r * sin(2 * pi() * i / 128) AS y))",
        "clamp01(v DOUBLE) RETURNS DOUBLE": "CASE WHEN v IS NULL OR isnan(v) OR abs(v) = double('Infinity') THEN 0D ELSE greatest(0D, least(1D, v)) END",
        "malignancy_label(score DOUBLE) RETURNS STRING": "CASE WHEN score > 0.35D THEN 'Malignant' ELSE 'Normal' END",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in functions]
