"""Fields of a mesh to a layout of material, by a given model.

The contract of a model: it gets single-precision arrays of shape (n, 3, side, side), channels of 0 to 255 (both fields
scaled to bytes, the volume), and returns logits of shape (n, 2, h, w), background first. What does not fit gives a row
with an error instead of a layout: a mesh with gaps or doubled points, fields that are not finite, logits of another shape
or not finite."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 256
COLUMNS = ("py", "px", "dx", "dy", "volume")


def to_bytes(a: np.ndarray) -> np.ndarray:
    """Numbers as bytes over their range; 128 where they hardly differ."""
    lo, hi = a.min(), a.max()
    return np.full(a.shape, 128, np.uint8) if hi - lo < 1e-8 else ((a - lo) / (hi - lo) * 255).astype(np.uint8)


def resized(a: np.ndarray, side: int) -> np.ndarray:
    """A channel of bytes at another size: linear between the centres of pixels, over as many as one of the new covers."""

    def weights(n: int) -> np.ndarray:
        scale = n / side
        reach = max(1.0, scale)
        centre = (np.arange(side) + 0.5) * scale
        w = np.maximum(0, 1 - np.abs(np.arange(n) + 0.5 - centre[:, None]) / reach)
        return w / w.sum(1, keepdims=True)

    if a.shape == (side, side):
        return a
    wide = np.floor(a @ weights(a.shape[1]).T + 0.5)
    return np.floor(weights(a.shape[0]) @ wide + 0.5).astype(np.uint8)


def _mesh(y: np.ndarray, x: np.ndarray, *fields: np.ndarray) -> list[np.ndarray]:
    h, w = int(y.max()) + 1, int(x.max()) + 1
    if len(y) != h * w or len(np.unique(y * w + x)) != h * w or y.min() < 0 or x.min() < 0:
        raise ValueError(f"{len(y)} points are no mesh of {h} x {w}")
    out = []
    for f in fields:
        a = np.empty((h, w))
        a[y, x] = f
        if not np.isfinite(a).all():
            raise ValueError("a field is not finite")
        out.append(a)
    return out


def layouts(points: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], side: int = SIDE) -> DataFrame:
    """id, height, width, probability (row by row), binary, foreground (the share of material) and error of each mesh of
    ``points`` (id, py, px, dx, dy, volume). ``load`` runs once in each task and returns the model."""
    return mesh_layouts(points.groupBy("id").agg(*[F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))).alias(c) for c in COLUMNS]), load, side)  # one mesh


def mesh_layouts(meshes: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], side: int = SIDE) -> DataFrame:
    """``layouts`` of meshes whose points are lists already (id and COLUMNS, one mesh to a row): nothing is shuffled."""
    columns, kind = COLUMNS, meshes.schema["id"].dataType.simpleString()
    lists = meshes.select("id", *[F.transform(F.col(c).cast("array<double>"), lambda v: F.coalesce(v, F.lit(float("nan")))).alias(c) for c in columns])

    def run(batches):
        model = load()
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                try:
                    y, x, dx, dy, volume = (np.asarray(batch.column(c)[k].values) for c in columns)
                    if not (np.isfinite(y).all() and np.isfinite(x).all()):
                        raise ValueError("a point has no place")
                    dx, dy, volume = _mesh(y.astype(int), x.astype(int), dx, dy, volume)
                    share = np.full(dx.shape, int(min(1.0, max(0.0, volume[0, 0])) * 255), np.uint8)
                    tensor = np.stack([resized(c, side) for c in (to_bytes(dx), to_bytes(dy), share)]).astype(np.float32)[None]
                    logits = np.asarray(model(tensor), float)
                    if logits.ndim != 4 or logits.shape[:2] != (1, 2) or not np.isfinite(logits).all():
                        raise ValueError(f"a model must return finite logits of shape (1, 2, h, w), not {logits.shape}")
                    p = 1 / (1 + np.exp(logits[0, 0] - logits[0, 1]))
                    out.append((*p.shape, p.ravel(), (p > 0.5).astype(np.int8).ravel(), float((p > 0.5).mean()), None))
                except ValueError as e:
                    out.append((None, None, None, None, None, str(e)))
            h, w, p, b, share, error = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "height": pa.array(h, pa.int32()), "width": pa.array(w, pa.int32()), "probability": pa.array(p, pa.list_(pa.float64())), "binary": pa.array(b, pa.list_(pa.int8())),
                "foreground": pa.array(share, pa.float64()), "error": pa.array(error, pa.string()),
            })

    return lists.mapInArrow(run, f"id {kind}, height int, width int, probability array<double>, binary array<tinyint>, foreground double, error string")
