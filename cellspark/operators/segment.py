"""Segmentation of large images in overlapping tiles by a model that is given.

The contract of a segmentation model: it gets one tile as an array (height, width, 3) of bytes and returns polygons, each
an array of (x, y) rows in the tile's pixels. Tiles overlap, so an object at an edge is whole in some tile; of what several
tiles found of one object the largest polygon is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ring
from . import choice, ordered
from .checkpoints import cut

POLYGON = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def tile_pixels(pixels: DataFrame, images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """id, x0, y0, w, h, data: the bytes r, g, b of each tile in row order. ``pixels``: id, y, x, r, g, b; ``images``: id,
    width, height. A pixel meets the tiles of its own square only; a missing pixel is black."""
    tiles = ordered.tiles(images, tile, overlap)
    span = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(a) + F.col(n) - 1) / tile)))
    wide = tiles.withColumn("_gx", span("x0", "w")).withColumn("_gy", span("y0", "h"))
    placed = pixels.withColumns({"_gx": F.floor(F.col("x") / tile), "_gy": F.floor(F.col("y") / tile)})
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("h"))
    place = ((F.col("y") - F.col("y0")) * F.col("w") + F.col("x") - F.col("x0")).cast("int")
    met = wide.join(placed, ["id", "_gx", "_gy"]).where(inside)
    one = F.struct(place.alias("k"), *[F.col(c).cast("int").alias(c) for c in "rgb"])
    return met.groupBy("id", "x0", "y0", "w", "h").agg(F.collect_list(one).alias("data"))  # one tile


def segments(pixels: DataFrame, images: DataFrame, load: Callable[[], Callable[[np.ndarray], Iterable[np.ndarray]]], tile: int = 512, overlap: int = 64, apart: float = 12.0) -> DataFrame:
    """id, cell_id, area, centroid_x, centroid_y, ring of the objects of images; ``load`` runs once in each task."""
    kind = pixels.schema["id"].dataType.simpleString()

    def run(batches):
        model = load()
        for batch in batches:
            out = []
            for own, x0, y0, w, h, data in zip(*(batch.column(c) for c in ("id", "x0", "y0", "w", "h", "data")), strict=True):
                at = data.values
                image = np.zeros((h.as_py() * w.as_py(), 3), np.uint8)
                image[at.field("k").to_numpy()] = np.stack([at.field(c).to_numpy() for c in "rgb"], 1)
                for polygon in model(image.reshape(h.as_py(), w.as_py(), 3)):
                    p = np.asarray(polygon, float)
                    if p.ndim != 2 or p.shape[1] != 2:
                        raise ValueError(f"a segmentation model must return rows of (x, y), not {p.shape}")
                    if len(p) > 2:
                        out.append((own.as_py(), [{"x": x, "y": y} for x, y in (p + (x0.as_py(), y0.as_py())).tolist()]))
            ids, rings = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, batch.schema.field("id").type), "ring": pa.array(rings, POLYGON)})

    found = tile_pixels(pixels, images, tile, overlap).mapInArrow(run, f"id {kind}, ring array<struct<x:double,y:double>>").distinct()
    x, y = ring.centroid()
    shaped = found.select("id", "ring", ring.area().alias("area"), x.alias("centroid_x"), y.alias("centroid_y"))
    cells = cut(shaped.withColumns({"slide_id": F.col("id").cast("string"), "cell_id": F.xxhash64("id", "ring")}))
    kept = choice.dedupe_by_distance(cells, apart)
    return cells.join(kept, ["slide_id", "cell_id"], "left_semi").select("id", "cell_id", "area", "centroid_x", "centroid_y", "ring")
