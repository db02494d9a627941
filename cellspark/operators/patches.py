"""Patches of pixels around cells, and the models that read them.

The contract of a patch model: it gets single-precision arrays of shape (n, 3, side, side), channels r, g, b scaled to 0
to 1, and returns (n, width) numbers. Anything else is an error."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, WIDTH = 32, 16


def patches(pixels: DataFrame, cells: DataFrame, side: int = SIDE) -> DataFrame:
    """id, cell_id, patch: 3 * side * side numbers (channel, row, column), 0 outside the image.

    ``pixels``: id, y, x, r, g, b. ``cells``: id, cell_id, centroid_x, centroid_y; the patch starts half a side before the
    whole part of the centroid. Both meet in squares of ``side``, so a pixel goes to the cells near it only."""
    start = lambda c: F.col(c).cast("int") - side // 2
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / side), F.floor((F.col(c) + side - 1) / side)))
    own = cells.select("id", "cell_id", start("centroid_x").alias("_x"), start("centroid_y").alias("_y"))
    wide = own.withColumn("_gx", span("_x")).withColumn("_gy", span("_y"))
    placed = pixels.withColumns({"_gx": F.floor(F.col("x") / side), "_gy": F.floor(F.col("y") / side)})
    u, v = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    met = wide.join(placed, ["id", "_gx", "_gy"]).where(u.between(0, side - 1) & v.between(0, side - 1))
    at = (v * side + u).cast("int")
    some = met.select("id", "cell_id", at.alias("at"), *[F.col(c).cast("float").alias(c) for c in "rgb"])
    lists = own.select("id", "cell_id").join(some.groupBy("id", "cell_id").agg(*[F.collect_list(c).alias(c) for c in ("at", *"rgb")]), ["id", "cell_id"], "left")  # one patch
    kinds = {f.name: f.dataType.simpleString() for f in own.select("id", "cell_id").schema}

    def place(batches):
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((n, 3, side * side), np.float32)
            lengths = np.diff(batch.column("at").offsets.to_numpy())
            row, to = np.repeat(np.arange(n), lengths), batch.column("at").flatten().to_numpy(zero_copy_only=False)
            for k, c in enumerate("rgb"):
                out[row, k, to] = batch.column(c).flatten().to_numpy(zero_copy_only=False) / np.float32(255)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * 3 * side * side)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cell_id": batch.column("cell_id"), "patch": pa.ListArray.from_arrays(ends, pa.array(out.ravel()))})

    return lists.mapInArrow(place, f"id {kinds['id']}, cell_id {kinds['cell_id']}, patch array<float>")


def visual_features(rows: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """id, cell_id, features (``width`` numbers) of patches; ``load`` runs once in each task and returns the model."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.select("id", "cell_id").schema}

    def run(batches):
        model = load()
        for batch in batches:
            flat = batch.column("patch").flatten().to_numpy(zero_copy_only=False)
            if len(flat) != batch.num_rows * 3 * side * side:
                raise ValueError(f"patches must have {3 * side * side} numbers")
            out = np.asarray(model(flat.reshape(-1, 3, side, side).astype(np.float32)), float)
            if out.shape != (batch.num_rows, width):
                raise ValueError(f"a patch model must return ({batch.num_rows}, {width}), not {out.shape}")
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cell_id": batch.column("cell_id"), "features": pa.array(list(out), pa.list_(pa.float64()))})

    return rows.select("id", "cell_id", "patch").mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", features array<double>")


def cell_features(pixels: DataFrame, cells: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """id, cell_id, features of the patches around cells. Cells whose patches begin at the same pixel share one, which is
    cut out and read by the model once."""
    start = ["id", "_x", "_y"]
    own = cells.select("id", "cell_id", *[F.col(c).cast("int").alias(n) for c, n in (("centroid_x", "_x"), ("centroid_y", "_y"))])
    places = own.groupBy(start).agg(F.min("cell_id").alias("cell_id")).where("_x IS NOT NULL AND _y IS NOT NULL")
    read = visual_features(patches(pixels, places.select("id", "cell_id", F.col("_x").alias("centroid_x"), F.col("_y").alias("centroid_y")), side), load, side, width)
    named = places.join(read, ["id", "cell_id"]).drop("cell_id")
    return own.hint("merge").join(named, start).select("id", "cell_id", "features")
