"""What failed at size: pixels as rows where runs do, shuffles of what one row can tell, ties of printed digits."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from cellspark.functions import imaging
from cellspark.operators import patches
from cellspark.sources import exports


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fields_are_not_shuffled(spark):
    cases = spark.createDataFrame([(1, 0.5, 3, 4, 2.0, 1), (2, 2.0, 0, 0, 0.0, 0)], "id long, vf double, x int, y int, load double, complexity int")
    out = imaging.fields(cases, 4)
    assert "Exchange" not in plan(out)
    assert {(r.id, round(r.top, 6)) for r in out.groupBy("id").agg(F.max("strain").alias("top")).collect()} == {(1, 1.0), (2, 1.0)}
    lists = imaging.field_lists(cases, 4)
    each = lists.select("id", F.explode(F.arrays_zip("py", "px", "strain", "volume", "load")).alias("e")).select("id", "e.*")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, out.collect()))


def test_runs_of_rings(spark):
    points = "array<struct<x:double,y:double>>"
    star = [(2.0, -1.5), (9.5, 3.25), (0.25, 7.0), (6.0, 9.75), (4.5, -2.0)]  # crosses itself
    rows = [("s", 1, star), ("s", 2, None), ("s", 3, []), ("s", 4, [(float("nan"), 0.0), (5.0, 5.0), (0.0, 5.0)]), ("s", 5, [(x + 3, y) for x, y in star])]
    cells = spark.createDataFrame(rows, f"slide_id string, cell_id long, ring {points}")
    got = {(r.cell_id, r.px, r.py) for r in imaging.rasterized(cells).collect()}
    runs = imaging.raster_runs(cells, most=3)
    assert {(r.cell_id, x, r.py) for r in runs.collect() for x in range(r.x0, r.x1)} == got

    def inside(ring, x, y):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    assert got == {(c, x, y) for _, c, ring in rows if c in (1, 5) for x in range(-3, 16) for y in range(-3, 12) if inside(ring, x + 0.5, y + 0.5)}


def test_contours_from_runs(spark):
    runs = spark.createDataFrame([("s", 1, 0, 0, 4), ("s", 1, 1, 1, 3), ("s", 1, 2, 0, 2), ("s", 2, 0, 0, 9)], "slide_id string, inst long, py int, x0 int, x1 int")
    pixels = runs.select("slide_id", "inst", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("px"), "py")
    assert imaging.contours(runs).collect() == imaging.contours(pixels).collect()


def test_equal_patches_are_read_once(spark):
    pixels = spark.range(16).select(F.lit(1).alias("id"), F.expr("int(id div 4)").alias("y"), F.expr("int(id % 4)").alias("x"), *[F.lit(255).alias(c) for c in "rgb"])
    cells = spark.range(50).select(F.lit(1).alias("id"), F.col("id").alias("cell_id"), (F.col("id") % 2 + 1.5).alias("centroid_x"), F.lit(2.0).alias("centroid_y"))

    def load():
        def model(batch):
            return np.full((len(batch), 1), float(batch.sum())) / len(batch) + len(batch) * 1000

        return model

    got = {r.cell_id: r.features[0] for r in patches.cell_features(pixels.coalesce(1), cells, load, 4, 1).collect()}
    assert len(got) == 50 and max(got.values()) < 3000  # a batch of two patches at most


def test_digits_of_ties_are_even(spark):
    ring = [(0.0078125, 0.0234375), (-0.0078125, 1.0), (2.5, float("inf"))]
    rows = spark.createDataFrame([("a", 0, ring)], "path string, source_index int, ring array<struct<x:double,y:double>>")
    text = "0.007812,0.023438;-0.007812,1.000000;2.500000,inf;"
    assert exports.coordinate_digests(rows).first().digest == hashlib.sha256(text.encode()).hexdigest()


def test_hulls_of_many_points():
    import time

    from cellspark.functions import kernels

    draw = np.random.default_rng(3)
    t = np.linspace(-1, 1, 500)
    sets = [draw.integers(0, m, (n, 2)).astype(float) for m in (1, 2, 3, 9, 100) for n in (1, 2, 3, 5, 40, 300)]
    sets += [np.stack((t, t * t), 1), np.stack((t, -t * t), 1), np.vstack((np.stack((t, t * t), 1), [[2.0, -900.0]])), np.vstack((np.stack((t, -t * t), 1), [[-2.0, 900.0]])), draw.normal(size=(400, 2))]
    for p in sets:
        index, size = kernels.hulls(p[None])
        want = p[index[0, : size[0]]]
        assert np.array_equal(kernels.convex_hull(p), want)
    began = time.perf_counter()
    kernels.convex_hull(draw.normal(size=(200_000, 2)))
    assert time.perf_counter() - began < 2


def test_small_ranges_are_put_together(tmp_path):
    from cellspark.sources import matrices

    for name, n in (("a", 30_000), ("b", 7)):
        np.arange(n * 2, dtype="<f4").tofile(tmp_path / f"{name}.raw")
    reader = matrices.SlabReader({"path": str(tmp_path), "dims": "2", "rows": "1", "splitBytes": "8"})
    ranges = reader.partitions()
    assert len(ranges) <= matrices.TASKS + 2
    assert [r.first + i for r in ranges if r.path.endswith("a.raw") for i in range(r.n)] == list(range(30_000)) and sum(r.n for r in ranges) == 30_007
    assert len(matrices.SlabReader({"path": str(tmp_path / "b.raw"), "dims": "2", "rows": "1", "splitBytes": "8"}).partitions()) == 7


def test_envelopes_are_parsed_once(spark):
    from cellspark.sources import annotations

    rows = annotations.segment_cells(spark.createDataFrame([("s", '{"cell_count": 1, "cells": [[[0, 0], [1, 0], [1, 1]]]}')], "slide_id string, json string"))
    assert plan(rows).count("from_json") == 1 and len(rows.first().ring) == 3


def test_rings_of_parts_are_made_by_all_cores(spark, sf_dir):
    from cellspark.sources import fixtures

    assert fixtures.cells_parts(spark, sf_dir).rdd.getNumPartitions() > 4


def test_pairs_of_a_slide_are_dealt_to_tasks(spark, monkeypatch):
    from cellspark.operators import graph

    draw = np.random.default_rng(5)
    rows = [(s, i // 2 if s == "t" else i, [float(x) for x in draw.normal(size=3)], rank) for s, n, rank in (("s", 90, 2), ("t", 7, 3), ("u", 1, 1), ("v", 4, 0)) for i in range(n)]
    rows += [("s", 900, [float("nan")] * 3, 2), ("s", None, [0.0] * 3, 2), (None, 1, [0.0] * 3, 2), (None, 2, [0.0] * 3, 2), ("s", 901, [None, 0.0, 0.0], 2), ("w", 1, [0.5], 3), ("w", 2, [0.1], 3)]
    cells = spark.createDataFrame(rows, "slide_id string, cell_id long, u array<double>, rank90 int")
    good = [r for r in rows if r[0] and r[1] is not None and r[2][0] is not None]
    want = sorted((s, i, j, round(d, 9)) for s, i, u, rank in good for t, j, v, _ in good if s == t and i < j and abs(d := sum(x * y for x, y in zip(u[:rank], v[:rank], strict=True))) <= 0.3)
    monkeypatch.setattr(graph, "BUCKET", 8, raising=False)
    for width in (None, 3):
        own = graph.orthogonal_pairs(cells, 0.3, width).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.slide_id, r.a, r.b, round(r.dot, 9)) for r in own) == want and len(want) > 500
        assert len({r.task for r in own if r.slide_id == "s"}) == 4


def test_rings_of_features_are_not_made_where_parts_are_read(spark, sf_dir):
    from cellspark.sources import fixtures

    cells = fixtures.cells_parts(spark, sf_dir).withColumn("clinical", F.lit("Immune"))
    docs = exports.feature_pieces(cells, F.col("slide_id"))
    text = docs._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Repartition", text.index("Window")) > text.index("forall(")  # the plan's end is the file

    points = "array<struct<x:double,y:double>>"
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    rows = [("s", 1, []), ("s", 2, ring), ("s", 3, [(float("inf"), 0.0)]), ("s", 4, ring), ("s", 5, None), ("s", None, ring), ("t", 1, []), (None, 7, ring)]
    cells = spark.createDataFrame([(*r, "Immune") for r in rows], f"slide_id string, cell_id long, ring {points}, clinical string")
    whole = {r.slide_id: r.json for r in exports.feature_collections(cells.where("cell_id IS NOT NULL")).collect()}
    found = {}
    for r in sorted(exports.feature_pieces(cells.where("cell_id IS NOT NULL"), F.col("slide_id")).collect(), key=lambda r: r.part):
        found[r.path] = found.get(r.path, "") + bytes(r.content).decode()
    assert found == whole and set(found) == {"s", None}
