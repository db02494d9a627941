"""Masks, peaks, boxes, models, SQL names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.functions import imaging, nuclei, sql, status
from cellspark.functions.kernels import shoelace
from cellspark.operators import exemplars


def test_outline_is_the_largest_part():
    m = np.zeros((12, 12), bool)
    m[1, 1] = True
    m[4:9, 3:10] = True
    p = imaging.outline(m)
    assert p[0] == p[-1] and len(p) == 5 and abs(shoelace(np.array(p[:-1]))) == 35
    m[6, 6] = False
    assert abs(shoelace(np.array(imaging.outline(m)[:-1]))) == 35
    assert imaging.outline(np.zeros((3, 3), bool)) == []


def rows_of(spark, images):
    return spark.createDataFrame([(i, y, x, float(v)) for i, h in images.items() for (y, x), v in np.ndenumerate(h)], "id long, y long, x long, h double")


def blur_of(h, sigma):
    reach = int(4 * sigma + 0.5)
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    for axis in (0, 1):
        p = np.pad(h, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
        h = np.apply_along_axis(lambda v: np.convolve(v, k / k.sum(), "valid"), axis, p)
    return h


def test_blur_and_peaks(spark):
    rng = np.random.default_rng(2)
    images = {1: rng.random((30, 41)), 2: rng.random((17, 12))}
    for i, h in images.items():
        got = {(r["y"], r["x"]): r["h"] for r in exemplars.blurred(rows_of(spark, {i: h}), "h", 1.0).collect()}
        want = blur_of(h, 1.0)
        assert len(got) == h.size and max(abs(got[p] - v) for p, v in np.ndenumerate(want)) < 1e-9
    y, x = np.mgrid[0:96, 0:96]
    spots = [(20, 20), (20, 70), (70, 40)]
    h = sum(np.exp(-((x - a) ** 2 + (y - b) ** 2) / 50) for a, b in spots)
    found = exemplars.peaks(rows_of(spark, {5: h}), 8).collect()
    assert sorted((int(r["x"]), int(r["y"])) for r in found) == sorted(spots) and {r["id"] for r in found} == {5}


def test_exemplar_boxes_are_those_of_the_definition(spark):
    """Boxes against a plain reading of the rule: greedy peaks, greedy boxes, greedy pale places away from them."""
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:60, 0:72]
    h = sum(np.exp(-((x - a) ** 2 + (y - b) ** 2) / 30) for a, b in ((8, 9), (16, 12), (50, 40), (70, 58), (40, 12))) + rng.random((60, 72)) * 0.05
    half, apart = 6, 5
    b = blur_of(h, 1.0)
    level = np.percentile(b, 70)
    top = [p for p, v in np.ndenumerate(b) if v >= level and v == b[max(0, p[0] - 5) : p[0] + 6, max(0, p[1] - 5) : p[1] + 6].max()]
    box = lambda u, v: (max(0.0, u - half), max(0.0, v - half), min(71.0, u + half), min(59.0, v + half))

    def share(p, q):
        w, v = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        both = max(0.0, w) * max(0.0, v)
        return both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both)

    far, good, bad = [], [], []
    for v, u in sorted(top, key=lambda p: -b[p]):
        if all((u - s) ** 2 + (v - t) ** 2 >= apart**2 for s, t in far):
            far.append((u, v))
    centres = []
    for u, v in far:
        if all(share(box(u, v), g) <= 0.3 for g in good):
            good.append(box(u, v))
            centres.append((u, v))
    pale = blur_of(h, 2.0)
    for v, u in sorted((p for p, value in np.ndenumerate(pale) if value <= np.percentile(pale, 25)), key=lambda p: pale[p]):
        q = box(u, v)
        if len(bad) < 4 and q[2] - q[0] >= 4 and q[3] - q[1] >= 4 and all((u - s) ** 2 + (v - t) ** 2 >= 225 for s, t in centres) and all(share(q, n) <= 0.2 for n in bad):
            bad.append(q)
    flat = np.full((9, 9), 0.5)
    got = exemplars.boxes(rows_of(spark, {1: h, 2: flat}), half=half).collect()
    assert {r["id"] for r in got} == {1} and len(good) >= 4 and len(bad) == 4
    assert sorted(tuple(r)[1:] for r in got) == sorted([(*g, 1) for g in good] + [(*n, 0) for n in bad])
    assert exemplars.boxes(rows_of(spark, {2: flat})).count() == 0 == exemplars.boxes(rows_of(spark, {2: flat}).limit(0)).count()


def test_models_load_once_in_each_task(spark):
    def load():
        return lambda part: part.assign(score=part["id"] * 2.0)

    out = imaging.with_model(spark.range(10), load, "id long, score double")
    assert out.agg(F.sum("score")).first()[0] == 90


def test_sql_names(spark):
    assert "ring_area" in sql.register(spark)
    row = spark.sql("SELECT ring_area(ring_circle(0D, 0D, 1D)) AS a, clamp01(double('NaN')) AS c, malignancy_label(0.35D) AS l").first()
    assert row["a"] == pytest.approx(np.pi, abs=2e-3) and row["c"] == 0 and row["l"] == "Normal"


def test_status(spark):
    names = [r["n"] for r in spark.createDataFrame([(0,), (42,), (None,)], "c int").select(status.name_of(F.col("c")).alias("n")).collect()]
    assert names == ["Success", "UnknownTransport", "UnknownTransport"]


def test_heat(spark):
    rows = spark.range(3).select(imaging.heat_color(F.col("id") / 2.0).alias("c")).collect()
    assert [r["c"] for r in rows] == [[0, 0, 255], [255, 255, 0], [255, 0, 0]]


def test_touching_nuclei_are_split():
    y, x = np.mgrid[0:40, 0:60]
    left, right = (x - 20) ** 2 + (y - 20) ** 2 <= 144, (x - 41) ** 2 + (y - 20) ** 2 <= 144
    own = np.where((x - 20) ** 2 + (y - 20) ** 2 <= (x - 41) ** 2 + (y - 20) ** 2, 20, 41)
    mask = left | right
    h, v = np.where(mask, (x - own) / 12, 0), np.where(mask, (y - 20) / 12, 0)
    got = nuclei.split(mask.astype(float), h, v)
    assert set(np.unique(got)) == {0, 1, 2} and got[20, 14] != got[20, 47] and ((got > 0) == mask).mean() > 0.99


def test_imaging_queries_take_every_part(spark, tmp_path):
    from cellspark.plans import registry

    sizes = {1: 1, 2: 25, 3: 50, 10: 7, 25: 12}
    spark.createDataFrame(list(sizes.items()), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    inside = {}
    for i, size in sizes.items():
        cx, cy, h = i * 7919 % 1000 + 0.25, i * 104729 % 1000 + 0.25, size / 2
        inside[i] = [(x, y) for x in range(-30, 1030) if abs(x + 0.5 - cx) < h for y in range(-30, 1030) if abs(y + 0.5 - cy) < h]
    assert {r["cell_id"]: r["pixels"] for r in run("rasterize")} == {i: len(p) for i, p in inside.items()}
    boxes = {i: (min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p) + 1, max(y for _, y in p) + 1, len(p)) for i, p in inside.items() if len(p) > 1}
    assert {r["inst"]: (r["x0"], r["y0"], r["x1"], r["y1"], r["n"]) for r in run("instance_info")} == boxes
    assert {r["id"]: r["red"] for r in run("heat_colors")} == {1: 10, 2: 255, 3: 255, 10: 71, 25: 122}


def test_tile_queries_take_every_part(spark, tmp_path):
    from cellspark.plans import registry

    spark.range(1, 42).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    sizes = {i: (300 + i * 37 % 1500, 200 + i * 53 % 1200) for i in range(1, 42)}
    starts = lambda n: {*range(0, max(0, n - 512) + 1, 448), max(0, n - 512)}
    for name, side, first in (("overlapping_tiles", 512, starts), ("plain_tiles", 256, lambda n: range(0, n, 256))):
        got = [tuple(r[c] for c in ("id", "x0", "y0", "w", "h")) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted((i, x, y, min(side, w - x), min(side, h - y)) for i, (w, h) in sizes.items() for x in first(w) for y in first(h))
