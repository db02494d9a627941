"""Closed forms: squares, circles, two nodes, hulls, kernels."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellspark.functions import kernels, ring, score
from cellspark.operators import choice, graph, spatial
from cellspark.plans import enrich

RING = "slide_id string, cell_id long, ring array<struct<x:double,y:double>>"


def rings(spark, *rows):
    return spark.createDataFrame([("s", i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rows)], RING)


def circle(n, r=1.0, cx=0.0, cy=0.0):
    return [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n)]


SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]


def test_square_and_degenerate_rings(spark):
    rows = enrich.shape(rings(spark, SQUARE, SQUARE[::-1], [], [(2, 3)], [(0, 0), (3, 4)])).orderBy("cell_id").collect()
    assert [r["area"] for r in rows] == [1, 1, 0, 0, 0]
    assert [r["perimeter"] for r in rows[:2]] == [4, 4] and rows[4]["perimeter"] == 10
    assert rows[0]["circularity"] == pytest.approx(math.pi / 4)
    assert (rows[0]["centroid_x"], rows[0]["centroid_y"]) == (0.5, 0.5) == (rows[1]["centroid_x"], rows[1]["centroid_y"])
    assert rows[2]["centroid_x"] is None and (rows[3]["centroid_x"], rows[3]["centroid_y"]) == (2, 3)
    assert rows[0]["eccentricity"] == pytest.approx(0)


def test_two_nodes(spark):
    p = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 3.0, 4.0), ("t", 5, 1.0, 1.0)], "slide_id string, cell_id long, centroid_x double, centroid_y double")
    got = {r["cell_id"]: r["knn_density"] for r in spatial.knn_density(p, spatial.knn(p)).collect()}
    assert got == {0: 5.0, 1: 5.0, 5: 0.0}
    near = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 1.0, 0.0)], p.schema)
    assert [r["rbf"] for r in spatial.rbf_field(near, 1.0).collect()] == [pytest.approx(math.exp(-0.5))] * 2


PLACES = "slide_id string, cell_id long, centroid_x double, centroid_y double"


def placed(spark, *slides):
    rows = [(f"s{j}", i * 3 + j, float(x), float(y)) for j, xy in enumerate(slides) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["slide_id", "cell_id", "centroid_x", "centroid_y"]), PLACES).repartition(4)


def brute_neighbours(xy, j, k):
    """(src, dst, rank) by comparing all cells."""
    out, ids = [], np.arange(len(xy)) * 3 + j
    for i in range(len(xy)):
        d2 = (xy[i, 0] - xy[:, 0]) * (xy[i, 0] - xy[:, 0]) + (xy[i, 1] - xy[:, 1]) * (xy[i, 1] - xy[:, 1])
        d2[i] = np.inf
        best = np.lexsort((ids, d2))[: min(k, len(xy) - 1)]
        out += [(f"s{j}", int(ids[i]), int(ids[b]), r + 1) for r, b in enumerate(best)]
    return out


@pytest.mark.parametrize("leaf", [16, 60, 1024])
def test_neighbours_are_brute_force(spark, leaf):
    rng = np.random.default_rng(3)
    slides = [
        np.concatenate((rng.normal(0, 1, (150, 2)), rng.normal(500, 3, (80, 2)), np.zeros((12, 2)))).round(1),
        np.concatenate((rng.random((300, 2)), [[1e6, -1e6], [1e6, 1e6 + 1]])),  # far outliers
        np.concatenate((np.full((90, 2), 5.0), rng.integers(0, 4, (200, 2)))).astype(float),  # a pile, and a lattice of ties
        np.stack((np.zeros(200), rng.random(200)), 1), np.full((70, 2), -1.5), np.array([[0.0, 0.0]]), np.zeros((3, 2)),
        np.concatenate((np.stack((np.zeros(190), np.zeros(190)), 1), [[0.0, i] for i in range(1, 9)], [[i, 0.0] for i in range(1, 9)])),
    ]
    got = sorted((r["slide_id"], r["src"], r["dst"], r["rank"]) for r in spatial.knn(placed(spark, *slides), 5, leaf).collect())
    assert got == sorted(e for j, xy in enumerate(slides) for e in brute_neighbours(xy, j, 5))


def test_often_visited_leaves_are_dealt_out(spark, monkeypatch):
    from cellspark.operators import neighbours

    monkeypatch.setattr(neighbours, "VISITORS", 5)
    xy = np.random.default_rng(8).random((400, 2))
    got = sorted((r["slide_id"], r["src"], r["dst"], r["rank"]) for r in spatial.knn(placed(spark, xy), 5, 40).collect())
    assert got == sorted(brute_neighbours(xy, 0, 5))


@pytest.mark.parametrize("shape", ["outlier", "corner"])
def test_skewed_slides_have_leaves_of_bounded_size(spark, shape):
    """200,000 cells, all but one in one square of the slide's box, or nine tenths in a hundredth of it."""
    from cellspark.operators import neighbours

    rng, n = np.random.default_rng(4), 200_000
    xy = rng.random((n, 2)) * 1000
    if shape == "outlier":
        xy[0] = 1e9
    else:
        xy[: n * 9 // 10] /= 10
    cells = placed(spark, xy)
    leaves, boxes = neighbours.split(spatial._points(cells))
    sizes = [r["count"] for r in leaves.groupBy("slide_id", "node").count().collect()]
    assert sum(sizes) == n and max(sizes) <= neighbours.LEAF and len(sizes) < 10 * n / neighbours.LEAF and boxes.where("leaf").count() == len(sizes)
    edges = spatial.knn(cells, 8).cache()
    assert edges.count() == 8 * n
    asked = [0, 1, 7, n // 2, n - 1] + rng.integers(0, n, 60).tolist()
    got = {}
    for r in edges.where(F.col("src").isin([3 * i for i in asked])).collect():
        got.setdefault(r["src"] // 3, []).append((r["rank"], r["dst"] // 3))
    for i in asked:
        d2 = (xy[i, 0] - xy[:, 0]) ** 2 + (xy[i, 1] - xy[:, 1]) ** 2
        d2[i] = np.inf
        best = np.argpartition(d2, 8)[:8]
        assert [b for _, b in sorted(got[i])] == best[np.lexsort((best, d2[best]))].tolist()
    edges.unpersist()


def test_hull_and_distance(spark):
    h = kernels.convex_hull(np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5), (0.5, 0)], float))
    assert len(h) == 4 and kernels.shoelace(h) == 1
    p = spark.createDataFrame([("s", float(x), float(y)) for x, y in [*SQUARE, (0.5, 0.5)]], "slide_id string, x double, y double")
    assert len(enrich.hulls(p).first()["hull"]) == 4
    q = rings(spark, [(0, 0), (2, 0), (2, 2), (0, 2)], [(5, 5)], []).select(ring.distance_to_polygon("1D", "1D", "ring").alias("d"))
    assert [r["d"] for r in q.collect()] == [1, pytest.approx(math.sqrt(32)), math.inf]


def test_kernels():
    c = np.array(circle(64))
    assert kernels.kappa(c) > 0.45
    assert kernels.kappa(np.stack((c[:, 0] * 18, c[:, 1] * 0.35), 1)) < 0.35
    assert kernels.kappa(np.zeros((64, 2))) == 0
    assert len(kernels.resampled(np.array(circle(32)), 128)) == 128
    assert np.allclose(kernels.resampled(np.array([(1.0, 2.0)]), 4), [(1, 2)] * 4)
    with pytest.raises(ValueError):
        kernels.smoothed(c, 0)
    assert np.allclose(kernels.smoothed(c, 4), c)


def test_score_handles_values_that_are_not_finite(spark):
    row = spark.range(1).select(score.clamp01(F.lit(float("nan"))).alias("a"), score.clamp01(F.lit(float("inf"))).alias("b"), score.clamp01(F.lit(7.0)).alias("c"), score.clamp01(F.lit(None).cast("double")).alias("d")).first()
    assert tuple(row) == (0, 0, 1, 0)
    assert sum(score.WEIGHTS.values()) == pytest.approx(1)


def test_communities_and_patches(spark):
    cells = spark.createDataFrame([("s", i, float(i), 0.0, 1.0 if i < 4 else 9.0) for i in range(8)], "slide_id string, cell_id long, centroid_x double, centroid_y double, area double")
    edges = spatial.knn(cells, 2)
    modules = graph.communities(cells, edges).groupBy("module").count().collect()
    assert len(modules) == 4 and sum(m["count"] for m in modules) == 8
    patches = graph.equilibrium_patches(cells, edges, "area", 0.5).groupBy("patch").count().orderBy("patch").collect()
    assert [tuple(p) for p in patches] == [(0, 4), (4, 4)]


def merged(n, edges, target):
    """Communities by the rule read plainly: of all pairs of groups the one with most edges between, the first of equals."""
    groups = [[i] for i in range(n)]
    while len(groups) > target:
        between = lambda a, b: sum((x in a and y in b) or (x in b and y in a) for x, y in edges)
        pairs = [(between(groups[i], groups[j]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        best = max(pairs)
        if not best[0]:
            break
        groups[-best[1]] += groups.pop(-best[2])
    return sorted(map(sorted, groups))


def test_communities_are_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = [(s, 10 * i + 3, rng.random() * 100, rng.random() * 100, 1.0) for s, n in (("a", 30), ("b", 17), ("c", 3), ("d", 5)) for i in range(n)]
    cells = spark.createDataFrame(rows, "slide_id string, cell_id long, centroid_x double, centroid_y double, area double")
    edges = spatial.knn(cells, 3)
    links, got = {}, {}
    for e in edges.collect():
        links.setdefault(e["slide_id"], []).append(((e["src"] - 3) // 10, (e["dst"] - 3) // 10))
    for r in graph.communities(cells, edges).collect():
        got.setdefault(r["slide_id"], {}).setdefault(r["module"], []).append((r["cell_id"] - 3) // 10)
    assert set(got) == {"a", "b", "d"}
    for s, n in (("a", 30), ("b", 17), ("d", 5)):
        assert sorted(map(sorted, got[s].values())) == merged(n, links[s], min(max(int(n**0.5), 4), n // 2))


def test_ranks_over_buckets(spark):
    from cellspark.operators import stats

    rows = [("a", float(i * i % 101)) for i in range(300)] + [("b", 5.0)] * 40 + [("c", 1.0)]
    df = spark.createDataFrame(rows, "slide_id string, v double")
    got = {}
    for r in stats.ranked(df, "v", rows=20).collect():
        got.setdefault(r["slide_id"], []).append((r["_rank"], r["v"]))
    for k, own in got.items():
        assert [v for _, v in sorted(own)] == sorted(v for s, v in rows if s == k) and sorted(i for i, _ in own) == list(range(1, len(own) + 1))
    mids = {r["slide_id"]: r["upper_median"] for r in stats.upper_median(df, "v").collect()}
    assert mids == {k: sorted(v for s, v in rows if s == k)[sum(s == k for s, _ in rows) // 2] for k in "abc"}


def test_fields_and_neighbours_of_clustered_slides(spark):
    """Squares change nothing: fields, surfaces and neighbours of clusters far apart are those of all pairs."""
    import random

    rng = random.Random(8)
    pts = [(rng.gauss(cx, 3), rng.gauss(cy, 3)) for cx, cy in ((0, 0), (5000, 10), (5000, 9000)) for _ in range(60)]
    cells = spark.createDataFrame([("s", i, x, y, 1.0) for i, (x, y) in enumerate(pts)], "slide_id string, cell_id long, centroid_x double, centroid_y double, area double")
    d2 = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    got = {r["cell_id"]: r["rbf"] for r in spatial.rbf_field(cells, 4.0).collect()}
    assert all(abs(got[i] - sum(math.exp(-d2(p, q) / 32) for j, q in enumerate(pts) if j != i)) < 1e-9 for i, p in enumerate(pts))
    near = {}
    for e in spatial.knn(cells, 5).collect():
        near.setdefault(e["src"], {})[e["rank"]] = e["dst"]
    assert all([near[i][k] for k in range(1, 6)] == sorted((j for j in range(len(pts)) if j != i), key=lambda j: (d2(pts[i], pts[j]), j))[:5] for i in range(len(pts)))
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    step = lambda v, i: min(v) + (i + 0.5) * (max(v) - min(v)) / 4
    for r in spatial.surface(cells, 4, 50.0).collect():
        assert abs(r["value"] - sum(math.exp(-d2((step(xs, r["i"]), step(ys, r["j"])), q) / 5000) for q in pts)) < 1e-9


def test_suppression_and_distance(spark):
    b = spark.createDataFrame([("g", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("g", 2, 1.0, 1.0, 11.0, 11.0, 0.8), ("g", 3, 50.0, 50.0, 60.0, 60.0, 0.7)], "group string, id long, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(r["id"] for r in choice.suppress(b).collect()) == [1, 3]
    c = spark.createDataFrame([("s", 1, 5.0, 0.0, 0.0), ("s", 2, 4.0, 3.0, 0.0), ("s", 3, 3.0, 30.0, 0.0)], "slide_id string, cell_id long, area double, centroid_x double, centroid_y double")
    assert sorted(r["cell_id"] for r in choice.dedupe_by_distance(c).collect()) == [1, 3]


def test_empty_cells(spark):
    assert enrich.enrich(rings(spark)).count() == 0


def test_first_sources_are_counted_within_each_slide(spark):
    rows = [(s, 5000 + 10 * i, float(i), 0.0, 1.0) for s in ("a", "b") for i in range(6)]
    cells = spark.createDataFrame(rows, "slide_id string, cell_id long, centroid_x double, centroid_y double, area double")
    want = {(s, c): pytest.approx(sum(math.exp(-((x - j) ** 2) / 2) for j in range(4) if j != x)) for s, c, x, _, _ in rows}
    assert {(r["slide_id"], r["cell_id"]): r["rbf"] for r in spatial.rbf_field(cells, 1.0, first=4).collect()} == want


def test_blocked_field_and_walk_take_the_limits_of_the_reference(spark, monkeypatch):
    """All 60 cells of a slide are sources, though most ids are above 1,000, and a walk takes 50 steps."""
    from cellspark.plans import queries_extended, queries_geometry, registry

    cells = spark.createDataFrame([("s", 900 + 10 * i, float(i * i), 0.0, 1.0) for i in range(60)], "slide_id string, cell_id long, centroid_x double, centroid_y double, area double")
    for module in (queries_extended, queries_geometry):
        monkeypatch.setattr(module, "points_parts", lambda *_: cells)
    want = {900 + 10 * i: round(sum(math.exp(-((i * i - j * j) ** 2) / 5000) for j in range(60) if j != i), 6) for i in range(60)}
    assert {r["cell_id"]: r["rbf"] for r in registry.queries()["rbf_field_blocked"](spark, "").collect()} == pytest.approx(want, abs=2e-6)
    assert [r["cell_id"] for r in registry.queries()["radial_walk"](spark, "").orderBy("step").collect()] == [900 + 10 * i for i in range(51)]


def test_blocked_field_reads_all_cells_of_a_slide(spark, monkeypatch):
    """Cells beyond the first 3,072 of a slide are sources too, and its SQL has no limit either."""
    from cellspark.plans import queries_geometry, registry

    cells = spark.range(3200).select(F.lit("s").alias("slide_id"), F.col("id").alias("cell_id"), (F.col("id") * 40.0).alias("centroid_x"), F.lit(0.0).alias("centroid_y"))
    monkeypatch.setattr(queries_geometry, "points_parts", lambda *_: cells)
    got = {r["cell_id"]: r["rbf"] for r in registry.queries()["rbf_field_blocked"](spark, "").collect()}
    term = [math.exp(-((40 * k) ** 2) / 5000) for k in range(12)]
    assert got == pytest.approx({i: sum(term[abs(i - j)] for j in range(max(0, i - 11), min(3200, i + 12)) if j != i) for i in range(3200)}, abs=2e-6)
    assert "3072" not in registry.oracle_sql()["rbf_field_blocked"]


def brute_choice(rows, clash):
    kept = []
    for r in sorted(rows, key=lambda r: (-r["score"], r["id"])):
        if not any(clash(r, k) for k in kept):
            kept.append(r)
    return sorted((r["slide_id"], r["id"]) for r in kept)


def overlap(a, b):
    w, h = (max(0.0, min(a[f"{c}1"], b[f"{c}1"]) - max(a[f"{c}0"], b[f"{c}0"])) for c in "xy")
    area = lambda r: max(0.0, r["x1"] - r["x0"]) * max(0.0, r["y1"] - r["y0"])
    union = area(a) + area(b) - w * h
    return 0.0 if union <= 1e-12 else w * h / union


def some_boxes(n, seed):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        x, y, scale = *rng.integers(0, 60, 2), float(rng.choice([0.5, 3, 8, 30]))
        w, h = (float(v) for v in rng.integers(0, 5, 2) * scale / 2)
        out.append({"slide_id": f"s{i % 2}", "id": i, "x0": float(x), "y0": float(y), "x1": x + w, "y1": y + h, "score": float(rng.integers(0, 9))})
    return out + [dict(out[k % 20], id=n + k, score=float(k % 9)) for k in range(60)]  # copies


BOXES = "slide_id string, id long, x0 double, y0 double, x1 double, y1 double, score double"


@pytest.mark.parametrize("most", [0.0, 0.1, 0.3, 0.8])
def test_boxes_kept_are_the_greedy_ones(spark, most):
    rows = some_boxes(500, 6)
    df = spark.createDataFrame(pd.DataFrame(rows), BOXES).repartition(4)
    got = sorted((r["slide_id"], r["id"]) for r in choice.apart_boxes(df, most).collect())
    assert got == brute_choice(rows, lambda a, b: a["slide_id"] == b["slide_id"] and overlap(a, b) > most)


@pytest.mark.parametrize("rounds", [0, 2, 50])
def test_points_kept_are_the_greedy_ones(spark, rounds, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [{"slide_id": f"s{i % 3}", "id": i, "x": float(x), "y": float(y), "score": float(s)} for i, (x, y, s) in enumerate(zip(*rng.integers(0, 40, (2, 400)), rng.integers(0, 5, 400), strict=True))]
    rows += [{"slide_id": "chain", "id": 1000 + i, "x": 3.0 * i, "y": 0.0, "score": float(-i)} for i in range(120)]
    df = spark.createDataFrame(pd.DataFrame(rows), "slide_id string, id long, x double, y double, score double").repartition(4)
    monkeypatch.setattr(choice.beaten, "__defaults__", (rounds,))
    got = sorted((r["slide_id"], r["id"]) for r in choice.apart(df, 4.0).collect())
    assert got == brute_choice(rows, lambda a, b: a["slide_id"] == b["slide_id"] and (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 < 16)


def test_a_slide_of_a_million_boxes_is_spread(spark):
    """No plan reads a slide as one group."""
    i = F.col("id")
    boxes = spark.range(1_000_000).select(F.lit("s").alias("slide_id"), "id", (i % 1000 * 10).cast("double").alias("x0"), (F.floor(i / 1000) * 10).cast("double").alias("y0"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("score"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 13, "y1": F.col("y0") + 10})
    kept = choice.apart_boxes(boxes, 0.1).select("id", F.spark_partition_id().alias("p"))
    sizes = [r["count"] for r in kept.groupBy("p").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    own = boxes.where("y0 = 50").select("id", "score").orderBy(F.desc("score"), "id").collect()
    taken = set()
    for r in own:  # a row of boxes, each over the next by 3 of 23
        if not {r["id"] - 1, r["id"] + 1} & taken:
            taken.add(r["id"])
    assert {r["id"] for r in kept.where(F.col("id").between(5000, 5999)).collect()} == taken
