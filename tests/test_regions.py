"""Parts over tiles are those of the whole mask."""

import numpy as np
import pytest

from cellspark.functions import nuclei
from cellspark.functions.kernels import shoelace
from cellspark.operators import regions

KIND = "id string, x long, y long, height int, width int, mask array<boolean>"


def tiles(spark, masks, side):
    rows = []
    for name, m in masks.items():
        for y in range(0, m.shape[0], side):
            for x in range(0, m.shape[1], side):
                t = m[y : y + side, x : x + side]
                rows.append((name, x, y, *t.shape, t.ravel().tolist()))
    return spark.createDataFrame(rows, KIND).repartition(4)


def inside(ring, height, width):
    """Pixels whose centres lie inside a closed ring."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    odd = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if ay != by:
            odd ^= (y > min(ay, by)) & (y < max(ay, by)) & (x < ax)
    return odd


def surrounded(mask):
    """A part with all that no path of background pixels, corners included, joins with the border."""
    outside, free = np.pad(np.zeros(mask.shape, bool), 1, constant_values=True), np.pad(~mask, 1, constant_values=True)
    while True:
        p = np.pad(outside, 1)
        grown = free & np.logical_or.reduce([p[v : v + free.shape[0], u : u + free.shape[1]] for v in range(3) for u in range(3)])
        if np.array_equal(grown, outside):
            return ~outside[1:-1, 1:-1]
        outside = grown


@pytest.mark.parametrize("side", [7, 64])
def test_parts_are_those_of_the_whole_mask(spark, side):
    rng = np.random.default_rng(3)
    masks = {"noise": rng.random((60, 50)) < 0.55, "full": np.ones((33, 20), bool), "none": np.zeros((9, 9), bool), "ring": np.pad(np.zeros((20, 20), bool), 3, constant_values=True)}
    got = {}
    for r in regions.mask_parts(tiles(spark, masks, side), 1).collect():
        got.setdefault(r["id"], []).append((r["part"], r["n"], [(p["x"], p["y"]) for p in r["ring"]]))
    assert "none" not in got
    for name in ("noise", "full", "ring"):
        m = masks[name]
        own = nuclei.parts(m)
        first = {i: np.argwhere(own == i)[0] for i in range(1, own.max() + 1)}
        assert sorted((p, n) for p, n, _ in got[name]) == sorted(((int(y) << 31) + int(x), int((own == i).sum())) for i, (y, x) in first.items())
        for part, _, ring in got[name]:
            label = own[part >> 31, part & (1 << 31) - 1]
            assert ring[0] == ring[-1] and label and np.array_equal(inside(ring, *m.shape), surrounded(own == label))


def test_an_object_over_four_tiles_has_one_ring(spark):
    y, x = np.mgrid[0:80, 0:80]
    found = regions.mask_parts(tiles(spark, {"a": (x - 40) ** 2 + (y - 40) ** 2 <= 900}, 40)).collect()
    assert len(found) == 1 and found[0]["n"] == ((x - 40) ** 2 + (y - 40) ** 2 <= 900).sum()
    assert abs(shoelace(np.array([(p["x"], p["y"]) for p in found[0]["ring"][:-1]]))) == found[0]["n"]
    assert regions.mask_parts(tiles(spark, {"a": np.eye(6, dtype=bool)}, 3), 2).count() == 0


def test_a_part_that_touches_itself_at_a_corner():
    m = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 0]], bool)
    row, a, b = nuclei.runs(m)
    ring = regions.traced(row, a, b)
    assert np.array_equal(inside(ring, 3, 3), m)  # the hole lies open at a corner
