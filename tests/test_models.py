"""Tree ensembles and layouts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellspark.operators import ensemble, topology

KIND = "tree long, node long, feature int, threshold double, low long, high long, value double"


def grown(rng, tree, depth, features):
    """A random tree as rows, and as a function."""
    rows = []

    def grow(d):
        at = len(rows)
        rows.append(None)
        if d == 0 or rng.random() < 0.2:
            v = float(rng.normal())
            rows[at] = (tree, at, None, None, None, None, v)
            return at, lambda x: v
        f, t = int(rng.integers(features)), float(rng.normal())
        low, left = grow(d - 1)
        high, right = grow(d - 1)
        rows[at] = (tree, at, f, t, low, high, None)
        return at, lambda x: left(x) if x[f] <= t else right(x)

    return rows, grow(depth)[1]


def test_scores_are_those_of_the_trees(spark):
    rng = np.random.default_rng(4)
    grown_ = []
    for t in range(12):
        rows, f = grown(rng, t * 3, 5, 6)
        grown_.append((rows, f))
    trees = [r for rows, _ in grown_ for r in rows]
    x = rng.normal(size=(300, 6))
    x[:5, 2] = np.nan
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names)).withColumn("f3", F.nullif("f3", F.lit(x[7, 3])))
    x[7, 3] = np.nan
    got = {r["id"]: r for r in ensemble.classify(df.repartition(3), names, spark.createDataFrame(rng.permutation(np.array(trees, object)).tolist(), KIND), -0.3, 0.25, 0.4).collect()}
    for i, row in enumerate(x):
        p = 1 / (1 + np.exp(-(-0.3 + 0.25 * sum(f(row) for _, f in grown_))))
        assert got[i]["probability"] == pytest.approx(p, rel=1e-12) and got[i]["positive"] == (got[i]["probability"] > 0.4)


def test_models_that_are_none(spark):
    ok = [(0, 0, 0, 1.0, 1, 2, None), (0, 1, None, None, None, None, 1.0), (0, 2, None, None, None, None, 2.0)]
    table = lambda rows: spark.createDataFrame(rows, KIND).toArrow()
    assert ensemble.Ensemble(table(ok)).scores(np.array([[0.0], [2.0]])).tolist() == [1, 2]
    assert ensemble.Ensemble(table([])).scores(np.zeros((2, 1))).tolist() == [0, 0]
    for bad in (ok[1:], [(0, 0, 0, 1.0, 0, 2, None), *ok[1:]], [(0, 0, 0, 1.0, 1, 9, None), *ok[1:]]):
        with pytest.raises(ValueError):
            ensemble.Ensemble(table(bad))
    with pytest.raises(ValueError):
        ensemble.Ensemble(table([(0, 0, 5, 1.0, 1, 2, None), *ok[1:]])).scores(np.zeros((1, 2)))
    assert isinstance(table(ok), pa.Table)


def test_layouts_and_their_errors(spark):
    def load():
        def model(x):
            if x[0, 2].max() > 200:
                return np.zeros((1, 3, 2, 2))
            return np.stack([x[:, 0], x[:, 1]], 1)

        return model

    y, x = np.mgrid[0:4, 0:6]
    mesh = lambda i, volume=0.5, drop=0, dx=None: [(i, int(v), int(u), float(u) if dx is None else dx, float(v * u % 3), volume) for v, u in list(zip(y.ravel(), x.ravel(), strict=True))[drop:]]
    rows = mesh(1) + mesh(2, drop=1)[:-1] + mesh(3) + mesh(3)[:1] + mesh(4, dx=float("nan")) + mesh(5, volume=0.9) + [(6, 0, None, 1.0, 1.0, 0.1)] + mesh(7, dx=2.0)
    df = spark.createDataFrame(rows, "id long, py int, px int, dx double, dy double, volume double").repartition(4)
    got = {r["id"]: r for r in topology.layouts(df, load, 8).collect()}
    assert {i for i, r in got.items() if r["error"] is None} == {1, 7}
    one = got[1]
    a = [topology.resized(topology.to_bytes(c), 8).astype(float) for c in (x.astype(float), (y * x % 3).astype(float))]
    p = 1 / (1 + np.exp(a[0] - a[1]))
    assert (one["height"], one["width"]) == (8, 8) and np.allclose(one["probability"], p.ravel()) and one["binary"] == (p > 0.5).astype(int).ravel().tolist()
    assert one["foreground"] == (p > 0.5).mean()


def test_channels_are_resized_between_centres():
    ramp = np.tile(np.arange(0, 160, 10, dtype=np.uint8), (16, 1))
    assert np.array_equal(topology.resized(ramp, 16), ramp) and topology.resized(ramp, 8)[3].tolist() == sorted(topology.resized(ramp, 8)[3].tolist())
    assert topology.resized(ramp, 32).shape == (32, 32) and topology.resized(ramp, 32)[0, 2:6].tolist() == [8, 13, 18, 23]
    assert (topology.resized(np.full((5, 9), 77, np.uint8), 4) == 77).all()
