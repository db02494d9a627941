"""Fields of dense slides cost no pairs, and the feature table reads its rings once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import dense, spatial
from cellspark.plans import features

PLACES = "slide_id string, cell_id long, centroid_x double, centroid_y double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def field(xy, sigma):
    return np.array([np.exp(-((xy - p) ** 2).sum(1) / (2 * sigma * sigma)).sum() - 1 for p in xy])


def slides(spark):
    """A dense slide with a pile and a far cell, one with a dense corner, one with few cells; away from the origin."""
    draw = np.random.default_rng(4)
    a = np.vstack((draw.uniform(0, 30, (1500, 2)), [[7.0, 7.0]] * 5, [[900.0, -900.0]])) + 1e5
    b = np.vstack((draw.normal(0, 3, (1300, 2)), draw.uniform(-200, 200, (60, 2))))
    own = {"a": (a, 40.0), "b": (b, 5.0), "c": (draw.uniform(0, 9, (20, 2)), 2.0)}
    cells = spark.createDataFrame([(s, i, float(x), float(y)) for s, (xy, _) in own.items() for i, (x, y) in enumerate(xy)], PLACES)
    return own, cells, spark.createDataFrame([(s, v) for s, (_, v) in own.items()], "slide_id string, sigma double")


def check(own, rows):
    got = {(r.slide_id, r.cell_id): r.rbf for r in rows}
    assert len(got) == sum(len(xy) for xy, _ in own.values())
    for s, (xy, sigma) in own.items():
        assert [got[s, i] for i in range(len(xy))] == pytest.approx(field(xy, sigma), abs=1e-9)


def test_dense_squares_act_by_moments(spark):
    own, cells, sigma = slides(spark)
    out = spatial.rbf_field(cells, sigma)
    assert "MapInArrow" in plan(out)
    check(own, out.collect())


@pytest.mark.parametrize("most", [0, 40, 10**9])
def test_moments_and_pairs_agree(spark, most, monkeypatch):
    monkeypatch.setattr(dense, "SHARE", 200)  # a square is dealt to several tasks
    own, cells, sigma = slides(spark)
    check(own, spatial.rbf_field(cells, sigma, most=most).collect())


def test_first_sources_of_dense_squares(spark):
    own, cells, _ = slides(spark)
    xy = own["a"][0]
    want = [np.exp(-((xy[:1200] - p) ** 2).sum(1) / 3200).sum() - (i < 1200) for i, p in enumerate(xy)]
    got = {r.cell_id: r.rbf for r in spatial.rbf_field(cells.where("slide_id = 'a'"), 40.0, first=1200).collect()}
    assert [got[i] for i in range(len(xy))] == pytest.approx(want, abs=1e-9)


def test_the_feature_table_reads_its_rings_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def ring(i):
        seen.add(1)
        return [(float(x + i * 7 % 50), float(y + i * i % 40)) for x, y in ((0, 0), (2, 0), (2, 1), (0, 3))]

    made = F.udf(ring, "array<struct<x:double,y:double>>")
    cells = spark.range(30).select(F.lit("s").alias("slide_id"), F.col("id").alias("cell_id"), made("id").alias("ring"))
    assert len(features.features(cells).collect()) == 30 and seen.value == 30
