"""Many cells in one place cost no more than one, and whole tables of cells are not broadcast by the size of a file."""

import math

import pytest
from pyspark.sql import functions as F

from cellspark.operators import spatial


def piles(spark, n=300):
    return spark.range(n).select(F.lit("s").alias("slide_id"), F.col("id").alias("cell_id"), (F.col("id") % 3 * 10.0).alias("centroid_x"), F.lit(0.0).alias("centroid_y"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("first", [None, 30])
def test_field_of_piles(spark, first):
    out = spatial.rbf_field(piles(spark), 10.0, first)
    assert "strategy=merge" in plan(out)
    each = 100 if first is None else first // 3
    near, far = math.exp(-0.5), math.exp(-2)
    for row in out.collect():
        others = each * (2 * near if row.cell_id % 3 == 1 else near + far)
        own = each - (first is None or row.cell_id < first)
        assert row.rbf == pytest.approx(others + own, abs=1e-9)


def test_neighbours_of_piles(spark):
    found = spatial.knn(piles(spark), 4, leaf=16).groupBy("src").agg(F.collect_list(F.struct("rank", "dst", "d")).alias("e")).collect()
    assert len(found) == 300
    for row in found:
        same = [c for c in range(row.src % 3, 18, 3) if c != row.src][:4]
        assert [(e.dst, e.d) for e in sorted(row.e)] == [(c, 0.0) for c in same]


def test_instances_on_piles(spark):
    box = lambda x, r: F.struct((F.col(x) - r).alias("x0"), F.lit(-r).cast("double").alias("y0"), (F.col(x) + r).alias("x1"), F.lit(r).cast("double").alias("y1"))
    cells = piles(spark).withColumn("box", box("centroid_x", 4.0))
    i = spark.createDataFrame([("s", 7, 1.0, 0.0, 0.5, "a"), ("s", 8, 1.0, 0.0, 0.7, "b"), ("s", 9, 25.5, 0.0, 0.9, "c")], "slide_id string, inst_id long, x double, y double, confidence double, label string")
    out = spatial.project(cells, i.withColumn("box", box("x", 6.0)), most=5.0)
    assert "strategy=merge" in plan(out)
    got = {r.cell_id: (r.label, r.confidence) for r in out.where("label <> 'Stromal'").collect()}
    assert got == {0: ("b", 0.7), 2: ("c", 0.9)}  # the least ids of their places; c by the overlap of boxes
    assert out.count() == 300
