"""Queries of the plans that end in a model: tree ensembles over shapes, layouts from fields; with their DuckDB twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import imaging
from ..operators import topology
from ..sources.fixtures import PARTS_SQL, cells_parts
from . import fusion
from .queries_geometry import KNN_SQL, RBF_SQL, r, rounded
from .queries_imaging import CASES_SQL, cases

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql_: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql_:
            ORACLES[name] = sql_
        return f

    return add


#: tree, node, feature, threshold, low, high, value of a small model over ``fusion.NAMES``.
_TREES = [
    (0, 0, 0, 0.6, 1, 2, None), (0, 1, None, None, None, None, -0.7), (0, 2, 3, 1.05, 3, 4, None), (0, 3, None, None, None, None, 0.9), (0, 4, None, None, None, None, 0.1),
    (1, 0, 15, 0.45, 1, 2, None), (1, 1, None, None, None, None, -0.4), (1, 2, 2, 0.02, 3, 4, None), (1, 3, None, None, None, None, 0.2), (1, 4, None, None, None, None, 0.8),
]


@query(
    "fusion_classes",
    f"""WITH {PARTS_SQL}, {KNN_SQL.format(t='g', k=8)}, med AS (SELECT slide_id, count(*) AS n, quantile_cont(area,0.5) AS med_area, quantile_cont(knn_density,0.5) AS med_knn, greatest(quantile_cont(knn_density,0.5) FILTER (knn_density>0),1e-9) AS sigma FROM g JOIN knn USING (slide_id, cell_id) GROUP BY ALL),
    sig AS (SELECT slide_id, sigma FROM med), {RBF_SQL}, ff AS (SELECT g.slide_id, g.cell_id, area/med_area AS ar, knn_density/med_knn AS kr, rbf/greatest(n-1,1) AS rb, (g.cell_id%10)/10.0 AS neo FROM g JOIN knn USING (slide_id, cell_id) JOIN rbf USING (slide_id, cell_id) JOIN med USING (slide_id)),
    sc AS (SELECT *, 0.1+0.5*(CASE WHEN ar<=0.6 THEN -0.7 WHEN kr<=1.05 THEN 0.9 ELSE 0.1 END + CASE WHEN neo<=0.45 THEN -0.4 WHEN rb<=0.02 THEN 0.2 ELSE 0.8 END) AS s FROM ff)
    SELECT slide_id, cell_id, {r('1/(1+exp(-s))')} AS probability, 1/(1+exp(-s))>0.5 AS malignant FROM sc""",
)
def _(spark, d):
    """O237, O290: cells scored by an ensemble over 16 features; here two small trees."""
    trees = spark.createDataFrame(_TREES, "tree long, node long, feature int, threshold double, low long, high long, value double")
    cells = cells_parts(spark, d).withColumn("neoplastic", (F.col("cell_id") % 10) / 10.0)
    return rounded(fusion.fusion(cells, trees, 0.1, 0.5).select("slide_id", "cell_id", "probability", "malignant"), "probability")


@query(
    "topology_layouts",
    f"""WITH {CASES_SQL}, fi AS (SELECT id, py, px, {r('s/(top+1e-9)')} AS dx, {r('least(1,exp(-d2/3200.0)*(load/10))')} AS dy, cast(vf AS double) AS vf FROM s JOIN t USING (id)),
    e AS (SELECT id, min(dx) AS x0, max(dx) AS x1, min(dy) AS y0, max(dy) AS y1 FROM fi GROUP BY id),
    b AS (SELECT id, CASE WHEN x1-x0<1e-8 THEN 128 ELSE floor((dx-x0)/(x1-x0)*255) END AS c0, CASE WHEN y1-y0<1e-8 THEN 128 ELSE floor((dy-y0)/(y1-y0)*255) END AS c1, floor(vf*255) AS c2 FROM fi JOIN e USING (id)),
    p AS (SELECT id, 1/(1+exp(c0*0.02::double-(c1*0.01::double+c2*0.005::double))) AS p FROM b)
    SELECT id, 16 AS height, 16 AS width, {r('avg(p)')} AS mean, {r("avg(CASE WHEN p>0.5 THEN 1.0 ELSE 0.0 END)")} AS foreground, cast(NULL AS varchar) AS error FROM p GROUP BY id""",
)
def _(spark, d):
    """O242, O291: load cases to layouts of material by a model of the field model's contract (here a linear one)."""

    def load():
        def model(x):
            c = x.astype(float)
            return np.stack([c[:, 0] * 0.02, c[:, 1] * 0.01 + c[:, 2] * 0.005], 1)

        return model

    digits = lambda c: F.transform(c, lambda v: F.round(v, 6) + 0.0)
    meshes = imaging.field_lists(cases(spark, d), 16).select("id", "py", "px", digits("strain").alias("dx"), digits("load").alias("dy"), "volume")
    out = topology.mesh_layouts(meshes, load, 16)
    mean = F.expr("aggregate(probability, 0D, (s, p) -> s + p) / size(probability)")
    return rounded(out.select("id", "height", "width", mean.alias("mean"), "foreground", "error"), "mean", "foreground")
