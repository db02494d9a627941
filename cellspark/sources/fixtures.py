"""Cells made from the engine's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ring


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores: a small file is one task, however much work hangs on each of its rows."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def cells_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_id, cell_id and a ring of 32 vertices from each embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pts = F.expr("transform(sequence(0, 31), i -> struct(cast(embedding[2 * i] AS double) AS x, cast(embedding[2 * i + 1] AS double) AS y))")
    return e.select(F.col("label").cast("string").alias("slide_id"), F.col("vec_id").alias("cell_id"), pts.alias("ring"))


def cells_parts(spark: SparkSession, sf_dir: str, vertices: int = 32) -> DataFrame:
    """slide_id (brand), cell_id and a regular ring for each part: radius p_size / 2 at a centre from the key."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_brand").alias("slide_id"), F.col("p_partkey").alias("cell_id"),
        (F.col("p_partkey") * 7919 % 1000).cast("double").alias("cx"), (F.col("p_partkey") * 104729 % 1000).cast("double").alias("cy"),
        (F.col("p_size") / 2).cast("double").alias("r"),
    )
    return spread(p).select("slide_id", "cell_id", ring.circle("cx", "cy", "r", vertices).alias("ring"))


def followers(cells: DataFrame) -> DataFrame:
    """slide_id, a, b, ra, rb: each cell's ring beside that of the next cell of its slide."""
    from pyspark.sql import Window

    after = Window.partitionBy("slide_id").orderBy("cell_id")
    out = cells.select("slide_id", F.col("cell_id").alias("a"), F.lead("cell_id").over(after).alias("b"), F.col("ring").alias("ra"), F.lead("ring").over(after).alias("rb"))
    return out.where("b IS NOT NULL")


def points_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid-only cells of the parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(
        F.col("p_brand").alias("slide_id"), F.col("p_partkey").alias("cell_id"), (F.col("p_partkey") * 7919 % 1000).cast("double").alias("centroid_x"),
        (F.col("p_partkey") * 104729 % 1000).cast("double").alias("centroid_y"), (F.pi() * F.col("p_size") * F.col("p_size") / 4).alias("area"),
    )


def points_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid-only cells of the line items: one slide for each shipping mode."""
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return p.select(
        F.col("l_shipmode").alias("slide_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cell_id"),
        (F.col("l_partkey") * 7919 % 100_003).cast("double").alias("centroid_x"), (F.col("l_orderkey") * 104_729 % 100_003).cast("double").alias("centroid_y"),
    )


#: DuckDB: cells, their edges (v: x, y to nx, ny) and per-cell sums (g) of ``cells_embed``.
CELLS_SQL = """
cells AS (SELECT cast(label AS varchar) AS slide_id, vec_id AS cell_id, embedding AS e FROM embeddings),
v AS (SELECT slide_id, cell_id, i, cast(e[2*i+1] AS double) AS x, cast(e[2*i+2] AS double) AS y,
             cast(e[2*((i+1)%32)+1] AS double) AS nx, cast(e[2*((i+1)%32)+2] AS double) AS ny
      FROM cells, (SELECT unnest(range(32)) AS i)),
s AS (SELECT slide_id, cell_id, 0.5*sum(x*ny-nx*y) AS signed_area, sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))) AS perimeter,
             avg(x) AS mx, avg(y) AS my, sum((x+nx)*(x*ny-nx*y)) AS sx, sum((y+ny)*(x*ny-nx*y)) AS sy,
             min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v GROUP BY ALL),
c AS (SELECT slide_id, cell_id, avg((x-mx)*(x-mx)) AS xx, avg((y-my)*(y-my)) AS yy, avg((x-mx)*(y-my)) AS xy
      FROM v JOIN s USING (slide_id, cell_id) GROUP BY ALL),
l AS (SELECT slide_id, cell_id, (xx+yy)/2 + sqrt(greatest((xx+yy)*(xx+yy)/4-(xx*yy-xy*xy),0)) AS l1,
             greatest((xx+yy)/2 - sqrt(greatest((xx+yy)*(xx+yy)/4-(xx*yy-xy*xy),0)),0) AS l2 FROM c),
g AS (SELECT s.*, l1, l2, abs(signed_area) AS area,
             CASE WHEN perimeter<=1e-18 THEN 0 ELSE least(1, 4*pi()*abs(signed_area)/(perimeter*perimeter)) END AS circularity,
             CASE WHEN abs(signed_area)<1e-18 THEN mx ELSE sx/(6*signed_area) END AS centroid_x,
             CASE WHEN abs(signed_area)<1e-18 THEN my ELSE sy/(6*signed_area) END AS centroid_y,
             CASE WHEN l1<=1e-18 THEN 0 ELSE sqrt(1-least(1,greatest(0,l2/l1))) END AS eccentricity
      FROM s JOIN l USING (slide_id, cell_id))
"""

#: DuckDB: points of ``points_parts``.
POINTS_SQL = """
pts AS (SELECT p_brand AS slide_id, p_partkey AS cell_id, cast(p_partkey*7919%1000 AS double) AS centroid_x,
               cast(p_partkey*104729%1000 AS double) AS centroid_y, pi()*p_size*p_size/4 AS area FROM part)
"""

_CELL_BODY = CELLS_SQL[CELLS_SQL.index("\ns AS (") :]

#: DuckDB: the same tables of ``cells_parts``.
PARTS_SQL = (
    """
v AS (SELECT p_brand AS slide_id, p_partkey AS cell_id, i, p_partkey*7919%1000+p_size/2*cos(2*pi()*i/32) AS x, p_partkey*104729%1000+p_size/2*sin(2*pi()*i/32) AS y,
             p_partkey*7919%1000+p_size/2*cos(2*pi()*((i+1)%32)/32) AS nx, p_partkey*104729%1000+p_size/2*sin(2*pi()*((i+1)%32)/32) AS ny
      FROM part, (SELECT unnest(range(32)) AS i)),"""
    + _CELL_BODY
)

#: DuckDB: a and b, each cell of ``cells_embed`` and the next one of its slide.
FOLLOW_SQL = "fo AS (SELECT slide_id, cell_id AS a, lead(cell_id) OVER (PARTITION BY slide_id ORDER BY cell_id) AS b FROM cells QUALIFY b IS NOT NULL)"

#: DuckDB: edges (ax, ay to bx, byy) of the hull of the points (k, x, y) of a table, in counter-clockwise direction.
HULL_SQL = """
{out}_d AS (SELECT DISTINCT k, x, y FROM {t}),
{out} AS (SELECT e.k, ax, ay, bx, byy FROM (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM {out}_d a JOIN {out}_d b ON a.k=b.k AND (a.x<>b.x OR a.y<>b.y)) e JOIN {out}_d d ON d.k=e.k GROUP BY ALL
    HAVING bool_and((bx-ax)*(d.y-ay)-(byy-ay)*(d.x-ax) > 0 OR ((d.x=ax AND d.y=ay) OR (d.x=bx AND d.y=byy)) OR ((bx-ax)*(d.y-ay)-(byy-ay)*(d.x-ax) = 0 AND (d.x-ax)*(bx-ax)+(d.y-ay)*(byy-ay) BETWEEN 0 AND (bx-ax)*(bx-ax)+(byy-ay)*(byy-ay))))
"""

#: DuckDB: squared distance of (px, py) to the segment (ax, ay) to (bx, byy).
SEGMENT_SQL = "(SELECT pow(px-ax-t*(bx-ax),2)+pow(py-ay-t*(byy-ay),2) FROM (SELECT greatest(0,least(1,((px-ax)*(bx-ax)+(py-ay)*(byy-ay))/((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay)))) AS t))"
