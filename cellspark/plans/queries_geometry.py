"""Queries of the row-local geometry and the flagship plan, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels, ring, score
from ..operators import spatial
from ..sources.fixtures import CELLS_SQL, HULL_SQL, POINTS_SQL, cells_embed, cells_parts, points_parts
from . import enrich

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df, *names: str, digits: int = 6):
    """``df`` with these columns rounded; negative zero becomes zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


def r(expr: str, digits: int = 6) -> str:
    """DuckDB twin of ``rounded``."""
    return f"round({expr},{digits})+0.0"


@query("ring_area_perimeter", f"WITH {CELLS_SQL} SELECT slide_id, cell_id, {r('area')} AS area, {r('perimeter')} AS perimeter, {r('signed_area')} AS signed_area FROM g")
def _(spark, d):
    """O063, O066, O068: signed area, area, perimeter."""
    c = cells_embed(spark, d).select("slide_id", "cell_id", ring.area().alias("area"), ring.perimeter().alias("perimeter"), ring.signed_area().alias("signed_area"))
    return rounded(c, "area", "perimeter", "signed_area")


@query("ring_area_f32", f"WITH {CELLS_SQL} SELECT slide_id, cell_id, round(cast(cast(area AS float) AS double),3)+0.0 AS area FROM g")
def _(spark, d):
    """O067: single-precision area."""
    return cells_embed(spark, d).select("slide_id", "cell_id", (F.round(ring.area_f32().cast("double"), 3) + 0.0).alias("area"))


@query("ring_circularity", f"WITH {CELLS_SQL} SELECT slide_id, cell_id, {r('circularity')} AS circularity, {r('4*pi()*area/(perimeter*perimeter)')} AS unclamped FROM g")
def _(spark, d):
    """O069, O081: circularity, clamped and not."""
    a, p = ring.area(), ring.perimeter()
    return rounded(cells_embed(spark, d).select("slide_id", "cell_id", ring.circularity(a, p).alias("circularity"), ring.circularity(a, p, False).alias("unclamped")), "circularity", "unclamped")


@query("ring_centroid", f"WITH {CELLS_SQL} SELECT slide_id, cell_id, {r('centroid_x',4)} AS centroid_x, {r('centroid_y',4)} AS centroid_y, {r('mx')} AS mean_x, {r('my')} AS mean_y FROM g")
def _(spark, d):
    """O070, O079: area-weighted centroid and vertex mean."""
    cx, cy = ring.centroid()
    mx, my = ring.vertex_mean()
    c = cells_embed(spark, d).select("slide_id", "cell_id", cx.alias("centroid_x"), cy.alias("centroid_y"), mx.alias("mean_x"), my.alias("mean_y"))
    return rounded(rounded(c, "centroid_x", "centroid_y", digits=4), "mean_x", "mean_y")


@query("ring_eigen", f"WITH {CELLS_SQL} SELECT slide_id, cell_id, {r('l1')} AS l1, {r('l2')} AS l2, {r('eccentricity')} AS eccentricity, {r('CASE WHEN l1<=1e-18 THEN 0 ELSE 1-sqrt(greatest(0,l2)/l1) END')} AS ecc_linear, {r('CASE WHEN l2<=1e-18 THEN 1 ELSE greatest(1,l1/l2) END')} AS aspect_ratio FROM g")
def _(spark, d):
    """O071, O072, O073, O080: covariance eigenvalues and what follows from them."""
    s = enrich.shape(cells_embed(spark, d))
    s = s.select("slide_id", "cell_id", "l1", "l2", "eccentricity", ring.eccentricity_linear(F.col("l1"), F.col("l2")).alias("ecc_linear"), ring.aspect_ratio(F.col("l1"), F.col("l2")).alias("aspect_ratio"))
    return rounded(s, "l1", "l2", "eccentricity", "ecc_linear", "aspect_ratio")


_HU = """
m AS (SELECT slide_id, cell_id, sum(pow(x-mx,2))/pow(32,2) AS n20, sum(pow(y-my,2))/pow(32,2) AS n02, sum((x-mx)*(y-my))/pow(32,2) AS n11,
             sum(pow(x-mx,3))/pow(32,2.5) AS n30, sum(pow(y-my,3))/pow(32,2.5) AS n03, sum(pow(x-mx,2)*(y-my))/pow(32,2.5) AS n21, sum((x-mx)*pow(y-my,2))/pow(32,2.5) AS n12
      FROM v JOIN s USING (slide_id, cell_id) GROUP BY ALL),
o AS (SELECT *, n30+n12 AS a, n21+n03 AS b, n30-3*n12 AS c, 3*n21-n03 AS d FROM m),
h AS (SELECT slide_id, cell_id, n20+n02 AS h1, pow(n20-n02,2)+4*n11*n11 AS h2, c*c+d*d AS h3, a*a+b*b AS h4,
             c*a*(a*a-3*b*b)+d*b*(3*a*a-b*b) AS h5, (n20-n02)*(a*a-b*b)+4*n11*a*b AS h6, d*a*(a*a-3*b*b)-c*b*(3*a*a-b*b) AS h7 FROM o)
"""


@query("ring_hu_moments", f"WITH {CELLS_SQL}, {_HU} SELECT slide_id, cell_id, {', '.join(r(f'-log10(abs(h{i}))', 4) + f' AS hu{i}' for i in range(1, 8))} FROM h")
def _(spark, d):
    """O074: all seven Hu invariants."""
    c = cells_embed(spark, d).select("slide_id", "cell_id", ring.hu_moments().alias("h"))
    return rounded(c.select("slide_id", "cell_id", *[F.col("h")[i].alias(f"hu{i + 1}") for i in range(7)]), *[f"hu{i}" for i in range(1, 8)], digits=4)


@query("ring_bbox", f"WITH {CELLS_SQL} SELECT slide_id, cell_id, {r('x0')} AS x0, {r('y0')} AS y0, {r('x1')} AS x1, {r('y1')} AS y1 FROM g")
def _(spark, d):
    """O083: bounding box."""
    return rounded(cells_embed(spark, d).select("slide_id", "cell_id", ring.bbox().alias("b")).select("slide_id", "cell_id", "b.*"), "x0", "y0", "x1", "y1")


@query(
    "bbox_iou_pairs",
    f"""WITH {CELLS_SQL}, p AS (SELECT a.slide_id, a.cell_id AS a, b.cell_id AS b, greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS i,
    (a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0) AS t FROM g a JOIN g b ON a.slide_id=b.slide_id AND b.cell_id=a.cell_id+10)
    SELECT slide_id, a, b, {r('CASE WHEN t-i<=1e-12 THEN 0 ELSE i/(t-i) END')} AS iou FROM p""",
)
def _(spark, d):
    """O084, O085: overlap of the boxes of cells ten ids apart."""
    b = cells_embed(spark, d).select("slide_id", "cell_id", ring.bbox().alias("box"))
    p = b.toDF("slide_id", "a", "abox").join(b.toDF("slide_id", "b", "bbox").withColumn("a", F.col("b") - 10), ["slide_id", "a"])
    return rounded(p.select("slide_id", "a", "b", ring.iou("abox", "bbox").alias("iou")), "iou")


@query("box_from_center", f"WITH {POINTS_SQL} SELECT cell_id, least(greatest(centroid_x-12,0),900) AS x0, least(greatest(centroid_y-12,0),800) AS y0, least(greatest(centroid_x+12,0),900) AS x1, least(greatest(centroid_y+12,0),800) AS y1 FROM pts")
def _(spark, d):
    """O086: clamped square boxes."""
    return points_parts(spark, d).select("cell_id", ring.box_from_center(F.col("centroid_x"), F.col("centroid_y"), 12.0, 900, 800).alias("b")).select("cell_id", "b.*")


@query("ring_transforms", f"""WITH {CELLS_SQL}, t AS (SELECT slide_id, cell_id, sum(CASE WHEN i%2=0 THEN x END) AS even_x, sum(x+3) AS moved_x, sum(y-2) AS moved_y, abs(any_value(signed_area)) AS ccw_area FROM v JOIN s USING (slide_id, cell_id) GROUP BY ALL)
SELECT slide_id, cell_id, {r('even_x')} AS even_x, {r('moved_x')} AS moved_x, {r('moved_y')} AS moved_y, {r('ccw_area')} AS ccw_area FROM t""")
def _(spark, d):
    """O062, O065, O087: direction, every second vertex, translation."""
    c = cells_embed(spark, d).withColumns({"even": ring.every_second(), "moved": ring.shift("ring", "3D", "-2D"), "ccw": ring.counter_clockwise()})
    total = lambda n, c: F.expr(ring.total(f"transform({n}, p -> p.{c})"))
    return rounded(c.select("slide_id", "cell_id", total("even", "x").alias("even_x"), total("moved", "x").alias("moved_x"), total("moved", "y").alias("moved_y"), ring.signed_area("ccw").alias("ccw_area")), "even_x", "moved_x", "moved_y", "ccw_area")


@query(
    "ring_turning",
    f"""WITH {CELLS_SQL}, t AS (SELECT slide_id, cell_id, i, nx-x AS u, ny-y AS v FROM v), n AS (SELECT a.slide_id, a.cell_id, acos(greatest(-1,least(1,(a.u*b.u+a.v*b.v)/(sqrt(a.u*a.u+a.v*a.v)*sqrt(b.u*b.u+b.v*b.v))))) AS w
    FROM t a JOIN t b ON a.cell_id=b.cell_id AND b.i=(a.i+1)%32), q AS (SELECT slide_id, cell_id, avg(w) AS w FROM n GROUP BY ALL)
    SELECT slide_id, {r('avg(w)')} AS turning, {r('avg(circularity)')} AS compactness FROM q JOIN g USING (slide_id, cell_id) GROUP BY slide_id""",
)
def _(spark, d):
    """O088: mean turning and compactness by slide."""
    c = cells_embed(spark, d).select("slide_id", ring.turning().alias("t"), ring.circularity(ring.area(), ring.perimeter()).alias("c"))
    return rounded(c.groupBy("slide_id").agg(F.avg("t").alias("turning"), F.avg("c").alias("compactness")), "turning", "compactness")


@query("ring_from_centroid", "SELECT p_brand AS slide_id, p_partkey AS cell_id, round(64*sin(2*pi()/128)*p_size*p_size/4,5)+0.0 AS area, 128 AS vertices FROM part")
def _(spark, d):
    """O021, O022: regular rings of 128 vertices with the radius from the size attribute."""
    p = spark.read.parquet(f"{d}/part.parquet").withColumns({"attributes": F.create_map(F.lit("size"), F.col("p_size").cast("double")), "cx": (F.col("p_partkey") * 7919 % 1000).cast("double"), "cy": (F.col("p_partkey") * 104729 % 1000).cast("double")})
    p = p.withColumn("r", ring.radius()).withColumn("ring", ring.circle("cx", "cy", "r"))
    return p.select(F.col("p_brand").alias("slide_id"), F.col("p_partkey").alias("cell_id"), (F.round(ring.area(), 5) + 0.0).alias("area"), F.size("ring").alias("vertices"))


@query("radius_heuristic", f"""SELECT p_partkey AS cell_id, {r("CASE WHEN p_partkey%4=0 THEN p_size WHEN p_partkey%4=1 THEN p_size*0.5 WHEN p_partkey%4=2 THEN sqrt(p_size/pi()) ELSE 4 END")} AS radius FROM part""")
def _(spark, d):
    """O021: precedence of radius, diameter, area and the default."""
    p = spark.read.parquet(f"{d}/part.parquet")
    key = F.element_at(F.array(*map(F.lit, ("r", "diameter", "area", "other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return rounded(p.withColumn("attributes", F.create_map(key, F.col("p_size").cast("double"))).select(F.col("p_partkey").alias("cell_id"), ring.radius().alias("radius")), "radius")


@query("ring_digest", f"""WITH {CELLS_SQL} SELECT slide_id, cell_id, sha256(string_agg(format('{{:.3f}},{{:.3f}};', x, y), '' ORDER BY i) || '|') AS digest FROM v GROUP BY ALL""")
def _(spark, d):
    """O257 (and the form of O117): digest of formatted coordinates."""
    return cells_embed(spark, d).select("slide_id", "cell_id", ring.digest(digits=3, close="|").alias("digest"))


@query("ring_finite", "SELECT cast(label AS varchar) AS slide_id, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, d):
    """O113: rings with finite coordinates only."""
    return cells_embed(spark, d).where(ring.finite()).groupBy("slide_id").agg(F.count("*").alias("n"))


@query("ring_resample", "SELECT p_partkey AS cell_id, 64 AS vertices, round(p_size*p_size*0.125*32*sin(2*pi()/32),1)+0.0 AS area FROM part")
def _(spark, d):
    """O060, O061, O064: equal-arc resampling of 32-gons to 64 vertices keeps their area."""
    c = cells_parts(spark, d).withColumn("ring", kernels.resample(64)("ring"))
    return c.select("cell_id", F.size("ring").alias("vertices"), (F.round(ring.area(), 1) + 0.0).alias("area"))


_SOLID = """, pp AS (SELECT cell_id AS k, x, y FROM v), """ + HULL_SQL.format(t="pp", out="hh") + """, hs AS (SELECT k AS cell_id, sum(ax*byy-bx*ay)/2 AS ha, sum(sqrt((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay))) AS hp FROM hh GROUP BY k),
n AS (SELECT g.*, greatest(0,least(1,area/ha)) AS solidity, least(1,hp/perimeter) AS convexity, CASE WHEN l2<=1e-18 THEN 1 ELSE greatest(1,l1/l2) END AS aspect_ratio FROM g JOIN hs USING (cell_id))"""


@query("ring_hull", f"WITH {CELLS_SQL}{_SOLID} SELECT slide_id, cell_id, {r('solidity')} AS solidity, {r('convexity')} AS convexity, {r('aspect_ratio')} AS aspect_ratio FROM n")
def _(spark, d):
    """O075, O076: hull size, solidity and convexity of each ring."""
    return rounded(enrich.nodes(cells_embed(spark, d)).select("slide_id", "cell_id", "solidity", "convexity", "aspect_ratio"), "solidity", "convexity", "aspect_ratio")


@query(
    "slide_hull_corners",
    f"""WITH {POINTS_SQL}, d AS (SELECT DISTINCT slide_id, centroid_x AS x, centroid_y AS y FROM pts),
    e AS (SELECT a.slide_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM d a JOIN d b ON a.slide_id=b.slide_id AND (a.x<>b.x OR a.y<>b.y)),
    k AS (SELECT e.slide_id, ax, ay, bx, byy FROM e JOIN d ON d.slide_id=e.slide_id GROUP BY ALL
          HAVING bool_and((bx-ax)*(d.y-ay)-(byy-ay)*(d.x-ax) > 0 OR ((bx-ax)*(d.y-ay)-(byy-ay)*(d.x-ax) = 0 AND (d.x-ax)*(bx-ax)+(d.y-ay)*(byy-ay) BETWEEN 0 AND (bx-ax)*(bx-ax)+(byy-ay)*(byy-ay))))
    SELECT slide_id, count(*) AS corners, {r('sum(ax*byy-bx*ay)/2')} AS area FROM k GROUP BY slide_id""",
)
def _(spark, d):
    """O076, O222: hull of all centroids of a slide."""
    p = points_parts(spark, d).select("slide_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    return rounded(enrich.hulls(p).select("slide_id", F.size("hull").cast("long").alias("corners"), ring.signed_area("hull").alias("area")), "area")


@query("distance_to_hull", f"""WITH {POINTS_SQL} SELECT cell_id, {r("least(abs(centroid_x-100),1e18)")} AS dx, round(CASE WHEN centroid_x BETWEEN 100 AND 300 AND centroid_y BETWEEN 100 AND 300
   THEN least(centroid_x-100,300-centroid_x,centroid_y-100,300-centroid_y) ELSE sqrt(pow(greatest(100-centroid_x,0,centroid_x-300),2)+pow(greatest(100-centroid_y,0,centroid_y-300),2)) END,6)+0.0 AS d FROM pts""")
def _(spark, d):
    """O077, O078: distance to the edges of a square."""
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((100, 100), (300, 100), (300, 300), (100, 300))])
    p = points_parts(spark, d).withColumn("hull", corners)
    return rounded(p.select("cell_id", F.abs(F.col("centroid_x") - 100).alias("dx"), ring.distance_to_polygon("centroid_x", "centroid_y").alias("d")), "dx", "d")


KNN_SQL = """
pairs AS (SELECT a.slide_id, a.cell_id AS src, b.cell_id AS dst, (a.centroid_x-b.centroid_x)*(a.centroid_x-b.centroid_x)+(a.centroid_y-b.centroid_y)*(a.centroid_y-b.centroid_y) AS d2
          FROM {t} a JOIN {t} b ON a.slide_id=b.slide_id AND a.cell_id<>b.cell_id),
edges AS (SELECT slide_id, src, dst, sqrt(d2) AS d, row_number() OVER (PARTITION BY slide_id, src ORDER BY d2, dst) AS rank FROM pairs QUALIFY rank <= {k}),
knn AS (SELECT slide_id, src AS cell_id, avg(d) AS knn_density FROM edges GROUP BY ALL)
"""


@query("knn_edges", f"WITH {POINTS_SQL}, {KNN_SQL.format(t='pts', k=8)} SELECT slide_id, src, dst, rank, {r('d')} AS d FROM edges")
def _(spark, d):
    """O126, O127: directed neighbour edges."""
    return rounded(spatial.knn(points_parts(spark, d)), "d")


@query("knn_density", f"WITH {POINTS_SQL}, {KNN_SQL.format(t='pts', k=8)} SELECT slide_id, cell_id, {r('knn_density')} AS knn_density FROM knn")
def _(spark, d):
    """O125: mean distance to the eight nearest."""
    p = points_parts(spark, d)
    return rounded(spatial.knn_density(p, spatial.knn(p)).select("slide_id", "cell_id", "knn_density"), "knn_density")


@query("knn_density_grid", f"WITH {POINTS_SQL}, {KNN_SQL.format(t='pts', k=8)} SELECT slide_id, cell_id, {r('knn_density')} AS knn_density FROM knn")
def _(spark, d):
    """O125 over many leaves, as large slides have them."""
    p = points_parts(spark, d)
    return rounded(spatial.knn_density(p, spatial.knn(p, leaf=32)).select("slide_id", "cell_id", "knn_density"), "knn_density")


RBF_SQL = "rbf AS (SELECT p.slide_id, src AS cell_id, sum(exp(-d2/(2*sigma*sigma))) AS rbf FROM pairs p JOIN sig USING (slide_id) GROUP BY ALL)"


@query("rbf_field", f"WITH {POINTS_SQL}, {KNN_SQL.format(t='pts', k=8)}, sig AS (SELECT slide_id, greatest(quantile_cont(knn_density,0.5) FILTER (knn_density>0),1e-9) AS sigma FROM knn GROUP BY ALL), {RBF_SQL} SELECT slide_id, cell_id, {r('rbf')} AS rbf FROM rbf")
def _(spark, d):
    """O128, O142: Gaussian field with the median neighbour distance as sigma."""
    p = points_parts(spark, d)
    p = spatial.knn_density(p, spatial.knn(p))
    return rounded(spatial.rbf_field(p, enrich.medians(p).select("slide_id", "sigma")), "rbf")


@query("rbf_field_blocked", f"WITH {POINTS_SQL} SELECT a.slide_id, a.cell_id, {r('coalesce(sum(exp(-((a.centroid_x-b.centroid_x)*(a.centroid_x-b.centroid_x)+(a.centroid_y-b.centroid_y)*(a.centroid_y-b.centroid_y))/(2*50.0*50.0))),0)')} AS rbf FROM pts a LEFT JOIN pts b ON a.slide_id=b.slide_id AND a.cell_id<>b.cell_id GROUP BY ALL")
def _(spark, d):
    """O129: the field of all cells of each slide with a fixed sigma; the plan deals the blocks."""
    return rounded(spatial.rbf_field(points_parts(spark, d), 50.0), "rbf")


@query(
    "rbf_surface",
    f"""WITH {POINTS_SQL}, box AS (SELECT slide_id, min(centroid_x) x0, max(centroid_x) x1, min(centroid_y) y0, max(centroid_y) y1 FROM pts GROUP BY ALL),
    grid AS (SELECT *, x0+(i+0.5)*(x1-x0)/16 AS gx, y0+(j+0.5)*(y1-y0)/16 AS gy FROM box, (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j))
    SELECT slide_id, i, j, {r('sum(exp(-((gx-centroid_x)*(gx-centroid_x)+(gy-centroid_y)*(gy-centroid_y))/(2*40.0*40.0)))')} AS value FROM grid JOIN pts USING (slide_id) GROUP BY ALL""",
)
def _(spark, d):
    """O130: field over a grid."""
    return rounded(spatial.surface(points_parts(spark, d), 16, 40.0), "value")


SCORE_SQL = f"""WITH {CELLS_SQL}, {KNN_SQL.format(t='g', k=8)},
med AS (SELECT slide_id, count(*) AS n, quantile_cont(area,0.5) AS med_area, quantile_cont(knn_density,0.5) AS med_knn, greatest(quantile_cont(knn_density,0.5) FILTER (knn_density>0),1e-9) AS sigma FROM g JOIN knn USING (slide_id, cell_id) GROUP BY ALL),
sig AS (SELECT slide_id, sigma FROM med), {RBF_SQL},
f AS (SELECT g.slide_id, g.cell_id, area, circularity, eccentricity, centroid_x, centroid_y, knn_density, rbf/greatest(n-1,1) AS rbf, area/med_area AS ar, knn_density/med_knn AS kr, med_area
      FROM g JOIN knn USING (slide_id, cell_id) JOIN rbf USING (slide_id, cell_id) JOIN med USING (slide_id)),
sc AS (SELECT *, least(1,greatest(0,0.17*CASE WHEN ar<=1.08 THEN 0 ELSE least(1,greatest(0,(ar-1.08)/0.67)) END + 0.21*CASE WHEN circularity>=0.75 THEN 0 ELSE least(1,greatest(0,(0.75-circularity)/0.75)) END
      + 0.21*least(1,greatest(0,2.8*rbf)) + 0.17*CASE WHEN kr>=1 THEN 0 ELSE least(1,greatest(0,1.15*(1-kr))) END + 0.24*least(1,greatest(0,eccentricity)))) AS score,
      cast(area AS float) > cast(1.5 AS float)*cast(med_area AS float) AS gate FROM f)
"""


@query("enrich_scored", SCORE_SQL + f"SELECT slide_id, cell_id, {r('score')} AS score, {r('knn_density')} AS knn_density, {r('rbf')} AS rbf_risk_score, gate AS area_gate, CASE WHEN score>0.35 OR gate THEN 'Malignant' ELSE 'Normal' END AS clinical FROM sc")
def _(spark, d):
    """O110, O140-O142, O190-O197: neighbours, field, score, gate and label."""
    out = enrich.scored(cells_embed(spark, d)).select("slide_id", "cell_id", "score", "knn_density", "rbf_risk_score", "area_gate", "clinical")
    return rounded(out, "score", "knn_density", "rbf_risk_score")


_FLAG = ["area", "perimeter", "circularity", "eccentricity", "knn_density", "rbf_risk_score", "score", "distance_to_tumor_edge"]


@query(
    "enrich_flagship",
    SCORE_SQL + f""", lab AS (SELECT sc.*, g.perimeter, CASE WHEN score>0.35 OR gate THEN 'Malignant' ELSE 'Normal' END AS clinical FROM sc JOIN g USING (slide_id, cell_id)),
    bad AS (SELECT slide_id AS k, centroid_x AS x, centroid_y AS y FROM lab WHERE clinical='Malignant'), {HULL_SQL.format(t='bad', out='hh')},
    far AS (SELECT slide_id, cell_id, sqrt(min(pow(centroid_x-ax-t*(bx-ax),2)+pow(centroid_y-ay-t*(byy-ay),2))) AS dist FROM (SELECT *, greatest(0,least(1,((centroid_x-ax)*(bx-ax)+(centroid_y-ay)*(byy-ay))/((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay)))) AS t FROM lab JOIN hh ON k=slide_id) GROUP BY ALL),
    one AS (SELECT k, any_value(x) AS x, any_value(y) AS y FROM hh_d GROUP BY k HAVING count(*)=1)
    SELECT slide_id, cell_id, {r('area')} AS area, {r('perimeter')} AS perimeter, {r('circularity')} AS circularity, {r('eccentricity')} AS eccentricity, {r('knn_density')} AS knn_density, {r('rbf')} AS rbf_risk_score, {r('score')} AS score,
    {r('coalesce(dist, sqrt(pow(centroid_x-one.x,2)+pow(centroid_y-one.y,2)), 0)')} AS distance_to_tumor_edge, clinical FROM lab LEFT JOIN far USING (slide_id, cell_id) LEFT JOIN one ON one.k=slide_id""",
)
def _(spark, d):
    """O030, O261: the whole plan with the distance to the malignant hull."""
    out = enrich.enrich(cells_embed(spark, d))
    return rounded(out.select("slide_id", "cell_id", *_FLAG, "clinical"), *_FLAG)


@query(
    "score_components",
    """SELECT p_partkey AS id, round(least(1,greatest(0,CASE WHEN a<=1.08 THEN 0 ELSE (a-1.08)/0.67 END)),6)+0.0 AS area, round(least(1,greatest(0,CASE WHEN c>=0.75 THEN 0 ELSE (0.75-c)/0.75 END)),6)+0.0 AS circularity,
    round(least(1,greatest(0,2.8*c)),6)+0.0 AS rbf, round(CASE WHEN a>=1 THEN 0 ELSE least(1,1.15*(1-a)) END,6)+0.0 AS packing, round(least(1,greatest(0,c)),6)+0.0 AS eccentricity FROM (SELECT p_partkey, p_size/25.0 AS a, p_size/50.0 AS c FROM part)""",
)
def _(spark, d):
    """O192-O197: each component of the score."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 25.0).alias("a"), (F.col("p_size") / 50.0).alias("c"))
    a, c = F.col("a"), F.col("c")
    out = p.select("id", score.area_component(a).alias("area"), score.circularity_component(c).alias("circularity"), score.rbf_component(c).alias("rbf"), score.packing_component(a).alias("packing"), score.clamp01(c).alias("eccentricity"))
    return rounded(out, "area", "circularity", "rbf", "packing", "eccentricity")
